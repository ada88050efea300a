"""All reference queries and their SQL."""

from lumenforge.plans import aggregates, commute_plans, date_plans, domain, fielded_plans, filters, joins, merges, prerequisite_plans, queue_plans, recommend_plans, requirement_pages, requirement_plans, search_plans, section_plans, series, sources_plans, streams, writer_plans  # noqa: F401
from lumenforge.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
