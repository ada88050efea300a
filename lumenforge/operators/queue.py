"""A queue of jobs to fetch, in batches: specs planned and outcomes reported, each batch one join on the job's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiers by urgency, with seconds between fetches; the spread around them, the shortest and longest waits and the most doublings.
TIERS = {"baseline": 3600, "hot": 120, "registration": 30}
JITTER, SHORTEST, LONGEST, DOUBLINGS = 0.25, 5, 86_400, 6


def tier_rank(tier: Column) -> Column:
    """Urgency from 0; unknown tiers and null count as the least urgent."""
    return F.greatest(F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier), F.lit(1)), F.lit(1)) - 1


def wait_seconds(tier: Column, doublings: Column, share: Column) -> Column:
    """Whole seconds until a tier's next fetch: its interval doubled so often, ``share`` (0 to 1) placing it within the spread, LONGEST at most."""
    base = F.element_at(F.array(*[F.lit(s) for s in TIERS.values()]), (tier_rank(tier) + 1).cast("int"))
    return F.least(F.greatest(F.floor(base * F.pow(F.lit(2.0), doublings) * (1 - JITTER + 2 * JITTER * share)), F.lit(SHORTEST)), F.lit(LONGEST)).cast("long")


def _after(now: Column, seconds: Column) -> Column:
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def enqueued(jobs: DataFrame, specs: DataFrame, key: str, now: Column, share: Column) -> DataFrame:
    """(key, url, tier, next_fetch_at, inserted) of all jobs after a batch of specs.

    ``jobs`` (key, url, tier, next_fetch_at) with distinct keys; ``specs`` (key, url, tier, due_now, next_at), of which the most urgent of a
    key counts, then the smallest url. A new job is due at ``next_at``, now, or after its tier's wait. One that stands takes the spec's url and
    tier; it moves only where the spec is due now, or forward where its tier rose. ``share`` is a column of the key. ``inserted`` is null for
    jobs without a spec. Specs with a null key are ignored.
    """
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(tier_rank(F.col("tier"))), "url", F.desc("due_now"), "next_at"))
    s = specs.where(F.col(key).isNotNull()).withColumn("_n", best).where("_n = 1")
    s = s.select(key, F.struct("url", "tier", F.coalesce("due_now", F.lit(False)).alias("due_now"), "next_at").alias("s"))
    rows = jobs.select(key, F.struct("url", "tier", "next_fetch_at").alias("j")).join(s, key, "full")
    new, spec, job = F.col("j").isNull(), F.col("s"), F.col("j")
    waits = _after(now, wait_seconds(spec["tier"], F.lit(0), share))
    due = F.when(spec.isNull(), job["next_fetch_at"]).when(spec["due_now"] | new, F.coalesce(spec["next_at"], F.when(spec["due_now"], now).otherwise(waits)))
    due = due.when(tier_rank(spec["tier"]) > tier_rank(job["tier"]), F.least(job["next_fetch_at"], waits)).otherwise(job["next_fetch_at"])
    said = lambda c: F.when(spec.isNull(), job[c]).otherwise(spec[c]).alias(c)
    return rows.select(key, said("url"), said("tier"), due.alias("next_fetch_at"), F.when(spec.isNotNull(), new).alias("inserted"))


def completed(jobs: DataFrame, outcomes: DataFrame, key: str, now: Column, share: Column, trusted: bool = False) -> DataFrame:
    """(key, tier, next_fetch_at, last_ok_at, failures, last_error, lease_token, accepted) of all jobs after a batch of outcomes.

    ``jobs`` has these columns but the last; ``outcomes`` (key, ok, lease_token, error, next_at). An outcome counts where its token is the
    job's lease (any does where ``trusted``), of several the smallest by ok, error and next_at, as the first one ends the lease. Success clears the failures;
    a failure (null ok is one) waits twice as long for each one before it, up to DOUBLINGS. ``next_at`` overrules. The lease ends. ``accepted``
    is null for jobs without an outcome and false for those whose outcomes show no lease; these stay as they are.
    """
    o = outcomes.where(F.col(key).isNotNull()).select(key, F.struct(F.coalesce("ok", F.lit(False)).alias("ok"), "error", "next_at", "lease_token").alias("o"))
    held = jobs.join(o, key, "left").withColumn("_ok", F.when(F.col("o").isNotNull(), F.lit(trusted) | F.coalesce(F.col("o.lease_token") == F.col("lease_token"), F.lit(False))))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("_ok"), "o.ok", "o.error", "o.next_at"))
    r = held.withColumn("_n", best).where("_n = 1")
    mine, good = F.coalesce(F.col("_ok"), F.lit(False)), F.col("o.ok")
    times = F.when(good, 0).otherwise(F.least(F.col("failures"), F.lit(DOUBLINGS)))
    due = F.coalesce(F.col("o.next_at"), _after(now, wait_seconds(F.col("tier"), times, share)))
    changed = lambda c, to: F.when(mine, to).otherwise(F.col(c)).alias(c)
    return r.select(
        key, "tier", changed("next_fetch_at", due), F.when(mine & good, now).otherwise(F.col("last_ok_at")).alias("last_ok_at"),
        changed("failures", F.when(good, F.lit(0)).otherwise(F.col("failures") + 1)), changed("last_error", F.when(~good, F.left(F.coalesce("o.error", F.lit("unspecified")), F.lit(2000)))),
        changed("lease_token", F.lit(None)), F.col("_ok").alias("accepted"),
    )
