"""Operators for large training-data pipelines, on Spark DataFrames.

Nothing outside this subpackage imports it. ``queries`` registers one query for
each operator; the modules hold the operators themselves.
"""
