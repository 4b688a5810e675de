"""Cleaning, profiling and quality checks for Spark tables.

Every cleaning step is ``f(df, **config) -> DataFrame``.  Steps that depend on a
statistic of the whole table measure it first (one bounded row per column comes
back to the driver, as with ``pyspark.ml`` estimators) and then apply it as
literals, so that the resulting plan stays a plain projection or filter.
"""
