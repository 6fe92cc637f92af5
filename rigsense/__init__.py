"""Device-fleet telemetry analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame, so it can be
chained with ``df.transform``; nothing runs until an action is called, except
where a docstring says that a small, bounded statistic is collected first.
"""
