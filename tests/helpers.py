"""Small helpers of the tests."""


def value(spark, column):
    """Evaluate one column expression."""
    return spark.range(1).select(column.alias("v")).first()["v"]
