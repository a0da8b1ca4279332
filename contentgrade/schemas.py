"""Table schemas."""

from pyspark.sql import types as T

FETCHES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("html", T.StringType()),
        T.StructField("fetched_at", T.DoubleType()),
        T.StructField("referer", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("depth", T.IntegerType()),
    ]
)

ROBOTS = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("body", T.StringType()),
    ]
)
