"""Record types of the keyed tables, and how the shared test tables are mapped onto them."""

from pyspark.sql import types as T

PRODUCT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("price", T.DoubleType()),
    ]
)
TASK = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("priority", T.StringType()),
        T.StructField("completed", T.BooleanType()),
    ]
)
ORDER = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.DecimalType(20, 0)),
        T.StructField("side", T.StringType()),
        T.StructField("price", T.DecimalType(20, 0)),
        T.StructField("quantity", T.DecimalType(20, 0)),
    ]
)
HEADERS = T.MapType(T.StringType(), T.StringType())
