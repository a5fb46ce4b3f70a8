"""The row of a sequencing read."""

from pyspark.sql import types as T

READS = T.StructType(
    [
        T.StructField("file_name", T.StringType(), False),
        T.StructField("read_idx", T.LongType(), False),  # 0-based place in the file; Spark keeps no order
        T.StructField("id", T.StringType()),
        T.StructField("sequence", T.StringType()),
        T.StructField("quality", T.StringType()),
        T.StructField("colorspace", T.StringType()),
        T.StructField("is_filtered", T.BooleanType()),
    ]
)
