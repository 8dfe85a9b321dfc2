"""The one record of a changelog, and what makes a batch of them valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: key, value, delete marker, time in ms; seq orders the changes of a run.
CHANGE = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.BinaryType(), False),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)


def normalised(changes: DataFrame) -> DataFrame:
    """``changes`` with the columns of CHANGE; a null or empty key raises when the rows are read.

    A null value is an empty one, which isn't the same as a missing key; a
    delete carries no value. Missing columns get defaults: tombstone false, ts 0.
    """
    have = changes.columns
    key = F.when(F.length("key") > 0, F.col("key")).otherwise(F.raise_error(F.lit("a key must not be null or empty")).cast("string"))
    dead = F.coalesce(F.col("tombstone"), F.lit(False)) if "tombstone" in have else F.lit(False)
    value = F.when(~dead, F.col("value").cast("binary")) if "value" in have else F.lit(None).cast("binary")
    ts = F.coalesce(F.col("ts").cast("long"), F.lit(0).cast("long")) if "ts" in have else F.lit(0).cast("long")
    return changes.select(key.alias("key"), F.coalesce(value, F.lit(b"")).alias("value"), dead.alias("tombstone"), ts.alias("ts"), F.col("seq").cast("long").alias("seq"))
