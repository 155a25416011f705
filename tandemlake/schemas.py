"""Schemas of the canonical tables."""

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType


def _fields(*pairs):
    return StructType([StructField(n, t) for n, t in pairs])


DAY_LAKE = _fields(
    ("datetime", TimestampNTZType()), ("ticker", StringType()), ("id", StringType()), ("close", DoubleType()), ("close_split", DoubleType()),
    ("close_tr", DoubleType()), ("volume_split", DoubleType()), ("tr_price_factor", DoubleType()),
)
MINUTE_LAKE = _fields(("datetime", TimestampNTZType()), ("ticker", StringType()), ("close_tr", DoubleType()), ("close_split", DoubleType()), ("close", DoubleType()), ("volume", LongType()))
BARS = _fields(("ticker", StringType()), ("ts", TimestampNTZType()), ("close", DoubleType()), ("raw_close", DoubleType()), ("volume", DoubleType()), ("dollar_volume", DoubleType()), ("id", StringType()))
