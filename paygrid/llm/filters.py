"""A bitmap that spares a large table the shuffle of rows no join wants.

``BITS`` bits in buckets of 32,768 (4 KB each) are built by grouped
aggregation and broadcast: at most ``BITS / 8`` bytes whatever the data.  Rows
whose key bit is not set have no partner; those that pass by chance are
dropped by the join that follows.  When the bits fill up, more rows pass and
the plan becomes the plain join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
BUCKET = 32_768


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bitmap_of(keys: DataFrame, key: str) -> DataFrame:
    """``(_bucket, _bits)`` of all values of ``key``, null included."""
    bit = _bit(F.col(key))
    return keys.select((bit / BUCKET).cast("int").alias("_bucket"), (bit % BUCKET).alias("_at")).groupBy("_bucket").agg(
        F.bitmap_construct_agg("_at").alias("_bits"))


def may_hold(df: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be one of those in the bitmap."""
    bit = _bit(F.col(f"`{key}`"))
    at = F.pmod(bit, F.lit(BUCKET)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    return df.join(F.broadcast(bitmap), (bit / BUCKET).cast("int") == F.col("_bucket")).where(held).drop("_bucket", "_bits")
