"""Feature hashing of tokens with MD5, identical in Spark and plain SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_bucket(token: Column, dim: int, hashed: bool = False) -> Column:
    """Bucket = first 32 bits of md5(token) modulo ``dim`` (``hashed``: the
    column already holds the hex digest)."""
    h = token if hashed else F.md5(token)
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(dim)).cast("int")


def md5_sign(token: Column, hashed: bool = False) -> Column:
    """+1 or -1 from the 9th hex digit of md5(token)."""
    h = token if hashed else F.md5(token)
    return F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
