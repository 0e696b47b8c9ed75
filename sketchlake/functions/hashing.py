"""The context hash as column arithmetic, inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The seed and the multipliers of the 64-bit finaliser.
SEED = 0x9E3779B97F4A7C15
GOLDEN = 0x9E3779B97F4A7C15
FIRST, SECOND = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Object bits of the default layout; the hash keeps the other 44 of 64.
OBJECT_BITS = 20


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Integer arithmetic of frames built within wraps modulo 2**64; the session's setting returns afterwards.

    A frame keeps the arithmetic it was analysed with, so only its construction
    must lie within.
    """
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def mix64(x: Column) -> Column:
    x = x + F.lit(_signed(GOLDEN))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 30)) * F.lit(_signed(FIRST))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 27)) * F.lit(_signed(SECOND))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 31))


def context_hash(context: Column, object_bits: int = OBJECT_BITS) -> Column:
    """The hash of a context, of 64 - object_bits bits (non-negative unless object_bits is 0). Build it within ``wrapping``."""
    mixed = mix64(context.cast("long").bitwiseXOR(F.lit(_signed(SEED))))
    return F.shiftrightunsigned(mixed, object_bits) if object_bits else mixed


def hash_contexts(frame: DataFrame, context: str, name: str = "hctx", object_bits: int = OBJECT_BITS) -> DataFrame:
    with wrapping(frame.sparkSession):
        return frame.withColumn(name, context_hash(F.col(context), object_bits))
