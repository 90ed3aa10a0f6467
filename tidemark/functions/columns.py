"""Column expressions that statistics are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def kind(t: T.DataType) -> str:
    """Family of a type, as statistics see it."""
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(t, T.DecimalType):
        return "decimal"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(t, T.StringType):
        return "string"
    return "binary" if isinstance(t, T.BinaryType) else "other"


def ordinal(c: Column, t: T.DataType) -> Column:
    """An order-preserving long (not strictly); null for null, NaN and nested values."""
    k = kind(t)
    if k in ("bool", "int"):
        return c.cast("int").cast("long") if k == "bool" else c.cast("long")
    if k == "float":
        return F.when(~F.isnan(c), F.floor(c.cast("double"))).cast("long")
    if k == "decimal":
        low, high = F.lit(-(2**63)).cast("decimal(20,0)"), F.lit(2**63 - 1).cast("decimal(20,0)")
        return F.when(c.isNotNull(), F.least(F.greatest(F.floor(c), low), high)).cast("long")
    if k == "date":
        return F.unix_date(c).cast("long")
    if k == "timestamp":
        return F.unix_micros(c.cast("timestamp"))
    if k in ("string", "binary"):
        raw = F.encode(c, "UTF-8") if k == "string" else c
        return F.conv(F.rpad(F.hex(F.substring(raw, 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.lit(None).cast("long")


def canonical(c: Column, t: T.DataType) -> Column:
    """The text that identifies a value in every engine."""
    k = kind(t)
    if k == "float":
        return c.cast("decimal(38,6)").cast("string")
    if k == "timestamp":
        return F.unix_micros(c.cast("timestamp")).cast("string")
    return F.lower(F.hex(c)) if k == "binary" else c.cast("string")


def hash64(c: Column, t: T.DataType, method: str = "xxhash64") -> Column:
    """A signed long whose 64 bits are a hash of the value; null for null. ``md5``
    takes the first half of the digest of the canonical text, which other engines
    can repeat; ``xxhash64`` is several times as fast."""
    if method == "md5":
        return F.conv(F.substring(F.md5(canonical(c, t).cast("binary")), 1, 16), 16, -10).cast("long")
    if method != "xxhash64":
        raise ValueError(f"unknown hash {method!r}")
    return F.when(c.isNotNull(), F.xxhash64(c))


def digest8(c: Column, t: T.DataType) -> Column:
    """The eight bytes of ``hash64`` by ``md5``."""
    return F.unhex(F.substring(F.md5(canonical(c, t).cast("binary")), 1, 16))


def first7(c: Column, t: T.DataType) -> Column:
    """The seven bytes that are the ordinal of text or bytes, as one number."""
    return F.rpad(F.substring(F.encode(c, "UTF-8") if kind(t) == "string" else c, 1, 7), 7, F.lit(b"\0"))


def unsigned(c: Column) -> Column:
    """A long's bits as an unsigned decimal(20,0)."""
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, d + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def shortened(c: Column, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis where there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def value_bytes(c: Column, t: T.DataType) -> Column:
    """Uncompressed bytes of a value of a type of varying length."""
    if kind(t) in ("string", "binary"):
        return F.octet_length(c).cast("long")
    if isinstance(t, T.ArrayType) and type(t.elementType) in FIXED:
        return (F.greatest(F.size(c), F.lit(0)) * FIXED[type(t.elementType)]).cast("long")
    return F.octet_length(F.to_json(F.struct(c))).cast("long")


def varies(t: T.DataType) -> bool:
    return type(t) not in FIXED and not isinstance(t, T.DecimalType)


def logical_bytes(n: Column, values: Column, t: T.DataType) -> Column:
    """Uncompressed bytes of a column of ``n`` rows, its values of varying length making
    up ``values`` (offsets of 4 bytes for these, validity bits not counted)."""
    if varies(t):
        return (F.coalesce(values, F.lit(0)) + 4 * (n + 1)).cast("long")
    return (n * FIXED.get(type(t), 16)).cast("long")


def bin_index(v: Column, low: Column, high: Column, bins: int = 32) -> Column:
    """Bin of a value; the last bin holds the maximum alone."""
    share = (v.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(share * (bins - 1)))).cast("int")
