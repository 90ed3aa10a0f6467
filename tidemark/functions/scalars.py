"""Small scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: Column) -> Column:
    """The number that a text is, as a double; null if it is none. Whole numbers are
    read exactly before they are widened."""
    bare = F.trim(text)
    return F.coalesce(bare.try_cast("bigint").cast("double"), bare.try_cast("double"))


def decode_bound(raw: Column) -> Column:
    """Text of a binary bound, without the 0xFF bytes that may fill it up."""
    return F.decode(F.unhex(F.regexp_replace(F.hex(raw), "(FF)+$", "")), "UTF-8")


def linspace(low: Column, high: Column, parts: int) -> Column:
    """The edges of equal parts of a range, both ends included."""
    step = (high - low) / F.lit(float(parts))
    return F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda i: F.when(i == parts, high).otherwise(low + step * i.cast("double")))


def split_name(name: Column) -> Column:
    """struct<collection,name> of a dotted name; nulls if it hasn't exactly one dot."""
    parts = F.split(name, "\\.")
    ok = F.size(parts) == 2
    return F.struct(F.when(ok, parts[0]).alias("collection"), F.when(ok, F.try_element_at(parts, F.lit(2))).alias("name"))


def hex_json(row: Column, binary: list[str], plain: list[str]) -> Column:
    """Fields of a struct as a JSON object, the binary ones as hex text."""
    return F.to_json(F.struct(*[F.lower(F.hex(row[c])).alias(c) for c in binary], *[row[c].alias(c) for c in plain]))
