"""Equi-join of many rows with a table of distinct keys, safe against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A lookup table of up to this many rows is broadcast (about 16 MB at 80 bytes a row).
BROADCAST_ROWS = 200_000
#: A key that holds more than 1/HOT of all rows is hot; there are fewer than HOT such keys.
HOT = 2_000


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    weight: str,
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``left`` with ``right``, which has one row a key and in ``weight``
    the number of rows of ``left`` that carry the key.

    ``right`` should be materialised: it is counted. Up to ``broadcast_rows``
    it is broadcast. Beyond, only the keys that hold over 1/HOT of the weight
    are (fewer than HOT by the pigeonhole principle); every other key is bounded
    and is joined through a shuffle. Rows with a null key match nothing.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    total = right.agg(F.count("*").alias("n"), F.sum(weight).alias("w")).first()
    if total["n"] <= broadcast_rows:
        return left.join(F.broadcast(right), on, how)
    hot = F.broadcast(right.filter(F.col(weight) > total["w"] / HOT))
    cold = right.filter(~(F.col(weight) > total["w"] / HOT))
    rest = left.join(hot.select(*on), on, "left_anti")
    return left.join(hot, on, "inner").unionByName(rest.join(cold.hint("shuffle_merge"), on, how))
