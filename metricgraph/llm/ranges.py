"""Range partitions with splitters of our own: chosen once from the data, known to both sides of each boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_splitters(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 ascending values of an integer column, nulls apart, that cut its rows about evenly.

    Each is a value of the column itself. The driver holds one number for each partition.
    """
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, at, max(10_000, 20 * parts)).alias("q")).first()["q"]
    return sorted(set(found or []))


def part_of(key: Column, splitters: list[int], step: int = 64) -> Column:
    """How many of the ascending splitters are at or below a key: every step-th one is counted, then those of one step."""
    if not splitters:
        return F.lit(0)
    every, coarse = F.array(*map(F.lit, splitters)), F.array(*map(F.lit, splitters[::step]))
    steps = F.size(F.filter(coarse, lambda t: t <= key))
    inside = F.size(F.filter(F.slice(every, F.greatest(steps - 1, F.lit(0)) * step + 1, F.lit(step)), lambda t: t <= key))
    return F.when(steps == 0, 0).otherwise((steps - 1) * step + inside)
