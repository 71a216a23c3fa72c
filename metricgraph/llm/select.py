"""Selection and ranking by a composite key (score descending, row_key ascending) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricgraph.llm.common import discard, parallelism, stored

#: Pivots of a round: the keys that are left shrink to about one in PIVOTS.
PIVOTS = 31


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS, seed: int = 0) -> tuple[int, int] | None:
    """The k-th of keys(score, row_key), by descending score and ascending row_key; None if there are fewer than k.

    Keys are distinct and not null. Quickselect: a round draws random keys as pivots, counts in one aggregate, exactly,
    how many keys lie before, at and between them, and goes on with the keys between two pivots, which it writes. The
    driver holds `pivots` keys and two counts for each. No key is sorted but the pivots.
    """
    if k < 1:
        return None
    left, turn = keys.select((-F.col("score")).alias("low"), "row_key"), 0
    while True:
        drawn = left.orderBy(F.xxhash64("row_key", F.lit(seed), F.lit(turn)), "row_key").limit(pivots).collect()
        cuts = sorted((r["low"], r["row_key"]) for r in drawn)
        if not cuts:
            return None
        key, at = F.struct("low", "row_key"), F.from_json(F.lit(str([{"low": a, "row_key": b} for a, b in cuts]).replace("'", '"')), "array<struct<low:bigint,row_key:bigint>>")
        placed = left.withColumn("gap", F.size(F.filter(at, lambda c: c < key))).withColumn("on", F.array_contains(at, key))
        counts = {(r["gap"], r["on"]): r["count"] for r in placed.groupBy("gap", "on").count().collect()}
        before = 0
        for gap in range(len(cuts) + 1):
            between, on = counts.get((gap, False), 0), counts.get((gap, True), 0)
            if k <= before + between:
                break
            if k <= before + between + on:
                return -cuts[gap][0], cuts[gap][1]
            before += between + on
        else:
            return None
        old, left = left, stored(placed.filter((F.col("gap") == gap) & ~F.col("on")).select("low", "row_key"), "selection")
        if turn:
            discard(old)
        k, turn = k - before, turn + 1


def ranked(rows: DataFrame) -> DataFrame:
    """rows(score, row_key, ...) with rank 1, 2, 3 ... by descending score and ascending row_key, sorted in ranges.

    A range adds the sizes of those before it; the driver holds one number for each range.
    """
    order = F.col("score").desc(), F.col("row_key").asc()
    ranges = stored(rows.repartitionByRange(parallelism(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())
    before, found = {}, 0
    for part, n in sizes:
        before[part], found = found, found + n
    shift = rows.sparkSession.createDataFrame(list(before.items()), "_range int, _before long")
    inside = ranges.selectExpr("*", "row_number() over (partition by _range order by score desc, row_key) as _place")
    return inside.join(F.broadcast(shift), "_range").withColumn("rank", F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")
