"""op12: the k greatest inner products of query vectors with all vectors, exactly, over buckets of similar length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricgraph.llm.common import discard, stored

#: Components that the vectors of a bucket and those of a block of queries have in all: 4 and 8 MB of doubles.
BUCKET_VALUES, QUERY_VALUES = 1 << 19, 1 << 20
#: From this local cosine on, sorted lists of coordinates choose the candidates, below it lengths do.
COORDINATES_FROM = 0.3
#: Coordinates of a query, its largest, whose lists are looked at.
FOCUS = 3
#: Stands for a query that has not found k products yet.
NOTHING = -(2**63)
#: Bounds are widened by this share, more than doubles can be wrong by.
SLACK = 1e-9


class Bucket:
    """Vectors of similar length, longest first, with the sorted list of a coordinate made at its first use."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.keys, self.vectors, self.norms = keys[order], vectors[order], norms[order]
        self.exact = self.vectors.astype(float)
        self.largest = float(np.abs(self.exact).max(initial=0.0))
        self.unit = self.exact / np.maximum(self.norms, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.looked = 0

    def products(self, query: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        """Exact integers: in doubles while no sum can reach 2^53, else in Python's integers, which must end within 64 bits."""
        if self.largest * float(np.abs(query).max(initial=0)) * len(query) < 2**53:
            return (self.exact[rows] @ query.astype(float)).astype(np.int64)
        return (self.vectors[rows].astype(object) @ query.astype(object)).astype(np.int64)

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, query: np.ndarray, theta: float) -> np.ndarray | slice:
        """Rows that may reach theta: all whose length and focus coordinates allow it.

        A vector whose product reaches theta has a cosine of theta / (|q| |p|) at least, so of theta / (|q| longest). For a
        query of unit length with the coordinate x, a unit vector with the cosine c or more has a coordinate within
        c x -+ sqrt((1 - c^2) (1 - x^2)); where that interval passes x beyond the cosine's reach it ends at 1 or -1.
        """
        size = float(np.sqrt((query.astype(float) ** 2).sum()))
        if theta <= 0 or size == 0.0:
            return slice(None)
        cosine = theta / (size * self.norms[0]) * (1 - SLACK) if self.norms[0] > 0 else np.inf
        if cosine > 1:
            return slice(0, 0)
        if cosine < COORDINATES_FROM:
            return slice(0, int(np.searchsorted(-self.norms, -theta / size * (1 - SLACK), "right")))
        unit = query / size
        best, spans = None, []
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            x = float(unit[f])
            spread = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - x * x)))
            low, high = (cosine * x - spread if x > -cosine else -1.0) - SLACK, (cosine * x + spread if x < cosine else 1.0) + SLACK
            order, values = self._list(int(f))
            at, to = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            spans.append((int(f), low, high))
            if best is None or to - at < len(best):
                best = order[at:to]
        for f, low, high in spans:
            best = best[(self.unit[best, f] >= low) & (self.unit[best, f] <= high)]
        return best[self.norms[best] * size >= theta * (1 - SLACK)]

    def top(self, query: np.ndarray, own: int, k: int, theta: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(keys, products) of the k best rows but the query's own, ties to the smaller key; those below theta may be left out."""
        rows = slice(None) if theta is None else self.candidates(query, theta)
        keys, found = self.keys[rows], self.products(query, rows)
        self.looked += len(keys)
        held = keys != own
        if theta is not None:
            held &= found >= theta
        keys, found = keys[held], found[held]
        best = np.lexsort((keys, -found))[:k]
        return keys[best], found[best]


def _meet(queries: DataFrame, buckets: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query, row_key, score): the k best of each (query, bucket) of queries(row_key, vector, theta, bucket) and
    buckets(row_key, vector, bucket). A block of queries meets a bucket in one task."""
    own = F.pmod(F.xxhash64("row_key"), F.lit(blocks)).cast("int")
    asked = queries.select(F.lit(True).alias("asks"), "row_key", "vector", "theta", "bucket", own.alias("block"))
    spread = buckets.select(F.lit(False).alias("asks"), "row_key", "vector", F.lit(NOTHING).alias("theta"), "bucket", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def meet(met: pd.DataFrame) -> pd.DataFrame:
        q, p = met[met["asks"]], met[~met["asks"]]
        out = []
        if len(q) and len(p):
            bucket = Bucket(p["row_key"].to_numpy(), np.stack(p["vector"]))
            for key, vector, theta in zip(q["row_key"], q["vector"], q["theta"], strict=True):
                keys, found = bucket.top(vector, key, k, None if theta == NOTHING else int(theta))
                out.append(pd.DataFrame({"query": key, "row_key": keys, "score": found}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "row_key": [], "score": []}, dtype="int64")

    return asked.union(spread).groupBy("bucket", "block").applyInPandas(meet, "query long, row_key long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.selectExpr("*", "row_number() over (partition by query order by score desc, row_key) as rank").filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, asks: Column, k: int = 5, scale: float = 256.0, bucket_values: int = BUCKET_VALUES, query_values: int = QUERY_VALUES) -> DataFrame:
    """The k greatest integer inner products of each query of vectors(vec_id, embedding) with all other rows.

    Returns query_id, rank (from 1), vec_id, score; ties to the smaller vec_id. asks says which rows are queries; each
    component x counts as floor(scale x), x as double.

    Rows are dealt by length into buckets of about bucket_values components, longest first. Every query first meets the
    first bucket; the k-th product found there is the least that it needs. It goes on to those buckets only whose longest
    vector could reach that, where its local cosine chooses between the bucket's lengths and its sorted coordinates to leave
    vectors out; what remains is multiplied exactly. Bounds are rounded outward, so nothing is lost.
    Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as padded with zeros.
    Repeated vec_ids are rows of their own, null ids are never asked by a null condition and come first in ties. Products
    must fit 64 bits. An empty table gives no rows; other columns are not read.
    """
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", F.coalesce(asks, F.lit(False)).alias("asks"), "embedding").filter(sound)
    rows = rows.select("vec_id", "asks", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))
    if rows.groupBy("vec_id").count().filter("count > 1 or vec_id is null").isEmpty():
        rows = rows.withColumn("row_key", F.col("vec_id").cast("long"))
    else:
        rows = rows.orderBy(F.col("vec_id").asc_nulls_first(), "vector", F.col("asks").desc()).withColumn("row_key", F.monotonically_increasing_id())
    rows = stored(rows, "vectors")
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"), F.max(F.size("vector")).alias("dims")).first()
    dims = max(1, size["dims"] or 1)
    padded = F.when(F.size("vector") < dims, F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("vector")))).otherwise(F.col("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    rows = rows.withColumns({"vector": padded, "norm": norm})
    count = max(1, -(-size["n"] * dims // bucket_values))
    blocks = max(1, -(-size["asked"] * dims // query_values))
    dealt = stored(rows.select("row_key", "vector", "norm").repartitionByRange(count, F.col("norm").desc(), "row_key").withColumn("bucket", F.spark_partition_id()), "buckets")
    tops = [(r["bucket"], r["top"]) for r in dealt.groupBy("bucket").agg(F.max("norm").alias("top")).orderBy("bucket").collect()]  # one number for each bucket
    asked = rows.filter("asks").select("row_key", "vector", "norm")
    if not tops or not size["asked"]:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    first = stored(_meet(asked.select("row_key", "vector", F.lit(NOTHING).alias("theta"), F.lit(tops[0][0]).alias("bucket")), dealt.filter(F.col("bucket") == tops[0][0]), k, blocks), "first")
    least = _best(first, k).filter(F.col("rank") == k).select(F.col("query").alias("row_key"), F.col("score").alias("theta"))
    lengths = F.from_json(F.lit(str([[float(b), t * (1 + SLACK)] for b, t in tops[1:]])), "array<array<double>>")
    known = stored(asked.join(least, "row_key", "left"), "asked")
    reach = F.filter(lengths, lambda b: F.col("theta").isNull() | (F.get(b, F.lit(1)) * F.col("norm") >= F.col("theta")))
    deepest = known.agg(F.max(F.size(reach))).first()[0]  # what a query needs is a prefix of the buckets
    further = known.withColumn("reached", F.explode(reach)).select("row_key", "vector", F.coalesce("theta", F.lit(NOTHING)).alias("theta"), F.get("reached", F.lit(0)).cast("int").alias("bucket"))
    found = stored(_meet(further, dealt.filter(F.col("bucket").isin([b for b, _ in tops[1 : deepest + 1]])), k, blocks), "found")
    best = stored(_best(first.union(found), k), "best")
    discard(first, known, found, dealt)
    ids = rows.select("row_key", "vec_id")
    named = best.join(ids.withColumnRenamed("vec_id", "query_id").withColumnRenamed("row_key", "query"), "query").join(ids, "row_key")
    return named.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
