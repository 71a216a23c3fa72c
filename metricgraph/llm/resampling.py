"""op11: documents drawn so that their hashed features look like those of a target corpus."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricgraph.llm.common import ROWS, keyed, stored
from metricgraph.llm.select import kth_key, ranked
from metricgraph.llm.words import words

#: Features whose bucket a task remembers before it starts anew; this only bounds memory.
REMEMBERED = 500_000


class _Buckets(dict):
    """Bucket of each feature, worked out at its first use."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def _featurizer(runs: tuple[int, int], buckets: int) -> Callable[[str | None], tuple[int, np.ndarray]]:
    """text -> number of words, and the bucket of every run of runs[0] to runs[1] words."""
    known = _Buckets(buckets)

    def of(text: str | None) -> tuple[int, np.ndarray]:
        w = words(text)
        if len(known) > REMEMBERED:
            known.clear()
        features = w if runs == (1, 1) else [b" ".join(w[i : i + n]) for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1)]
        return len(w), np.fromiter(map(known.__getitem__, features), np.int32, len(features))

    return of


def bucket_counts(texts: DataFrame, runs: tuple[int, int], buckets: int) -> DataFrame:
    """(bucket, n) over all texts(text). A task adds its counts up in an array and gives one row for each bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = _featurizer(runs, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                found = [of(t)[1] for t in batch.column(0).slice(at, ROWS).to_pylist()]
                total += np.bincount(np.concatenate(found), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, runs: tuple[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, from all texts of both tables.

    The driver holds two numbers for each bucket, however large the tables are.
    """
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for side, texts in ((s, docs), (t, target)):
        for r in bucket_counts(texts, runs, buckets).collect():
            side[r["bucket"]] = r["n"]
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, runs: tuple[int, int]) -> DataFrame:
    """keyed docs(doc_id, text, row_key) to (doc_id, row_key, n_words, n_features, weight), the gains of all features added."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("row_key long, n_words long, n_features long, weight long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _featurizer(runs, len(gain))
        for batch in batches:
            found = []
            for t in batch.column("text").to_pylist():
                n, buckets = of(t)
                found.append((n, len(buckets), int(gain[buckets].sum())))
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *columns], schema.names)

    return docs.select("doc_id", "text", "row_key").mapInArrow(run, schema)


def _scored(docs: DataFrame, target: DataFrame, runs: tuple[int, int], buckets: int, seed: int) -> DataFrame:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights(docs, gains(docs, target, runs, buckets), runs).withColumn("score", F.col("weight") + noise.cast("long"))


def resample(docs: DataFrame, target: DataFrame, runs: tuple[int, int] = (1, 1), buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Draw a share of docs(doc_id, text) without replacement, so that they resemble target(text).

    Returns doc_id, n_features, weight, score, rank, one row for each row of docs. Features are all runs of runs[0] to
    runs[1] words, hashed into buckets; a document's weight is the sum of its features' gains; its score adds a Gumbel draw
    made from the seed and doc_id. Of the N documents with least_words or more, floor(percent N / 100) with the highest
    scores have a rank, ties to the smaller doc_id; rank is null for all others.

    Two passes over the texts, no shuffle of them: counts of buckets (an array for each task), then weights from an array
    of gains. The last score to be drawn is found by quickselect over (score, row_key); only winners are sorted, in ranges.
    A null text has no words. Null ids draw as the empty string and come before all others in ties; repeated rows
    have the same score and are documents of their own. Empty tables: no rows; without target texts all gains
    come from docs alone. Other columns are not read.
    """
    rows = stored(_scored(keyed(docs), target, runs, buckets, seed), "weights")
    able = rows.filter(F.col("n_words") >= least_words)
    last = kth_key(able.select("score", "row_key"), percent * able.count() // 100)
    shown = "doc_id", "n_features", "weight", "score", "rank"
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(*shown)
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > last[0]) | ((F.col("score") == last[0]) & (F.col("row_key") <= last[1])))
    others = rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.filter(drawn)).select(*shown).union(others.select(*shown))
