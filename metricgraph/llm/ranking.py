"""op13: the best documents of each item by exact integer scores of their common terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricgraph.llm.balltree import BallTree
from metricgraph.llm.common import ROWS, discard, keyed, stored
from metricgraph.llm.words import words

#: Words that the items of a block have in all; their terms go to all tasks. Larger sets of items are worked on block by block.
ITEM_WORDS = 500_000
#: Entries of the vectors of a tree: about 30 MB with all that the tree holds.
TREE_ENTRIES = 400_000


class _Items:
    """The items of a block as sparse vectors of term counts."""

    def __init__(self, rows: list[tuple[int, str]]):
        counted = [(key, Counter(words(text))) for key, text in rows]
        self.terms = {t: i for i, t in enumerate(sorted({t for _, c in counted for t in c}))}
        self.vectors = [(key, np.array(sorted(self.terms[t] for t in c), np.int64), np.array([n for _, n in sorted((self.terms[t], n) for t, n in c.items())], np.int64)) for key, c in counted if c]


def _term_counts(docs: DataFrame, items: _Items) -> DataFrame:
    """(row_key, n, terms, times): all words of each document with a word, and how often it holds each term of the items."""
    shared = docs.sparkSession.sparkContext.broadcast(items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch, keys, sizes, terms, times = whole.slice(at, ROWS), [], [], [], []
                for key, text in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if w := words(text):
                        c = Counter(filter(None.__ne__, map(known.get, w)))
                        keys.append(key)
                        sizes.append(len(w))
                        terms.append(list(c))
                        times.append(list(c.values()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["row_key", "n", "terms", "times"])

    return docs.select("row_key", "text").mapInArrow(run, "row_key long, n long, terms array<int>, times array<long>")


class _Best:
    """The k best documents of an item so far, in one task."""

    def __init__(self, k: int):
        self.k, self.keys, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        keys, scores = np.concatenate((self.keys, keys)), np.concatenate((self.scores, scores))
        best = np.lexsort((keys, -scores))[: self.k]
        self.keys, self.scores = keys[best], scores[best]


def _block_scores(counted: DataFrame, items: _Items, k: int) -> DataFrame:
    """(item, row_key, score): the k best of each item in each task's documents."""
    sums = counted.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    documents, all_words = sums["n"], sums["words"] or 1
    df = {r["term"]: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # terms of a block of items
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(items.terms))], np.int64)
    scale = np.sqrt(np.maximum(weight, 1).astype(float))
    asked = [(key, terms, times * weight[terms]) for key, terms, times in items.vectors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {key: _Best(k) for key, _, _ in asked}
        keys, starts, terms, values, held = [], [0], [], [], 0

        def search() -> None:
            tree = BallTree(np.array(starts), np.concatenate(terms), np.concatenate(values), scale)
            of = np.array(keys)
            for key, t, w in asked:
                rows, scores, _ = tree.search(t, w, best[key].least(), k)
                if len(rows):
                    best[key].add(of[rows], scores)

        for batch in batches:
            columns = (batch.column(c) for c in ("row_key", "n", "terms", "times"))
            for key, n, t, times in zip(*(c.to_numpy(zero_copy_only=False) for c in columns), strict=True):
                m = 25 + 75 * int(n) * documents // all_words
                keys.append(key)
                terms.append(t.astype(np.int64))
                values.append(1_000_000_000 * times // (1000 * times + 8 * m))
                held += len(t)
                starts.append(held)
                if held >= TREE_ENTRIES:
                    search()
                    keys, starts, terms, values, held = [], [0], [], [], 0
        if keys:
            search()
        found = [(key, int(r), int(s)) for key, b in best.items() for r, s in zip(b.keys, b.scores, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["item", "row_key", "score"])

    return counted.filter(F.size("terms") > 0).mapInArrow(run, "item long, row_key long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, item_words: int = ITEM_WORDS) -> DataFrame:
    """The k documents of docs(doc_id, text) with the highest scores above 0 for each of items(item_id, text).

    Returns item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id. With N documents that hold a word, L
    words in all, n words in a document, df documents with a term and tf occurrences in the document, a term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))), m is 25 + (75 n N) div L, and a score adds
    weight * ((1000000000 tf) div (1000 tf + 8 m)) over the item's words, repeats included.

    Documents become sparse vectors over the terms of the items. Each task puts its vectors into ball trees of bounded
    size and takes every item through them best first: centroid and radius, rounded outward, bound the products of a
    subtree; products at leaves are exact integers. What a task found in one tree prunes its next ones. It gives k rows
    for each item at most. No text is shuffled. Items are worked on in blocks of about item_words words, whose terms and
    weights the driver holds; all blocks take the same way.
    A null text has no terms. Items without terms, or without a document that shares a term of weight above 0, have no row.
    Null doc_ids come first in ties, repeated documents and items are rows of their own, null item_ids pass through. Empty
    tables give no rows; other columns are not read.
    """
    numbered = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).orderBy(F.col("item_id").asc_nulls_first(), "text").withColumn("item", F.monotonically_increasing_id())
    numbered = stored(numbered.withColumn("words", F.size(F.regexp_extract_all("text", F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1)))), "items").filter("words > 0")
    texts = keyed(docs)
    blocks = max(1, -(-(numbered.agg(F.sum("words")).first()[0] or 0) // item_words))
    found = None
    for block in range(blocks):
        held = _Items([(r["item"], r["text"]) for r in numbered.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "text").collect()])
        counted = stored(_term_counts(texts, held), "terms")
        scores = stored(_block_scores(counted, held, k), "scores")
        discard(counted)
        found = scores if found is None else found.union(scores)
    best = found.selectExpr("*", "row_number() over (partition by item order by score desc, row_key) as rank").filter(F.col("rank") <= k)
    best = best.join(numbered.select("item", "item_id"), "item")
    if texts.filter("row_key is distinct from doc_id").isEmpty():
        return best.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("row_key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "score")
    return best.join(texts.select("row_key", "doc_id"), "row_key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
