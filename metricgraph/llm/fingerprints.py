"""op6: document fingerprints by one-permutation MinHash.

The hash of each word shingle falls into one of 256 bins and only the least value of a bin is kept. An empty bin takes
the value of the first filled bin on its own fixed random walk over the bins (optimal densification). Of each value four
bits are stored. Two fingerprints agree by chance in 1 of 16 bins, and the likeness is corrected for that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricgraph.llm.common import map_texts, parallelism
from metricgraph.llm.near import _mix, shingle_hashes, words_of
from metricgraph.llm.ranges import row_splitters

BINS, BITS, SHINGLE = 256, 4, 5


@lru_cache(maxsize=1)
def _walks() -> np.ndarray:
    """Row i: the step at which bin i's random walk reaches each bin for the first time."""
    steps = 16 * BINS
    seeds = np.arange(BINS * steps, dtype=np.uint64).reshape(BINS, steps)
    walk = (_mix(seeds + np.uint64(0x632BE59BD9B4E019)) % np.uint64(BINS)).astype(np.int64)
    first = np.full((BINS, BINS), steps, np.int64)
    for i in range(BINS):
        bins, at = np.unique(walk[i], return_index=True)
        first[i, bins] = at
    # A bin that a walk misses comes after the others, the nearest on its right first.
    late = first == steps
    first[late] = (steps + (np.arange(BINS)[None, :] - np.arange(BINS)[:, None]) % BINS)[late]
    return first


def fingerprint(text: str | None) -> str:
    """Hexadecimal digits, one for each bin; an empty string for a text without words."""
    h = shingle_hashes(words_of(text), SHINGLE)
    if not len(h):
        return ""
    bins = (h >> np.uint64(56)).astype(np.int64)  # the hashes are sorted: the first of a bin is its least
    filled, at = np.unique(bins, return_index=True)
    values = np.zeros(BINS, np.uint64)
    values[filled] = h[at]
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled)
        values[empty] = values[filled[_walks()[np.ix_(empty, filled)].argmin(1)]]
    low = (_mix(values) & np.uint64(2**BITS - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints, from 0 to 1. Two empty ones are alike, one is like no other."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(s.encode(), np.uint8) for s in (a, b))
    chance = 2.0**-BITS
    return float(max(0.0, ((x == y).mean() - chance) / (1 - chance)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of docs(doc_id, text), one row for each row. Null and empty texts have an empty fingerprint."""

    return map_texts(docs, lambda: lambda texts: [(fingerprint(t),) for t in texts], "fingerprint string")


def against_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each document and its edited text: the last half replaced by the start of the next document.

    The next document is the one with the next smaller (doc_id, text), nulls last; after the last comes the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row for each
    row of docs. A null text counts as empty; repeated rows follow one another; other columns are not read.

    Documents are dealt into ranges of doc_id whose splitters are ids in the data, so the first document of a range is
    known, and a copy of it goes to the range before as that range's last neighbour.
    """
    parts = parallelism(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    tops = row_splitters(docs, "key", parts)
    top = docs.agg(F.max("key")).first()[0]
    tops = sorted({*tops, *([top] if top is not None else [])}, reverse=True)  # the first key of each range, descending
    n = max(1, len(tops))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ascending = np.array(tops[::-1], np.int64)
        for batch in batches:
            at = n - 1 - np.searchsorted(ascending, batch["key"].to_numpy(), side="left")
            at = np.maximum(at, 0)
            own = batch.assign(part=at.astype(np.int32), guest=False)
            first = np.isin(batch["key"].to_numpy(), ascending)
            guests = own[first].assign(guest=True)
            guests["part"] = ((guests["part"] - 1) % n).astype(np.int32)
            yield pd.concat([own, guests])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        names = ["key", "no_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            rows = []
            for part, guest, key, no_id, text in zip(batch["part"], batch["guest"], batch["key"], batch["no_id"], batch["text"], strict=True):
                print_ = fingerprint(text)
                if held is not None and held[0] == part and not held[1]:
                    rows.append(_edited(*held[2:], text, print_))
                held = (part, guest, key, no_id, text, print_)
            yield pd.DataFrame(rows, columns=names)

    def _edited(key: int, no_id: bool, text: str, own: str, following: str, next_: str) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        changed = fingerprint(edited)
        return key, no_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_)

    dealt = docs.mapInPandas(deal, "key long, no_id boolean, text string, part int, guest boolean")
    dealt = dealt.repartitionById(n, "part").sortWithinPartitions("part", "guest", F.desc("key"), "no_id", F.desc("text"))
    schema = "key long, no_id boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = dealt.select("part", "guest", "key", "no_id", "text").mapInPandas(run, schema)
    return out.select(F.when(~F.col("no_id"), F.col("key")).alias("doc_id"), *out.columns[2:])
