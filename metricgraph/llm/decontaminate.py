"""op7: benchmark decontamination by exact word windows.

The windows of the benchmark go to every task as a hash table, where their number is within a checked bound; documents
are scanned once, a rolling hash finds candidate windows, and the words themselves verify them. Beyond the bound
128-bit digests of documents' windows are joined with the benchmark's by a shuffle; equal digests count as equal windows there.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricgraph.llm.common import whole_rows

WINDOW = 10
#: A benchmark of more words than this is joined by a shuffle instead of being sent to every task (about 200 bytes each).
MAX_BROADCAST_WORDS = 500_000
#: A-Z in lower case; every ASCII character that is neither a letter nor a digit becomes a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def bench_words(text: str | None) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split() if text else []


class Windows:
    """The benchmark's windows by length and hash. Words are numbered; number 0 is any other word."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, words in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found[size][tuple(ids[i : i + size])].add(item)
        self.by_size = {}
        for size, windows in found.items():
            table = np.array(list(windows), np.uint64)
            hashes: dict[int, list[tuple[tuple[int, ...], set[str]]]] = defaultdict(list)
            for h, w in zip(_roll(table.ravel(), size)[::size].tolist(), windows.items(), strict=True):
                hashes[h].append(w)
            self.by_size[size] = (np.array(sorted(hashes), np.uint64), dict(hashes))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside an occurrence of a window, and the items whose windows occur."""
        get = self.number.get
        ids = np.fromiter([get(w, 0) for w in words], np.uint64, len(words))
        change = np.zeros(len(ids) + 1, np.int64)
        items: set[str] = set()
        for size, (keys, hashes) in self.by_size.items():
            if len(ids) < size:
                continue
            other = np.cumsum(np.append(0, ids == 0))
            starts = np.flatnonzero(other[size:] == other[:-size])  # windows of benchmark words only
            if not len(starts):
                continue
            rolled = _roll(ids, size)[starts]
            at = np.minimum(np.searchsorted(keys, rolled), len(keys) - 1)
            for s, h in zip(starts[keys[at] == rolled].tolist(), rolled[keys[at] == rolled].tolist(), strict=True):
                held = tuple(ids[s : s + size].tolist())
                for window, owners in hashes[h]:
                    if window == held:
                        change[s] += 1
                        change[s + size] -= 1
                        items |= owners
        return np.cumsum(change[:-1]) > 0, items


def _roll(ids: np.ndarray, size: int) -> np.ndarray:
    n = len(ids) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _hit_spans(hit: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)


def without_words(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between two hit words of one run."""
    data = np.frombuffer(text.encode(), np.uint8)
    letter = np.frombuffer(data.tobytes().translate(TO_WORDS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    keep = np.ones(len(data), bool)
    for first, last in _hit_spans(hit):
        keep[edges[first, 0] : edges[last - 1, 1]] = False
    return data[keep].tobytes().decode()


def _digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _benchmark(benchmark: DataFrame, window: int, limit: int) -> Windows | None:
    """The table of windows, or None if the benchmark has more words than may be broadcast."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = b.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # no text has more words than that
    if size > limit:
        words = F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
        if (b.agg(F.sum(words)).first()[0] or 0) > limit:
            return None
    return Windows(((r["item"] or "", bench_words(r["text"])) for r in b.toLocalIterator()), window)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, limit: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[tuple]]]:
    """The rows of docs as structs, with what scanning needs, and a function of a batch that gives (words, hit, items) of each."""
    known = _benchmark(benchmark, window, limit)
    docs = docs.select(whole_rows(docs).alias("row"))
    if known is not None:
        held = docs.sparkSession.sparkContext.broadcast(known)

        def scanned(batch: pa.RecordBatch) -> Iterator[tuple]:
            for text in batch.column("row").field("text").to_pylist():
                words = bench_words(text)
                yield words, *held.value.scan(words)

        return docs, scanned

    # The hits of a text depend on the text alone, so equal texts are looked up once.
    docs = docs.withColumn("_key", F.sha2(F.coalesce("row.text", F.lit("")), 256))
    texts = docs.select("_key", F.coalesce("row.text", F.lit("")).alias("text")).dropDuplicates(["_key"])
    docs = docs.join(_joined(texts, benchmark, window), "_key", "left")

    def joined(batch: pa.RecordBatch) -> Iterator[tuple]:
        for text, spans, items in zip(batch.column("row").field("text").to_pylist(), *(batch.column(c).to_pylist() for c in ("_spans", "_items")), strict=True):
            words = bench_words(text)
            change = np.zeros(len(words) + 1, np.int64)
            for s in spans or ():
                change[s["pos"]] += 1
                change[s["pos"] + s["size"]] -= 1
            yield words, np.cumsum(change[:-1]) > 0, set(items or ())

    return docs, joined


def _joined(texts: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """(_key, _spans, _items) by a shuffle join of window hashes, for a benchmark that is too large to broadcast."""

    def explode(batches: Iterator[pd.DataFrame], name: str, sizes: list[int] | None) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, body in zip(batch[name], batch["text"], strict=True):
                words = bench_words(body)
                for size in sizes or [min(window, len(words))]:
                    if 0 < size <= len(words):
                        runs = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
                        yield pd.DataFrame({name: key, "pos": range(len(runs)), "size": size, "h": [hashlib.blake2b(r, digest_size=16).digest() for r in runs]})

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = items.mapInPandas(lambda b: explode(b, "item", None), "item string, pos int, size int, h binary").select("h", "size", "item").distinct()
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # at most `window` numbers
    if not sizes:
        return texts.filter("false").select("_key", F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("size"))).alias("_spans"), F.array(F.lit("")).alias("_items"))
    own = texts.select("_key", "text").mapInPandas(lambda b: explode(b, "_key", sizes), "_key string, pos int, size int, h binary")
    places = own.join(wanted.select("h", "size").distinct(), ["h", "size"])
    spans = places.groupBy("_key").agg(F.collect_set(F.struct("pos", "size")).alias("_spans"))
    owners = places.select("_key", "h", "size").distinct().join(wanted, ["h", "size"]).groupBy("_key").agg(F.collect_set("item").alias("_items"))
    return spans.join(owners, "_key", "left")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """Find benchmark windows in docs(doc_id, text); benchmark has (item_id, text).

    A window is `window` consecutive words of an item, or all words of a shorter item. Returns doc_id, n_words, n_hit
    (words inside an occurrence of a window), n_items, items_sha256, contaminated, one row for each row of docs. Null
    and empty texts have no words, and an empty benchmark hits nothing. Items that repeat a text share its windows; an
    item without id counts as an item named "". Null and repeated doc_ids pass through; other columns are not read.
    """
    made = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(made).fields])
    docs, of = _found(docs.select("doc_id", "text"), benchmark, window, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(words), int(hit.sum()), len(items), _digest(items), bool(hit.any())) for words, hit, items in of(batch)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("row").field("doc_id"), *columns], schema.names)

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", max_share: float = 0.5, window: int = WINDOW, limit: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """docs without benchmark text, with all columns of docs and their other values as they are.

    mode "documents" drops every document with a hit. mode "spans" takes the hit spans out, and drops a document only
    when more than max_share of its words were hit. Rows without a hit are unchanged, null texts included.
    """
    schema = docs.schema
    docs, of = _found(docs, benchmark, window, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            texts, keep = row.field("text").to_pylist(), []
            for i, (words, hit, _) in enumerate(of(batch)):
                n = int(hit.sum())
                keep.append(n == 0 or mode == "spans" and n <= max_share * len(words))
                if n and keep[-1]:
                    texts[i] = without_words(texts[i], hit)
            columns = [pa.array(texts, pa.string()) if c == "text" else row.field(c) for c in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
