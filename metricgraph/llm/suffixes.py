"""op4: repeated 100-byte strings, by a sampled suffix array that is range-partitioned over the cluster.

Of all suffixes only those take part that start at an anchor: in each 100-byte window the 32-byte string with the least
hash (the leftmost of equals). Equal windows have their anchors at the same place, so each window is decided at its
anchor's suffixes alone; about one byte in 37 is an anchor. A suffix is known by the hash of its leading 32 bytes and by
the hash of its span, the bytes of all windows that have the anchor. Suffixes are dealt by splitters from a sample of
them, ordered by (lead, span, document, position), so that even a third of all suffixes alike is cut into even buckets.
A bucket sorts by multikey quicksort and compares neighbours:

- it comes sorted by lead and is held in parts of whole leads, each of which is sorted as a whole;
- of suffixes with equal lead and span all but the first repeat as a whole;
- the first of each span stays open if its lead has other spans too, or may have them beyond the bucket's boundary. A
  window holds the SIDE bytes before its lead or those behind it, so of an open span only the windows of a side stay that
  another span of the lead has too, by 32 bits of hash each (equal hashes of different bytes only cost a comparison).

Open spans are taken apart into windows, which are dealt and compared in the same way; there the last window of a bucket
is compared with the first of the next, so no boundary is left. Both hashes together have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricgraph.llm.common import ROWS, keyed, parallelism, possibly_among, release, stored
from metricgraph.llm.near import _mix

LENGTH, LEAD = 100, 32
#: Bytes beside the lead: a window that starts so many bytes before it or more holds those, any other the ones behind it.
SIDE = (LENGTH - LEAD) // 2
#: Suffixes of a bucket and the most buckets; beyond them (364 GB of text) buckets grow, but a task still holds a part at a time.
BUCKET, BUCKETS = 300_000, 1 << 15
#: The least documents in the sample that gives the splitters, suffixes of each, and sampled suffixes for each bucket.
SAMPLE_DOCS, SAMPLE_EACH, PER_BUCKET = 1_000, 200, 40
#: Bytes of a text at a time; rows of a bucket that are sorted at a time, and more only where one lead has more.
SEGMENT, PART = 1 << 22, 100_000
LEAD_BASE, SPAN_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
KEYS = ["lead", "span", "row_key", "lo"]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of SPAN_BASE and of its inverse, modulo 2**64."""
    n = SEGMENT + LENGTH + 1
    up = np.full(n, SPAN_BASE, np.uint64)
    down = np.full(n, pow(SPAN_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers()
    return np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]))


def _range_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the bytes lo to hi, wherever they stand."""
    return _mix((sums[hi] - sums[lo]) * _powers()[1][lo] + (hi - lo).astype(np.uint64))


def _lead_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the LEAD bytes at each position, by doubling."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < LEAD:
        h = h[:-size] * np.uint64(pow(LEAD_BASE, size, 2**64)) + h[size:]
        size *= 2
    return _mix(h)


def _segments(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text that share no window and leave none out."""
    for start in range(0, len(data) - LENGTH + 1, SEGMENT):
        yield start, data[start : start + SEGMENT + LENGTH - 1]


def anchored(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lead, span, lo, n, at, sides) of each anchor of a piece: its windows start at lo to lo + n - 1, its lead at `at`.

    sides holds two 32-bit hashes, of the lead with the SIDE bytes before it and of the lead with those behind it; what
    would lie outside the piece is left out, and no window needs it.
    """
    h = _lead_hashes(data)
    width = LENGTH - LEAD + 1
    place = np.arange(len(h), dtype=np.uint64)
    key = (h & ~np.uint64(SEGMENT * 4 - 1)) | place  # the least hash, then the leftmost
    blocks = np.concatenate([key, np.full(-len(key) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(h) - width + 1
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(SEGMENT * 4 - 1)
    lo = np.flatnonzero(np.diff(least, prepend=np.uint64(2**63)))
    counts = np.diff(np.append(lo, n))
    sums, at = _sums(data), least[lo].astype(np.int64)
    span = _range_hash(sums, lo, lo + counts + LENGTH - 1)
    before = _range_hash(sums, np.maximum(at - SIDE, 0), at + LEAD)
    behind = _range_hash(sums, at, np.minimum(at + LEAD + SIDE, len(data)))
    sides = before >> np.uint64(32) << np.uint64(32) | behind >> np.uint64(32)
    return h[at], span, lo, counts, at, sides


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order by the columns in turn: quicksort by one, then by the next only inside runs of equal values."""
    order = np.argsort(columns[0], kind="quicksort")
    run = np.append(0, np.cumsum(np.diff(columns[0][order]) != 0)) if len(order) else order
    for column in columns[1:]:
        tied = np.zeros(len(order), bool)
        tied[1:] = run[1:] == run[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        order[at] = order[at[np.lexsort((column[order[at]], run[at]))]]
        same = run[1:] == run[:-1]
        same &= column[order[1:]] == column[order[:-1]]
        run = np.append(0, np.cumsum(~same))
    return order


def _first_inside(lead: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Which of a document's suffixes, in order of position, are the first of their kind in it."""
    order = np.lexsort((np.arange(len(lead)), span, lead))
    first = np.ones(len(lead), bool)
    first[order[1:]] = (lead[order[1:]] != lead[order[:-1]]) | (span[order[1:]] != span[order[:-1]])
    return first


def _runs(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows lo to lo + n - 1 as maximal runs of window starts; lo ascends."""
    if not len(lo):
        return lo, n
    new = np.append(True, lo[1:] > np.maximum.accumulate(lo + n)[:-1])
    starts = lo[new]
    ends = np.maximum.reduceat(lo + n, np.flatnonzero(new))
    return starts, ends - starts


class Splitters:
    """Ascending keys that begin the buckets after the first; a key belongs to the last bucket that begins at or before it."""

    def __init__(self, sample: pd.DataFrame, buckets: int):
        sample = sample[KEYS].sort_values(KEYS).drop_duplicates()
        at = np.unique(np.linspace(0, len(sample), buckets + 1).astype(int)[1:-1]) if len(sample) else []
        self.keys = [tuple(map(int, x)) for x in sample.iloc[at].itertuples(index=False)] if len(sample) else []
        self.leads = np.array([k[0] for k in self.keys], np.int64)
        self.buckets = len(self.keys) + 1

    def bucket(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.searchsorted(self.leads, columns[0], side="right")
        tied = np.flatnonzero(out > np.searchsorted(self.leads, columns[0], side="left"))  # leads that are splitters
        below = np.searchsorted(self.leads, columns[0][tied], side="left")
        width = int((out[tied] - below).max()) if len(tied) else 0
        base, top = below.copy(), out[tied]
        for i in range(width):  # how many splitters of that lead are at or below the key
            k = below + i
            some = k < top
            rows, ks = tied[some], k[some]
            le = np.ones(len(rows), bool)
            decided = np.zeros(len(rows), bool)
            for c in range(1, 4):
                s = np.array([self.keys[j][c] for j in ks], np.int64)
                v = columns[c][rows]
                le = np.where(~decided, v >= s, le)
                decided |= v != s
            base[some] += le
        out[tied] = base
        return out.astype(np.int32)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for whole in batches:
        for start in range(0, len(whole), ROWS):  # what is made for a batch can be many times its size
            batch = whole.iloc[start : start + ROWS]
            yield batch, [np.frombuffer(t.encode(), np.uint8) for t in batch["text"]]


def _frame(parts: list[tuple[int, tuple[np.ndarray, ...]]], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({"row_key": np.repeat(np.array([k for k, _ in parts], np.int64), [len(x[0]) for _, x in parts])})
    for i, name in enumerate(names):
        out[name] = np.concatenate([x[i] for _, x in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    return out


def _suffixes(docs: DataFrame, splitters: Splitters | None) -> DataFrame:
    """A row for each suffix: bucket -1 holds windows that repeat inside their document. Without splitters: a sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, texts in _texts(batches):
            own, inside = [], []
            for key, data in zip(batch["row_key"], texts, strict=True):
                found = [(lead, span, lo + start, n, at - lo, sides) for start, piece in _segments(data) for lead, span, lo, n, at, sides in [anchored(piece)]]
                if not found:
                    continue
                lead, span, lo, n, at, sides = (np.concatenate(x) for x in zip(*found, strict=True))
                first = _first_inside(lead, span)
                inside.append((key, _runs(lo[~first], n[~first])))
                step = 1 if splitters else max(1, len(lead) // SAMPLE_EACH)
                own.append((key, tuple(x[first][::step] for x in (lead, span, lo, n, at, sides))))
            out = _frame(own, ["lead", "span", "lo", "n", "at", "sides"])
            if splitters is None:
                yield out.assign(bucket=np.int32(0))
                continue
            yield out.assign(bucket=splitters.bucket([out[c].to_numpy() for c in KEYS]))
            yield _frame(inside, ["lo", "n"]).assign(bucket=np.int32(-1), lead=0, span=0, at=0, sides=0)

    return docs.select("row_key", "text").mapInPandas(run, "row_key long, lead long, span long, lo long, n long, at int, sides long, bucket int")


def _windows(opened: DataFrame, docs: DataFrame, splitters: Splitters | None) -> DataFrame:
    """A row for each window of the open spans, in the form of suffixes: span is the window's hash, n is 1."""
    spans = opened.groupBy("row_key").agg(F.collect_list(F.struct("lead", "lo", "n")).alias("spans"))
    docs = possibly_among(docs.select("row_key", "text"), "row_key", opened)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, texts in _texts(batches):
            own, inside = [], []
            for key, data, spans in zip(batch["row_key"], texts, batch["spans"], strict=True):
                lead, at, n = (np.array([s[c] for s in spans], np.int64) for c in ("lead", "lo", "n"))
                lo = np.repeat(at - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                lead = np.repeat(lead, n)
                order = np.argsort(lo)
                lead, lo = lead[order], lo[order]
                span = np.zeros(len(lo), np.uint64)
                for start, piece in _segments(data):
                    some = (lo >= start) & (lo < start + SEGMENT)
                    if some.any():
                        span[some] = _range_hash(_sums(piece), lo[some] - start, lo[some] - start + LENGTH)
                span = span.astype(np.int64)
                first = _first_inside(lead, span)
                inside.append((key, _runs(lo[~first], np.ones((~first).sum(), np.int64))))
                step = 1 if splitters else max(1, len(lead) // SAMPLE_EACH)
                own.append((key, tuple(x[first][::step] for x in (lead, span, lo, np.ones(len(lo), np.int64)))))
            out = _frame(own, ["lead", "span", "lo", "n"])
            if splitters is None:
                yield out.assign(bucket=np.int32(0))
                continue
            yield out.assign(bucket=splitters.bucket([out[c].to_numpy() for c in KEYS]))
            yield _frame(inside, ["lo", "n"]).assign(bucket=np.int32(-1), lead=0, span=0)

    return docs.join(spans.hint("merge"), "row_key").select("row_key", "text", "spans").mapInPandas(run, "row_key long, lead long, span long, lo long, n long, bucket int")


def _open(spans: pd.DataFrame, group: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    """The windows of spans that another span of the same group may have too; at the ends of a bucket all of them.

    Windows that start SIDE bytes before the lead or earlier need another span with the same bytes before it, the
    others one with the same bytes behind it.
    """
    lo, n, at, sides = (spans[c].to_numpy() for c in ("lo", "n", "at", "sides"))
    early = np.clip(at - SIDE + 1, 0, n)  # so many windows start early enough
    parts = []
    for side, start, size in ((sides >> 32, lo, early), (sides & 0xFFFFFFFF, lo + early, n - early)):
        held = np.flatnonzero(size > 0)
        order = held[np.lexsort((side[held], group[held]))]
        twin = np.append(False, (side[order[1:]] == side[order[:-1]]) & (group[order[1:]] == group[order[:-1]])) if len(order) else np.zeros(0, bool)
        keep = np.zeros(len(lo), bool)
        keep[order[twin | np.append(twin[1:], False)]] = True
        keep = (keep | ends) & (size > 0)
        parts.append(spans[keep].assign(lo=start[keep], n=size[keep]))
    return pd.concat(parts)


class WholeLeads:
    """Cuts a bucket's rows, which come in order of lead, into parts of whole leads: (rows, begins, ends the bucket)."""

    def __init__(self, part: int) -> None:
        self.held, self.size, self.part, self.limit, self.begins = [], 0, part, part, True

    def add(self, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, bool, bool]]:
        if not len(rows):
            return
        self.held.append(rows)
        self.size += len(rows)
        if self.size < self.limit:
            return
        rows = pd.concat(self.held)
        cut = int(np.searchsorted(rows["lead"].to_numpy(), rows["lead"].iloc[-1], side="left"))
        self.held, self.size = [rows.iloc[cut:]], len(rows) - cut
        self.limit = max(self.part, 2 * self.size)
        if cut:
            yield rows.iloc[:cut], self.begins, False
            self.begins = False

    def rest(self) -> Iterator[tuple[pd.DataFrame, bool, bool]]:
        if self.size:
            yield pd.concat(self.held), self.begins, True


def _resolved(suffixes: DataFrame, buckets: int, windows: bool) -> DataFrame:
    """What a bucket finds. kind 0: windows that repeat. kind 1: open spans. kind 2 and 3: its first and last row."""
    names, rows_at_a_time = ["kind", "bucket", "lead", "span", "row_key", "lo", "n"], PART

    def compared(part: pd.DataFrame, begins: bool, ends_here: bool) -> Iterator[pd.DataFrame]:
        bucket = int(part["bucket"].iloc[0])
        part = part.iloc[multikey_order([part[c].to_numpy() for c in KEYS])]
        lead, span = part["lead"].to_numpy(), part["span"].to_numpy()
        other = np.append(True, lead[1:] != lead[:-1])
        first = other | np.append(True, span[1:] != span[:-1])
        repeated = part[~first]
        for _, some in repeated.groupby(np.arange(len(repeated)) // 200_000):
            yield some.assign(kind=0)[names]
        if windows:
            if begins:
                yield part.iloc[[0]].assign(kind=2)[names]
            if ends_here:
                yield part.iloc[[-1]].assign(kind=3)[names]
            return
        group = np.cumsum(other) - 1
        ends = (group == 0) & (begins and bucket > 0) | (group == group[-1]) & (ends_here and bucket < buckets - 1)
        yield _open(part[first], group[first], ends[first]).assign(kind=1)[names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = WholeLeads(rows_at_a_time)
        for batch in batches:
            inside = batch["bucket"].to_numpy() < 0
            if inside.any():
                yield batch[inside].assign(kind=0)[names]
            for part in bucket.add(batch[~inside]):
                yield from compared(*part)
        for part in bucket.rest():
            yield from compared(*part)

    at = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("row_key"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    dealt = suffixes.repartitionById(buckets, at).sortWithinPartitions("lead")
    return dealt.mapInPandas(run, "kind int, bucket int, lead long, span long, row_key long, lo long, n long")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(row_key, lo, n): windows of LENGTH bytes starting at lo to lo + n - 1 that also start earlier; docs as keyed()."""
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    spark = docs.sparkSession

    def buckets(n: float) -> int:
        return max(parallelism(spark), min(BUCKETS, int(n // BUCKET) + 1))

    def sampled(n: int) -> Column:
        """Rows of enough documents for splitters between n buckets."""
        wanted = max(SAMPLE_DOCS, n * PER_BUCKET // SAMPLE_EACH)
        return F.pmod(F.xxhash64("row_key"), F.lit(max(1, rows // wanted))) == 0

    n = buckets((size or 0) / 37)
    splitters = Splitters(_suffixes(docs.filter(sampled(n)), None).toPandas(), n)
    found = stored(_resolved(_suffixes(docs, splitters), splitters.buckets, False), "suffixes")
    release(spark)
    opened = found.filter("kind = 1")
    n = buckets(opened.agg(F.sum("n")).first()[0] or 0)
    inner = Splitters(_windows(opened.filter(sampled(n)), docs.filter(sampled(n)), None).toPandas(), n)
    more = stored(_resolved(_windows(opened, docs, inner), inner.buckets, True), "windows")

    release(spark)

    # The first window of a bucket repeats if the bucket before ends with an equal one.
    last = more.filter("kind = 3").select((F.col("bucket") + 1).alias("bucket"), "lead", "span")
    across = more.filter("kind = 2").join(last, ["bucket", "lead", "span"])
    return reduce_union([t.select("row_key", "lo", "n") for t in (found.filter("kind = 0"), more.filter("kind = 0"), across)])


def reduce_union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _cut(texts: DataFrame, schema: str, row) -> DataFrame:  # noqa: ANN001
    """row(row_key, bytes, removed spans as an array of (start, end)) for each text."""
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, data in _texts(batches):
            rows = []
            for key, d, spans in zip(batch["row_key"], data, batch["spans"], strict=True):
                removed = np.zeros((0, 2), np.int64)
                if spans is not None and len(spans):
                    found = np.array(sorted((s["lo"], s["lo"] + s["n"] + LENGTH - 1) for s in spans), np.int64)
                    starts, sizes = _runs(found[:, 0], found[:, 1] - found[:, 0])
                    removed = np.stack([starts, starts + sizes], 1)
                rows.append(row(key, d, removed))
            yield pd.DataFrame(rows, columns=names)

    return texts.select("row_key", "text", "spans").mapInPandas(run, schema)


def _kept(data: np.ndarray, removed: np.ndarray) -> bytes:
    keep = np.ones(len(data), bool)
    for s, e in removed:
        keep[s:e] = False
    return data[keep].tobytes()


def _with_spans(docs: DataFrame) -> DataFrame:
    found = repeated_windows(docs).groupBy("row_key").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    return docs.join(found, "row_key", "left")


def suffix_report(docs: DataFrame) -> DataFrame:
    """Remove from docs(doc_id, text), as UTF-8 bytes, each byte covered by a 100-byte string that also starts earlier.

    Earlier is a smaller doc_id, or the same document and a smaller position; strings are judged on the input and do not
    cross documents. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, one row for each
    row of docs. Null texts count as empty, texts under 100 bytes stay whole. Rows without id come first; rows that
    repeat an id are documents of their own, ordered by text. Other columns are not read.
    """
    docs = keyed(docs)

    def row(key: int, data: np.ndarray, removed: np.ndarray) -> tuple:
        return key, len(data), int((removed[:, 1] - removed[:, 0]).sum()), len(removed), hashlib.sha256(_kept(data, removed)).hexdigest()

    out = _cut(_with_spans(docs), "row_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", row)
    return docs.select("row_key", "doc_id").join(out, "row_key").drop("row_key")


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary) and spans, an array of the removed (start, end), for each row of docs; as suffix_report."""
    docs = keyed(docs)

    def row(key: int, data: np.ndarray, removed: np.ndarray) -> tuple:
        return key, _kept(data, removed), [{"start": int(s), "end": int(e)} for s, e in removed]

    out = _cut(_with_spans(docs), "row_key long, kept binary, spans array<struct<start:long,end:long>>", row)
    return docs.select("row_key", "doc_id").join(out, "row_key").drop("row_key")
