"""op1 and op9: exact encoding, decoding and counting with the word vocabulary."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from metricgraph.llm.common import map_texts
from metricgraph.llm.wordbpe import Vocabulary, count_word, encode_words, vocabulary

#: Beyond this many distinct chunks a worker forgets rare ones, and words are merged once about this many characters of text
#: have come in. Both only bound memory; results do not depend on them.
MAX_CHUNKS = 400_000
CHUNK_CHARS = 6_000_000
#: The same for a worker that gives out ids and texts, and the rows that it encodes at a time.
WHOLE_CHUNKS, WHOLE_ROWS = 200_000, 500


def _chunks(texts: list[str]) -> Iterator[range]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield range(start, i + 1)
            start, size = i + 1, 0
    yield range(start, len(texts))


def encode_chunks(v: Vocabulary, chunks: list[str]) -> list[bytes]:
    """Ids of each chunk as little-endian unsigned 32-bit integers; the words of all chunks are merged together."""
    cut = [v.pieces(c) for c in chunks]
    words = {w: None for c, pieces in zip(chunks, cut, strict=True) for w in pieces if not (c[0] == " " and w in v.special)}
    ids = {w: i.astype("<u4").tobytes() for w, i in zip(words, encode_words(v, list(words)), strict=True)}
    special = {f" {w}": np.array([i], "<u4").tobytes() for w, i in v.special.items()}
    return [special[c] if c in special else ids[p[0]] if len(p) == 1 else b"".join(map(ids.__getitem__, p)) for c, p in zip(chunks, cut, strict=True)]


class _WordCounts(dict):
    """Token counts of words, each worked out at its first use."""

    def __init__(self, v: Vocabulary):
        self.v = v

    def __missing__(self, word: str) -> int:
        self[word] = n = count_word(self.v, word)
        return n

    def chunk(self, chunk: str) -> int:
        if chunk[0] == " " and chunk[1:] in self.v.special:
            return 1
        return sum(map(self.__getitem__, self.v.pieces(chunk)))


class _Memory:
    """What is known of distinct chunks; each new one is worked out once, together with the others of some texts.

    Beyond `most` those are forgotten that only one lot of texts has held, or if others fill half of it, all but the last.
    """

    def __init__(self, v: Vocabulary, work: Callable[[list[str]], list], most: int | None = None):
        self.v, self.work, self.most, self.known, self.again = v, work, most or MAX_CHUNKS, {}, set()

    def __call__(self, texts: list[str]) -> Iterator[list[str]]:
        """The chunks of each text, all of them known."""
        for some in _chunks(texts):
            used = [self.v.chunks(texts[i]) for i in some]
            present = set().union(*used)
            new = present.difference(self.known)
            self.again |= present - new
            if len(self.known) + len(new) > self.most:
                if len(self.again) > self.most // 2:
                    self.again = present - new
                self.known = {c: self.known[c] for c in self.again}
            self._learn(list(new))
            while used:  # what has been given is let go
                yield used.pop(0)

    def _learn(self, new: list[str]) -> None:
        """The collector of cycles rests meanwhile: many lists are made, none of them in a cycle, and it would walk them all."""
        on = gc.isenabled()
        gc.disable()
        try:
            self.known.update(zip(new, self.work(new), strict=True))
        finally:
            if on:
                gc.enable()


class Encoder:
    """Encodes batches of texts; remembers the ids of chunks."""

    def __init__(self, path: str, encode: Callable[[Vocabulary, list[str]], list[bytes]] = encode_chunks, decoded: bool = True, most: int | None = None):
        self.v, self.encode, self.decoded = vocabulary(path), encode, decoded
        self.memory = _Memory(self.v, self._work, most)

    def _work(self, chunks: list[str]) -> list[bytes]:
        return self.encode(self.v, chunks)

    def __call__(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        for chunks in self.memory(texts):
            ids = b"".join(map(self.memory.known.__getitem__, chunks))
            yield ids, " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) if self.decoded else ""


@lru_cache(maxsize=2)
def worker_encoder(path: str, encode: Callable[[Vocabulary, list[str]], list[bytes]] = encode_chunks, decoded: bool = True, most: int | None = None) -> Encoder:
    """The encoder of this Python worker: what it remembers serves all tasks that the worker gets."""
    return Encoder(path, encode, decoded, most)


class Counter:
    """Counts the tokens of batches of texts; remembers the counts of chunks."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.memory = _Memory(self.v, self._work)

    def _work(self, chunks: list[str]) -> list[int]:
        words = _WordCounts(self.v)
        return [words.chunk(c) for c in chunks]

    def __call__(self, texts: list[str]) -> Iterator[int]:
        return (sum(map(self.memory.known.__getitem__, chunks)) for chunks in self.memory(texts))


@lru_cache(maxsize=2)
def worker_counter(path: str) -> Counter:
    """The counter of this Python worker."""
    return Counter(path)


def encode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """Encode and decode every whole text of docs(doc_id, text).

    Returns doc_id, ids array<int> and decoded string, one row for each row of docs; with digests, instead of ids and
    decoded: n_tokens, ids_sha256, decoded_sha256. A null text counts as empty: no ids, decoded "". Null and repeated
    doc_ids pass through. Other columns of docs are not read. The vocabulary has no decoder, so the decoded text is its
    token strings with a space between, as the library gives it.
    """

    def start() -> Callable[[list[str]], list[tuple]]:
        encoder = worker_encoder(path) if digests else worker_encoder(path, most=WHOLE_CHUNKS)

        def of(texts: list[str]) -> list[tuple]:
            if digests:
                return [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) for ids, decoded in encoder(texts)]
            return [(np.frombuffer(ids, "<u4").astype(np.int32), decoded) for ids, decoded in encoder(texts)]

        return of

    if digests:
        return map_texts(docs, start, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return map_texts(docs, start, "ids array<int>, decoded string", WHOLE_ROWS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Decode encoded(doc_id, ids array<int>) into doc_id, decoded. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for batch in batches:
            decoded = [" ".join([tokens[i] for i in ids or ()]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("decoded", T.StringType())]))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Count the tokens of every whole text of docs(doc_id, text) without making any id.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row for each row of docs. A null text counts
    as empty. Null and repeated doc_ids pass through; other columns are not read.
    """

    def start() -> Callable[[list[str]], list[tuple]]:
        count = worker_counter(path)
        return lambda texts: [(len(t.encode()), n, n > limit) for t, n in zip(texts, count(texts), strict=True)]

    return map_texts(docs, start, "n_bytes long, n_tokens long, over_limit boolean")
