"""op5: token ids in sorted-string-table shards.

A shard file is a run of blocks, an index, a Bloom filter and a footer, all little-endian:

    block   size of the entries u32, the entries compressed as zstd. entry: shared u16, rest u16, n u32, the key's last `rest` bytes, n ids as u16 or u32
            (the key's first `shared` bytes are those of the key before it; the first entry of a block shares none)
    index   for each block: size of its first key u16, the key, offset u64, size u32, ids before it in the shard u64
    bloom   bits of a filter over all keys, BLOOM_HASHES positions for each
    footer  index offset u64, index size u64, bloom offset u64, bloom size u64, blocks u64, keys u64, ids u64,
            bytes in an id u8, 7 zero bytes, MAGIC

A key is the doc_id as 8 big-endian bytes with the sign bit flipped, so that bytes sort as numbers. A lookup reads the
footer, asks the filter, searches the index by halves and reads one block.

Tasks write files of their own names; the manifest table lists the files of the attempts that succeeded, so that a
repeated task leaves at most an unlisted file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricgraph.llm.common import END_ID, parallelism, shared_folder, stored
from metricgraph.llm.ranges import part_of, row_splitters
from metricgraph.llm.tokens import worker_encoder
from metricgraph.llm.wordbpe import END, Vocabulary, vocabulary

MAGIC = b"SSTIDS02"
FOOTER = struct.Struct("<7QB7x8s")
ENTRY = struct.Struct("<HHI")
BLOCK_BYTES = 128 * 1024
ZSTD = pa.Codec("zstd", 1)
BLOOM_BITS, BLOOM_HASHES = 10, 7
MANIFEST = "part int, path string, first_key long, last_key long, n_docs long, n_ids long, keyless boolean"


def key_bytes(doc_id: int) -> bytes:
    return struct.pack(">Q", doc_id + 2**63)


def _positions(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh3_64_intdigest(key), xxhash.xxh3_64_intdigest(key, 1) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


@dataclass
class ShardWriter:
    """Writes records in ascending key order. Equal keys may follow one another. Holds one block and the index."""

    path: str
    id_bytes: int
    offset: int = 0
    ids: int = 0
    keys: list[bytes] = field(default_factory=list)
    index: list[bytes] = field(default_factory=list)
    block: list[bytes] = field(default_factory=list)
    size: int = 0
    before: int = 0
    first: bytes = b""
    last: bytes = b""

    def __post_init__(self) -> None:
        system, name = _open(self.path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(name)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        key = key_bytes(doc_id)
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.before = key, self.ids
        data = ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype(f"<u{self.id_bytes}").tobytes()
        self.block.append(data)
        self.size += len(data)
        self.ids += len(ids)
        self.last = key
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = b"".join(self.block)
            data = struct.pack("<I", len(data)) + ZSTD.compress(data, asbytes=True)
            self.index.append(struct.pack("<H", len(self.first)) + self.first + struct.pack("<QIQ", self.offset, len(data), self.before))
            self.out.write(data)
            self.offset += len(data)
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in _positions(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.out.write(index + bloom.tobytes())
        self.out.write(FOOTER.pack(self.offset, len(index), self.offset + len(index), len(bloom), len(self.index), len(self.keys), self.ids, self.id_bytes, MAGIC))
        self.out.close()


class ShardReader:
    """Reads a shard block by block, or one document by its key."""

    def __init__(self, path: str):
        system, name = _open(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        self.at, n, self.bloom_at, self.bloom_size, self.blocks, self.n_keys, self.n_ids, self.id_bytes, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard file")
        data, p, self.index = self._read(self.at, n), 0, []
        for _ in range(self.blocks):
            k = struct.unpack_from("<H", data, p)[0]
            self.index.append((data[p + 2 : p + 2 + k], *struct.unpack_from("<QIQ", data, p + 2 + k)))
            p += 2 + k + 20

    def _read(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def block(self, i: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, ids before it in the shard, ids) of a block's entries."""
        _, offset, size, before = self.index[i]
        data, p, key = self._read(offset, size), 0, b""
        data = ZSTD.decompress(data[4:], struct.unpack_from("<I", data)[0], asbytes=True)
        while p < len(data):
            shared, rest, n = ENTRY.unpack_from(data, p)
            p += ENTRY.size
            key = key[:shared] + data[p : p + rest]
            ids = np.frombuffer(data, f"<u{self.id_bytes}", n, p + rest)
            p += rest + n * self.id_bytes
            yield int.from_bytes(key, "big") - 2**63, before, ids
            before += n

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for i in range(self.blocks):
            yield from self.block(i)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document of that id, in order; an empty list if there is none."""
        key = key_bytes(doc_id)
        bits = max(64, BLOOM_BITS * self.n_keys)
        bloom = self._read(self.bloom_at, self.bloom_size)
        if not all(bloom[p >> 3] >> (p & 7) & 1 for p in _positions(key, bits)):
            return []
        firsts = [x[0] for x in self.index]
        i = bisect_right(firsts, key) - 1
        while i > 0 and firsts[i] == key:  # an id that repeats may begin in the block before
            i -= 1
        out: list[np.ndarray] = []
        while 0 <= i < self.blocks and firsts[i] <= key:
            out += [ids for d, _, ids in self.block(i) if d == doc_id]
            i += 1
        return out

    def close(self) -> None:
        self.file.close()


def library_chunks(v: Vocabulary, chunks: list[str]) -> list[bytes]:
    """Ids of each chunk by the tokenizers library, which gets each distinct word once, a few thousand words as one text.

    White space ends words, and only the last token of a word has the end mark, so ids are dealt to words by it. Exact
    pieces (of chunks that begin with a space) may hold anything and go to the library as single words.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
    tokenizer, ends = _tokenizer(v.path)
    ids = {f" {w}": np.array([i], "<u4").tobytes() for w, i in v.special.items()}
    cut: dict[str, list[str]] = {}
    words: set[str] = set()
    for c in chunks:
        if c.isalpha():  # one word
            words.add(c)
        elif c[0] != " ":
            cut[c] = pieces = v.pieces(c)
            words.update(pieces)
        elif c not in ids:
            ids[c] = np.array(tokenizer.encode([c[1:]], is_pretokenized=True, add_special_tokens=False).ids, "<u4").tobytes()
    listed = list(words)
    parts = [listed[i : i + 2048] for i in range(0, len(listed), 2048)]
    for part, made in zip(parts, tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
        found = np.array(made.ids, "<u4")
        data, stops = found.tobytes(), (4 * (np.flatnonzero(ends[found]) + 1)).tolist()
        ids.update(zip(part, [data[s:e] for s, e in zip([0, *stops], stops, strict=False)], strict=True))
    of = ids.__getitem__
    return [b"".join(map(of, cut[c])) if c in cut else of(c) for c in chunks]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple:
    """The library's tokenizer for chunks, special strings having been cut out before; and which ids end a word."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return tokenizer, np.array([t.endswith(END) for t in vocabulary(path).tokens])


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int | None = END_ID, parts: int | None = None) -> DataFrame:
    """Encode docs(doc_id, text) and write one shard for each range of doc_ids under folder, a path all executors share.

    Returns the manifest: part, path, first_key, last_key, n_docs, n_ids, keyless, one row for each shard in ascending order.
    Null texts count as empty; rows that repeat an id follow one another by text. Rows without an id have no key to be
    found by: they lie in a shard of their own, part 0, which the manifest marks keyless. Ids are cast to long. An empty table
    writes nothing. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    tops = row_splitters(docs, "key", parts or parallelism(docs.sparkSession))
    part = F.when(F.col("key").isNull(), 0).otherwise(part_of(F.col("key"), tops) + 1)
    docs = docs.select(part.alias("part"), F.coalesce("key", F.lit(-(2**63))).alias("key"), "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(path, library_chunks, False)
        wide = 2 if max(len(vocabulary(path).tokens) - 1, end_id or 0) < 2**16 else 4
        writer, row = None, []
        for batch in batches:
            for part, key, (ids, _) in zip(batch["part"], batch["key"], encoder(batch["text"].tolist()), strict=True):
                if writer is None:
                    name = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.sst"
                    writer, row = ShardWriter(name, wide), [int(part), name, int(key)]
                ids = np.frombuffer(ids, "<u4")
                writer.add(int(key), ids if end_id is None else np.append(ids, np.uint32(end_id)))
        if writer is not None:
            last = int.from_bytes(writer.last, "big") - 2**63
            writer.close()
            yield pd.DataFrame([[*row, last, len(writer.keys), writer.ids, row[0] == 0]], columns=["part", "path", "first_key", "last_key", "n_docs", "n_ids", "keyless"])

    # A range is one partition, so that its task writes one file.
    dealt = docs.repartitionById(len(tops) + 2, "part").sortWithinPartitions("key", "text")
    return stored(dealt.select("part", "key", "text").mapInPandas(write, MANIFEST), "manifest").orderBy("part")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, read back from the files.

    The driver holds one row for each shard; ids stay in the tasks.
    """
    shards = manifest.orderBy("part").collect()
    if not shards:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    starts = np.cumsum([0, *(r["n_ids"] for r in shards)]).tolist()
    rows = [(i, r["path"], s, r["keyless"]) for i, (r, s) in enumerate(zip(shards, starts, strict=False))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, keyless in zip(batch["path"], batch["start"], batch["keyless"], strict=True):
                shard = ShardReader(path)
                for i in range(shard.blocks):
                    entries = [(d, start + b, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, b, ids in shard.block(i)]
                    yield pd.DataFrame(entries, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).assign(keyless=keyless)
                shard.close()

    listed = spark.createDataFrame(rows, "shard int, path string, start long, keyless boolean").repartitionById(len(rows), "shard")
    out = listed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, keyless boolean")
    return out.withColumn("doc_id", F.when(~F.col("keyless"), F.col("doc_id"))).drop("keyless")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write docs as shards into a new shared folder and read them back."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, shared_folder(spark, "shards"), path))
