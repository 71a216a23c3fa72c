"""The word vocabulary: normalising and cutting a text into words, and two ways to merge the words' bytes.

The file names the rules (NFC, one space for white space, lower case, a word pattern, bytes as symbols, "</w>" at a
word's end); they are applied here, so that each distinct word of a batch is merged once.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: The word pattern of the vocabulary file, for all of Unicode and for ASCII in lower case.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+")
END = "</w>"
#: Characters that Python's split() takes for white space and the vocabulary doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
BEYOND_BMP = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=1)
def _newer() -> tuple[re.Pattern, re.Pattern]:
    """Characters that this Python's tables do not hold yet but that the regex module calls letters or numbers.

    Two patterns, up to U+FFFF and beyond: the first is one table lookup for each character.
    """
    named = regex.compile(r"[\p{L}\p{N}]")
    found = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and named.match(chr(c))]
    ranges = ([], [])
    for c in found:
        own: list[list[int]] = ranges[c > 0xFFFF]
        if own and own[-1][1] == c - 1:
            own[-1][1] = c
        else:
            own.append([c, c])
    return tuple(re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in own) + "]" if own else "(?!)") for own in ranges)


def _has_newer(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        low, high = _newer()
        return bool(low.search(text) or BEYOND_BMP.search(text) and high.search(text))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 256
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b], free = chr(free), free + 1
    return out


class Vocabulary:
    """Symbols and merges of a vocabulary file, as arrays for batches and as a dictionary for single words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.path = path
        ids: dict[str, int] = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        symbols = byte_symbols()
        self.byte = {s: b for b, s in enumerate(symbols)}
        self.first = np.array([ids[s] for s in symbols], np.int32)
        self.last = np.array([ids[s + END] for s in symbols], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        # A batch may apply ranks in ascending order only if a merge never makes a pair of a lower rank.
        born = {int(c): r for r, c in enumerate(self.made)}
        if len(born) != len(merges) or any(born.get(int(x), -1) >= r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True)) for x in (a, b)):
            raise ValueError(f"{path}: merges are not in the order in which their symbols are made")
        pairs = self.left << 32 | self.right
        order = np.argsort(pairs)
        self.pairs, self.rank_of = np.append(pairs[order], np.int64(2**62)), np.append(order, -1)
        self.ranks = {int(p): r for r, p in enumerate(pairs)}
        self.first_of, self.last_of, self.made_of = self.first.tolist(), self.last.tolist(), self.made.tolist()
        self._library = None

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, -1 where the two never merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.rank_of[at], -1)

    def chunks(self, text: str) -> list[str]:
        """What stands between white space, normalised, in order; a chunk that begins with a space is one exact piece.

        No word spans white space, so texts are cut there first and only distinct chunks see the word pattern.
        """
        if "<|" not in text:
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [f" {part}"] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if any(c in text for c in SEPARATORS) or _has_newer(text):  # the library's tables decide
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path)
            cut = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
            return [" " + bytes(self.byte[c] for c in w).decode() for w, _ in cut]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower().split()

    def pieces(self, chunk: str) -> list[str]:
        """The words of a chunk."""
        if chunk[0] == " ":
            return [chunk[1:]]
        if chunk.isalpha():  # letters alone are one word
            return [chunk]
        return (ASCII_WORDS if chunk.isascii() else WORDS).findall(chunk)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(v: Vocabulary, words: list[str]) -> list[np.ndarray]:
    """Ids of each word, all words together, by a pair occurrence index.

    The index maps each pair (by its rank) to all its positions in the batch. Active ranks are applied in ascending
    order; a merge at a position puts the two new neighbouring pairs into the lists of their ranks.
    """
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data)
    symbol = v.first[data]
    symbol[ends - 1] = v.last[data[ends - 1]]
    following = np.arange(1, n + 1, dtype=np.int32)
    following[ends - 1] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[ends - sizes] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(positions: np.ndarray) -> None:
        rank = v.ranks_of(symbol[positions], symbol[following[positions]])
        known = rank >= 0
        if not known.any():
            return
        positions, rank = positions[known], rank[known]
        order = np.argsort(rank, kind="stable")
        positions, rank = positions[order], rank[order]
        starts = np.flatnonzero(np.diff(rank, prepend=-1)).tolist()
        for s, e in zip(starts, [*starts[1:], len(rank)], strict=True):
            r = int(rank[s])
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(positions[s:e])

    add(np.flatnonzero(following >= 0).astype(np.int32))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b = v.left[r], v.right[r]
        after = following[at]
        at = at[(symbol[at] == a) & (after >= 0) & (symbol[after] == b)]
        if len(lists) > 1:
            at = np.unique(at, sorted=True)
        if a == b and len(at) > 1:  # of overlapping positions, from the left every second one
            chained = np.append(False, following[at[:-1]] == at[1:])
            where = np.arange(len(at))
            run = np.maximum.accumulate(np.where(chained, 0, where))
            at = at[(where - run) % 2 == 0]
        if not len(at):
            continue
        gone = following[at]
        symbol[at], symbol[gone] = v.made[r], -1
        beyond = following[gone]
        following[at] = beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        previous = before[at]
        add(np.unique(np.concatenate([previous[previous >= 0], at[has]])))
    if not n:
        return []
    kept = symbol >= 0
    ids, stops = symbol[kept].astype(np.uint32), np.cumsum(np.add.reduceat(kept, ends - sizes)).tolist()
    return [ids[s:e] for s, e in zip([0, *stops], stops, strict=False)]


def count_word(v: Vocabulary, word: str) -> int:
    """Tokens of one word: its symbols less the merges, by a heap of adjacent pairs over a linked list."""
    data = word.encode()
    n = len(data)
    symbol = [*map(v.first_of.__getitem__, data[:-1]), v.last_of[data[-1]]]
    following, before = [*range(1, n), -1], [*range(-1, n - 1)]
    ranks = v.ranks
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(symbol[i] << 32 | symbol[i + 1])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        r, i = heapq.heappop(heap)
        j = following[i]
        if symbol[i] < 0 or j < 0 or ranks.get(symbol[i] << 32 | symbol[j]) != r:
            continue  # one of the two is gone since
        merges += 1
        symbol[i], symbol[j] = v.made_of[r], -1
        k = following[i] = following[j]
        if k >= 0:
            before[k] = i
            if (q := ranks.get(symbol[i] << 32 | symbol[k])) is not None:
                heapq.heappush(heap, (q, i))
        h = before[i]
        if h >= 0 and (q := ranks.get(symbol[h] << 32 | symbol[i])) is not None:
            heapq.heappush(heap, (q, h))
    return n - merges
