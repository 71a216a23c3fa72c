"""op2: near duplicates by bottom-k sketches.

One hash function; a document keeps the k smallest shingle hashes of its set. Inverted lists of retained values, each
taken with its successor in the sketch, bring documents together. Sketches of unions estimate the similarity of a
candidate pair, and the exact Jaccard similarity of the full sets decides.

A value that very many sketches retain (a passage that a third of all documents share) would make lists of documents
that have little else in common. Such hot values are left out of a sketch's keys, unless they are nearly half of it or
more: then the document consists of them, and its full sketch makes keys too. Two linked documents differ in a fifth of
their values at most, so at least one kind of key is made by both. Sets of at most SMALL values make full keys whenever they
hold a hot value: of u values in the union of two linked sets at most 0.2 u are not common, which breaks 0.4 u of the
u - 1 pairs of neighbours, so a key is surely shared. Of linked sets of which one is larger and keeps to cold keys, these
have enough pairs for the same count.

How sure a link is to be found: in the union of two linked sets ordered by hash, a share p of at least 0.8 is common to
both (of the cold values of documents with half hot ones, at least 0.64). No two neighbours among the first m are then
both common with a probability of 0.512 ** (m - 1), 2e-7 for m = 24 (0.693 ** (m - 1) for cold ones, 6e-7 for m = 40,
1e-5 where half of the sketch is hot).

Each list has a hub, and all lists of a hub make one group. The hub is compared with each member: the estimate of the
union sketch, which a linked pair misses with a probability of 4e-9, and the words themselves. Members of a group that
are in different components after that are compared with each other: overlaps counted from the inverted lists of the
group's retained values, the same estimate, and for the members that this leaves counts over their full sets. So full
sets travel once for each group in which a member is still in question, and never for lists that are settled.

exact=True adds what has no chances: all values are counted, each set is ordered by how few sets hold a value, and its
first n - ceil(percent n / 100) + 1 values make keys. Two linked sets always share one of them, so they meet in a group and are
compared by their full sets, unless they are in one component already. A value that no other set holds makes no list,
which leaves out every document of which fewer than percent of the values occur elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricgraph.llm.common import discard, keyed, own_ids, parallelism, possibly_among, release, stored, whole_rows
from metricgraph.operators.graph import reached

SKETCH = 64
#: A value is hot beyond so many sketches, or beyond this share of all: at most SKETCH / HOT_SHARE values are hot.
HOT_LEAST, HOT_SHARE = 200, 1 / 2000
#: Share of hot values from which the full sketch makes keys, and up to which the cold one does.
FULL_FROM, COLD_TO = 0.45, 0.7
#: Sets of at most so many values make full keys as soon as one value is hot: they are too small for chances.
SMALL = 16
#: Cold values and values at all that make keys.
COLD_VALUES, FULL_VALUES = 40, 24
#: Least estimate, as a share of the similarity asked for.
ESTIMATE = 0.625
#: Orders of members from which the lists' hubs are taken: a group that shares all its lists meets so many hubs.
HUBS = 6
#: Fills the rows of sketches shorter than k.
PAD = np.uint64(2**64 - 1)
#: Members of an inverted list that one task compares at once.
BLOCK = 1000
#: Distinct words whose hashes a worker remembers.
MAX_WORDS = 500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _hashes() -> _WordHashes:
    return _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, then what stands between ASCII white space (0x20, 0x09 to 0x0D)."""
    return text.encode().lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `size` words; of fewer words, the whole run; of none, nothing."""
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(one) - size + 1, np.uint64(size))
    for i in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + one[i : len(one) - size + 1 + i])
    return np.unique(out)


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    size = min(size, len(words))
    return set(zip(*(words[i:] for i in range(size)), strict=False)) if words else set()


def _sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(row_key, n_shingles, s1, s2, sketch): s1 and s2 name the set, as two sums over its hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                h = shingle_hashes(words_of(text), size)
                names = (h.sum(dtype=np.uint64), _mix(h).sum(dtype=np.uint64))
                rows.append((len(h), *(int(x.astype(np.int64)) for x in names), h[:k].astype(np.int64)))
            out = pd.DataFrame(rows, columns=["n_shingles", "s1", "s2", "sketch"])
            out.insert(0, "row_key", batch["row_key"].to_numpy())
            yield out

    return docs.select("row_key", "text").mapInPandas(run, "row_key long, n_shingles long, s1 long, s2 long, sketch array<long>")


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) that sizes and the sketch of the union leave. Unsigned order is kept by the sign bit."""
    flipped = F.transform("sketch", lambda x: x.bitwiseXOR(F.lit(-(2**63))))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    side = possibly_among(reps.select("rep", "n_shingles", "sketch"), "rep", ids).select("rep", "n_shingles", flipped.alias("s"))
    p = pairs.join(side.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("s").alias("sa")), "a")
    p = p.join(side.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("s").alias("sb")), "b")
    p = p.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    p = p.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    common = F.size(F.array_intersect("u", F.array_intersect("sa", "sb")))
    return p.filter(common * 100 >= F.size("u") * percent * ESTIMATE).select("a", "b")


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(row_key, text) of the documents whose row_key is among ids, which may repeat. The join is the same at every size."""
    return possibly_among(docs.select("row_key", "text"), "row_key", ids).join(ids.distinct().hint("merge"), "row_key")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    texts = stored(_chosen(docs, pairs.select(F.explode(F.array("a", "b")).alias("row_key"))), "candidates")
    joined = pairs.join(texts.select(F.col("row_key").alias("b"), F.col("text").alias("tb")), "b")
    joined = joined.join(texts.select(F.col("row_key").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sa = None, set()
        for batch in batches:
            kept = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
                if a != last:
                    last, sa = a, shingles(words_of(ta), size)
                sb = shingles(words_of(tb), size)
                both = len(sa & sb)
                kept.append(both > 0 and 100 * both >= percent * (len(sa) + len(sb) - both))
            yield batch.loc[kept, ["a", "b"]]

    return joined.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def _matrix(sketches: Iterable[np.ndarray], k: int) -> np.ndarray:
    out = np.full((len(sketches), k), PAD, np.uint64)
    for row, s in enumerate(sketches):
        out[row, : len(s)] = s.view(np.uint64)
    return out


def _keys(reps: DataFrame, k: int) -> DataFrame:
    """(key, rep): the entries of the inverted lists."""
    limit = max(HOT_LEAST, int(reps.count() * HOT_SHARE))
    held = reps.select(F.explode("sketch").alias("v")).groupBy("v").count().filter(F.col("count") > limit).select("v").collect()
    hot = np.sort(np.array([r["v"] for r in held], np.int64).view(np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sketch = _matrix(batch["sketch"], k)
            is_hot, real = np.isin(sketch, hot), sketch != PAD
            share = is_hot.sum(1) / np.maximum(real.sum(1), 1)
            full = (share >= FULL_FROM) | (is_hot.any(1) & (real.sum(1) <= SMALL))
            rep, parts = batch["rep"].to_numpy(), []
            for kind, keep, rows, most in ((1, real & ~is_hot, share <= COLD_TO, COLD_VALUES), (2, real, full, FULL_VALUES)):
                at, cols = np.nonzero(keep & rows[:, None] & (np.cumsum(keep, 1) <= most))
                value = sketch[at, cols]
                pair = np.flatnonzero(at[1:] == at[:-1])  # a value and the next one of the same row
                parts.append(pd.DataFrame({"key": _mix(_mix(value[pair] + np.uint64(kind)) + value[pair + 1]).view(np.int64), "rep": rep[at[pair]]}))
            yield pd.concat(parts)

    return reps.select("rep", "sketch").mapInPandas(run, "key long, rep long")


def _estimates(x: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the sketch of the union of x with each of the others: its values that both have, and its size."""
    both = np.sort(np.concatenate([np.broadcast_to(x, others.shape), others], 1), 1)
    twin = np.zeros(both.shape, bool)
    twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != PAD)
    rank = np.cumsum(~twin & (both != PAD), 1)
    return (twin & (rank <= k)).sum(1), np.minimum(rank[:, -1], k)


def _postings(values: np.ndarray, whose: np.ndarray, members: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each member the numbers of its values that others hold too; the members that hold value i are owner[first[i] : first[i + 1]]."""
    order = np.argsort(values, kind="stable")
    twin = np.append(False, values[order[1:]] == values[order[:-1]])
    shared = twin | np.append(twin[1:], False)
    owner, token = whose[order[shared]], np.cumsum(~twin[shared]) - 1
    first = np.append(np.flatnonzero(~twin[shared]), len(token))
    by_owner = np.argsort(owner, kind="stable")
    mine = np.append(0, np.cumsum(np.bincount(owner, minlength=members)))
    return [token[by_owner[s:e]] for s, e in zip(mine, mine[1:], strict=False)], owner, first


def _overlaps(own: np.ndarray, owner: np.ndarray, first: np.ndarray, members: int) -> np.ndarray:
    """How many of these values each member holds."""
    lists = [owner[s:e] for s, e in zip(first[own].tolist(), first[own + 1].tolist(), strict=True)]
    return np.bincount(np.concatenate(lists), minlength=members) if lists else np.zeros(members, np.int64)


Rows = dict[str, np.ndarray]


def _per_group(groups: DataFrame, of: Callable[[Rows], list[tuple[int, int]]], names: tuple[str, str]) -> DataFrame:
    """The pairs of numbers that `of` finds in each hub's group; of large groups, each pair of blocks meets.

    A task goes through its groups in order and holds one at a time, of two blocks at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch])
            rows = {c: batch[c].to_numpy() for c in batch}
            new = np.flatnonzero(np.any([np.diff(rows[c]) != 0 for c in ("hub", "i", "j")], 0)) + 1
            cut = [0, *new.tolist()]
            found = [p for s, e in zip(cut, cut[1:], strict=False) for p in of({c: v[s:e] for c, v in rows.items()})]
            rest = batch.iloc[cut[-1] :]
            yield pd.DataFrame(found, columns=list(names), dtype="int64")
        if rest is not None and len(rest):
            yield pd.DataFrame(of({c: rest[c].to_numpy() for c in rest}), columns=list(names), dtype="int64")

    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).select("*", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    dealt = dealt.drop("o", "members").repartition(parallelism(groups.sparkSession), "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return dealt.mapInPandas(run, f"{names[0]} long, {names[1]} long").distinct()


class _Group:
    """Members of one group: who is in another component, and who shares how many values with whom."""

    def __init__(self, rows: Rows, values: np.ndarray, whose: np.ndarray):
        self.rep, self.component, self.block, self.n = (rows[c] for c in ("rep", "component", "block", "n_shingles"))
        self.apart = rows["i"][0] != rows["j"][0]
        self.own, self.owner, self.first = _postings(values, whose, len(self.rep))

    def pairs(self, percent: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(x, others, values in common) for each member x outside the largest component.

        Others are in another component, of a size that allows a link, and share at least `least` of x and of their own.
        """
        names, sizes = np.unique(self.component, return_counts=True)
        done = np.zeros(len(self.rep), bool)
        for x in np.flatnonzero(self.component != names[sizes.argmax()]):
            done[x] = True
            if len(self.own[x]) < least[x]:
                continue  # even all that it shares with anyone would be too little
            both = _overlaps(self.own[x], self.owner, self.first, len(self.rep))
            y = ~done & (self.component != self.component[x]) & (both >= np.maximum(least, least[x]))
            y &= 100 * np.minimum(self.n, self.n[x]) >= percent * np.maximum(self.n, self.n[x])
            if self.apart:
                y &= self.block != self.block[x]
            y = np.flatnonzero(y)
            if len(y):
                yield x, y, both[y]


def _close(groups: DataFrame, percent: int, k: int) -> DataFrame:
    """(hub, rep) of the members that have another one in a different component so near that the union's sketch leaves the pair."""

    def of(rows: Rows) -> list[tuple[int, int]]:
        sketch = _matrix(rows["sketch"], k)
        group = _Group(rows, sketch[sketch != PAD], np.repeat(np.arange(len(sketch)), (sketch != PAD).sum(1)))
        close, least = np.zeros(len(sketch), bool), percent * ESTIMATE / 100
        looked = group.rep == rows["hub"][0]  # pairs with the hub have been looked at
        for x, y, _ in group.pairs(percent, least * np.minimum(group.n, k)):
            y = y[~(looked[y] | looked[x] | close[y] & close[x])]
            common, size = _estimates(sketch[x], sketch[y], k)
            y = y[common >= least * size]
            close[y] = True
            close[x] |= len(y) > 0
        return [(rows["hub"][0], r) for r in group.rep[close]]

    return _per_group(groups, of, ("hub", "rep"))


def _across(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between members in different components so far, by counts over the full sets of shingles.

    Of its links to one component a member gives the strongest alone, which is enough to join the two.
    """

    def of(rows: Rows) -> list[tuple[int, int]]:
        sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
        group = _Group(rows, np.concatenate(sets), np.repeat(np.arange(len(sets)), rows["n_shingles"]))
        rep, found = group.rep, set()
        for x, y, both in group.pairs(percent, percent * group.n / 100):
            share = both / (group.n[y] + group.n[x] - both)
            linked = 100 * both >= percent * (group.n[y] + group.n[x] - both)
            y, share = y[linked], share[linked]
            y = y[np.argsort(-share, kind="stable")]
            y = y[np.unique(group.component[y], return_index=True)[1]]
            found |= {(min(rep[x], rep[i]), max(rep[x], rep[i])) for i in y}
        return sorted(found)

    return _per_group(groups, of, ("a", "b"))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(rep, hashes): the full shingle sets of some documents, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rep": batch["row_key"], "hashes": [shingle_hashes(words_of(t), size).tobytes() for t in batch["text"]]})

    return docs.select("row_key", "text").mapInPandas(run, "rep long, hashes binary")


def _prefixes(full: DataFrame, percent: int) -> DataFrame:
    """(key, rep) of full(rep, n_shingles, hashes): the rarest values of each set, as many as two linked sets cannot both lack."""
    entries = full.select("rep", "n_shingles", F.explode("hashes").alias("key"))
    held = stored(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "held")
    shared = entries.join(held, "key").groupBy("rep", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("values"))
    # Values of no other set are the rarest, so they come first in the order and fill as many places.
    most = F.expr(f"cast(size(values) - (({percent} * n_shingles + 99) div 100) + 1 as int)")
    return shared.withColumn("most", most).filter("most > 0").select(F.explode(F.slice("values", 1, F.col("most"))).alias("v"), "rep").select("v.key", "rep")


def _lists(entries: DataFrame) -> DataFrame:
    """(rep, hub): the members of the inverted lists but for their hubs."""
    hubs = entries.groupBy("key").agg(_hub(), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    return entries.join(hubs, "key").filter("rep <> hub").select("rep", "hub").distinct()


def _groups(grouped: DataFrame, found: DataFrame) -> DataFrame:
    """(rep, hub, component, members) of the groups whose members are in several of the components found so far."""
    groups = grouped.union(grouped.select(F.col("hub").alias("rep"), "hub").distinct())
    return _mixed(groups.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))


def _missed(docs: DataFrame, reps: DataFrame, found: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links between components found so far, enough to join all that belong together; none is left to chance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [shingle_hashes(words_of(t), shingle).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"rep": batch["row_key"], "n_shingles": [len(h) for h in hashes], "hashes": hashes})

    full = _chosen(docs, reps.select(F.col("rep").alias("row_key"))).select("row_key", "text")
    full = stored(full.mapInPandas(run, "rep long, n_shingles long, hashes array<long>"), "full")
    grouped = stored(_lists(stored(_prefixes(full, percent), "prefixes")), "pairs")
    groups = stored(_groups(grouped, found), "groups")
    return _verified(stored(_across(groups.join(full.hint("merge"), "rep"), percent), "pairs"), docs, shingle, percent)


def _hub() -> Column:
    """The hub of a list, as an aggregate: one of HUBS orders of the members, chosen by the key, names its first member."""
    order = F.xxhash64("rep", F.pmod(F.xxhash64("key"), F.lit(HUBS)))
    return F.min(F.struct(order, "rep"))["rep"].alias("hub")


def _mixed(groups: DataFrame) -> DataFrame:
    """The groups whose members are in several components, with the number of members."""
    several = groups.groupBy("hub").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("members"))
    return groups.join(several.filter("c0 <> c1").select("hub", "members"), "hub")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = SKETCH, exact: bool = False) -> DataFrame:
    """Link docs(doc_id, text) whose word shingle sets have 100 * intersection >= percent * union.

    Returns row_key, doc_id, n_shingles, component (smallest row_key that links reach), kept (row_key = component), one
    row for each row of docs. row_key is doc_id where ids are unique and not null; see common.keyed for the rest: each
    repeated row is a document of its own. Texts that are null or without words have no shingles and link with nothing.
    Equal sets are one class before any pair is made, so copies cost no pairs; other columns of docs are not read.
    exact leaves no link to the chances that the module names (equal 64-bit hashes of different shingles apart); it
    shuffles all values of all distinct sets twice.
    """
    docs = keyed(docs)
    sketches = stored(_sketches(docs, shingle, k), "sketches")
    name = ["s1", "s2", "n_shingles"]
    reps = sketches.filter("n_shingles > 0").groupBy(*name).agg(F.min("row_key").alias("rep"), F.first("sketch").alias("sketch"))
    reps = stored(reps, "classes")
    members = sketches.select("row_key", *name).join(reps.select(*name, "rep").hint("merge"), name, "left")
    members = stored(members.select("row_key", "n_shingles", "rep"), "members")
    discard(sketches)

    # Inverted lists. Each has a hub, with which each other member is paired.
    grouped = stored(_lists(_keys(reps.filter("n_shingles > 1"), k)), "pairs")
    release(docs.sparkSession)
    pairs = grouped.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    links = stored(_verified(stored(_estimated(pairs, reps, percent, k), "estimated"), docs, shingle, percent), "links")
    found = reached(links)

    # Members of a hub's lists that are in different components still are compared with each other: by their sketches,
    # and those that are near another one by their full sets.
    groups = stored(_groups(grouped, found).filter("members > 2"), "groups")
    sides = possibly_among(reps.select("rep", "n_shingles", "sketch"), "rep", groups.select("rep"))
    close = stored(_close(groups.join(sides.hint("merge"), "rep"), percent, k), "close")
    groups = _mixed(groups.drop("members").join(close, ["hub", "rep"]).join(reps.select("rep", "n_shingles").hint("merge"), "rep"))
    sets = stored(_sets(_chosen(docs, close.select(F.col("rep").alias("row_key"))), shingle), "sets")
    more = stored(_verified(stored(_across(groups.join(sets.hint("merge"), "rep"), percent), "pairs"), docs, shingle, percent), "links")
    if not more.isEmpty():
        links = links.union(more)
        found = reached(links)
    if exact:
        missed = stored(_missed(docs, reps, found, shingle, percent), "links")
        if not missed.isEmpty():
            found = reached(links.union(missed))

    release(docs.sparkSession)
    out = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep", "row_key"))
    out = out.select("row_key", "n_shingles", "component", (F.col("component") == F.col("row_key")).alias("kept"))
    return docs.select("row_key", "doc_id").join(out, "row_key")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """docs with one row of each group of near duplicates, the one with the smallest (doc_id, text).

    All columns of docs stay. Of rows that repeat both doc_id and text one is kept. Texts without words, null ones too,
    all stay; an empty table stays empty. exact is near_duplicates' own.
    """
    found = stored(near_duplicates(docs, shingle, percent, exact=exact).select("row_key", "doc_id", "kept"), "kept")
    rows = docs.select(whole_rows(docs).alias("row"))
    if own_ids(found):
        gone = found.filter("not kept").select(F.col("doc_id").alias("gone"))
        return rows.join(gone.hint("merge"), F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")
    kept = keyed(docs).join(found.filter("kept").select("row_key"), "row_key").select("doc_id", "text").distinct()
    one = docs.dropDuplicates(["doc_id", "text"]).select(whole_rows(docs).alias("row"))
    return one.join(kept, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.coalesce("row.text", F.lit("")) == F.col("text")), "left_semi").select("row.*")
