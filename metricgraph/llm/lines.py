"""op3: near-duplicate lines by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared as sequences of words, the strings between single spaces. The edit bound is one word (inserted, deleted
or replaced) for lines of at least NEAR_WORDS words and none for shorter ones, which go when they repeat exactly. Blank
lines stay. Every line whose first or last half occurs in another distinct line
emits all its deletion variants as hashed keys: two lines are within the bound exactly if they share a variant with the
same position left out, or one is a variant of the other. Found pairs are verified on their words.

Only distinct lines take part, and a group of equal variants is never paired: each member meets the group's earliest
line alone, which is enough to know whether an earlier line exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricgraph.llm.common import discard, keyed, own_ids, possibly_among, quoted, release, stored, whole_rows

#: Lines of fewer words than this are removed only when they repeat exactly: one word would be more than a quarter of them.
NEAR_WORDS = 4
#: What names a line: its document and its number in it, from 0.
PLACE = ["row_key", "line"]


def _count(line: Column) -> Column:
    """Words of a line: what stands between single spaces."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _half(line: Column, n: Column, last: bool) -> Column:
    """Hash of the first or last (n - 1) div 2 words, n being the word count of the shorter line of a pair."""
    size = F.floor((n - 1) / 2).cast("int")
    return F.xxhash64(F.lit(int(last)), n, F.call_function("substring_index", line, F.lit(" "), -size if last else size))


def _variants(worded: DataFrame) -> DataFrame:
    """(row_key, line, gone, key): each word left out in turn (gone from 1), and the whole line (gone 0).

    A word's hash holds its place in the variant. The key is the exclusive or of the hashes before the gap and, one
    place further left, behind it, taken from running sums over the line's words, so a line costs its length.
    """
    spread = worded.repartition(*PLACE).select(*PLACE, F.posexplode("words").alias("at", "word"))
    spread = spread.select(*PLACE, "at", F.xxhash64("word", "at").alias("a"), F.xxhash64("word", F.col("at") - 1).alias("b"))
    spread = spread.selectExpr(
        *PLACE, "at", "a",
        "bit_xor(a) over (partition by row_key, line order by at rows between unbounded preceding and current row) as upto",
        "bit_xor(b) over (partition by row_key, line order by at rows between unbounded preceding and current row) as upto_b",
        "bit_xor(a) over (partition by row_key, line) as whole", "bit_xor(b) over (partition by row_key, line) as whole_b",
    )
    made = F.array(F.struct((F.col("at") + 1).alias("gone"), F.expr("upto ^ a ^ whole_b ^ upto_b").alias("key")))
    made = F.when(F.col("at") == 0, F.concat(made, F.array(F.struct(F.lit(0).alias("gone"), F.col("whole").alias("key"))))).otherwise(made)
    return spread.select(*PLACE, F.inline(made))


def _near(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(h1, h2) of distinct lines within one word of an earlier distinct line; lines has h1, h2, row_key, line, halves."""
    halves = lines.filter(F.col("halves").isNotNull()).select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    some = halves.join(shared.hint("merge"), "half").select("h1").distinct()
    open_ = stored(some.join(lines.filter(F.col("halves").isNotNull()).select("h1", "h2", *PLACE).hint("merge"), "h1"), "open")
    release(docs.sparkSession)

    # The words of those lines, from the documents in which they occur first.
    # (Merge joins at every size: how many documents are meant is not known beforehand.)
    places = open_.groupBy("row_key").agg(F.collect_list("line").alias("places"))
    text = possibly_among(docs.select("row_key", "text"), "row_key", places).join(places.hint("merge"), "row_key")
    text = text.withColumn("split", F.split("text", "\n")).select("row_key", "split", F.explode("places").alias("line"))
    worded = stored(text.select(*PLACE, F.split(F.element_at("split", F.col("line") + 1), " ").alias("words")), "worded")
    release(docs.sparkSession)

    # Keys that two variants share; what follows is about those few rows.
    every = stored(_variants(worded), "variants")
    twice = every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    variants = stored(possibly_among(every, "key", twice).join(twice.hint("merge"), "key"), "shared")
    discard(every)
    gone, whole = variants.filter("gone > 0"), variants.filter("gone = 0")

    # Same position left out: replaced words. A whole line against variants: inserted or deleted words.
    member, later = F.min(F.struct(*PLACE, "gone")).alias("e"), F.struct(*PLACE) > F.struct("e.row_key", "e.line")
    pair = [*PLACE, "gone", F.col("e.row_key").alias("e_key"), F.col("e.line").alias("e_line"), F.col("e.gone").alias("e_gone")]
    replaced = gone.join(gone.groupBy("key", "gone").agg(member), ["key", "gone"])
    inserted = whole.join(gone.groupBy("key").agg(member), "key")
    deleted = gone.join(whole.groupBy("key").agg(member), "key")
    pairs = stored(replaced.filter(later).select(*pair).union(inserted.filter(later).select(*pair)).union(deleted.filter(later).select(*pair)).distinct(), "pairs")

    # Verified on the words themselves: what is left of both lines is equal.
    def rest(words: str, gone: str) -> Column:
        w, g = F.col(words), F.col(gone)
        return F.when(g == 0, w).otherwise(F.concat(F.slice(w, F.lit(1), F.greatest(g - 1, F.lit(0))), F.slice(w, g + 1, F.size(w))))

    meant = possibly_among(worded, "row_key", pairs.select("row_key").union(pairs.select("e_key")))
    own = meant.select(*PLACE, F.col("words").alias("w"))
    other = meant.select(F.col("row_key").alias("e_key"), F.col("line").alias("e_line"), F.col("words").alias("ew"))
    checked = pairs.join(own, PLACE).join(other, ["e_key", "e_line"]).filter(rest("w", "gone") == rest("ew", "e_gone"))
    near = stored(checked.select(*PLACE).distinct().join(open_, PLACE).select("h1", "h2").distinct(), "near")
    discard(open_, worded, variants, pairs)
    return near


def repeated_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(row_key, gone) of docs as keyed(): the numbers of the lines (from 0) that an earlier line repeats.

    Earlier is by (row_key, line number) over the whole table; near repeats are judged on the input's lines. Documents
    that lose no line have no row.
    """
    split = docs.select("row_key", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    split = split.withColumn("n", _count(F.col("body"))).filter(F.col("body").rlike(r"[^ \t\x0B\f\r]"))
    n, body = F.col("n"), F.col("body")
    # A pair's shorter line has n or n - 1 words. Two hashes of different seeds name a line.
    halves = F.array(*(_half(body, k, last) for k in (n, n - 1) for last in (False, True)))
    names = [F.xxhash64(F.lit(i), body).alias(f"h{i + 1}") for i in range(2)]
    occurrence = stored(split.select(*PLACE, *names, F.when(n >= near_words, halves).alias("halves")), "occurrences")
    lines = occurrence.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first"), F.first("halves").alias("halves"), F.count("*").alias("times"))
    lines = stored(lines.select("h1", "h2", "first.*", "halves", "times"), "lines")
    release(docs.sparkSession)
    near = _near(lines, docs)
    # Only lines that repeat, or that are near another, have anything to remove.
    decided = lines.select("h1", "h2", F.struct(*PLACE).alias("first"), "times").join(near.withColumn("near", F.lit(True)).hint("merge"), ["h1", "h2"], "left")
    decided = decided.filter("times > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    repeats = possibly_among(occurrence.select(*PLACE, "h1", "h2"), "h1", decided).join(decided.hint("merge"), ["h1", "h2"])
    repeats = repeats.filter(F.col("near") | (F.struct(*PLACE) != F.col("first")))
    gone = stored(repeats.groupBy("row_key").agg(F.array_sort(F.collect_set("line")).alias("gone")), "gone")
    discard(occurrence, lines, near)
    release(docs.sparkSession)
    return gone


def _kept(text: str, gone: str) -> Column:
    """The text without its lines of those numbers; a text that loses none stays as it is, null included."""
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(gone, i))
    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))


def line_report(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """Deduplicate the lines of docs(doc_id, text), keeping the earliest of each group.

    Returns doc_id, n_lines, n_removed, kept_sha256 (of the text that is left), one row for each row of docs. A null or
    empty text is one empty line. Blank lines are never removed. Repeated rows are documents of their
    own, the later ones lose their lines; rows without id come first. Other columns are not read.
    """
    docs = keyed(docs)
    out = docs.join(repeated_lines(docs, near_words).hint("merge"), "row_key", "left")
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    n_removed = F.coalesce(F.size("gone"), F.lit(0))
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"), F.sha2(_kept("text", "gone"), 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with repeated lines taken out of text, with all columns of docs. Documents that lose a line and have
    nothing but white space left go.

    A text that loses no line stays as it is, nulls included. Rows with the same doc_id and text share a decision: the
    one of their first.
    """
    own = keyed(docs)
    gone = repeated_lines(own, near_words)
    rows = docs.select(whole_rows(docs).alias("row"), F.col("doc_id").alias("id"), "text")
    if own_ids(own):
        out = rows.join(gone.withColumnRenamed("row_key", "id").hint("merge"), "id", "left")
    else:
        first = own.groupBy("doc_id", "text").agg(F.min("row_key").alias("row_key")).join(gone, "row_key").select(F.col("doc_id").alias("g_id"), F.col("text").alias("g_text"), "gone")
        out = rows.join(first, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("text") == F.col("g_text")), "left")
    out = out.select("row", "gone", _kept("text", "gone").alias("left")).filter(F.col("gone").isNull() | F.col("left").rlike(r"[^ \t\n\x0B\f\r]"))
    return out.select(*(F.col("left" if c == "text" else f"row.{quoted(c)}").alias(c) for c in docs.columns))
