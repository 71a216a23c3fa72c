"""What the corpus operators share: reading tables, written tables between jobs, unique document keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from metricgraph.functions.storage import discard, possibly_among, release, shared_folder, stored  # noqa: F401

#: Word vocabulary of the public tokenizers, and the id that op5 appends to each document.
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Rows that a task works on at a time.
ROWS = 1_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a vocabulary file of the public tokenizers lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row_key): row_key is unique, never null and ordered as (doc_id with nulls first, text).

    doc_id must be an integer; other kinds of ids are for the caller to number.

    It is doc_id itself wherever ids are unique and not null, which one small aggregation over the id column finds out.
    Otherwise rows are sorted once and numbered, so that each repeated row remains a document of its own.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.groupBy("doc_id").count()
    if ids.filter("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("row_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))
    ordered = stored(docs.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    return ordered.select("doc_id", "text", "row_key")


def quoted(name: str) -> str:
    """A column's name as Spark reads it back, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def whole_rows(docs: DataFrame, *but: str) -> Column:
    """A struct of all columns of docs apart from some."""
    return F.struct(*(docs[quoted(c)] for c in docs.columns if c not in but))


def own_ids(keyed_docs: DataFrame) -> bool:
    """Whether row_key is doc_id in every row, so that doc_id alone names a row."""
    return keyed_docs.filter("row_key is distinct from doc_id").isEmpty()


def map_texts(docs: DataFrame, start: Callable[[], Callable[[list[str]], list[tuple]]], fields: str, most: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id as it is, and the fields that the started function gives for its text.

    start() runs once for each task, its function once for each batch of at most `most` rows. Null texts come as empty
    strings. A worker outlives its task by a minute, so the memory of Arrow's batches is given back at the end.
    """
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([docs.schema["doc_id"], *made.fields])
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for whole in batches:
            for at in range(0, whole.num_rows, most):  # what is made for a batch can be many times its size
                batch = whole.slice(at, most)
                rows = of([t or "" for t in batch.column("text").to_pylist()])
                columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *arrow.names])
        whole = batch = rows = columns = None
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
