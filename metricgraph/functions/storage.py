"""Written tables between the jobs of one operator, and a bounded filter of rows before a join."""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter in possibly_among, and bits in each of its rows: it never has more than BITS / WORD rows.
BITS, WORD = 1 << 23, 64

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting (as in tests) gets a local folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose plans nobody holds any more.

    Its cleaner learns of them only when the driver's collectors run, which a driver with little to do may not do for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends here, on any executor."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() has written, once all that was made from them has been written too."""
    for t in tables:
        spark, path = t.sparkSession, _paths.pop(t)
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def parts_for(spark: SparkSession, rows: int, each: int = 250_000) -> int:
    """Partitions of about `each` rows, Spark's own number at least: a task's memory does not grow with the table then."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def possibly_among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key occurs in wanted's column of the same name, and few others: to be used before a join.

    One bit for each hash of a wanted key goes to all tasks, BITS of them at most (BITS / WORD rows), however many keys
    there are: with far more keys than bits the filter lets everything pass, and the join does all the work.
    """
    word, place = f"pmod(xxhash64(`{key}`), {BITS}) div {WORD} as _word", f"cast(pmod(xxhash64(`{key}`), {WORD}) as int)"
    words = wanted.selectExpr(word, f"shiftleft(1L, {place}) as _bit").groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = rows.selectExpr("*", word).join(F.broadcast(words), "_word")
    return held.filter(f"shiftrightunsigned(_bits, {place}) & 1L = 1L").select(*rows.columns)
