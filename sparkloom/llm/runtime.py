"""What the operators of this subpackage share: cutting lineage in the shared folder, and ranks without one-task windows."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where the driver found it by its own sys.path, and keep batches small.

    This stays with the session: PYTHONPATH of its workers, which take their memory from malloc (so `lean` can give it back),
    and Arrow batches of 500 rows and 4 MB, unless its own settings differ from Spark's defaults; whole texts are long.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
        env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
        env.setdefault("MALLOC_ARENA_MAX", "1")
    for key, default, own in (("maxRecordsPerBatch", "10000", "500"), ("maxBytesPerBatch", "67108864", "4194304")):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, default) in (default, "67108864b", "64MB"):
            spark.conf.set(name, own)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow that gives the worker's free memory back when a task ends: workers wait for tasks of other stages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a libc without it
            pass

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, or a temporary one on a local master only."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
            spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        _folders[sc.applicationId] = f"{base.rstrip('/')}/sparkloom-{sc.applicationId}"
        atexit.register(_clean, spark, _folders[sc.applicationId])
    return _folders[sc.applicationId]


def _clean(spark: SparkSession, folder: str) -> None:
    """At the end of the program, while its JVM still answers."""
    try:
        if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc().isStopped() is False:
            drop_folder(spark, folder)
    except Exception as e:  # the JVM may have gone first; the folder is then left to its owner
        print(f"sparkloom: {folder} was left: {type(e).__name__}", file=sys.stderr)


def drop_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to, now rather than at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there and lost executors cost nothing before it."""
    spark, folder = df.sparkSession, f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(folder)
    out._cut_folder = folder
    return out


def drop(*cuts: DataFrame) -> None:
    """Delete what `cut` wrote for these frames; nothing that is read later may hang on them."""
    for df in cuts:
        drop_folder(df.sparkSession, df._cut_folder)


def words_count(text: Column) -> Column:
    """Words of a text; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long"), F.lit(0).cast("long"))


def cell_ranks(df: DataFrame, cell: Sequence[str], order: Column, out: str) -> DataFrame:
    """df with `out`: the row's place from 0 among the rows of its cell, in an order that is fixed by `order` alone.

    A cell may hold any share of all rows: it is dealt to about sqrt(rows) buckets by a hash of `order`, whose counts
    give each bucket's first place, so that no task sorts a whole cell. Cells aren't null. Rows alike in cell and order
    share out their places in any way. df is read three times, so cut it first.
    """
    cell = list(cell)
    buckets = cut(df.groupBy(*cell).agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("_buckets")))
    dealt = df.join(buckets, cell).withColumn("_order", order).withColumn("_bucket", F.pmod(F.xxhash64("_order"), F.col("_buckets"))).repartition(*cell, "_bucket")  # else the join's partitions of whole cells would do for the window
    counts = dealt.groupBy(*cell, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*cell).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*cell, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_first"))
    ranked = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*cell, "_bucket").orderBy("_order")) - 1)
    return ranked.join(first, [*cell, "_bucket"]).withColumn(out, F.col("_first") + F.col("_in")).drop("_order", "_bucket", "_buckets", "_in", "_first")


def global_places(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """df with `out`: the row's place from 0 in the order of all rows, from range partitions and their counts."""
    spark = df.sparkSession
    placed = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each range partition
    first, total = [], 0
    for p, n in counts:
        first.append((p, total))
        total += n
    firsts = spark.createDataFrame(first, "_p long, _first long")
    return placed.withColumn("_p", part).join(F.broadcast(firsts), "_p").withColumn(out, F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_id", "_first")
