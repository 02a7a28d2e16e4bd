"""Small helpers on sessions and frames that the operators share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may do without: it gets a folder of its own, removed at exit."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(shared_folder, "own", None):
        shared_folder.own = tempfile.mkdtemp(prefix="quadrille-")
        atexit.register(shutil.rmtree, shared_folder.own, True)
    return f"file://{shared_folder.own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Hadoop finds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_made: list[list[str]] = []


@contextlib.contextmanager
def swept(spark: SparkSession):
    """Deletes, at its end, every step that was written inside: for callers that have written their own result by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage, survives lost executors.

    While it writes, finished queries of the session drop their shuffle files at once, not at some later garbage
    collection. Another query that is run meanwhile and again later computes its shuffles again; its rows are the same.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if _made:
        _made[-1].append(path)
    had = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")  # of this write only: what it shuffled isn't read again
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if had is None else spark.conf.set(_DROP_SHUFFLES, had)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a `written` step that no later step reads."""
    if path := getattr(df, "_scratch", None):
        delete(df.sparkSession, path)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`: 1.. in the given order within each group, nulls first.

    Ranges of (group, order) are sorted apart and counted, so a group of any size is spread over tasks; equal rows are
    spread too.
    """
    parts = partitions(df.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    ranged = df.withColumn("_tie", F.rand(7)).repartitionByRange(parts, *keys, "_tie").withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    sizes = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")).drop("_n")
    starts = starts.select(*(F.col(c).alias(f"_{c}") for c in group), F.col("_part").alias("_p"), "_start")
    at = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*(F.col(c).asc_nulls_first() for c in order), "_tie"))
    same = F.col("_part") == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ranged.withColumn("_at", at).join(starts, same).withColumn(name, F.col("_start") + F.col("_at")).select(*df.columns, name)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not at some later garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).alias("n")).first()["n"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, n: int, column: str) -> DataFrame:
    """df with the row's partition given by an integer column in 0..n-1, so no two values share one by chance."""
    return df.repartitionById(n, F.col(column)) if hasattr(df, "repartitionById") else df.repartition(n, column)
