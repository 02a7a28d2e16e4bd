"""Sharding by proportional stratified interleaving.

Rows are ranked in seeded random order within their source; a row's fractional rank is (rank + 1/2) / rows of the
source. Sorted by it, every stretch of the corpus holds the sources in their overall proportions, and equal cuts of
that order make shards of equal row counts (at most one apart) and of the corpus's mixture.

Neither ranking puts a source or the corpus in one task: rows are dealt into buckets by the leading bits of the key
they are ranked by, buckets are counted, counts are summed up, and ranks are numbered within a bucket. Only ids,
sizes and checksums are shuffled; texts are read once and stay.

Defined cases: a null source is a source of its own; a null text has size 1 and checksum 0; rows given twice are
rows of their own: those alike in id, size, checksum and source are numbered, and the number takes part in the order, so
that neither they nor null ids fall in one bucket; an empty table gives no rows; with fewer rows than shards the last
shards are empty; texts of any length are only measured. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frames import written

SHARDS, SEED = 8, 42
#: Rows of a bucket, and how many buckets a ranking has at most: their counts are summed up in one task.
BUCKET_ROWS, BUCKETS = 1_000, 1 << 20


def _numbered(df: DataFrame, group: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """df with `name`: 0.. in the order of (bucket, order) within each group; bucket agrees with the order."""
    sizes = df.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group or [F.lit(0)]).orderBy(bucket)) - F.col("_n"))
    keys = [*group, bucket]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).join(before.drop("_n"), keys).withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_before", "_at")


def _copies(rows: DataFrame) -> DataFrame:
    """rows with `copy`: 0.. among rows that are alike; they are counted task by task first, so no task sees all of many."""
    alike = rows.columns
    counted = rows.groupBy(*alike, F.spark_partition_id().alias("_task")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*alike).orderBy("_task")) - F.col("_n")
    return counted.withColumn("_before", before).select(*alike, F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("_n") - 1)).alias("copy"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each row of docs: its id, size, text_crc32, source, shard, slot (0.. within the shard)."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("source"),
    )
    rows = written(_copies(rows).withColumn("turn", F.xxhash64("id", "text_crc32", "size", "copy", F.lit(seed))), "rows")
    totals = written(rows.groupBy("source").agg(F.count("*").alias("of")), "sources")
    n = totals.agg(F.sum("of")).first()[0] or 0
    # 2**k buckets of the hash, so many that a bucket of the largest source holds about BUCKET_ROWS
    largest = totals.agg(F.max("of")).first()[0] or 0
    bits = min((largest // BUCKET_ROWS).bit_length(), BUCKETS.bit_length() - 1)
    top = F.shiftrightunsigned("turn", 64 - bits) if bits else F.lit(0).cast("long")
    # ordered as unsigned, as its leading bits are
    ordered = rows.withColumn("bucket", top).withColumn("key", F.shiftrightunsigned("turn", 1))
    by_source = _numbered(ordered, ["source"], "bucket", ["key", "turn", "id", "text_crc32", "size", "copy"], "rank").drop("bucket", "key", "turn")
    parts = max(1, min(n // BUCKET_ROWS, BUCKETS))
    part = by_source.join(totals, "source").withColumn("fraction", (F.col("rank") * 2 + 1) / (F.col("of") * 2))
    dealt = part.withColumn("bucket", F.least(F.floor(F.col("fraction") * parts), F.lit(parts - 1)).cast("long"))
    placed = _numbered(dealt, [], "bucket", ["fraction", "source", "rank"], "position")
    # shard k holds the positions from ceil(k * n / shards)
    shard = F.expr(f"position * {shards} div {max(n, 1)}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - start).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.when(F.col("source") != "", F.expr("substring(source, 2)")).alias("source"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
