"""Incremental ingestion as set operations on file tables: diff, outcomes, upsert, carry-over, cost batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the cost model: seconds for a heavy file, and for a light one by its size.
HEAVY_SECONDS, LIGHT_SECONDS, LIGHT_BYTES_PER_SECOND = 0.5, 0.002, 40_000_000
HEAVY = ("pdf", "docx", "docm", "doc", "rtf", "xlsx", "xlsm", "xls", "png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "webp")


def plan(found: DataFrame, known: DataFrame, max_bytes: int) -> DataFrame:
    """``relative_path, category`` from files found (with ``reason`` for those a rule skips) and files known.

    One full outer join on the path. ``unchanged`` needs equal size and mtime; a content hash settles the rest later.
    """
    f, k = found.alias("f"), known.alias("k")
    category = (
        F.when(F.col("f.relative_path").isNull(), "removed").when(F.col("f.reason").isNotNull(), "excluded").when(F.col("f.size") > max_bytes, "too_large")
        .when(F.col("k.relative_path").isNull(), "added").when((F.col("f.size") == F.col("k.size")) & (F.col("f.mtime") == F.col("k.mtime")), "unchanged").otherwise("changed")
    )
    path = F.coalesce("f.relative_path", "k.relative_path")
    return f.join(k, F.col("f.relative_path") == F.col("k.relative_path"), "full_outer").select(path.alias("relative_path"), category.alias("category"))


def settled(planned: DataFrame, hashes: DataFrame, known: DataFrame) -> DataFrame:
    """Planned rows with ``changed`` split into ``updated`` and, where the content hash is the known one, ``unchanged``."""
    both = planned.join(hashes.select("relative_path", F.col("content_hash").alias("new_hash")), "relative_path", "left").join(known.select("relative_path", F.col("content_hash").alias("old_hash")), "relative_path", "left")
    same = F.coalesce(F.col("new_hash") == F.col("old_hash"), F.lit(False))
    return both.select("relative_path", F.when(F.col("category") == "changed", F.when(same, "unchanged").otherwise("updated")).otherwise(F.col("category")).alias("category"))


def stats(planned: DataFrame) -> DataFrame:
    """One row with the number of files in each category."""
    names = ("added", "updated", "removed", "unchanged", "excluded", "too_large")
    return planned.agg(*[F.count_if(F.col("category") == n).alias(n) for n in names])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``: replaces all rows of a key (copy on write)."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def refreshed(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """``old`` with the given columns taken from ``new`` where it has a value, else kept."""
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return old.join(n, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def carried_over(done: DataFrame, previous: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """After a cancelled build: rows that were done, and of the files not reached the previous rows that still exist."""
    kept = previous.join(done.select(key).distinct(), key, "left_anti").join(found.select(key).distinct(), key, "left_semi")
    return done.unionByName(kept, allowMissingColumns=True)


def missing(files: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Indexed files without a document."""
    return files.where(F.col("status") == "indexed").join(documents, key, "left_anti")


def without_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Paths with a chunk that has no vector."""
    return chunks.join(vectors, "chunk_id", "left_anti").select("relative_path").distinct()


def cost(extension: Column, size: Column) -> Column:
    """Estimated seconds to extract a file."""
    return F.when(extension.isin(*HEAVY), HEAVY_SECONDS).otherwise(F.lit(LIGHT_SECONDS) + size / LIGHT_BYTES_PER_SECOND)


def cost_batches(files: DataFrame, seconds: float, shards: int | None = None) -> DataFrame:
    """``shard`` and ``batch`` for each file so that batches cost about ``seconds``: running sums of cost within hashed shards.

    The shards keep the running sum from being one task's, so there are as many as the session has shuffle partitions, 64 at
    least. Costs are summed as whole microseconds, so that the sums are exact.
    """
    shards = shards or max(64, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shard = (F.conv(F.substring(F.md5("relative_path"), 1, 8), 16, 10).cast("bigint") % shards).cast("int")
    micros = F.round(F.col("cost") * 1_000_000).cast("bigint")
    running = F.sum(micros).over(Window.partitionBy("shard").orderBy("relative_path")) - micros
    return files.withColumn("shard", shard).withColumn("batch", F.floor(running / int(seconds * 1_000_000)).cast("int"))


def dense_ids(rows: DataFrame, start: int, *order: str | Column) -> DataFrame:
    """``id`` = start + 1, start + 2, ... in ``order``: numbers within sorted partitions plus the sizes of those before.

    Only one row a partition is summed, so no task sees all rows.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    first = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__low"))
    offsets = first.select("__part", "__low", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    return ranged.join(offsets, "__part").withColumn("id", F.col("__at") - F.col("__low") + F.coalesce("__before", F.lit(0)) + F.lit(start + 1)).drop("__part", "__at", "__low", "__before")
