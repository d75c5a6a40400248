"""Change-driven refresh with Structured Streaming: debounce, throttling, latest state per key, synchronising.

All take a streaming or a batch DataFrame; the windows are the same expressions on both.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUIET = "4 seconds"


def debounced(changes: DataFrame, key: str, at: str, quiet: str = QUIET, late: str | None = "1 minute") -> DataFrame:
    """One row for each burst of changes of a key that is followed by ``quiet`` without any: its start, end and size."""
    rows = changes.withWatermark(at, late) if changes.isStreaming and late else changes
    burst = F.session_window(at, quiet)
    return rows.groupBy(key, burst.alias("burst")).agg(F.count("*").alias("changes")).select(key, F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "changes")


def throttled(progress: DataFrame, key: str, at: str, value: str, every: str = "100 milliseconds", late: str | None = "1 minute") -> DataFrame:
    """The last value of a key in each slot of time."""
    rows = progress.withWatermark(at, late) if progress.isStreaming and late else progress
    return rows.groupBy(key, F.window(at, every).alias("slot")).agg(F.max_by(value, F.struct(at, value)).alias("last")).select(key, F.col("slot.start").alias("start"), "last")


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times the one with the larger ``tie``. Partial maxima, no sort."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(at, tie)).alias("r"))
    return best.select("r.*")


def without_late_cancels(events: DataFrame, key: str, seq: str, kind: str) -> DataFrame:
    """Drops cancels that are older than the newest build of their key."""
    builds = events.where(F.col(kind) == "build").groupBy(key).agg(F.max(seq).alias("__newest"))
    both = events.join(builds, key, "left")
    return both.where((F.col(kind) != "cancel") | F.col("__newest").isNull() | (F.col(seq) > F.col("__newest"))).drop("__newest")


def synchronise(changes: DataFrame, sync: Callable[[list], None], key: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls ``sync`` with the distinct keys that changed, one micro-batch at a time.

    Changes that come while a batch runs wait for the next one together, so syncs never overlap or pile up. Keys
    are channels, of which a batch has few.
    """

    def batch(df: DataFrame, _: int) -> None:
        keys = [r[0] for r in df.select(key).distinct().orderBy(key).collect()]
        if keys:
            sync(keys)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: Parts of a state table; a batch rewrites those that its keys fall into.
BUCKETS = 64


def _versions(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, list[int]]:
    """Batches that wrote each bucket, in order; only finished ones, and only those before batch ``below``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found: dict[int, list[int]] = {}
    for done in fs.globStatus(path(f"{folder}/v*/_SUCCESS")) or ():
        version = int(done.getPath().getParent().getName()[1:])
        if below is None or version < below:
            for part in fs.globStatus(path(f"{folder}/v{version}/bucket=*")) or ():
                found.setdefault(int(part.getPath().getName().removeprefix("bucket=")), []).append(version)
    return {b: sorted(v) for b, v in found.items()}


def read_state(spark: SparkSession, folder: str, schema, below: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
    """The newest row of each key, from the newest version of each bucket."""
    newest = {b: v[-1] for b, v in _versions(spark, folder, below).items() if buckets is None or b in buckets}
    return spark.read.schema(schema).parquet(*[f"{folder}/v{v}/bucket={b}" for b, v in newest.items()]) if newest else spark.createDataFrame([], schema)


def upsert_state(changes: DataFrame, folder: str, key: str, at: str, tie: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest row of each key under ``folder``, which ``read_state`` reads.

    A key belongs to a bucket. A micro-batch merges into the buckets that its keys fall into and writes these as a version
    named by the batch, so that a repeated batch writes the same again. Of a bucket's older versions one stays, for readers.
    """

    def merge(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")
        touched = [r[0] for r in df.select(bucket).distinct().collect()]  # BUCKETS at most
        merged = latest(read_state(spark, folder, df.schema, n, touched).unionByName(df), key, at, tie)
        merged.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v{n}")
        for b, versions in _versions(spark, folder, n + 1).items():
            for old in versions[:-2]:
                fs.delete(path(f"{folder}/v{old}/bucket={b}"), True)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_plan_order(results: DataFrame, plan: DataFrame, key: str, order: str) -> DataFrame:
    """Results with the place that the plan gives them, in that order, in whatever order they were made."""
    return results.join(plan.select(key, order), key).orderBy(order)
