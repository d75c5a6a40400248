"""What the operators of this subpackage share: scratch tables and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every operator here (fixed values).
WHITE = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{WHITE}]+"
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent and everything runs on one machine, as in local tests, a folder of our own is
    made and set. On a cluster without the setting this is an error: executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each open ``passing``, from the outermost on, the folders that go at its end.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage like ``checkpoint()``, but columnar and compressed; losing an executor
    afterwards costs nothing, since the files belong to no executor. The shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    if _PASSING.get():
        _PASSING.get()[-1].append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that ``written`` makes in this block are deleted at its end, but for those made by the function that it gives.

    Only for blocks whose results all come from that function: what is lazy and reads another table would miss it.
    """
    outer = _PASSING.get()
    gone: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        inner = _PASSING.set(outer)
        try:
            return written(df, label)
        finally:
            _PASSING.reset(inner)

    token = _PASSING.set((*outer, gone))
    try:
        yield keep
    finally:
        _PASSING.reset(token)
        for path in gone:
            _delete(spark, path)


def scratch(spark: SparkSession) -> str:
    """The application's own folder in the shared one. Results are lazy and read from it, so only the application knows
    when it may go: see ``clear_scratch``."""
    return f"{shared_dir(spark)}/leafmill/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what ``written`` has left in the shared folder for this application, once its results are written elsewhere."""
    _delete(spark, scratch(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What Spark takes if nobody has set it.
_SPARKS_OWN = 64 << 20


def rows(df: DataFrame, *columns) -> DataFrame:
    """The given columns of ``df``, on their way to Python in batches of a few megabytes.

    Spark's own bound of 64 MB a batch is held several times over by the JVM and by Python for each task, so the session's
    setting is lowered to BATCH_BYTES, unless it has been set to something else.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCHES).lower() in (str(_SPARKS_OWN), f"{_SPARKS_OWN}b", "64mb", "64m"):
        conf.set(_BATCHES, str(BATCH_BYTES))
    return df.select(*columns)


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if column.nbytes <= most:
            yield batch
            continue
        size = np.array([x or 0 for x in pa.compute.binary_length(column).to_pylist()], dtype=np.int64)
        part, start = np.cumsum(size) // most, 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1), len(part)]:
            yield batch.slice(start, end - start)
            start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) over an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
