"""Queries over an index that is built from the documents as files, synchronised once, and embedded; and over a sheet read from CSV.

The index is built once for an application and a folder of tables: first from four documents of five, then again after the rest was added,
some were changed and some removed. So each query sees what two builds left.
"""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.index import Embedder, Index
from ..session import shared_folder
from ..sources import workbook
from . import query, read
from .index_queries import _CHUNKS, _PATH
from .scalar import file_path

LETTERS, QUESTION, ASKED = "aeinorst", "src3 de ering", "the rest is near our nation"
ADDED, CHANGED, REMOVED, MORE = "doc_id % 5 = 0", "doc_id % 7 = 1", "doc_id % 11 = 3", " and one more zebra"


def letter_counts(texts: Sequence[str]) -> list[list[float]]:
    """An embedder that SQL can express: how often some letters occur."""
    return [[float(t.count(c)) for c in LETTERS] for t in texts]


def _put_files(rows: DataFrame, root: str) -> None:
    """A file for each row (path, text), written by the tasks; a null text deletes it."""

    def put(part) -> None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", root)) if re.match(r"[a-z0-9]+:", root) else (fs.LocalFileSystem(), root)
        made = set()
        for path, text in part:
            if text is None:
                with contextlib.suppress(FileNotFoundError):
                    system.delete_file(f"{at}/{path}")
                continue
            folder = path.rpartition("/")[0]
            if folder not in made:
                made.add(folder)
                system.create_dir(f"{at}/{folder}", recursive=True)
            with system.open_output_stream(f"{at}/{path}") as f:
                f.write(text.encode())

    rows.foreachPartition(put)


_BUILT: dict[tuple[str, str], tuple[Index, dict]] = {}


def built(spark: SparkSession, sf_dir: str) -> tuple[Index, dict]:
    """The index over the documents of ``sf_dir``, and what its second build counted."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        folder = f"{shared_folder(spark)}/leafmill/built-{uuid.uuid4().hex}"
        root = f"{folder}/files"
        docs = read(spark, sf_dir, "documents").select("doc_id", file_path().alias("path"), F.coalesce("text", F.lit("")).alias("text"))
        _put_files(docs.where(f"NOT ({ADDED})").select("path", "text"), root)
        index = Index(spark, root, f"{folder}/index", embedder=Embedder(letter_counts, "letters"))
        index.build()
        _put_files(docs.where(f"({ADDED}) AND NOT ({REMOVED})").select("path", "text"), root)
        _put_files(docs.where(f"({CHANGED}) AND NOT ({REMOVED})").select("path", F.concat("text", F.lit(MORE)).alias("text")), root)
        _put_files(docs.where(f"({REMOVED}) AND NOT ({ADDED})").select("path", F.lit(None).cast("string").alias("text")), root)
        _BUILT[key] = index, index.build(mode="vector")
    return _BUILT[key]


#: The files as they are at the second build, and their chunks.
_STATE = f"""norm AS (SELECT doc_id, {_PATH} AS path, t, trim(t, E' \\t\\n\\r\\x0b\\x0c') AS text FROM (SELECT *, coalesce(text, '') || CASE WHEN {CHANGED} THEN '{MORE}' ELSE '' END AS t FROM documents WHERE NOT ({REMOVED})))"""
_CUT = _CHUNKS.replace("FROM documents WHERE", "FROM norm WHERE").replace("WITH RECURSIVE w(", f"WITH RECURSIVE {_STATE}, w(") + r""",
c AS (SELECT path AS relative_path, ordinal, k.text, sha256(k.text) AS chunk_hash, path || ':' || ordinal || ':' || substr(sha256(path || ordinal || sha256(k.text)), 1, 8) AS chunk_id,
  regexp_extract_all(strip_accents(lower(k.text)), '[\p{L}\p{N}]+') AS ts FROM k JOIN norm USING (doc_id))"""


@query(_CUT + " SELECT path AS relative_path, CASE WHEN norm.text = '' THEN 'failed' ELSE 'indexed' END AS status, CAST(strlen(t) AS BIGINT) AS size, CAST(count(c.ordinal) AS INTEGER) AS chunks, CAST(coalesce(sum(len(ts)), 0) AS BIGINT) AS terms, sha256(t) AS content_hash FROM norm LEFT JOIN c ON c.relative_path = path GROUP BY path, norm.text, t")
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir)[0].files().select("relative_path", "status", "size", "chunks", "terms", "content_hash")


@query(_CUT + r""" SELECT path AS relative_path, CAST(count(c.ordinal) AS INTEGER) AS chunks, CAST(greatest(1, ceil(length(norm.text) / 4.0)) AS BIGINT) AS token_estimate, CASE WHEN length(f) > 420 THEN rtrim(substr(f, 1, 417)) || '...' ELSE f END AS summary
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM norm) norm LEFT JOIN c ON c.relative_path = path WHERE norm.text <> '' GROUP BY path, norm.text, f""")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir)[0].documents().select("relative_path", "chunks", F.col("token_estimate").cast("long").alias("token_estimate"), "summary")


@query(_CUT + " SELECT chunk_id, relative_path, ordinal, chunk_hash, CAST(len(ts) AS INTEGER) AS dl FROM c")
def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir)[0].read("chunks").select("chunk_id", "relative_path", "ordinal", "chunk_hash", "dl")


@query(f"""SELECT 'added' AS category, count(*) FILTER (WHERE {ADDED} AND NOT ({REMOVED})) AS n FROM documents UNION ALL SELECT 'updated', count(*) FILTER (WHERE {CHANGED} AND NOT ({REMOVED}) AND NOT ({ADDED})) FROM documents
UNION ALL SELECT 'removed', count(*) FILTER (WHERE {REMOVED} AND NOT ({ADDED})) FROM documents UNION ALL SELECT 'unchanged', count(*) FILTER (WHERE NOT ({REMOVED}) AND NOT ({CHANGED}) AND NOT ({ADDED})) FROM documents""")
def index_sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second build counted."""
    counted = built(spark, sf_dir)[1]
    return spark.createDataFrame([(k, counted[k]) for k in ("added", "updated", "removed", "unchanged")], "category string, n bigint")


@query(_CUT + " SELECT count(*) AS n_chunks, round(sum(len(ts)) / count(*), 9) AS avgdl FROM c")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest holds after the second build, against a count of all texts."""
    return built(spark, sf_dir)[0].statistics().select(F.col("n_chunks").cast("long").alias("n_chunks"), F.round("avgdl", 9).alias("avgdl"))


_SCORED = _CUT + r""", s AS (SELECT count(*) AS n, sum(len(ts)) / count(*) AS avgdl FROM c),
q AS (SELECT unnest(['src3', 'de', 'ering']) AS word), tf AS (SELECT chunk_id, len(ts) AS dl, word, len(list_filter(ts, lambda x: x = word)) AS tf FROM c, q), df AS (SELECT word, count(*) AS df FROM tf WHERE tf > 0 GROUP BY word),
bm AS (SELECT chunk_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (word), s WHERE tf > 0 GROUP BY chunk_id),
r AS (SELECT c.chunk_id, c.relative_path, c.text, coalesce(bm.score, 0) + 0.75 * (SELECT count(*) FROM q WHERE list_contains(regexp_extract_all(lower(c.relative_path), '[a-z0-9]+'), word)) AS score FROM c LEFT JOIN bm USING (chunk_id))"""


@query(_SCORED + " SELECT chunk_id, relative_path, round(score, 6) AS score, text FROM r WHERE score > 0 ORDER BY r.score DESC, chunk_id LIMIT 20")
def index_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir)[0].search(QUESTION, 20).select("chunk_id", "relative_path", F.round("score", 6).alias("score"), "text")


@query(_SCORED + " SELECT chunk_id, round(score, 6) AS score FROM r WHERE score > 0 AND relative_path IN ('src7/en/7.txt', 'src7/en/27.txt', 'src7/en/47.txt', 'src7/de/67.txt', 'src3/en/3.txt', 'src3/en/23.txt', 'src3/de/43.txt')")
def index_every_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches within some documents, however many: nothing is cut off."""
    ids = ["src7/en/7.txt", "src7/en/27.txt", "src7/en/47.txt", "src7/de/67.txt", "src3/en/3.txt", "src3/en/23.txt", "src3/de/43.txt"]
    return built(spark, sf_dir)[0].rows_matching(QUESTION, ids).select("chunk_id", F.round("score", 6).alias("score"))


_VECTORS = _CUT + f""", v AS (SELECT chunk_id, [{', '.join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in LETTERS)}] AS v FROM c), n AS (SELECT chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v),
z AS (SELECT chunk_id, CASE WHEN n > 0 THEN list_transform(v, lambda x: CAST(greatest(-127, least(127, round_even(x / n / (list_max(v) / n / 127.0::DOUBLE), 0))) AS INTEGER)) ELSE list_transform(v, lambda x: 0) END AS codes FROM n)"""


@query(_VECTORS + " SELECT chunk_id, CAST(8 AS INTEGER) AS dim, array_to_string(codes, ',') AS codes FROM z")
def index_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of every chunk, those of texts that occur elsewhere taken over."""
    return built(spark, sf_dir)[0].read("vectors").select("chunk_id", "dim", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


_ASKED = [ASKED.count(c) for c in LETTERS]


@query(_VECTORS + f", a AS (SELECT {_ASKED}::DOUBLE[] AS q), s AS (SELECT chunk_id, coalesce(list_dot_product(codes::DOUBLE[], q) / nullif(sqrt(list_dot_product(codes::DOUBLE[], codes::DOUBLE[])) * sqrt(list_dot_product(q, q)), 0), 0) AS score FROM z, a) SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 12) DESC, chunk_id LIMIT 15")
def index_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir)[0].search(ASKED, 15, mode="vector").select("chunk_id", F.round("score", 6).alias("score"))


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) + 1 AS INTEGER) AS _row, o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, strftime(o_orderdate::DATE, '%Y-%m-%d') AS o_orderdate FROM orders")
def sheet_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as one CSV file with a header, read by ranges, and typed by what the cells show."""
    folder = f"{shared_folder(spark)}/leafmill/sheet-{uuid.uuid4().hex}"
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), F.date_format("o_orderdate", "M/d/yyyy").alias("o_orderdate"))
    orders.orderBy("o_orderkey").coalesce(1).write.option("header", "true").csv(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().toString() for s in path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path) if s.getPath().getName().endswith(".csv")]
    return workbook.typed_table(workbook.read_sheets(spark, names), "")
