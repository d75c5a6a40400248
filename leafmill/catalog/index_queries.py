"""Search, ingestion and streaming queries, and questions in the dialect of the SQL surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import chunking, ingest, search
from ..session import shared_folder
from ..streaming import watch
from . import query, question, read
from .scalar import file_path

_PATH = "source || '/' || lang || '/' || doc_id || '.txt'"
_TERMS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
WORDS = ("the", "tion", "der", "ering")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of one each: chunk id, path, text and a flag for visuals."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), file_path().alias("relative_path"), "text", (F.col("doc_id") % 10 == 0).alias("has_visual"))


def _bm25(words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return rf"""t AS (SELECT doc_id, source, {_PATH} AS path, {_TERMS} AS ts FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
tf AS (SELECT doc_id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM t) WHERE term IN ({listed}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM tf JOIN df USING (term) CROSS JOIN stats GROUP BY doc_id)"""


@query(f"WITH {_bm25(WORDS)} SELECT doc_id AS chunk_id, round(score, 6) AS score FROM bm")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return search.bm25_scores(search.postings(c), search.statistics(search.lengths(c)), WORDS).select("chunk_id", F.round("text_score", 6).alias("score"))


_FUSED = """SELECT doc_id, path, coalesce(bm.score, 0) + 0.75::DOUBLE * (CAST(list_contains(regexp_extract_all(lower(path), '[a-z0-9]+'), 'src3') AS INTEGER)
  + CAST(list_contains(regexp_extract_all(lower(path), '[a-z0-9]+'), 'de') AS INTEGER)) + CASE WHEN doc_id % 10 = 0 THEN 1.5 ELSE 0 END AS score FROM t LEFT JOIN bm USING (doc_id)"""
QUERY = "src3 de ering images"


@query(f"WITH {_bm25(('src3', 'de', 'ering', 'images'))}, f AS ({_FUSED}) SELECT doc_id AS chunk_id, path AS relative_path, round(score, 6) AS score FROM f WHERE score > 0 ORDER BY f.score DESC, doc_id LIMIT 25")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    best = search.hybrid(c, search.postings(c), search.statistics(search.lengths(c)), QUERY, 25)
    return best.select("chunk_id", "relative_path", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25(('src3', 'de', 'ering', 'images'))}, f AS ({_FUSED}) SELECT doc_id AS chunk_id, round(score, 6) AS score FROM f WHERE score > 0 AND path LIKE 'src7/%' ORDER BY f.score DESC, doc_id LIMIT 10")
def bm25_filtered_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter on documents applies before ranking and leaves the corpus statistics alone."""
    c = _corpus(spark, sf_dir)
    only = c.where(F.col("relative_path").startswith("src7/")).select("relative_path")
    return search.hybrid(c, search.postings(c), search.statistics(search.lengths(c)), QUERY, 10, only).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, 0.75::DOUBLE * (CAST(source = 'src3' AS INTEGER) + CAST(lang = 'de' AS INTEGER)) AS bonus FROM documents")
def path_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", search.path_bonus(file_path(), ["src3", "de"]).alias("bonus"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 1.5::DOUBLE ELSE 0 END AS bonus FROM documents")
def visual_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), search.visual_bonus(F.col("has_visual"), ["images"]).alias("bonus"))


QUERY_VECTOR = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
_Q = f"[{', '.join(map(str, QUERY_VECTOR))}]::DOUBLE[]"
_V = "CAST(embedding AS DOUBLE[])"


@query(f"SELECT vec_id, round(greatest(list_cosine_similarity({_V}, {_Q}), 0), 6) AS score FROM embeddings ORDER BY list_cosine_similarity({_V}, {_Q}) DESC, vec_id LIMIT 20")
def topk_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cosine_top(read(spark, sf_dir, "embeddings"), QUERY_VECTOR, 20).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(greatest(list_cosine_similarity({_V}, {_Q}), 0), 6) AS score FROM embeddings")
def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vx.cosine(F.col("embedding"), q), 6).alias("score"))


@query(f"""
SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(greatest(-127, least(127, round_even(x / n / s, 0))) AS INTEGER)), ',') AS codes, round(s, 9) AS scale
FROM (SELECT vec_id, v, n, list_max(list_transform(v, lambda x: abs(x))) / n / 127.0::DOUBLE AS s FROM (SELECT vec_id, {_V} AS v, sqrt(list_sum(list_transform({_V}, lambda x: x * x))) AS n FROM embeddings))""")
def quantize_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(vx.codes(v), lambda c: c.cast("string")), ",").alias("codes"), F.round(vx.scale(v), 9).alias("scale"))


@query(f"""
SELECT vec_id, abs(list_cosine_similarity(c, {_Q}) - list_cosine_similarity(v, {_Q})) < 0.02 AS close FROM (
SELECT vec_id, v, list_transform(v, lambda x: greatest(-127.0::DOUBLE, least(127, round_even(x / n / s, 0))) * s) AS c
FROM (SELECT vec_id, v, n, list_max(list_transform(v, lambda x: abs(x))) / n / 127.0::DOUBLE AS s FROM (SELECT vec_id, {_V} AS v, sqrt(list_sum(list_transform({_V}, lambda x: x * x))) AS n FROM embeddings)))""")
def quantized_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = F.col("embedding"), F.array(*[F.lit(x) for x in QUERY_VECTOR])
    raw = lambda a: vx.dot(a, q) / (vx.norm(a) * vx.norm(q))
    return read(spark, sf_dir, "embeddings").select("vec_id", (F.abs(raw(vx.restored(vx.codes(v), vx.scale(v))) - raw(v)) < 0.02).alias("close"))


@query("SELECT d.doc_id AS chunk_id, m.vec AS vector FROM documents d LEFT JOIN (SELECT sha256(text) AS h, min(doc_id) AS vec FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) m ON sha256(d.text) = m.h")
def vector_reuse_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir).select("chunk_id", F.sha2("text", 256).alias("chunk_hash"))
    return search.reused_vectors(c, c.where("chunk_id % 2 = 0").withColumn("vector", F.col("chunk_id"))).select("chunk_id", "vector")


def _count(text: str, word: str) -> str:
    return f"((length({text}) - length(replace({text}, '{word}', ''))) // {len(word)})"


@query(f"""
SELECT doc_id, round(CASE WHEN contains(t, 'the er') THEN 5.0::DOUBLE ELSE 0 END + least({_count('t', 'the')}, 6) + least({_count('t', 'er')}, 6) + CASE WHEN contains(p, 'the') THEN 1.5 ELSE 0 END + CASE WHEN contains(p, 'er') THEN 1.5 ELSE 0 END, 6) AS score
FROM (SELECT doc_id, lower(text) AS t, lower({_PATH}) AS p FROM documents)""")
def manifest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.round(search.manifest_score(F.col("text"), file_path(), F.lit(False), "The er"), 6).alias("score"))


@query(f"SELECT p_partkey, CAST(least({_count('lower(p_name)', 'a')}, 4) + least({_count('lower(p_name)', 'part')}, 4) AS INTEGER) AS score FROM part")
def sheet_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", search.sheet_score(F.col("p_name"), ["a", "part"]).alias("score"))


_SPLIT = r"""
WITH RECURSIVE w(doc_id, text, n, cur, e) AS (
  SELECT doc_id, text, length(text), CAST(0 AS BIGINT), CAST(CASE WHEN length(text) <= 1200 THEN length(text) ELSE 900 + CASE
    WHEN len(regexp_extract(substr(text, 901, 300), '(?s)^.*\n\n')) > 0 THEN len(regexp_extract(substr(text, 901, 300), '(?s)^.*\n\n'))
    WHEN len(regexp_extract(substr(text, 901, 300), '(?s)^.*\n')) > 0 THEN len(regexp_extract(substr(text, 901, 300), '(?s)^.*\n'))
    WHEN len(regexp_extract(substr(text, 901, 300), BORDER)) > 0 THEN len(regexp_extract(substr(text, 901, 300), BORDER)) ELSE 300 END END AS BIGINT)
  FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, n, c, CAST(CASE WHEN n - c <= 1200 THEN n ELSE c + 900 + CASE
    WHEN len(regexp_extract(substr(text, c + 901, 300), '(?s)^.*\n\n')) > 0 THEN len(regexp_extract(substr(text, c + 901, 300), '(?s)^.*\n\n'))
    WHEN len(regexp_extract(substr(text, c + 901, 300), '(?s)^.*\n')) > 0 THEN len(regexp_extract(substr(text, c + 901, 300), '(?s)^.*\n'))
    WHEN len(regexp_extract(substr(text, c + 901, 300), BORDER)) > 0 THEN len(regexp_extract(substr(text, c + 901, 300), BORDER)) ELSE 300 END END AS BIGINT)
  FROM (SELECT doc_id, text, n, CAST(greatest(e - 200, cur + 1) AS BIGINT) AS c FROM w WHERE e < n))
SELECT doc_id, count(*) AS windows, CAST(sum(e - cur) AS BIGINT) AS chars, CAST(max(cur) AS BIGINT) AS last_start FROM w GROUP BY doc_id""".replace("BORDER", r"""'(?s)^.*[.!?。！？]["''’)\]]*\s'""")


@query(_SPLIT)
def split_text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the chunk splitter: how many, how long together, where the last one starts."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [(i, s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (s := chunking.spans(t or ""))]
            cols = [[i for i, _ in rows], [len(s) for _, s in rows], [sum(b - a for a, b in s) for _, s in rows], [s[-1][0] for _, s in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "windows", "chars", "last_start"])

    return read(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, windows long, chars long, last_start long")


_CHUNKS = _SPLIT[: _SPLIT.index("SELECT doc_id, count(*) AS windows")] + r""", b AS (SELECT doc_id, cur, trim(substr(text, CAST(cur AS BIGINT) + 1, CAST(e - cur AS BIGINT)), E' \t\n\r\x0b\x0c') AS text FROM w),
k AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cur) - 1 AS INTEGER) AS ordinal, text FROM b WHERE text <> '')"""


@query(_CHUNKS + " SELECT doc_id, ordinal, text, sha256(text) AS chunk_hash FROM k")
def split_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(_CHUNKS + r" SELECT doc_id, CAST(len(string_agg(text, E'\n\n' ORDER BY ordinal)) AS INTEGER) AS n_chars FROM k GROUP BY doc_id")
def joined_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.joined_text(chunking.chunks(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id").select("doc_id", F.length("full_text").alias("n_chars"))


# Ingestion ------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a folder made from the documents: found now, and known from before."""
    docs = read(spark, sf_dir, "documents").select("doc_id", file_path().alias("relative_path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("content_hash"))
    found = docs.where("doc_id % 7 <> 0").select("relative_path", "size", F.when(F.col("doc_id") % 5 == 0, 2.0).otherwise(1.0).alias("mtime"), F.when(F.col("doc_id") % 11 == 0, F.lit("Excluded by rule: x")).alias("reason"), "content_hash")
    known = docs.where("doc_id % 3 <> 0").select("relative_path", "size", F.lit(1.0).alias("mtime"), F.when(F.col("doc_id") % 2 == 0, F.col("content_hash")).otherwise(F.lit("old")).alias("content_hash"), F.lit("indexed").alias("status"))
    return found, known


_SNAP = f"""d AS (SELECT doc_id, {_PATH} AS p, n_chars AS size FROM documents),
f AS (SELECT p, doc_id, size, CASE WHEN doc_id % 5 = 0 THEN 2.0 ELSE 1.0 END AS mtime, CASE WHEN doc_id % 11 = 0 THEN 'x' END AS reason FROM d WHERE doc_id % 7 <> 0), k AS (SELECT p, doc_id, size, 1.0 AS mtime FROM d WHERE doc_id % 3 <> 0),
plan AS (SELECT coalesce(f.p, k.p) AS relative_path, coalesce(f.doc_id, k.doc_id) AS doc_id, CASE WHEN f.p IS NULL THEN 'removed' WHEN f.reason IS NOT NULL THEN 'excluded' WHEN f.size > 5000 THEN 'too_large' WHEN k.p IS NULL THEN 'added'
  WHEN f.size = k.size AND f.mtime = k.mtime THEN 'unchanged' ELSE 'changed' END AS category FROM f FULL JOIN k ON f.p = k.p)"""


@query(f"WITH {_SNAP} SELECT relative_path, category FROM plan")
def plan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.plan(*_snapshots(spark, sf_dir), 5000)


@query(f"WITH {_SNAP} SELECT relative_path, CASE WHEN category = 'changed' THEN CASE WHEN doc_id % 2 = 0 THEN 'unchanged' ELSE 'updated' END ELSE category END AS category FROM plan")
def hash_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, known = _snapshots(spark, sf_dir)
    return ingest.settled(ingest.plan(found, known, 5000), found, known)


@query(f"WITH {_SNAP}, c AS (SELECT CASE WHEN category = 'changed' THEN CASE WHEN doc_id % 2 = 0 THEN 'unchanged' ELSE 'updated' END ELSE category END AS c FROM plan) SELECT " + ", ".join(f"count(*) FILTER (c = '{n}') AS {n}" for n in ("added", "updated", "removed", "unchanged", "excluded", "too_large")) + " FROM c")
def plan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, known = _snapshots(spark, sf_dir)
    return ingest.stats(ingest.settled(ingest.plan(found, known, 5000), found, known))


@query(f"WITH {_SNAP} SELECT p AS relative_path, size, 'new' AS state FROM f UNION ALL SELECT p, size, 'old' FROM k WHERE p NOT IN (SELECT p FROM f)")
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, known = _snapshots(spark, sf_dir)
    return ingest.upsert(known.select("relative_path", "size", F.lit("old").alias("state")), found.select("relative_path", "size", F.lit("new").alias("state")), "relative_path")


@query(f"WITH {_SNAP} SELECT p AS relative_path, 'done' AS state FROM f WHERE doc_id % 4 = 0 UNION ALL SELECT k.p, 'kept' FROM k JOIN f ON f.p = k.p WHERE f.doc_id % 4 <> 0")
def carry_over_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, known = _snapshots(spark, sf_dir)
    ids = read(spark, sf_dir, "documents").select("doc_id", file_path().alias("relative_path"))
    done = found.join(ids.where("doc_id % 4 = 0"), "relative_path", "left_semi").select("relative_path", F.lit("done").alias("state"))
    return ingest.carried_over(done, known.select("relative_path", F.lit("kept").alias("state")), found, "relative_path")


@query(f"WITH {_SNAP} SELECT p AS relative_path FROM k WHERE p NOT IN (SELECT p FROM f)")
def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, known = _snapshots(spark, sf_dir)
    return ingest.missing(known, found.select("relative_path"), "relative_path").select("relative_path")


@query(f"SELECT {_PATH} AS relative_path, round(0.002::DOUBLE + n_chars / 40000000.0::DOUBLE, 9) AS cost FROM documents")
def file_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(file_path().alias("relative_path"), F.round(ingest.cost(tx.extension(file_path()), F.col("n_chars")), 9).alias("cost"))


@query(f"""WITH f AS (SELECT {_PATH} AS relative_path, n_chars FROM documents), c AS (SELECT relative_path, CASE WHEN regexp_extract(relative_path, '\\.([a-z0-9]+)$', 1) IN ({', '.join(repr(x) for x in ingest.HEAVY)}) THEN 0.5::DOUBLE ELSE 0.002::DOUBLE + n_chars / 40000000.0::DOUBLE END AS cost FROM f),
s AS (SELECT relative_path, cost, CAST(round(cost * 1000000) AS BIGINT) AS m, CAST(('0x' || substr(md5(relative_path), 1, 8))::UBIGINT % 64 AS INTEGER) AS shard FROM c)
SELECT relative_path, cost, shard, CAST(floor((sum(m) OVER (PARTITION BY shard ORDER BY relative_path) - m) / 250000) AS INTEGER) AS batch FROM s""")
def cost_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").select(file_path().alias("relative_path"), ingest.cost(tx.extension(file_path()), F.col("n_chars")).alias("cost"))
    return ingest.cost_batches(files, 0.25, 64)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 100 AS id FROM documents WHERE lang = 'fr'")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dense_ids(read(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id"), 100, "doc_id").select("doc_id", F.col("id").cast("long").alias("id"))


@query("SELECT DISTINCT source AS relative_path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def vectors_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("relative_path"))
    return ingest.without_vectors(chunks, read(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")))


# Streams --------------------------------------------------------------------------------------------

_SESSIONS = """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS changes FROM (
SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
FROM (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s"""


def _changes(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    return spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if stream else rows


@query(_SESSIONS)
def debounce_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.debounced(_changes(spark, sf_dir), "user_id", "ts", "4 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "changes")


@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, arg_max(value, (ts, value)) AS last FROM events GROUP BY ALL".replace("arg_max(value, (ts, value))", "last(value ORDER BY ts, value)"))
def throttle_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.throttled(_changes(spark, sf_dir), "event_type", "ts", "value", "1 day").select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "last")


_LATEST = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


@query(_LATEST)
def keyed_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.latest(_changes(spark, sf_dir).select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""
SELECT event_id, user_id FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'cancel' WHEN event_id % 3 = 1 THEN 'build' ELSE 'other' END AS kind FROM events) e
LEFT JOIN (SELECT user_id AS u, max(event_id) AS newest FROM events WHERE event_id % 3 = 1 GROUP BY user_id) b ON e.user_id = b.u WHERE kind <> 'cancel' OR newest IS NULL OR event_id > newest""")
def late_cancel_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "cancel").when(F.col("event_id") % 3 == 1, "build").otherwise("other")
    return watch.without_late_cancels(_changes(spark, sf_dir).withColumn("kind", kind), "user_id", "event_id", "kind").select("event_id", "user_id")


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    import uuid

    return f"{shared_folder(spark)}/leafmill/stream-{uuid.uuid4().hex}"


@query(_SESSIONS, "stream_debounce")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bursts from a stream that is read to its end: state by key, in complete mode without a watermark."""
    folder = _scratch(spark)
    bursts = watch.debounced(_changes(spark, sf_dir, True), "user_id", "ts", "4 hours", late=None)

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out")

    bursts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(bursts.schema).parquet(f"{folder}/out")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "changes")


@query(_LATEST, "stream_upsert")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key, merged by micro-batches into versions of a table."""
    folder = _scratch(spark)
    rows = _changes(spark, sf_dir, True).select("user_id", "event_id", "event_type", "ts")
    watch.upsert_state(rows, f"{folder}/table", "user_id", "ts", "event_id", f"{folder}/state").awaitTermination()
    return watch.read_state(spark, f"{folder}/table", rows.schema).select("user_id", "event_id", "event_type")


# The dialect of questions: by types, words of its own, and table functions ---------------------------

question("sql_whole_division", "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS whole, (l_orderkey + l_linenumber) / 2 / 3 AS twice, l_quantity / 7 AS real, l_orderkey / 0 AS none, CASE WHEN l_linenumber / 3 = 1 THEN l_partkey / CASE WHEN l_suppkey / 5 > 3 THEN 4 ELSE 9 END END AS nested FROM lineitem",
         "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS whole, (l_orderkey + l_linenumber) // 2 // 3 AS twice, l_quantity / 7 AS real, CAST(NULL AS BIGINT) AS none, CASE WHEN l_linenumber // 3 = 1 THEN l_partkey // CASE WHEN l_suppkey // 5 > 3 THEN 4 ELSE 9 END END AS nested FROM lineitem")
question("sql_whole_mean", "SELECT o_custkey, count(*) / 2 AS half, sum(o_orderkey) / count(*) AS mean, typeof(count(*) / 2) AS kind FROM orders GROUP BY o_custkey HAVING count(*) / 2 > 1",
         "SELECT o_custkey, count(*) // 2 AS half, CAST(sum(o_orderkey) AS BIGINT) // count(*) AS mean, 'integer' AS kind FROM orders GROUP BY o_custkey HAVING count(*) // 2 > 1")
question("sql_numeric_prefix", "SELECT c_custkey, CAST(substr(c_name, 10) || ' x' AS INTEGER) AS number, CAST(c_acctbal || 'abc' AS REAL) AS balance, CAST(c_name AS INTEGER) AS zero, CAST(CAST(c_acctbal AS TEXT) AS INTEGER) AS whole FROM customer",
         "SELECT c_custkey, CAST(substr(c_name, 10) AS BIGINT) AS number, CAST(c_acctbal AS DOUBLE) AS balance, CAST(0 AS BIGINT) AS zero, CAST(trunc(c_acctbal) AS BIGINT) AS whole FROM customer")
question("sql_glob_operator", "SELECT p_partkey, p_name GLOB '*[aeiou]?' AS ends, p_name GLOB substr(p_name, 1, 2) || '*' AS own FROM part WHERE p_name NOT GLOB '[m-z]*'",
         "SELECT p_partkey, p_name GLOB '*[aeiou]?' AS ends, p_name GLOB (substr(p_name, 1, 2) || '*') AS own FROM part WHERE NOT (p_name GLOB '[m-z]*')")
question("sql_nocase", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment COLLATE NOCASE, c_custkey) AS nth FROM customer WHERE lower(c_mktsegment) COLLATE NOCASE = 'BUILDING' OR c_mktsegment COLLATE NOCASE IN ('machinery')",
         "SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey) AS nth FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
question("sql_printf", "SELECT o_orderkey, printf('%08.2f|%5d|%-4s|%x|%%', o_orderkey, o_custkey, o_orderstatus, o_custkey) AS line, printf('%d %s', NULL, NULL) AS empty FROM orders",
         "SELECT o_orderkey, printf('%08.2f|%5d|%-4s|%x|%%', CAST(o_orderkey AS DOUBLE), o_custkey, o_orderstatus, o_custkey) AS line, '0 ' AS empty FROM orders")
question("sql_row_formats", "SELECT o_orderkey, strftime(CASE WHEN o_orderkey / 2 * 2 = o_orderkey THEN '%Y/%m' ELSE '%d.%m %j %%' END, o_orderdate) AS day FROM orders",
         "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate::DATE, '%Y/%m') ELSE strftime(o_orderdate::DATE, '%d.%m %j %%') END AS day FROM orders")
question("sql_json_each", "SELECT e.event_id, j.key, CAST(j.value AS INTEGER) AS number FROM events e, LATERAL json_each(e.props) j WHERE CAST(j.value AS INTEGER) / 10 = 4",
         "SELECT e.event_id, j.key, CAST(e.props ->> j.key AS BIGINT) AS number FROM events e, (SELECT event_id, unnest(json_keys(props)) AS key FROM events) j WHERE e.event_id = j.event_id AND CAST(e.props ->> j.key AS BIGINT) // 10 = 4", True)
question("sql_json_parameter", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT CAST(value AS INTEGER) FROM json_each('[3, 9, 27, 81, 243]'))", "SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 9, 27, 81, 243)", True)
question("sql_split_text", "SELECT d.doc_id, s.ordinal, length(s.text) AS size FROM documents d, LATERAL split_text(d.text) s", _CHUNKS + " SELECT doc_id, ordinal, CAST(len(text) AS INTEGER) AS size FROM k", True)
