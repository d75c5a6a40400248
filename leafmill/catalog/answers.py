"""Questions, preselection, notes, citations, visual assets, replies and state tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import answers, search, tabular
from . import query, read
from .scalar import file_path

_PATH = "source || '/' || lang || '/' || doc_id || '.txt'"

# A question for each customer or supplier, dealt from this list.
QUESTIONS = (
    "How many rows are in the claims sheet?", "How many rows where status is open?", "List the policies written by Smith", "Total premium by region", "What is the average per month?", "Top ten suppliers", "Show all entries, filtered",
    "Compare 2023 vs 2024 as a chart", "What percentage is paid?", "Who approved it?", "How much did it cost over time", "number of records per day", "Which rows mention fire", "lowest and highest value", "count entries",
)
_Q = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + "]"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*[F.lit(q) for q in QUESTIONS])
    return read(spark, sf_dir, "customer").select("c_custkey", F.element_at(listed, (F.col("c_custkey") % len(QUESTIONS) + 1).cast("int")).alias("question"))


@query(rf"""
WITH q AS (SELECT c_custkey, regexp_replace(lower({_Q}[c_custkey % {len(QUESTIONS)} + 1]), '\b(written|signed|approved|created|prepared|submitted|authored|sent|owned|reviewed|issued|made|modified|updated|edited|followed|caused|driven|covered|governed|required)\s+by\b', ' ', 'g') AS t FROM customer)
SELECT c_custkey, array_to_string(list_filter([
  CASE WHEN regexp_matches(t, '\b(how many|count|counts|number of|# of)\b') THEN 'count' END, CASE WHEN regexp_matches(t, '\b(totals?|sum|sums|add up|tally)\b') THEN 'total' END, CASE WHEN regexp_matches(t, '\bhow much\b') THEN 'how much' END,
  CASE WHEN regexp_matches(t, '\b(average|averages|avg|the mean|mean (of|for|value))\b') THEN 'average' END,
  CASE WHEN regexp_matches(t, '\b(minimum|maximum|min|max|highest|lowest|largest|smallest|biggest|greatest|most (common|frequent|expensive|costly)|least (common|frequent|expensive|costly))\b') THEN 'extreme' END,
  CASE WHEN regexp_matches(t, '\b(top|bottom)\s+(\d+|one|two|three|four|five|six|seven|eight|nine|ten|twenty)\b') THEN 'top n' END, CASE WHEN regexp_matches(t, '\b(break ?down|breakdown|group(ed)? by|grouped|distribution|histogram)\b') THEN 'grouping' END,
  CASE WHEN regexp_matches(t, '\b(per|for each|each)\s+[a-z]') THEN 'per' END, CASE WHEN regexp_matches(t, '\bby\s+[a-z]') THEN 'by' END, CASE WHEN regexp_matches(t, '\b(trends?|over time|month over month|year over year|monthly|quarterly|weekly|yearly|daily)\b') THEN 'trend' END,
  CASE WHEN regexp_matches(t, '\b(chart|charts|plot|graph|visuali[sz]e)\b') THEN 'chart' END, CASE WHEN regexp_matches(t, '\b(compare|compared|comparison|versus|vs)\b') THEN 'compare' END, CASE WHEN regexp_matches(t, '\b(percent|percentage|ratio|proportion|share of)\b|%') THEN 'percent' END
], lambda x: x IS NOT NULL), ',') AS signals FROM q""")
def intent_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen signals; "by" after a passive is none."""
    return _questions(spark, sf_dir).select("c_custkey", F.array_join(answers.signals(F.col("question")), ",").alias("signals"))


@query(f"""
SELECT c_custkey, k IN (0, 1, 3, 11, 14) AS wants_count, k IN (2, 6, 12) AS wants_list, k IN (1, 6) AND k <> 12 AS wants_filter, k IN (0, 14) AS row_count
FROM (SELECT c_custkey, c_custkey % {len(QUESTIONS)} AS k FROM customer)""")
def intent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question of the list wants; the SQL names the questions by their place."""
    f = answers.intents(F.col("question"))
    return _questions(spark, sf_dir).select("c_custkey", f["count"].alias("wants_count"), f["list"].alias("wants_list"), f["filter"].alias("wants_filter"), f["row_count"].alias("row_count"))


_SCORED = f"SELECT {_PATH} AS relative_path, length(text) - length(replace(lower(text), 'the', '')) AS score FROM documents"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(file_path().alias("relative_path"), (F.length("text") - F.length(F.replace(F.lower("text"), F.lit("the"), F.lit("")))).alias("score"))


@query(f"SELECT relative_path, score, row_number() OVER (ORDER BY score DESC, relative_path) AS rank FROM ({_SCORED}) QUALIFY rank <= 24")
def manifest_preselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.preselected(_scored(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT relative_path, row_number() OVER (ORDER BY score DESC, relative_path) AS rank FROM ({_SCORED}) QUALIFY rank <= 3")
def selection_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice without any candidate falls back to the first three."""
    chosen = spark.createDataFrame([("no/such/file",)], "relative_path string")
    return answers.selected(answers.preselected(_scored(spark, sf_dir)), chosen).select("relative_path", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH s AS ({_SCORED}), r AS (SELECT *, relative_path LIKE 'src1/%/1__.txt' AS found FROM s)
SELECT relative_path, found, row_number() OVER (ORDER BY found DESC, CASE WHEN found THEN 0 ELSE score END DESC, relative_path) AS rank FROM r QUALIFY rank <= 4""")
def calculation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return answers.to_calculate(scored.where("relative_path LIKE 'src1/%/1__.txt'"), scored).withColumn("rank", F.col("rank").cast("long"))


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("sheet"), F.lit("key name region").alias("headers"), (F.col("n_nationkey") * 10).alias("row_count"))


@query("SELECT CAST(sum(n_nationkey * 10) AS BIGINT) AS total_rows, true AS matched, string_agg(n_name || ' (' || n_nationkey * 10 || ')', ', ' ORDER BY n_name) AS sheets FROM nation WHERE lower(n_name) LIKE '%nation_2%'", "row_count_matched")
def row_count_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.row_count_answer(_sheets(spark, sf_dir), ["nation_2"])


@query("SELECT CAST(sum(n_nationkey * 10) AS BIGINT) AS total_rows, false AS matched, (SELECT string_agg(n_name || ' (' || n_nationkey * 10 || ')', ', ' ORDER BY n_name) FROM (SELECT * FROM nation ORDER BY n_name LIMIT 6)) AS sheets FROM nation", "row_count_all")
def row_count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.row_count_answer(_sheets(spark, sf_dir), ["policies"])


@query("""
WITH r AS (SELECT doc_id AS rank, source AS sheet FROM documents WHERE contains(text, 'er')), f AS (SELECT sheet, min(rank) AS first FROM r WHERE sheet IS NOT NULL GROUP BY sheet ORDER BY first, sheet LIMIT 6)
SELECT (SELECT count(*) FROM r) AS rows, (SELECT string_agg(sheet, ', ' ORDER BY first, sheet) FROM f) AS sheets""")
def row_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.row_scan(read(spark, sf_dir, "documents").where(F.contains("text", F.lit("er"))).select(F.col("doc_id").alias("rank"), F.col("source").alias("sheet")))


@query(f"""
SELECT {_PATH} AS relative_path, CAST(doc_id AS VARCHAR) AS chunk_id, n_chars::DOUBLE AS score, substr(text, 1, 240) AS snippet FROM documents
UNION ALL SELECT 'nations.xlsx', 'calc:nations.xlsx#' || n_name, 1.0, 'Calculated from sheet ''' || n_name || ''' (' || (n_nationkey + 1) || ',000 rows)' FROM nation""")
def citation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = read(spark, sf_dir, "documents").select(file_path().alias("relative_path"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("score"), tx.snippet(F.col("text")).alias("snippet"))
    used = read(spark, sf_dir, "nation").select(F.lit("nations.xlsx").alias("document"), F.col("n_name").alias("sheet"), ((F.col("n_nationkey") + 1) * 1000).alias("row_count"))
    return answers.citations(results, used)


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("kind"), (F.col("event_id") % 7).cast("int").alias("page"), F.concat(F.lit("Figure "), (F.col("event_id") % 40).cast("string")).alias("label"), F.col("event_id").alias("position"))


_ASSETS = "SELECT user_id AS doc, event_type AS kind, CAST(event_id % 7 AS INTEGER) AS page, 'Figure ' || (event_id % 40) AS label, event_id AS position FROM events"
_SUMMARY = f"""
a AS ({_ASSETS}), s AS (SELECT doc, count(*) AS total, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM a GROUP BY doc),
k AS (SELECT doc, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds, string_agg(n || ' ' || kind, ', ' ORDER BY kind) AS said FROM (SELECT doc, kind, count(*) AS n FROM a GROUP BY ALL) GROUP BY doc),
l AS (SELECT doc, label, row_number() OVER (PARTITION BY doc ORDER BY min(position), label) AS n FROM a GROUP BY doc, label), m AS (SELECT doc, string_agg(label, '|' ORDER BY n) AS labels, string_agg(label, ' | ' ORDER BY n) FILTER (n <= 5) AS five FROM l WHERE n <= 12 GROUP BY doc)"""


@query(f"WITH {_SUMMARY} SELECT doc, total, pages, kinds, labels FROM s JOIN k USING (doc) JOIN m USING (doc)")
def visual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_join(F.transform(F.map_entries("by_kind"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return answers.asset_summary(_assets(spark, sf_dir), "doc").select("doc", "total", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), kinds.alias("kinds"), F.array_join("labels", "|").alias("labels"))


@query(f"WITH {_SUMMARY} SELECT doc, doc || ': ' || total || ' indexed visual asset(s) (' || said || '). Pages: ' || replace(pages, ',', ', ') || '. Samples: ' || five || '.' AS note FROM s JOIN k USING (doc) JOIN m USING (doc)")
def visual_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = answers.asset_summary(_assets(spark, sf_dir), "doc")
    return s.select("doc", answers.asset_note(F.col("doc").cast("string"), F.col("total"), F.col("by_kind"), F.col("pages"), F.col("labels")).alias("note"))


@query(f"""
WITH a AS ({_ASSETS}), r AS (SELECT 0 AS source, doc AS rank, position, kind, 'f' || doc AS relative_path, page, label AS media FROM a WHERE doc <= 5 AND page = 3 UNION ALL SELECT 1, doc, position, kind, 'f' || doc, page, label FROM a WHERE page = 5),
g AS (SELECT kind, relative_path, page, media, min((source, rank, position)) AS first FROM r GROUP BY ALL)
SELECT row_number() OVER (ORDER BY first, kind, relative_path, page, media) AS nth, kind, relative_path, page, media FROM g QUALIFY nth <= 3""")
def answer_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assets(spark, sf_dir).select(F.col("doc").alias("rank"), "position", "kind", F.concat(F.lit("f"), F.col("doc").cast("string")).alias("relative_path"), "page", F.col("label").alias("media"))
    return answers.answer_assets(a.where("page = 3"), a.where("page = 5"), True).withColumn("nth", F.col("nth").cast("long"))


@query(r"SELECT conv_id, turn, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '...' ELSE t END AS sql FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(chr(7) || text || chr(10) || chr(10) || chr(10) || chr(10) || 'x', '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS t FROM conversations)")
def sql_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", answers.clean_sql(F.concat(F.lit("\x07"), "text", F.lit("\n\n\n\nx")), 60).alias("sql"))


@query("SELECT n_nationkey, CASE n_nationkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'SELECT ' || n_regionkey || ' AS x' END AS sql FROM nation")
def reply_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as plain JSON, in a fence, with words around, as a SQL block, refusing, and broken."""
    k, sql = F.col("n_nationkey") % 6, F.concat(F.lit("SELECT "), F.col("n_regionkey").cast("string"), F.lit(" AS x"))
    json = F.concat(F.lit('{"sql": "'), sql, F.lit(';"}'))
    reply = (
        F.when(k == 0, json).when(k == 1, F.concat(F.lit("Here:\n```json\n"), json, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure, "), json, F.lit(" is it")))
        .when(k == 3, F.concat(F.lit("```sql\n"), sql, F.lit(";\n```"))).when(k == 4, F.lit('{"sql": null}')).otherwise(F.lit("I cannot {say"))
    )
    return read(spark, sf_dir, "nation").select("n_nationkey", answers.sql_reply(reply).alias("sql"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 6 WHEN 1 THEN 'Unknown chart type "donut". Use one of: bar, stacked-bar, line, area, pie, scatter.' WHEN 2 THEN '"title" is required.' WHEN 3 THEN 'A pie chart takes exactly one series.' WHEN 4 THEN 'A series has another number of values than x.' WHEN 5 THEN 'Pie chart values can''t be negative.' END AS error FROM nation""")
def chart_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 6
    kind = F.when(k == 1, "donut").when(k.isin(3, 5), "pie").otherwise("bar")
    one = lambda name, *v: F.struct(F.lit(name).alias("name"), F.array(*[F.lit(float(x)) for x in v]).alias("values"))
    series = F.when(k == 3, F.array(one("a", 1, 2), one("b", 3, 4))).when(k == 4, F.array(one("a", 1))).when(k == 5, F.array(one("a", 1, -2))).otherwise(F.array(one("a", 1, 2)))
    return read(spark, sf_dir, "nation").select("n_nationkey", answers.chart_error(kind, F.when(k == 2, " ").otherwise("t"), F.array(F.lit("p"), F.lit("q")), series).alias("error"))


@query("SELECT r_regionkey, 'region;keys (n)|' || string_agg(n_name || ';' || n_nationkey || '.0', '|' ORDER BY n_name) AS grid FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def chart_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("v"))  # nations of a region
    series = F.array(F.struct(F.lit("keys").alias("name"), F.transform("v", lambda x: x["n_nationkey"].cast("double")).alias("values")))
    grid = answers.chart_rows(F.lit("region"), F.lit("n"), F.transform("v", lambda x: x["n_name"]), series)
    return n.select("r_regionkey", F.array_join(F.transform(grid, lambda r: F.array_join(r, ";")), "|").alias("grid"))


@query("SELECT n_nationkey, 'Key;Name & more|' || n_nationkey || ';' || n_name AS grid FROM nation")
def html_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("<p>x</p><TABLE class=a><tr><th>Key</th><th>Name &amp;\n more</th></tr><tr><td> "), F.col("n_nationkey").cast("string"), F.lit("</td><td><b>"), "n_name", F.lit("</b></td></tr></TABLE><table><tr><td>z</td></tr></table>"))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(answers.html_grid(page), lambda r: F.array_join(r, ";")), "|").alias("grid"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.2f', o_totalprice), '0') END AS shown FROM orders")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", answers.number_text(F.col("o_totalprice").cast("double")).alias("shown"))


@query("SELECT s_suppkey, s_name || '|http://x||' || CASE WHEN s_suppkey % 2 = 0 THEN 'dep|' ELSE '|m1' END AS key, s_name || CASE WHEN s_suppkey % 2 = 0 THEN '/dep' ELSE '/m1' END AS label FROM supplier")
def model_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("s_suppkey") % 2 == 0
    key = answers.model_key(F.col("s_name"), F.lit("http://x"), F.lit(None).cast("string"), F.when(even, "dep"), F.when(~even, "m1"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", key.alias("key"), answers.model_label(key).alias("label"))


@query("""
SELECT o_orderkey, CASE WHEN k = 0 THEN 'never' WHEN k = 1 THEN 'just now' WHEN k = 2 THEN '2 min ago' WHEN k = 3 THEN '5 h ago' WHEN k = 4 THEN 'yesterday' WHEN k = 5 THEN '3 days ago' ELSE strftime(CAST(o_orderdate AS TIMESTAMP) - INTERVAL 30 DAY, '%b %-d, %Y') END AS ago,
  CASE WHEN k = 1 THEN '1 row' ELSE k || ' rows' END AS rows FROM (SELECT *, o_orderkey % 7 AS k FROM orders)""")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, now = F.col("o_orderkey") % 7, F.col("o_orderdate").cast("timestamp")
    seconds = F.when(k == 1, 44).when(k == 2, 90).when(k == 3, 5 * 3600).when(k == 4, 26 * 3600).when(k == 5, 3 * 86400).otherwise(30 * 86400)
    at = F.when(k != 0, F.timestamp_seconds(F.unix_timestamp(now) - seconds))
    return read(spark, sf_dir, "orders").select("o_orderkey", tx.relative_time(at, now).alias("ago"), tx.plural(k, "row").alias("rows"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey IN (1, 3) THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def nulled_on_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = read(spark, sf_dir, "region").where("r_regionkey IN (1, 3)")
    return answers.detached(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), removed, "n_regionkey", "r_regionkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, 'new ' || n_name FROM nation WHERE n_nationkey >= 10")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return answers.added_only(n.where("n_nationkey < 10"), n.withColumn("n_name", F.concat(F.lit("new "), "n_name")), "n_nationkey")


@query("SELECT conv_id, row_number() OVER (ORDER BY max(turn) DESC, conv_id) AS place FROM conversations GROUP BY conv_id")
def thread_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"))
    return answers.placed(threads, None, F.desc("updated"), F.col("conv_id")).select("conv_id", F.col("place").cast("long").alias("place"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def message_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.placed(read(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", F.col("turn")).withColumn("place", F.col("place").cast("long"))


@query("SELECT p_partkey FROM part WHERE p_size > 25 AND p_brand <> 'Brand#1'")
def model_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that can chat: a filter that reaches the scan."""
    return read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 25).alias("supports_chat"), "p_brand").where("supports_chat AND p_brand <> 'Brand#1'").select("p_partkey")


@query("SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_name, 'changed' FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0")
def meta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    meta = n.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    changes = n.where("n_regionkey = 2").select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "changed").alias("value"))
    return answers.setting(meta, changes)


@query("SELECT p_partkey, 'Spreadsheet document ' || p_name || ' with ' || p_size || ' rows across 2 sheets. Sheets: a, b. Columns: key, name.' AS summary FROM part")
def sheet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, columns = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("key"), F.lit("name"))
    return read(spark, sf_dir, "part").select("p_partkey", answers.header_note(F.col("p_name"), F.lit(2), F.col("p_size"), names, columns).alias("summary"))


@query("SELECT event_type, max(value) AS high, list_sort(list(value))[least(count(*), CAST(floor(count(*) * 0.95) AS BIGINT) + 1)] AS p95 FROM events GROUP BY event_type")
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank p95, by ranks and not by gathering a group."""
    return tabular.nearest_rank(read(spark, sf_dir, "events"), "event_type", "value", 0.95)


@query("SELECT d.doc_id FROM documents d JOIN (SELECT unnest(range(0, 50)) AS v) p ON d.doc_id = p.v * 3")
def json_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter list as JSON becomes rows, and those a semi join."""
    listed = "[" + ",".join(str(3 * v) for v in range(50)) + "]"
    ids = spark.range(1).select(F.explode(F.from_json(F.lit(listed), "array<bigint>")).alias("v"))
    return read(spark, sf_dir, "documents").join(ids, F.col("doc_id") == F.col("v"), "left_semi").select("doc_id")


@query(r"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), lambda x: x IN ('the', 'der', 'cion')) AS ts, len(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS dl FROM documents),
c AS (SELECT doc_id, len(ts) AS n, dl FROM t WHERE len(ts) > 0) SELECT doc_id AS chunk_id, CAST(n AS BIGINT) AS hits FROM c""")
def folded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index has terms without diacritics: ``cion`` is found where the text has ``ción``."""
    docs = read(spark, sf_dir, "documents")
    p = search.postings(docs, "doc_id", "text").where(F.col("term").isin(search.query_words("The dér ción")))
    return p.groupBy("chunk_id").agg(F.sum("tf").alias("hits"))
