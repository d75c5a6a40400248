"""Scalar functions of the SQL surface, files rules and text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect as d
from ..functions import text as tx
from ..sources import filters
from . import query, question, read

question("fn_round_abs_sign", "SELECT c_custkey, round(c_acctbal, 1) AS r, abs(c_acctbal) AS a, sign(c_acctbal) AS s FROM customer", "SELECT c_custkey, round(c_acctbal, 1) AS r, abs(c_acctbal) AS a, sign(c_acctbal)::DOUBLE AS s FROM customer")
question("fn_floor_ceil_power", "SELECT p_partkey, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, power(p_size, 2) AS sq, round(sqrt(p_size), 6) AS rt FROM part", "SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, power(p_size, 2)::DOUBLE AS sq, round(sqrt(p_size), 6) AS rt FROM part")
question("fn_null_handling", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS a, ifnull(nullif(c_nationkey, 3), -1) AS b FROM customer")
question("fn_substr_instr_replace", "SELECT p_partkey, substr(p_name, 2, 4) AS s, substr(p_name, -3) AS tail, instr(p_name, 'a') AS at, replace(p_name, ' ', '_') AS r, length(p_name) AS n FROM part", "SELECT p_partkey, substr(p_name, 2, 4) AS s, right(p_name, 3) AS tail, CAST(instr(p_name, 'a') AS INTEGER) AS at, replace(p_name, ' ', '_') AS r, CAST(length(p_name) AS INTEGER) AS n FROM part")
question("fn_upper_lower_trim", "SELECT s_suppkey, upper(s_name) AS u, lower(s_name) AS l, trim(concat('  ', s_name, ' ')) AS t, trim(BOTH 'S' FROM s_name) AS x FROM supplier", "SELECT s_suppkey, upper(s_name) AS u, lower(s_name) AS l, trim('  ' || s_name || ' ') AS t, trim(s_name, 'S') AS x FROM supplier")
question("fn_like", "SELECT p_partkey FROM part WHERE p_type ILIKE '%steel%' OR p_name LIKE '_a%'")
question("fn_cast_case", "SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS band, CAST(o_custkey AS STRING) AS k FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS band, CAST(o_custkey AS VARCHAR) AS k FROM orders")
question("fn_between_in", "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 AND l_linenumber IN (1, 3, 5) AND l_tax IS NOT NULL")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS side FROM customer")
def fn_iif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", d.iif(F.col("c_acctbal") > 0, F.lit("credit"), F.lit("debit")).alias("side"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS root FROM customer")
def fn_safe_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(d.safe_sqrt(F.col("c_acctbal")), 6).alias("root"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey // nullif(l_linenumber - 1, 0) AS q FROM lineitem")
def fn_int_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d.int_div(F.col("l_orderkey"), F.col("l_linenumber") - 1).alias("q"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*[a-e]?'")
def fn_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_name").where(d.glob(F.col("p_name"), "*[a-e]?"))


@query("SELECT s_suppkey, printf('%05d|%s', s_suppkey, s_name) AS line FROM supplier")
def fn_printf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.printf(F.lit("%05d|%s"), "s_suppkey", "s_name").alias("line"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m') AS ym, strftime(o_orderdate, '%j') AS yday, CAST(dayofweek(o_orderdate) AS VARCHAR) AS wday FROM orders")
def fn_strftime(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", d.strftime("%Y/%m", at).alias("ym"), d.strftime("%j", at).alias("yday"), d.strftime("%w", at).alias("wday"))


@query("""
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
  strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)), '%Y-%m-%d') AS next_month FROM orders""")
def fn_date_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", d.start_of(at, "month").cast("string").alias("month_start"), d.add_months_overflow(at, 1).cast("string").alias("next_month"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) + 2440587.5::DOUBLE AS jd FROM orders")
def fn_julianday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", d.julianday(F.col("o_orderdate")).alias("jd"))


@query("SELECT p_partkey, CASE WHEN nullif(p_size, 7) IS NOT NULL THEN least(p_size, 20) END AS low, CASE WHEN nullif(p_size, 7) IS NOT NULL THEN greatest(p_size, 20) END AS high FROM part")
def fn_scalar_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.nullif(F.col("p_size"), F.lit(7))
    return read(spark, sf_dir, "part").select("p_partkey", d.scalar_min(size, F.lit(20)).alias("low"), d.scalar_max(size, F.lit(20)).alias("high"))


@query("""
SELECT column_name AS name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'real' ELSE 'text' END AS type
FROM (DESCRIBE lineitem) t(column_name, data_type, a, b, c, d)""".replace("FROM (DESCRIBE lineitem) t(column_name, data_type, a, b, c, d)", "FROM (SELECT column_name, column_type AS data_type FROM (DESCRIBE lineitem))"))
def fn_typeof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c, d.typeof(t)) for c, t in read(spark, sf_dir, "lineitem").dtypes], "name string, type string")


# Files and rules ----------------------------------------------------------------------------------

def file_path() -> Column:
    """The path that a document stands for: source, language, id."""
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


_PATH = "source || '/' || lang || '/' || doc_id || '.txt'"


def _paths(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", file_path().alias("path"), *more)


@query(f"SELECT doc_id, {_PATH} AS path, lang FROM documents WHERE lang = 'de'")
def scan_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, "lang").where("lang = 'de'")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query(f"SELECT doc_id, {_PATH} AS path FROM documents WHERE instr(lower({_PATH}), 'src1/en') > 0")
def path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(F.instr(F.lower("path"), "src1/en") > 0)


@query(f"SELECT doc_id, {_PATH} AS path FROM documents WHERE NOT regexp_matches({_PATH}, '^src1[0-9]/.*$') AND NOT regexp_matches({_PATH}, '(^|/)[0-9]*7\\.txt$')")
def glob_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(~filters.any_glob(F.col("path"), ["src1[0-9]/**", "*7.txt"]))


@query(f"SELECT doc_id, {_PATH} AS path FROM documents WHERE regexp_matches({_PATH}, '(^|/)[^/]*12[^/]*$') OR regexp_matches({_PATH}, '^src2/')")
def glob_include_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = filters.Rules.parse(["!12", "!src2/**"])
    return _paths(spark, sf_dir).where(filters.skip_reason(F.col("path"), rules).isNull())


@query(f"SELECT doc_id, CASE WHEN regexp_matches({_PATH}, '^src3/') THEN 'Excluded by rule: src3/' WHEN regexp_matches({_PATH}, '(^|/)1[^/]*\\.txt$') THEN 'Excluded by rule: 1*.txt' END AS reason FROM documents")
def rule_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", filters.skip_reason(F.col("path"), filters.Rules.parse(["src3/", "1*.txt"])).alias("reason"))


@query("SELECT doc_id, doc_id % 8 IN (0, 1, 2, 3) AS ignored FROM documents")
def builtin_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool folders, hidden names, lock and system files are ignored; folders of build output are not."""
    kinds = ("node_modules/a.txt", "x/.hidden/b.txt", "x/~$c.docx", "x/Thumbs.db", "dist/a.txt", "src/build/readme.md", "out/dist.txt", "x/venvs/c.txt")
    path = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", filters.ignored(path).alias("ignored"))


@query(f"SELECT doc_id, CASE WHEN NOT (regexp_matches({_PATH}, '(^|/)[^/]*12[^/]*$') OR regexp_matches({_PATH}, '[.]md$')) THEN 'Not one of the file types or names to include' END AS reason FROM documents")
def include_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", filters.skip_reason(F.col("path"), filters.Rules.parse(["!*.md", "!12"])).alias("reason"))


@query("SELECT doc_id, CASE WHEN n_chars > 2097 THEN 'Larger than 0.002 MB' END AS reason FROM documents")
def size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", filters.size_reason(F.col("n_chars"), 0.002).alias("reason"))


# Text ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, substr(text, 1, 240) AS snippet FROM documents")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query(f"SELECT doc_id, doc_id || '.txt' AS name, 'txt' AS ext, 'text' AS kind FROM documents")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select("doc_id", tx.file_name(p).alias("name"), tx.extension(p).alias("ext"), tx.file_kind(p).alias("kind"))


@query("SELECT doc_id, CASE WHEN u = '' THEN s || ' B' WHEN v >= 10 THEN CAST(floor(v + 0.5::DOUBLE) AS BIGINT) || u ELSE printf('%.1f', round(v, 1)) || u END AS size FROM (SELECT doc_id, s, CASE WHEN s < 1024 THEN '' WHEN s < 1048576 THEN ' KB' ELSE ' MB' END AS u, CASE WHEN s < 1048576 THEN s / 1024.0::DOUBLE ELSE s / 1048576.0::DOUBLE END AS v FROM (SELECT doc_id, n_chars * 4 AS s FROM documents))")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.format_bytes(F.col("n_chars") * 4).alias("size"))


@query("SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(f) > 200 THEN rtrim(substr(f, 1, 197)) || '...' ELSE f END AS summary FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.summary(F.col("text"), 200).alias("summary"))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: len(x) > 0) AS ls FROM documents),
h AS (SELECT doc_id, ls, list_filter(ls, lambda x: starts_with(x, '#') OR starts_with(lower(x), 'sheet:') OR (len(x) BETWEEN 4 AND 120 AND len(regexp_replace(x, '[^\p{L}]', '', 'g')) > 0 AND (ends_with(x, ':') OR
  len(regexp_replace(x, '[^\p{Lu}]', '', 'g')) > len(regexp_replace(x, '[^\p{L}]', '', 'g')) * 0.55::DOUBLE))) AS hs FROM l),
e AS (SELECT doc_id, list_transform(CASE WHEN len(hs) > 0 THEN hs[1:6] ELSE ls[1:6] END, lambda x: CASE WHEN len(trim(regexp_replace(x, '\s+', ' ', 'g'))) > 120 THEN rtrim(substr(trim(regexp_replace(x, '\s+', ' ', 'g')), 1, 117)) || '...' ELSE trim(regexp_replace(x, '\s+', ' ', 'g')) END) AS v FROM h),
u AS (SELECT doc_id, v, unnest(range(1, len(v) + 1)) AS i FROM e), f AS (SELECT doc_id, v[i] AS x, min(i) AS i FROM u GROUP BY ALL)
SELECT d.doc_id, coalesce(string_agg(x, '|' ORDER BY i), '') AS hints FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def section_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.array_join(tx.section_hints(F.col("text")), "|"), F.lit("")).alias("hints"))


@query("SELECT sha256(text) AS h, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text")
def sha256_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query(r"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: len(x) >= 2) AS t FROM documents)")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.terms(F.col("text"), 2)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) > 1), ' ') AS terms FROM benchmark")
def manifest_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.manifest_terms(F.col("text")), " ").alias("terms"))


@query(r"""
SELECT doc_id, CAST(count(*) FILTER (starts_with(x, '#') OR ends_with(x, ':')) AS INTEGER) AS marked FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY doc_id""")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(lines, lambda x: x.startswith("#") | x.endswith(":"))).alias("marked"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 2 THEN -o_totalprice ELSE o_totalprice END AS number FROM orders")
def classify_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey") % 4, F.format_number("o_totalprice", 2)
    cell = F.when(k == 0, F.concat(F.lit("$"), price)).when(k == 1, F.concat(F.lit(" "), price)).when(k == 2, F.concat(F.lit("("), price, F.lit(")"))).otherwise(F.concat(F.lit("0"), F.col("o_orderkey").cast("string")))
    return read(spark, sf_dir, "orders").select("o_orderkey", tx.cell_number(cell).alias("number"))


@query("""
SELECT o_orderkey, CASE k WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d WHEN 4 THEN d || ' 13:45:10' WHEN 5 THEN d || ' 13:30:00' WHEN 6 THEN d || ' 00:05:00' END AS day
FROM (SELECT o_orderkey, o_orderkey % 8 AS k, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""")
def classify_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day stay, in 12 or 24 hours; what follows a date without being a time makes it text."""
    k, at = F.col("o_orderkey") % 8, F.col("o_orderdate")
    shown = lambda form, after="": F.concat(F.date_format(at, form), F.lit(after))
    cell = (
        F.when(k == 0, shown("M/d/yyyy")).when(k == 1, shown("yyyy-MM-dd")).when(k == 2, shown("yyyy/M/d")).when(k == 3, F.lit("31/31/2020"))
        .when(k == 4, shown("yyyy-MM-dd", " 13:45:10")).when(k == 5, shown("M/d/yyyy", " 1:30 PM")).when(k == 6, shown("M/d/yyyy", " 12:05am")).otherwise(shown("yyyy-MM-dd", " garbage"))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", tx.cell_date(cell).alias("day"))


@query("""
SELECT p_partkey, round(0.8::DOUBLE + 1.2 + CASE WHEN regexp_matches(p_name, '[0-9]') THEN 0 ELSE 0.35 END + CASE WHEN length(p_name) <= 40 THEN 0.2 ELSE 0 END
  + 1.0 + 0.2 + CASE WHEN regexp_matches(p_brand, '[0-9]') THEN 0 ELSE 0.35 END + CASE WHEN regexp_matches(p_brand, '^[A-Z]{2,}[0-9]+$') THEN 0 ELSE 0.2 END, 6) AS score FROM part""")
def header_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.round(tx.header_score(F.array("p_name", F.lit(""), "p_brand")), 6).alias("score"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^0-9a-z]+', '_', 'g'), '_') AS name FROM part")
def sanitize_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", tx.identifier(F.col("p_type")).alias("name"))


@query("""SELECT conv_id, turn, CASE WHEN contains(g, '"') OR contains(g, ',') OR contains(g, chr(10)) OR contains(g, chr(13)) THEN '"' || replace(g, '"', '""') || '"' ELSE g END AS cell
FROM (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^[=+\\-@\t\r]') AND NOT regexp_matches(text, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN '''' || text ELSE text END AS g FROM conversations)""")
def csv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.csv_cell(F.col("text")).alias("cell"))


@query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '([\\|])', '\\\1', 'g'), '\s*\n\s*', ' ', 'g') AS cell FROM conversations")
def markdown_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.markdown_cell(F.col("text")).alias("cell"))
