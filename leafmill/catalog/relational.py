"""Joins, aggregates, windows, sorting and set operations of the SQL surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dialect as d
from ..operators import tabular
from . import query, question, read

# Joins ------------------------------------------------------------------------------------------

question("join_inner", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000")
question("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
question("join_right", "SELECT n.n_name, count(s.s_suppkey) AS n_suppliers FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
question("join_full", "SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < -900 GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) b ON a.k = b.k")
question("join_semi_in", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
question("join_semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
question("join_anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
question("join_anti_not_exists", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R')")
question("join_left_null_anti", "SELECT s.s_suppkey FROM supplier s LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity < 3) l ON l.l_suppkey = s.s_suppkey WHERE l.l_suppkey IS NULL")
question("join_self", "SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
question("join_cross_capped", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n ORDER BY r.r_name, n.n_name LIMIT 40")
question("join_theta_expr", "SELECT n.n_nationkey, c.c_custkey FROM nation n JOIN customer c ON c.c_custkey = n.n_nationkey * 7 + 1")
question("join_range_between", "SELECT b.label, count(*) AS n FROM (SELECT 'small' AS label, 0 AS low, 50000 AS high UNION ALL SELECT 'medium', 50001, 200000 UNION ALL SELECT 'large', 200001, 1000000) b JOIN orders o ON o.o_totalprice BETWEEN b.low AND b.high GROUP BY b.label")
question("join_natural_using", "SELECT k.nationkey, k.n_name, s.s_name FROM (SELECT n_nationkey AS nationkey, n_name FROM nation) k JOIN (SELECT s_nationkey AS nationkey, s_name FROM supplier) s USING (nationkey)")
question("join_natural", "SELECT nationkey, n_name, s_name FROM (SELECT n_nationkey AS nationkey, n_name FROM nation) k NATURAL JOIN (SELECT s_nationkey AS nationkey, s_name FROM supplier) s")
question("join_scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) + 5000 FROM customer)")
question("join_correlated_subquery", "SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
question("join_nested_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9900))")
question("join_five_way", "SELECT r.r_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")


@query("SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of a value per key; Spark broadcasts the labels only while their size allows it."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "n_chars", "quality")


# Aggregates -------------------------------------------------------------------------------------

question("agg_count", "SELECT count(*) AS n, count(c_acctbal) AS n_bal, count(nullif(c_mktsegment, 'BUILDING')) AS n_other FROM customer")
question("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
question("agg_sum_null", "SELECT sum(c_acctbal) AS s FROM customer WHERE c_custkey < 0")
question("agg_sum_int", "SELECT o_orderstatus, sum(o_orderkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
question("agg_avg", "SELECT l_linestatus, round(avg(l_quantity), 4) AS q, round(avg(l_extendedprice), 2) AS p FROM lineitem GROUP BY l_linestatus")
question("agg_min_max", "SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderkey) AS first_key FROM orders GROUP BY o_orderpriority")
question("agg_group_expr", "SELECT floor(o_totalprice / 50000) AS band, count(*) AS n FROM orders GROUP BY floor(o_totalprice / 50000)", "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS band, count(*) AS n FROM orders GROUP BY 1")
question("agg_group_alias", "SELECT strftime_month AS month, count(*) AS n FROM (SELECT date_format(o_orderdate, 'yyyy-MM') AS strftime_month FROM orders) t GROUP BY strftime_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
question("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
question("agg_filter_clause", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus <> 'F') AS others FROM orders GROUP BY o_orderpriority")
question("agg_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
question("agg_group_concat", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
question("agg_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus", None)


@query("SELECT n_name, coalesce(sum(c_acctbal), 0.0) AS total FROM (SELECT n_name, round(c_acctbal, 2) AS c_acctbal FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9990) GROUP BY n_name".replace("coalesce(sum(c_acctbal), 0.0)", "round(coalesce(sum(c_acctbal), 0.0), 2)"))
def agg_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer").where("c_acctbal > 9990")
    return n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").groupBy("n_name").agg(F.round(d.total(F.col("c_acctbal")), 2).alias("total"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang NOT IN ('en', 'de')) AS others FROM documents GROUP BY source")
def agg_stats_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c, n: F.count_if(c).alias(n)
    return read(spark, sf_dir, "documents").groupBy("source").agg(one(F.col("lang") == "en", "en"), one(F.col("lang") == "de", "de"), one(~F.col("lang").isin("en", "de"), "others"))


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS kinds, CAST(sum(n) AS BIGINT) AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def agg_kind_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind as a map per key, here shown as text; the map has an entry a kind."""
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    kinds = F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n"))))
    shown = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return counts.groupBy("user_id").agg(kinds.alias("kinds"), F.sum("n").alias("total")).select("user_id", shown.alias("kinds"), "total")


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.cells(read(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"]).unionByName(tabular.cells(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("""
WITH c AS (SELECT 'c_name' AS "column", c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
g AS (SELECT "column", trim(v) AS v, count(*) AS n FROM c WHERE trim(v) <> '' GROUP BY ALL)
SELECT "column", string_agg(v, '|' ORDER BY lower(v), v) AS categories FROM g GROUP BY "column" HAVING sum(n) >= 2 AND count(*) <= least(12, sum(n) // 2) AND max(len(v)) <= 40""")
def agg_category_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.categories(_profiled(spark, sf_dir)).select("column", F.array_join("categories", "|").alias("categories"))


@query("""
SELECT 'c_custkey' AS "column", 'integer' AS type, count(c_custkey) AS non_null, CAST(0 AS BIGINT) AS failed FROM customer UNION ALL SELECT 'c_acctbal', 'real', count(c_acctbal), 0 FROM customer
UNION ALL SELECT 'c_name', 'text', count(c_name), 0 FROM customer UNION ALL SELECT 'o_orderdate', 'date', count(o_orderdate), 0 FROM orders""")
def agg_type_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tabular.cells(read(spark, sf_dir, "customer"), ["c_custkey", "c_acctbal", "c_name"])
    o = tabular.cells(read(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "M/d/yyyy")), ["o_orderdate"])
    return tabular.type_votes(c.unionByName(o))


@query("""
SELECT n_regionkey AS doc, count(*) AS sheet_count, CAST(sum(len(n_name)) AS BIGINT) AS row_count, string_agg(n_name, '|' ORDER BY n_name) AS sheet_names FROM nation GROUP BY n_regionkey""")
def agg_structure_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc"), F.col("n_name").alias("sheet"), F.length("n_name").alias("row_count"), F.array(F.lit("key"), F.lit("name")).alias("headers"))
    return tabular.structure(sheets, "doc").select("doc", "sheet_count", "row_count", F.array_join("sheet_names", "|").alias("sheet_names"))


_STATUS = "CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'failed' WHEN coalesce(l.quality, 0) = 1 THEN 'indexed' ELSE 'skipped' END"


@query(f"SELECT source, CASE WHEN bool_or(s = 'indexed') THEN 'ready' WHEN bool_or(s = 'failed') THEN 'error' ELSE 'idle' END AS state FROM (SELECT d.source, {_STATUS} AS s FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY source")
def agg_channel_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.coalesce("toxic", F.lit(0)) == 1, "failed").when(F.coalesce("quality", F.lit(0)) == 1, "indexed").otherwise("skipped")
    return tabular.channel_status(rows, "source", status)


@query("""
WITH s AS (SELECT n_name, sum(o_orderkey) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, n_name) AS n FROM s)
SELECT CASE WHEN n < 8 THEN n_name ELSE 'Other' END AS slice, CAST(sum(v) AS BIGINT) AS value FROM r GROUP BY 1""")
def agg_pie_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    rows = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return tabular.pie_fold(rows, "n_name", "o_orderkey")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS high FROM events GROUP BY event_type")
def agg_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.max("value").alias("high"))


@query("SELECT EXISTS (SELECT 1 FROM labels WHERE toxic = 1) AS any_toxic, EXISTS (SELECT 1 FROM labels WHERE toxic > 5) AS any_odd")
def agg_exists_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return spark.createDataFrame([(not labels.where("toxic = 1").limit(1).isEmpty(), not labels.where("toxic > 5").limit(1).isEmpty())], "any_toxic boolean, any_odd boolean")


# Windows ----------------------------------------------------------------------------------------

question("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders")
question("win_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
question("win_dense_rank", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
question("win_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quartile FROM customer")
question("win_lag", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lag(o_orderkey, 2, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS two FROM orders")
question("win_lead", "SELECT o_orderkey, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_price FROM orders")
question("win_first", "SELECT l_orderkey, l_linenumber, first_value(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS f FROM lineitem")
question("win_last", "SELECT l_orderkey, l_linenumber, last_value(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM lineitem")
question("win_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders")
question("win_rows_frame", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving FROM orders")
question("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near_sizes FROM part")
question("win_named", "SELECT c_custkey, count(*) OVER w AS n, max(c_acctbal) OVER w AS top FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
question("win_share", "SELECT s_suppkey, round(s_acctbal / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 6) AS share FROM supplier")
question("win_filtered", "SELECT o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS f FROM orders", "SELECT o_orderkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS BIGINT) AS f FROM orders")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def win_last_n_per_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("n <= 6").drop("n")


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal FROM documents")
def win_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long").alias("ordinal"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def win_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of equal texts, by a hash of the text and partial minima instead of a sort of texts."""
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part)")
def win_unique_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(F.lower("p_name")).orderBy("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", F.when(n == 1, F.col("p_name")).otherwise(F.concat_ws("_", "p_name", n.cast("string"))).alias("unique_name"))


# Sorting, limits, set operations ------------------------------------------------------------------

question("sort_nulls", "SELECT o_custkey, f FROM (SELECT o_custkey, max(nullif(o_totalprice, 0)) AS f FROM orders GROUP BY o_custkey UNION ALL SELECT -1, NULL) t ORDER BY f NULLS FIRST, o_custkey LIMIT 20")
question("limit_offset", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50")
question("sort_nocase", "SELECT c_custkey, lower(c_name) AS n FROM customer ORDER BY lower(c_name), c_custkey LIMIT 30")
question("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
question("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
question("intersect_rows", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity = 50")
question("except_rows", "SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
question("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE s > 2000000) SELECT o_custkey, round(s, 2) AS s FROM top")
question("values_cte", "WITH v(k, w) AS (VALUES (0, 'zero'), (1, 'one'), (2, 'two')) SELECT r.r_name, v.w FROM region r JOIN v ON r.r_regionkey = v.k")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 200")
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: sorted per partition, merged as the best 200."""
    return read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(200)


@query("SELECT doc_id, n_chars, source FROM documents ORDER BY n_chars DESC, source, doc_id LIMIT 50")
def file_table_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source").orderBy(F.desc("n_chars"), "source", "doc_id").limit(50)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def removed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def valid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return read(spark, sf_dir, "labels").select("doc_id").join(english, "doc_id", "left_semi")
