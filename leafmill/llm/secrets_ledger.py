"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every historical version of every path is addressed by the SHA-256 of its content. The ledger holds, as
Parquet folders, the (blob, rule, version of the rule) pairs that were scanned and what was found. A scan
takes one representative of each blob, leaves out the pairs that the ledger has, searches the rest, appends
to the ledger, and joins the findings of all blobs back to all paths and versions. Changing a rule's version
rescans every blob for that rule alone.

A rule is a pattern whose matches are taken leftmost and non-overlapping; a match stays if its checked group
is long enough. Spans count code points, end exclusive: they follow from the lengths of the matches
(``regexp_extract_all``) and of the text between them (``split``), summed by a window over the matches of a blob.

Defined results: null text counts as empty and has no findings. Repeated rows, and the same content at other paths, all get
the findings of their blob. Of matches at one place the longer pattern of a rule stays, as its expression says; spans of different
rules may overlap, and those with one start come in the order of the rules. Null paths are kept. An empty table gives no rows.
Only path, version and text are read, so further columns may have any name. Texts of any length are taken whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


#: The base rules, in their order (fixed values), and further well-known formats of credentials.
#: ``[0-9a-f]{24,}`` and ``AKIA[A-Z0-9]{16,}`` match what the open-ended patterns match and a length check keeps:
#: their runs are maximal, so that where the first start in a run is too short, every later one is.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
FURTHER = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("ghtoken", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + FURTHER

SPANS = "array<struct<start:int,end:int>>"


MATCHES = "array<struct<b:int,f:int,c:int>>"


def matches(text: Column, rule: Rule) -> Column:
    """Of each match of a rule in ``text`` the code points between it and the match before it (b), its own (f), and those of the checked
    group (c); null where the pattern does not occur. All in one pass each."""
    lengths = lambda a: F.transform(a, F.length)
    between, found = lengths(F.split(text, rule.pattern, -1)), lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    checked = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else found
    return F.when(text.rlike(rule.pattern), F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("f"), checked.alias("c")).cast(MATCHES))


def located(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, kind, version, spans`` from ``blob, kind, version, matches``: where each match lies follows from the running sum of what comes
    before it, taken by a window, so that a text with very many matches costs no more for each of them."""
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    each = found.select("blob", "kind", "version", F.posexplode("matches").alias("nth", "m")).select("blob", "kind", "version", "nth", "m.*")
    end = F.sum(F.col("b") + F.col("f")).over(Window.partitionBy("blob", "kind", "version").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    kept = each.withColumn("end", end).where(F.col("c") >= least[F.col("kind")])
    return kept.groupBy("blob", "kind", "version").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("f")).alias("start"), "end"))).cast(SPANS).alias("spans"))


def open_ledger(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The ledger's scanned pairs and findings; empty where the folder is new."""
    scanned, findings = "blob string, kind string, version int", f"blob string, kind string, version int, spans {SPANS}"
    for name, schema in (("scanned", scanned), ("findings", findings)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/{name}")
    return spark.read.schema(scanned).parquet(f"{folder}/scanned"), spark.read.schema(findings).parquet(f"{folder}/findings")


def update_ledger(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger lacks of ``versions`` (path, version, text) and append it.

    Only hashes and ids are grouped (partial sums take the copies); each text moves once, and only that of a
    blob with an unseen pair. Findings are appended before the pairs that they belong to: a run that dies in
    between scans again and repeats findings, which reading takes once.
    """
    spark = versions.sparkSession
    scanned, _ = open_ledger(spark, folder)
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = versions.select("path", "version", text.alias("text"), F.sha2(text, 256).alias("blob"))
    blobs = keyed.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    seen = scanned.join(F.broadcast(wanted), ["kind", "version"]).groupBy("blob").agg(F.collect_set("kind").alias("seen"))  # at most one entry a rule
    todo = blobs.join(seen, "blob", "left").select(
        "blob", F.col("at.path").alias("path"), F.col("at.version").alias("version"), F.array_except(F.array(*[F.lit(r.kind) for r in rules]), F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")
    ).where(F.size("todo") > 0)
    k, t = keyed.alias("k"), todo.alias("t")
    unseen = k.join(t, F.col("k.path").eqNullSafe(F.col("t.path")) & F.col("k.version").eqNullSafe(F.col("t.version")) & (F.col("k.blob") == F.col("t.blob"))).select("k.blob", "k.text", "t.todo")
    per_rule = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("todo", r.kind), matches(F.col("text"), r)).alias("matches")) for r in rules]
    found = unseen.select("blob", F.filter(F.array(*per_rule), lambda x: F.size(x["matches"]) > 0).alias("found")).where(F.size("found") > 0)
    located(found.select("blob", F.explode("found").alias("x")).select("blob", "x.*"), rules).write.mode("append").parquet(f"{folder}/findings")
    versions_of = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    todo.select("blob", F.explode("todo").alias("kind")).withColumn("version", versions_of[F.col("kind")]).write.mode("append").parquet(f"{folder}/scanned")


def findings_by_path(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path, version, blob, found`` of every row: ``found`` maps a kind to its spans.

    The findings have one row a blob; a blob with very many paths is split by AQE on the paths' side.
    """
    spark = versions.sparkSession
    _, findings = open_ledger(spark, folder)
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    once = findings.join(F.broadcast(wanted), ["kind", "version"]).groupBy("blob", "kind").agg(F.first("spans").alias("spans"))
    by_blob = once.groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("kind", "spans"))).alias("found"))  # at most one entry a rule
    return versions.select("path", "version", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob")).join(by_blob, "blob", "left").select("path", "version", "blob", "found")


def joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    none = F.array().cast(SPANS)

    def named(nth: int, kind: str) -> Column:
        return F.transform(F.coalesce(found[kind], none), lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    rows = F.concat(*[named(i, r.kind) for i, r in enumerate(rules)])
    return F.coalesce(F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document is a path with one version; the ledger starts empty, in the application's own folder of the shared one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    folder = f"{scratch(spark)}/ledger-{uuid.uuid4().hex}"
    update_ledger(versions, folder)
    found = F.coalesce(F.col("found"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{SPANS}>")))
    counts = [F.coalesce(F.size(found[r.kind]), F.lit(0)) for r in BASE]
    counts = [F.greatest(c, F.lit(0)).cast("long").alias(f"n_{r.kind}") for c, r in zip(counts, BASE)]
    return findings_by_path(versions, folder).select(F.col("path").alias("doc_id"), *counts, F.sha2(joined(found, BASE), 256).alias("base_sha256"), joined(found, RULES).alias("spans"))


def _oracle() -> str:
    """DuckDB: the open-ended base patterns with their length checks, and the further rules, spans by prefix sums."""
    patterns = [(BASE[0].kind, BASE[0].pattern, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), *[(r.kind, r.pattern, 0, 0) for r in FURTHER]]
    q = lambda s: "'" + s.replace("'", "''") + "'"
    per = [
        f"SELECT doc_id, rid, {i} AS nth, {q(k)} AS kind, b, f, c, {least} AS least FROM (SELECT doc_id, rid, list_transform(regexp_split_to_array(t, {q(p)}), lambda x: len(x)) AS b, "
        f"list_transform(regexp_extract_all(t, {q(p)}), lambda x: len(x)) AS f, list_transform(regexp_extract_all(t, {q(p)}, {g}), lambda x: len(x)) AS c FROM d WHERE regexp_matches(t, {q(p)}))"
        for i, (k, p, g, least) in enumerate(patterns)
    ]
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(per)}),
e AS (SELECT rid, nth, kind, unnest(range(1, len(f) + 1)) AS i, b, f, c, least FROM m),
s AS (SELECT rid, nth, kind, CAST(list_sum(b[1:i]) + coalesce(list_sum(f[1:i-1]), 0) AS BIGINT) AS a, CAST(list_sum(b[1:i]) + list_sum(f[1:i]) AS BIGINT) AS z FROM e WHERE c[i] >= least),
g AS (SELECT rid, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, nth) FILTER (nth < 3) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, nth) AS spans FROM s GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


ORACLE = _oracle()
