"""How far the sources of a language differ in their words: a baseline-correction inverted index.

Of each language the terms in at least ``LEAST`` of its documents are kept, V of them. A group is a language and a source;
with n occurrences of kept terms, it gives a term with c of them p(c) = 1 + floor(SCALE * (c + ADD) / (n + ADD * V)). Two groups are
as far apart as the sum of |p - q| over the kept terms.

*Baseline.* If no term occurred, each pair would be V times f apart, where f = |z - y| and z = p(0), y = q(0).
*Corrections.* Only terms that occur change this. What a term of one group changes, if the other group lacks it, depends on p
and the other's y alone, so it is summed over the group's values of p, with the number of terms that have each. If both have it, the sum
of these two corrections is too large by twice what the intervals [z, p] and [y, q] share. So a term's postings, the groups that
have it, emit one correction for a pair whose intervals meet, and nothing for any other pair; they are summed before they are shuffled.
*Terms.* A group's terms that it gives more than its language does are ranked by a window that keeps ``TOP`` of each partition before its shuffle.

Texts are read once: tasks count by language, source and term and hand on one row for each, so a hot word or source is
small before the first shuffle. A term's postings are an array of the sources that have it, at most as long as the list of sources of
the language; pairs of these, all of which are reported, are the size of the result.

Defined results: null texts, languages and sources count as ''. Repeated rows are further documents. A language without kept terms
has pairs at distance 0 and no terms; one with a single source has no pairs; an empty table gives no rows. Ties are ranked by the
item's UTF-8 bytes. Only text, lang and source are read, so further columns may have any name. Texts are taken whole. Divisions are
of decimals, so they are exact for any count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, rows, written

LEAST, ADD, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Of UTF-8 bytes: ASCII letters and whatever is not ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Distinct language, source and term triples that a task counts before it hands them on.
HELD = 400_000
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n`` (occurrences) and ``docs`` (documents that have it); each group also has a row whose term is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                columns = [pa.array([*(t.decode() for t in terms), None], pa.string()), pa.array([*(n[t] for t in terms), 0], pa.int64()), pa.array([*(docs[t] for t in terms), 0], pa.int64())]
                same = [pa.array([x] * (len(terms) + 1), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, *columns], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in pieces(batches, "text"):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                # bytes.lower() lower-cases A-Z alone
                terms = Counter(TERM.findall(text.encode().lower())) if text else Counter()
                n, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                n.update(terms)
                docs.update(terms.keys())
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from handed_on()
        yield from handed_on()

    counted = rows(docs, "lang", "source", "text").mapInArrow(run, _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ADD) / (total + ADD * terms)), exactly; null without terms."""
    above = (count.cast("decimal(19,0)") + ADD) * F.lit(SCALE).cast("decimal(10,0)")
    below = total.cast("decimal(19,0)") + F.lit(ADD).cast("decimal(1,0)") * terms.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.when(terms > 0, F.call_function("div", above, below))


def _pairs(groups: DataFrame, index: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the distance of each ordered pair of groups of a language."""
    one = groups.select("lang", "source", "terms", "z")
    other = one.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    baseline = one.join(other, "lang").where("source != item").select("lang", "source", "item", F.coalesce(F.col("terms") * F.abs(F.col("z") - F.col("y")), F.lit(0)).alias("value"))
    # what the terms of one group change, by their shares
    alike = index.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("n"))
    change = F.col("n") * (F.abs(F.col("p") - F.col("y")) - F.abs(F.col("z") - F.col("y")))
    single = alike.join(other, "lang").where((F.col("source") != F.col("item")) & (change != 0)).groupBy("lang", "source", "item").agg(F.sum(change).alias("value"))
    single = single.unionByName(single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # what both have
    postings = index.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "z", "p"))).alias("groups")).where(F.size("groups") > 1)
    first = postings.select("lang", "groups", F.posexplode("groups").alias("at", "a"))
    shared = F.least("a.p", "b.p") - F.greatest("a.z", "b.z")
    met = first.select("lang", "a", F.explode(F.slice("groups", F.col("at") + 2, F.size("groups"))).alias("b")).where(shared > 0)
    both = met.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg((-2 * F.sum(shared)).alias("value"))
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return baseline.unionByName(single).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: of each group the distances to the other sources of its language (``pair``), and the
    terms that it has most above its language (``term``, the first ``top`` ranks)."""
    counts = written(term_counts(docs), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = written(kept, "kept-terms")
    languages = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("in_lang"))
    having = written(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "of_lang"), "postings")
    sums = having.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"), "in_lang")
    groups = written(groups.withColumn("z", share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    shares = having.join(groups, ["lang", "source"]).select("lang", "source", "term", "z", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("of_lang"), F.col("in_lang"), F.col("terms")).alias("q"))
    shares = written(shares, "shares")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Dense, as the definition reads: every pair of groups over every kept term.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST}),
v AS (SELECT lang, count(*) AS terms FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {ADD})) // (total + {ADD} * terms) AS p
      FROM gn JOIN kept ON kept.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
q AS (SELECT l.lang, l.term, 1 + ({SCALE}::HUGEINT * (l.n + {ADD})) // (sum(l.n) OVER (PARTITION BY l.lang) + {ADD} * terms) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) l JOIN v ON v.lang = l.lang),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
         FROM gn a JOIN gn b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT s.lang, s.source, o.source AS item, sum(abs(s.p - o.p)) AS value FROM p s JOIN p o ON s.lang = o.lang AND s.term = o.term AND s.source <> o.source GROUP BY ALL) x
           ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT p.lang, source, p.term AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term) WHERE rank <= {TOP}
"""
