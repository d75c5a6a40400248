"""Keyword and vector search as DataFrame plans.

Postings, lengths and corpus statistics are plain tables. A query is a handful of terms (64 at most), so its
terms are literals that are pushed down to the scan of the postings, never a join side. Scores are summed per
chunk with partial sums, ranked by ``TakeOrderedAndProject``, and only the winners fetch their text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx

# Fixed values of the ranking rules.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
PATH_BONUS, VISUAL_BONUS = 0.75, 1.5
#: Words of a query that favour chunks with visuals, and those that ask for the inventory of visuals.
VISUAL_TERMS = frozenset("chart charts graph graphs image images diagram diagrams figure figures screenshot screenshots visual visuals".split())
INVENTORY_TERMS = VISUAL_TERMS | frozenset("photo photos picture pictures".split())


def query_words(query: str, most: int = 64) -> list[str]:
    """Distinct lower-cased terms of two characters or more, without diacritics, as the index holds them."""
    import re

    found = (w for w in re.findall(r"[^\W_]+", query.casefold()) if len(w) >= 2)
    return list(dict.fromkeys(map(tx.folded, found)))[:most]


def postings(chunks: DataFrame, id_column: str = "chunk_id", text_column: str = "text") -> DataFrame:
    """``term, chunk_id, tf, dl``: term frequencies with the chunk's length in terms."""
    found = chunks.select(F.col(id_column).alias("chunk_id"), tx.index_terms(F.col(text_column)).alias("terms"))
    rows = found.select("chunk_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def lengths(chunks: DataFrame, id_column: str = "chunk_id", text_column: str = "text") -> DataFrame:
    return chunks.select(F.col(id_column).alias("chunk_id"), F.size(tx.index_terms(F.col(text_column))).alias("dl"))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """``statistics`` of chunks; only their texts are read."""
    return statistics(lengths(chunks))


def statistics(lengths_: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length."""
    return lengths_.agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))


def bm25_scores(posting_rows: DataFrame, stats: DataFrame, words: Sequence[str]) -> DataFrame:
    """``chunk_id, text_score`` of the chunks that hold any of the words (Okapi BM25, higher is better), with their path if postings have it.

    A term that half of the chunks or more hold has the floor as its weight. Statistics are the whole corpus's.
    """
    path = ["relative_path"] if "relative_path" in posting_rows.columns else []
    if not words:
        return posting_rows.limit(0).select("chunk_id", F.lit(0.0).alias("text_score"), *path)
    found = posting_rows.where(F.col("term").isin(list(words)))
    df = found.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term
    weighed = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # and one row of statistics
    idf = F.greatest(F.log((F.col("n_chunks") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))), F.lit(IDF_FLOOR))
    tf = F.col("tf").cast("double")
    score = idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")))
    # a sum for each word, added in the words' order, so that equal chunks have equal scores however their rows arrive
    by_word = [F.sum(F.when(F.col("term") == w, score)).alias(f"__{i}") for i, w in enumerate(words)]
    sums = weighed.groupBy("chunk_id").agg(*by_word, *[F.first(c).alias(c) for c in path])
    return sums.select("chunk_id", reduce(add, [F.coalesce(f"__{i}", F.lit(0.0)) for i in range(len(words))]).alias("text_score"), *path)


def path_bonus(path: Column, words: Sequence[str]) -> Column:
    """0.75 for each distinct query word among the terms of the path."""
    if not words:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array(*[F.lit(w) for w in words]), F.array_distinct(tx.terms(path, 2)))) * F.lit(PATH_BONUS)


def visual_bonus(has_visual: Column, words: Sequence[str]) -> Column:
    return F.when(has_visual, F.lit(VISUAL_BONUS)).otherwise(0.0) if VISUAL_TERMS & set(words) else F.lit(0.0)


def ranked(chunks: DataFrame, posting_rows: DataFrame, stats: DataFrame, query: str, k: int | None = 8, document_ids: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """``chunk_id, score`` of the best ``k`` chunks (None: of all) by text score plus path and visual bonus; ties by chunk id.

    ``chunks`` has chunk_id, relative_path and has_visual; its texts are not read. ``files`` has each path once, if there is such a
    table. A filter on documents applies before ranking and leaves the corpus statistics alone. Chunks that only a bonus brings in
    compete too; a score must be positive.
    """
    words = query_words(query)
    wanted = document_ids.select("relative_path").distinct() if document_ids is not None else None
    of = lambda df: df if wanted is None else df.join(wanted, "relative_path", "left_semi")
    narrow = chunks.select("chunk_id", "relative_path", "has_visual")
    # candidates: all hits of the postings, and the chunks that a bonus brings in; no other chunk is joined
    hits = bm25_scores(posting_rows, stats, words)
    if wanted is not None:
        hits = of(hits) if "relative_path" in hits.columns else hits.join(of(narrow).select("chunk_id"), "chunk_id", "left_semi")
    by_path, by_visual = path_bonus(F.col("relative_path"), words).alias("by_path"), visual_bonus(F.col("has_visual"), words).alias("by_visual")
    if files is None:
        lifted = of(narrow.select("chunk_id", "relative_path", by_path, by_visual).where("by_path > 0 OR by_visual > 0"))
    else:  # a path's bonus is found once for each path, not for each chunk
        paths = of(files.select("relative_path", by_path).where("by_path > 0"))
        lifted = narrow.join(paths, "relative_path").select("chunk_id", "by_path", by_visual)
        if VISUAL_TERMS & set(words):
            seen = of(narrow.where("has_visual")).join(paths, "relative_path", "left_anti")
            lifted = lifted.unionByName(seen.select("chunk_id", F.lit(0.0).alias("by_path"), by_visual))
    score = F.coalesce("text_score", F.lit(0.0)) + F.coalesce("by_path", F.lit(0.0)) + F.coalesce("by_visual", F.lit(0.0))
    best = hits.select("chunk_id", "text_score").join(lifted.select("chunk_id", "by_path", "by_visual"), "chunk_id", "full_outer").select("chunk_id", score.alias("score")).where("score > 0")
    return best if k is None else best.orderBy(F.desc("score"), "chunk_id").limit(k)


def hybrid(chunks: DataFrame, posting_rows: DataFrame, stats: DataFrame, query: str, k: int = 8, document_ids: DataFrame | None = None) -> DataFrame:
    """The best ``k`` chunks as ``ranked`` finds them, with their path and text, which are joined last."""
    best = ranked(chunks, posting_rows, stats, query, k, document_ids)
    return chunks.join(best, "chunk_id").select("chunk_id", "relative_path", "score", tx.snippet(F.col("text")).alias("snippet"), "text").orderBy(F.desc("score"), "chunk_id")


def code_top(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """``chunk_id, score`` of the ``k`` vectors (chunk_id, dim, codes) of the largest cosine with the query: int8 codes by their norm,
    cut off at 0, ties by id. A zero query finds nothing; a vector of another length is an error."""
    if not any(query) or k < 1:
        return vectors.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    length = sum(float(x) ** 2 for x in query) ** 0.5
    q = F.array(*[F.lit(float(x) / length) for x in query])
    other = F.raise_error(F.format_string(f"The index has a vector of %d dimensions, the query {len(query)}", "dim"))
    cosine = F.when(F.col("dim") != len(query), other.cast("double")).otherwise(vx.dot(F.col("codes"), q) / F.greatest(vx.norm(F.col("codes")), F.lit(1e-12)))
    return vectors.select("chunk_id", F.greatest(cosine, F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


def cosine_top(vectors: DataFrame, query: Sequence[float], k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` vectors of the largest cosine with the query, cut off at 0; ties by id. A zero query finds nothing; a vector of
    another length than the query's is an error."""
    if not any(query):
        return vectors.select(id_column, F.lit(0.0).alias("score")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    other = F.raise_error(F.format_string(f"A vector has %d dimensions, the query {len(query)}", F.size(vector_column)))
    score = F.when(F.size(vector_column) != len(query), other.cast("double")).otherwise(vx.cosine(F.col(vector_column), q))
    return vectors.select(id_column, score.alias("score")).where(F.col("score").isNotNull()).orderBy(F.desc("score"), id_column).limit(k)


def reused_vectors(chunks: DataFrame, old: DataFrame) -> DataFrame:
    """``chunk_id, chunk_hash, vector`` of new chunks: the vector of any old chunk with the same hash, null if none.

    One row stands for each hash (the old chunk of the smallest id), so a repeated text costs no expansion.
    """
    best = old.groupBy("chunk_hash").agg(F.min_by("vector", "chunk_id").alias("vector"))
    return chunks.select("chunk_id", "chunk_hash").join(best, "chunk_hash", "left")


def manifest_score(text: Column, path: Column, has_visual: Column, query: str) -> Column:
    """Score of a document's summary for a query: 5 for the phrase, up to 6 per term, 1.5 per term in the path, 4 for visuals."""
    import re

    words = list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", query.lower()) if len(w) > 1))
    low, where = F.lower(text), F.lower(path)
    out = F.when(F.contains(low, F.lit(query.lower().strip())), 5.0).otherwise(0.0)
    for w in words:
        out = out + F.least(tx.occurrences(low, F.lit(w)), F.lit(6)) + F.when(F.contains(where, F.lit(w)), 1.5).otherwise(0.0)
    return out + (F.when(has_visual, 4.0).otherwise(0.0) if INVENTORY_TERMS & set(words) else F.lit(0.0))


def sheet_score(header: Column, words: Sequence[str]) -> Column:
    """Sum over distinct words of how often each occurs in a sheet's name and headers, 4 at most."""
    out = F.lit(0)
    for w in dict.fromkeys(words):
        out = out + F.least(tx.occurrences(F.lower(header), F.lit(w)), F.lit(4))
    return out
