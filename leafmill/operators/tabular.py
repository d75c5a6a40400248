"""Schema inference over sheets as aggregates: one pass over cells, whatever the number of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Share of the values that decides a type, and the limits of a category profile.
MAJORITY, CATEGORIES, CATEGORY_LENGTH = 0.9, 12, 40


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value`` of every cell, as text; one scan for all columns."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("c")).select("c.*")


def type_votes(cell_rows: DataFrame, tokens: bool = False) -> DataFrame:
    """Type of each column by the kinds of its values: 90 % decide, numbers before dates, a real number makes it real.

    ``non_null`` counts values that are neither null nor a null token; ``failed`` those that the type loses; ``tokens``,
    where asked for, the null tokens.
    """
    kind = cell_rows.select("column", tx.cell_kind(F.col("value")).alias("kind"))
    n = lambda k: F.count_if(F.col("kind") == k)
    sums = kind.groupBy("column").agg(n("integer").alias("ints"), n("real").alias("reals"), n("date").alias("dates"), n("text").alias("texts"), n("token").alias("tokens"), n("null").alias("nulls"))
    valued = F.col("ints") + F.col("reals") + F.col("dates") + F.col("texts")
    numbers = F.col("ints") + F.col("reals")
    need = valued * F.lit(MAJORITY)
    decided = F.when((valued > 0) & (numbers >= need), F.when(F.col("reals") > 0, "real").otherwise("integer")).when((valued > 0) & (F.col("dates") >= need), "date").otherwise("text")
    failed = F.when(decided.isin("integer", "real"), valued - numbers).when(decided == "date", valued - F.col("dates")).otherwise(0)
    return sums.select("column", decided.alias("type"), valued.alias("non_null"), failed.alias("failed"), *([F.col("tokens")] if tokens else []))


def categories(cell_rows: DataFrame) -> DataFrame:
    """``column, categories``: the distinct values of a text column that has few: 12 at most, half of the values at most, short.

    Distinct values are counted before any are gathered, so an array never exceeds CATEGORIES entries.
    """
    value = F.trim("value")
    counted = cell_rows.where(value.isNotNull() & (value != "")).groupBy("column", value.alias("value")).agg(F.count("*").alias("n"))
    sizes = counted.groupBy("column").agg(F.count("*").alias("kinds"), F.sum("n").alias("non_null"), F.max(F.length("value")).alias("longest"))
    few = sizes.where((F.col("non_null") >= 2) & (F.col("kinds") <= F.least(F.lit(CATEGORIES), F.floor(F.col("non_null") / 2))) & (F.col("longest") <= CATEGORY_LENGTH))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("value").alias("k"), F.col("value").alias("v")))), lambda x: x["v"])
    return counted.join(few.select("column"), "column").groupBy("column").agg(ordered.alias("categories"))


def structure(sheets: DataFrame, by: str) -> DataFrame:
    """Per document: number of sheets and rows, sheet names and up to 12 distinct column names, in order."""
    hints = F.slice(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("sheet", "headers"))), lambda s: s["headers"]))), 1, 12)
    return sheets.groupBy(by).agg(F.count("*").alias("sheet_count"), F.sum("row_count").alias("row_count"), F.sort_array(F.collect_list("sheet")).alias("sheet_names"), hints.alias("column_hints"))


def header_row(rows: DataFrame, by: list[str], nth: str, cells_column: str, first: int = 12, least: float = 2.5) -> DataFrame:
    """The best header among the first rows of each sheet; the earliest of equals; none below ``least``."""
    scored = rows.where(F.col(nth) <= first).withColumn("score", F.round(tx.header_score(F.col(cells_column)), 6)).where(F.col("score") >= least)
    best = Window.partitionBy(*by).orderBy(F.desc("score"), nth)
    return scored.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def pie_fold(rows: DataFrame, name: str, value: str, slices: int = 8) -> DataFrame:
    """Names and sums for a pie: with more than ``slices`` names the largest ``slices - 1``, and the rest as ``Other``."""
    sums = rows.groupBy(name).agg(F.sum(value).alias("value"))
    order = [F.desc("value"), F.col(name)]
    # of all names only as many as can be shown, and one more, are numbered
    first = sums.orderBy(*order).limit(slices + 1).withColumn("n", F.row_number().over(Window.orderBy(*order))).withColumn("names", F.count("*").over(Window.partitionBy()))
    kept = first.where((F.col("names") <= slices) | (F.col("n") < slices)).select(F.col(name).alias("__kept"), F.lit(True).alias("__shown"))
    both = sums.join(F.broadcast(kept), F.col(name).eqNullSafe(F.col("__kept")), "left")
    return both.groupBy(F.when(F.col("__shown"), F.col(name)).otherwise("Other").alias("slice")).agg(F.sum("value").alias("value"))


def channel_status(files: DataFrame, by: str, status: Column, cancelled: Column | None = None) -> DataFrame:
    """stale where the last build was cancelled, else ready where a file is indexed, else error where one failed, else idle."""
    any_ = lambda s: F.bool_or(status == s)
    state = F.when(any_("indexed"), "ready").when(any_("failed"), "error").otherwise("idle")
    return files.groupBy(by).agg((state if cancelled is None else F.when(F.bool_or(cancelled), "stale").otherwise(state)).alias("state"))


def nearest_rank(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """Per ``by`` the largest value and the one at place floor(n * share) of its values in order, counted from 0.

    Equal values are counted first, so that a running sum passes over distinct values only.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy(value)) - F.col("n")
    placed = counted.withColumn("__before", before)
    sizes = counted.groupBy(by).agg(F.sum("n").alias("__all"), F.max(value).alias("high"))
    at = F.least(F.floor(F.col("__all") * F.lit(share)), F.col("__all") - 1)
    hit = (F.col("__before") <= at) & (at < F.col("__before") + F.col("n"))
    return placed.join(sizes, by).where(hit).select(by, "high", F.col(value).alias(f"p{round(share * 100)}"))
