"""What turns questions, documents and results into answers: intents, preselection, notes, citations, checks of replies.

All are column expressions or plans over tables of questions, documents, sheets, results or assets; what is said
once per question is an aggregate, and the order of rows is a column wherever it matters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import ingest

# Signals of a question that needs a calculation, phrases with "by" that are none, and other intents.
PASSIVE_BY = r"\b(written|signed|approved|created|prepared|submitted|authored|sent|owned|reviewed|issued|made|modified|updated|edited|followed|caused|driven|covered|governed|required)\s+by\b"
SIGNALS = {
    "count": r"\b(how many|count|counts|number of|# of)\b",
    "total": r"\b(totals?|sum|sums|add up|tally)\b",
    "how much": r"\bhow much\b",
    "average": r"\b(average|averages|avg|the mean|mean (?:of|for|value))\b",
    "extreme": r"\b(minimum|maximum|min|max|highest|lowest|largest|smallest|biggest|greatest|most (?:common|frequent|expensive|costly)|least (?:common|frequent|expensive|costly))\b",
    "top n": r"\b(top|bottom)\s+(\d+|one|two|three|four|five|six|seven|eight|nine|ten|twenty)\b",
    "grouping": r"\b(break ?down|breakdown|group(?:ed)? by|grouped|distribution|histogram)\b",
    "per": r"\b(per|for each|each)\s+[a-z]",
    "by": r"\bby\s+[a-z]",
    "trend": r"\b(trends?|over time|month over month|year over year|monthly|quarterly|weekly|yearly|daily)\b",
    "chart": r"\b(chart|charts|plot|graph|visuali[sz]e)\b",
    "compare": r"\b(compare|compared|comparison|versus|vs)\b",
    "percent": r"\b(percent|percentage|ratio|proportion|share of)\b|%",
}
WANTS_COUNT = r"\b(count|how many|number of|total)\b"
WANTS_LIST = r"\b(list|show all|find all|which rows|which entries)\b"
WANTS_FILTER = r"\b(rows where|entries where|matching rows|matching entries|filter|filtered)\b"
ROWS = r"\b(rows?|records?|entries|lines)\b"
NOT_PLAIN = r"\b(per|by|each|group|grouped|break ?down|distinct|unique|average|avg|sum|trend|over time|monthly|quarterly|weekly|yearly|daily|chart|plot)\b"
CONDITION = r"\b(where|with|whose|that|which|having|has|have|contain|contains|containing|equal|equals|greater|less|more than|fewer|above|below|after|before|between|over|under|exceed|exceeds|is|are not|status|named|called|marked)\b|[<>=]"
PLAIN_OPENING = r"\bhow many (rows?|records?|entries|lines) (are|is) (there )?(in|on)\b"
PRESELECTED, SELECTED, CALCULATED, ASSETS, ASSET_RESULTS = 24, 3, 4, 3, 5


# Questions ----------------------------------------------------------------------------------------


def signals(question: Column) -> Column:
    """Names of the signals that call for a calculation over every row."""
    text = F.regexp_replace(F.lower(question), PASSIVE_BY, " ")
    return F.filter(F.array(*[F.when(text.rlike(p), name) for name, p in SIGNALS.items()]), lambda x: x.isNotNull())


def intents(question: Column) -> Column:
    """A struct of flags: what a question about rows wants, and whether it only asks how many rows there are."""
    text = F.lower(question)
    count, narrowed = text.rlike(WANTS_COUNT), text.rlike(WANTS_FILTER)
    plain = text.rlike(ROWS) & ~text.rlike(NOT_PLAIN) & ~F.regexp_replace(text, PLAIN_OPENING, "").rlike(CONDITION)
    return F.struct(count.alias("count"), text.rlike(WANTS_LIST).alias("list"), narrowed.alias("filter"), (F.size(signals(question)) > 0).alias("analytical"), (count & ~narrowed & plain).alias("row_count"))


# Documents ----------------------------------------------------------------------------------------


def preselected(scored: DataFrame, score: str = "score", key: str = "relative_path", most: int = PRESELECTED) -> DataFrame:
    """The ``most`` best documents by score, ties by path, with their ``rank``. Spark keeps as many rows a task."""
    best = scored.orderBy(F.desc(score), key).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))  # of ``most`` rows


def selected(candidates: DataFrame, chosen: DataFrame, key: str = "relative_path", most: int = SELECTED) -> DataFrame:
    """The chosen candidates; where none of the choice is a candidate, the first ``most`` by rank."""
    valid = candidates.join(chosen.select(key).distinct(), key, "left_semi")
    none = valid.agg((F.count("*") == 0).alias("none"))
    return valid.unionByName(candidates.where(F.col("rank") <= most).crossJoin(none).where("none").drop("none"))  # one row beside it


def to_calculate(retrieved: DataFrame, scored: DataFrame, key: str = "relative_path", most: int = CALCULATED) -> DataFrame:
    """Sheets to calculate over: those retrieved first, then the best others by score; ``most`` in all, with their ``rank``."""
    both = scored.join(retrieved.select(key, F.lit(True).alias("found")).distinct(), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    order = [F.desc("found"), F.when(F.col("found"), 0.0).otherwise(F.col("score")).desc(), F.col(key)]
    best = both.orderBy(*order).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(key, "found", "rank")


def row_count_answer(sheets: DataFrame, words: Sequence[str]) -> DataFrame:
    """One row: rows of the sheets whose name or headers hold a word, or of all sheets where none does; the largest matches are named.

    ``sheets`` has sheet, headers (text) and row_count.
    """
    from .search import sheet_score

    scored = sheets.withColumn("score", sheet_score(F.concat_ws(" ", "sheet", "headers"), words))
    hit = F.col("score") > 0
    sums = scored.agg(F.count_if(hit).alias("n"), F.sum(F.when(hit, F.col("row_count"))).alias("some"), F.sum("row_count").alias("every"))
    matched = F.col("n") > 0
    top = scored.orderBy(F.desc("score"), "sheet").limit(6).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "sheet", "row_count", "score"))).alias("top"))
    named = F.filter("top", lambda x: ~matched | (x["score"] > 0))
    return sums.crossJoin(top).select(F.when(matched, F.col("some")).otherwise(F.col("every")).alias("total_rows"), matched.alias("matched"), F.array_join(F.transform(named, lambda x: F.format_string("%s (%d)", x["sheet"], x["row_count"])), ", ").alias("sheets"))


def row_scan(results: DataFrame, order: str = "rank", sheet: str = "sheet") -> DataFrame:
    """One row: how many rows matched, and their first six distinct sheets in the order of the results."""
    firsts = results.where(F.col(sheet).isNotNull()).groupBy(sheet).agg(F.min(order).alias("at"))
    six = firsts.orderBy("at", sheet).limit(6).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", sheet))), lambda x: x[sheet]), ", ").alias("sheets"))
    return results.agg(F.count("*").alias("rows")).crossJoin(six)


def citations(results: DataFrame, used: DataFrame) -> DataFrame:
    """Results as citations, and one with a score of 1 for each sheet that a calculation read (document, sheet, row_count)."""
    rows = F.format_string("Calculated from sheet '%s' (%s rows)", "sheet", F.format_number("row_count", 0))
    calculated = used.select(F.col("document").alias("relative_path"), F.concat(F.lit("calc:"), "document", F.lit("#"), "sheet").alias("chunk_id"), F.lit(1.0).alias("score"), rows.alias("snippet"))
    return results.select("relative_path", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("score").cast("double").alias("score"), "snippet").unionByName(calculated)


# Visual assets ------------------------------------------------------------------------------------


def asset_summary(assets: DataFrame, by: str) -> DataFrame:
    """Per document: number of assets, a map of kinds to counts, distinct pages in order, the first 12 distinct labels.

    ``assets`` has kind, page, label and position (in the document). An array has an entry for a page, a kind or a label.
    """
    kinds = assets.where("trim(kind) <> ''").groupBy(by, F.trim("kind").alias("kind")).agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))
    labels = assets.where("trim(label) <> ''").groupBy(by, F.trim("label").alias("label")).agg(F.min("position").alias("at"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy("at", "label"))
    labels = labels.withColumn("nth", nth).where("nth <= 12").groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "label"))), lambda x: x["label"]).alias("labels"))
    sums = assets.groupBy(by).agg(F.count("*").alias("total"), F.array_sort(F.collect_set("page")).alias("pages"))
    return sums.join(kinds, by, "left").join(labels, by, "left")


def asset_note(path: Column, total: Column, by_kind: Column, pages: Column, labels: Column) -> Column:
    """A line on a document's visual assets."""
    listed = lambda a, n, sep: F.array_join(F.slice(a.cast("array<string>"), 1, n), sep)
    kinds = F.array_join(F.transform(F.map_entries(by_kind), lambda e: F.format_string("%d %s", e["value"], e["key"])), ", ")
    return F.concat(
        F.format_string("%s: %d indexed visual asset(s)", path, total), F.when(kinds == "", "").otherwise(F.concat(F.lit(" ("), kinds, F.lit(")"))), F.lit("."),
        F.when(F.size(pages) > 0, F.concat(F.lit(" Pages: "), listed(pages, 12, ", "), F.lit("."))).otherwise(""), F.when(F.size(labels) > 0, F.concat(F.lit(" Samples: "), listed(labels, 5, " | "), F.lit("."))).otherwise(""),
    )


def answer_assets(results: DataFrame, documents: DataFrame, ask: bool, key: Sequence[str] = ("kind", "relative_path", "page", "media"), most: int = ASSETS) -> DataFrame:
    """The first ``most`` distinct assets of the best five results (rank), and then, if the question asks for visuals, of the documents."""
    rows = results.where(F.col("rank") <= ASSET_RESULTS).select(F.lit(0).alias("source"), "rank", "position", *key)
    rows = rows.unionByName(documents.select(F.lit(1).alias("source"), "rank", "position", *key)) if ask else rows
    first = rows.groupBy(*key).agg(F.min(F.struct("source", "rank", "position")).alias("at"))
    order = [F.col("at"), *[F.col(k) for k in key]]
    return first.orderBy(*order).limit(most).withColumn("nth", F.row_number().over(Window.orderBy(*order))).select("nth", *key)


# Replies and exports ------------------------------------------------------------------------------


def clean_sql(sql: Column, most: int = 4000) -> Column:
    """Without control characters, at most one empty line in a row, trimmed, cut to ``most`` characters."""
    text = F.regexp_replace(sql, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def loose_json(reply: Column) -> Column:
    """The JSON in a model's reply, as text: the whole reply, else a fenced block, else from the first to the last brace; else null."""
    text = F.trim(reply)
    fenced = F.trim(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1))
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(*[F.when((c != "") & F.try_parse_json(c).isNotNull(), c) for c in (text, fenced, braced)])


def sql_reply(reply: Column) -> Column:
    """The statement in a reply: of the field ``sql`` of its JSON, or of a fenced SQL block; null where there is none."""
    found = loose_json(reply)
    block = F.regexp_extract(reply, r"(?is)```sql\s*(.*?)```", 1)
    has = found.startswith("{") & F.get_json_object(found, "$.sql").isNotNull()
    sql = F.when(has, F.get_json_object(found, "$.sql")).when(block != "", block)
    return F.nullif(F.trim(F.regexp_replace(F.trim(sql), r"(?:;\s*)+$", "")), F.lit(""))


CHART_TYPES = ("bar", "stacked-bar", "line", "area", "pie", "scatter")
CHART_SERIES, CHART_POINTS = 8, 5000


def chart_error(kind: Column, title: Column, x: Column, series: Column) -> Column:
    """Why a chart is refused, null if it is not. ``x`` is an array, ``series`` an array of (name, values: array<double>)."""
    n = F.size(x)
    flat = F.flatten(F.transform(series, lambda s: s["values"]))
    return F.coalesce(
        F.when(kind.isNull() | ~kind.isin(*CHART_TYPES), F.concat(F.lit('Unknown chart type "'), F.coalesce(kind, F.lit("")), F.lit(f'". Use one of: {", ".join(CHART_TYPES)}.'))),
        F.when(title.isNull() | (F.trim(title) == ""), '"title" is required.'), F.when(x.isNull() | (n <= 0), '"x.values" must be a non-empty array.'),
        F.when((kind == "scatter") & F.exists(x, lambda v: v.try_cast("double").isNull()), '"x.values" must be numbers for a scatter chart.'), F.when(series.isNull() | (F.size(series) <= 0), '"series" must be a non-empty array.'),
        F.when(F.size(series) > CHART_SERIES, f"At most {CHART_SERIES} series are supported."), F.when((kind == "pie") & (F.size(series) != 1), "A pie chart takes exactly one series."), F.when(n * F.size(series) > CHART_POINTS, f"Too many data points (max {CHART_POINTS})."),
        F.when(F.exists(series, lambda s: F.size(s["values"]) != n), "A series has another number of values than x."), F.when((kind == "pie") & F.exists(flat, lambda v: v < 0), "Pie chart values can't be negative."),
    )


def chart_rows(x_label: Column, unit: Column, x: Column, series: Column) -> Column:
    """A chart's data as a grid, array of rows of texts, the header first."""
    name = lambda s: F.when(F.coalesce(unit, F.lit("")) != "", F.concat(s["name"], F.lit(" ("), unit, F.lit(")"))).otherwise(s["name"])
    header = F.concat(F.array(F.coalesce(F.nullif(x_label, F.lit("")), F.lit("x"))), F.transform(series, name))
    row = lambda v, i: F.concat(F.array(v.cast("string")), F.transform(series, lambda s: F.coalesce(F.get(s["values"], i).cast("string"), F.lit(""))))
    return F.concat(F.array(header), F.transform(x, row))


def html_grid(page: Column) -> Column:
    """The first table of a page as a grid: array of rows of the texts of their ``th`` and ``td`` cells; empty if it has none."""
    table = F.regexp_extract(page, r"(?is)<table\b[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|$)"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)(?=</t[hd]>|<t[hd]\b|$)"), F.lit(1))

    def plain(c: Column) -> Column:
        t = F.regexp_replace(c, r"(?s)<[^>]*>", "")
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            t = F.replace(t, F.lit(name), F.lit(sign))
        return F.trim(F.regexp_replace(t, r"\s+", " "))

    return F.filter(F.transform(rows, lambda r: F.transform(cells(r), plain)), lambda r: F.size(r) > 0)


def number_text(value: Column) -> Column:
    """A number as a cell shows it: whole ones without decimals, others with 15 significant digits."""
    fixed = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,15)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value.isNull() | F.isnan(value), None).when((value == F.floor(value)) & (F.abs(value) < 2.0**53), value.cast("decimal(20,0)").cast("string")).otherwise(fixed)


def model_key(*parts: Column) -> Column:
    """Provider, base address, version, deployment and model, joined; absent ones are empty."""
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def model_label(key: Column) -> Column:
    """What to call a model by its key: provider and model, or deployment."""
    part = lambda k: F.coalesce(F.get(F.split(key, r"\|"), F.lit(k)), F.lit(""))
    label = F.array_join(F.filter(F.array(part(0), F.when(part(4) != "", part(4)).otherwise(part(3))), lambda x: x != ""), "/")
    return F.when(label == "", "an unknown embedding model").otherwise(label)


# State tables -------------------------------------------------------------------------------------


def detached(rows: DataFrame, removed: DataFrame, column: str, key: str) -> DataFrame:
    """``rows`` with ``column`` null where it names a removed ``key``."""
    gone = removed.select(F.col(key).alias("__gone")).distinct()
    return rows.join(gone, rows[column] == gone["__gone"], "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).drop("__gone")


def added_only(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``table`` and the rows of ``new`` whose key it lacks; of new rows with one key the first by value."""
    once = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("r")).select(key, "r.*")
    return table.unionByName(once.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def placed(rows: DataFrame, by: str | None, *order: Column) -> DataFrame:
    """``rows`` with their ``place`` in an order, within each ``by``: threads by last change, messages by time. The places of a whole table
    are those of its ranges, so no task numbers all rows."""
    if by is None:
        return ingest.dense_ids(rows, 0, *order).withColumnRenamed("id", "place")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def setting(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Key and value rows after an upsert; a null value deletes its key."""
    return meta.join(changes.select("key"), "key", "left_anti").unionByName(changes.where(F.col("value").isNotNull()))


def same_settings(meta: dict[str, str | None], wanted: dict[str, str | None]) -> bool:
    """Whether an index needs no rebuild: format, mode, engine and model are the ones wanted."""
    return all(meta.get(k) == wanted.get(k) for k in ("version", "mode", "engine", "model"))


def header_note(path: Column, sheets: Column, rows: Column, names: Column, columns: Column) -> Column:
    """A spreadsheet's summary in a sentence or three, 420 characters at most."""
    parts = [
        F.format_string("Spreadsheet document %s with %d rows across %d sheets.", path, rows, sheets),
        F.when(F.size(names) > 0, F.concat(F.lit("Sheets: "), F.array_join(F.slice(names, 1, 6), ", "), F.lit("."))), F.when(F.size(columns) > 0, F.concat(F.lit("Columns: "), F.array_join(F.slice(columns, 1, 8), ", "), F.lit("."))),
    ]
    return tx.summary(F.concat_ws(" ", *parts), 420)
