"""Text expressions over columns: tokens, summaries, headings, paths, cells. All stay in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the search and display rules.
TERM = r"[\p{L}\p{N}]+"
MANIFEST_TERM = "[a-z0-9]+"
SNIPPET = 240
VISUAL_SUFFIXES = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff", "svg")
SHEET_SUFFIXES = ("xlsx", "xlsm", "xls", "csv")


def folded(text: str) -> str:
    """Without diacritics: canonical decomposition with the marks left out."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def _marked() -> tuple[str, str]:
    """Letters with diacritics up to U+1FFF and the letters they are folded to, by the rule of ``folded``."""
    pairs = [(chr(c), f) for c in range(0xC0, 0x2000) if len(f := folded(chr(c))) == 1 and f != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _marked()


def fold(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{Mn}", "")


def index_terms(text: Column) -> Column:
    """Terms as the index holds them: lower-cased, without diacritics, one-letter ones included."""
    return F.regexp_extract_all(fold(F.lower(text)), F.lit(TERM), F.lit(0))


@cache
def _folds() -> dict[int, str | None]:
    """``fold`` as a table for ``str.translate``: letters without their marks, and the marks themselves away."""
    marks = {c: None for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Mn"}
    return marks | {ord(a): b for a, b in zip(_MARKED, _PLAIN)}


_TERMS, _BEYOND_ASCII = re.compile(r"[^\W_]+"), re.compile(r"[^\x00-\x7f]+")


def terms_of(text: str) -> list[str]:
    """The terms of ``index_terms``, for a text in Python."""
    low, folds = text.lower(), _folds()
    return _TERMS.findall(low if low.isascii() else _BEYOND_ASCII.sub(lambda m: m[0].translate(folds), low))


def terms(text: Column, least: int = 1) -> Column:
    """Lower-cased runs of letters and digits, in order, of ``least`` characters or more."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= least) if least > 1 else found


def query_terms(text: Column, most: int = 64) -> Column:
    """Distinct terms of a query of two characters or more, at most ``most`` of them."""
    return F.slice(F.array_distinct(terms(text, 2)), 1, most)


def manifest_terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(MANIFEST_TERM), F.lit(0)), lambda t: F.length(t) > 1)


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET)


def summary(text: Column, limit: int) -> Column:
    """White space collapsed and trimmed; over ``limit`` characters cut and closed with three dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))).otherwise(flat)


def is_heading(line: Column) -> Column:
    """A Markdown heading, a sheet line, or a line of 4 to 120 characters that is mostly upper case or ends in a colon."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    shape = F.length(line).between(4, 120) & (letters > 0) & (line.endswith(":") | (upper > letters * F.lit(0.55)))
    return line.startswith("#") | F.lower(line).startswith("sheet:") | shape


def section_hints(text: Column, most: int = 6) -> Column:
    """The first ``most`` heading lines, cut to 120 characters, each once; where there are none, the first lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)  # a bare F.trim would take the line's number as what to trim
    heads = F.filter(lines, is_heading)
    chosen = F.slice(F.when(F.size(heads) > 0, heads).otherwise(lines), 1, most)
    return F.array_distinct(F.transform(chosen, lambda x: summary(x, 120)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` occurs in ``text``, not overlapping; 0 for an empty term."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (gone / F.length(term)).cast("int")).otherwise(0)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix without its dot; empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


# Suffixes by the kind that is shown.
KINDS = {
    "pdf": ("pdf",), "doc": ("doc", "docx", "rtf", "odt"), "sheet": ("xls", "xlsx", "xlsm", "csv", "tsv", "ods"), "image": ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp", "svg"),
    "slides": ("ppt", "pptx", "odp"), "text": ("txt", "md", "json", "xml", "html", "htm", "log", "yaml", "yml", "ini", "eml", "msg"),
}


def file_kind(path: Column) -> Column:
    e = extension(path)
    return F.coalesce(*[F.when(e.isin(*suffixes), kind) for kind, suffixes in KINDS.items()], F.lit("other"))


def format_bytes(size: Column) -> Column:
    """Sizes for people: whole bytes, else the largest unit up to GB, with a decimal below 10."""
    def shown(k: int, unit: str) -> Column:
        value = size / (1024.0**k)
        rounded = F.format_string("%d", F.floor(value + 0.5).cast("long"))
        return F.concat(F.when(value >= 10, rounded).otherwise(F.format_string("%.1f", value)) if k else rounded, F.lit(f" {unit}"))

    big = F.when(size < 1024**3, shown(2, "MB")).otherwise(shown(3, "GB"))
    return F.when(size.isNull() | (size <= 0), "0 B").when(size < 1024, shown(0, "B")).when(size < 1024**2, shown(1, "KB")).otherwise(big)


def relative_time(at: Column, now: Column) -> Column:
    """How long ago, for people: never, just now, minutes, hours, yesterday, days, and from a week on the date."""
    half_up = lambda x: F.floor(x + 0.5).cast("long")
    seconds = half_up((F.unix_millis(now) - F.unix_millis(at)) / 1000)
    minutes = half_up(seconds / 60)
    hours, days = half_up(minutes / 60), half_up(half_up(minutes / 60) / 24)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(at.isNull(), "never").when(seconds < 45, "just now").when(minutes < 60, said(minutes, " min ago")).when(hours < 24, said(hours, " h ago"))
        .when(days == 1, "yesterday").when(days < 7, said(days, " days ago")).otherwise(F.date_format(at, "MMM d, yyyy"))
    )


def plural(count: Column, singular: str, several: str | None = None) -> Column:
    return F.concat(F.format_number(count, 0), F.when(count == 1, F.lit(f" {singular}")).otherwise(F.lit(f" {several or singular + 's'}")))


def csv_cell(value: Column) -> Column:
    """RFC 4180 quoting, and a guard against formulas: a leading ``= + - @`` tab or CR gets a quote unless it is a plain number."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(r"^[=+\-@\t\r]") & ~text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(guarded.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def markdown_cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, r"([\\|])", r"\\$1"), r"\s*\n\s*", " ")


def identifier(text: Column, most: int = 48) -> Column:
    """A column name from a header: words for ``% # & $``, other runs than ``a-z0-9`` to ``_``, digits prefixed."""
    t = text
    for sign, word in (("%", "pct"), ("#", "num"), ("&", "and"), ("$", "usd")):
        t = F.replace(t, F.lit(sign), F.lit(f" {word} "))
    t = F.lower(F.regexp_replace(fold(t), r"[^\x00-\x7F]", ""))  # letters lose their marks, what is not ASCII then goes
    t = F.substring(F.regexp_replace(F.regexp_replace(t, "[^0-9a-z]+", "_"), "^_+|_+$", ""), 1, most)
    t = F.regexp_replace(t, "_+$", "")
    return F.when(t.rlike("^[0-9]"), F.concat(F.lit("c_"), t)).otherwise(t)


def header_score(cells: Column) -> Column:
    """How much a row looks like a header: 0.8 if all filled cells differ; per cell 1.0 for letters, 0.35 for no digits,
    0.2 for at most 40 characters, 0.2 for letters that are no code such as ``AB12``. 0 for fewer than two filled cells."""
    filled = F.filter(cells, lambda c: F.length(F.trim(c)) > 0)

    def one(c: Column) -> Column:
        letters = c.rlike(r"\p{L}")
        return (
            F.when(letters, 1.0).otherwise(0.0) + F.when(c.rlike("[0-9]"), 0.0).otherwise(0.35) + F.when(F.length(c) <= 40, 0.2).otherwise(0.0)
            + F.when(letters & ~c.rlike(r"^[A-Z]{2,}\d+$"), 0.2).otherwise(0.0)
        )

    distinct = F.size(F.array_distinct(F.transform(filled, F.lower))) == F.size(filled)
    score = F.aggregate(filled, F.lit(0.0), lambda a, c: a + one(c)) + F.when(distinct, 0.8).otherwise(0.0)
    return F.when(F.size(filled) >= 2, score).otherwise(0.0)


# Cells ------------------------------------------------------------------------------------------

#: Texts that mean "no value".
NULL_TOKENS = ("n/a", "na", "null", "none", "nan", "-", "--", "#n/a", "#null!", "#div/0!", "#value!", "#ref!", "#name?", "#num!")
_NUMBER = r"^\(?[+-]?[$€£]?[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)?(\.[0-9]+)?([eE][+-]?[0-9]+)?\)?$"


def cell_number(cell: Column) -> Column:
    """The number that a cell's text shows (currency signs, thousands, parentheses for negatives), else null.

    Identifiers, that is leading zeros and more than 15 digits, are no numbers.
    """
    text = F.trim(cell)
    bare = F.regexp_replace(text, r"[$€£,()\s]", "")
    digits = F.regexp_replace(bare, r"[^0-9]", "")
    code = bare.rlike(r"^[+-]?0[0-9]") | (F.length(digits) > 15)
    value = bare.try_cast("double")
    sign = F.when(text.startswith("(") & text.endswith(")"), F.lit(-1.0)).otherwise(F.lit(1.0))
    balanced = text.startswith("(") == text.endswith(")")
    return F.when(text.rlike(_NUMBER) & text.rlike("[0-9]") & ~code & balanced, sign * value)


# The forms of dates that cells show.
_ISO = r"^(?!0000)(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:(?<=:\d{2}:\d{2})\.\d+)?)?Z?$"
_SLASHED = r"^(\d{1,2})/(\d{1,2})/(?!0000)(\d{2}|\d{4})(?:\s+(\d{1,2}):(\d{2})(:\d{2})?(?:\s*([AaPp][Mm]))?)?$"
_YEAR_FIRST = r"^(?!0000)(\d{4})/(\d{1,2})/(\d{1,2})$"


def cell_date(cell: Column) -> Column:
    """ISO text of the date that a cell shows, with its time of day if that is not midnight; else null.

    Forms are ``y-m-d`` with or without a time, ``y/m/d``, and ``m/d/y`` (``d/m/y`` where only that can be) with or without a time,
    also of twelve hours. Two-digit years up to 69 are of this century. A date that does not exist gives null.

    Each form is put into the order of a timestamp by one replacement, and Spark's cast tells whether it exists; so the expression stays
    small, and in generated code.
    """
    text = F.trim(cell)
    # two-digit years get their century first, so that all years have four digits
    full = F.regexp_replace(F.regexp_replace(text, r"^(\d+/\d+/)([0-6]\d)(?!\d)", "$120$2"), r"^(\d+/\d+/)([7-9]\d)(?!\d)", "$119$2")
    with_time, of_twelve = F.contains(text, F.lit(":")), F.lower(F.right(text, F.lit(1))) == "m"

    def slashed(order: str) -> Column:
        hour = F.regexp_extract(text, _SLASHED, 4).try_cast("int") % 12 + F.when(F.lower(F.right(text, F.lit(2))) == "pm", 12).otherwise(0)
        twelve = F.concat(F.regexp_replace(full, _SLASHED, f"{order} "), hour.cast("string"), F.regexp_replace(full, _SLASHED, ":$5$6"))
        return F.when(of_twelve, twelve).when(with_time, F.regexp_replace(full, _SLASHED, f"{order} $4:$5$6")).otherwise(F.regexp_replace(full, _SLASHED, order))

    is_slashed = text.rlike(_SLASHED)
    ordered = (
        F.when(text.rlike(_ISO), F.when(with_time, F.regexp_replace(text, _ISO, "$1 $2$3")).otherwise(F.regexp_replace(text, _ISO, "$1")))
        .when(text.rlike(_YEAR_FIRST), F.regexp_replace(text, _YEAR_FIRST, "$1-$2-$3")).when(is_slashed, slashed("$3-$1-$2"))
    )
    # a first number over 12 can only be a day; otherwise the second order gives a month that does not exist either
    at = F.coalesce(ordered.try_cast("timestamp_ntz"), F.when(is_slashed, slashed("$3-$2-$1")).try_cast("timestamp_ntz"))
    return F.regexp_replace(at.cast("string"), " 00:00:00$", "")


def cell_kind(cell: Column) -> Column:
    """null, token, integer, real, date or text. Numbers with decimals or an exponent are real. A text's first character says
    which of the patterns are tried at all."""
    text = F.trim(cell)
    first = F.substring(text, 1, 1)
    number = cell_number(cell)
    kind_of_number = F.when(F.contains(text, F.lit(".")) | F.contains(F.lower(text), F.lit("e")), "real").otherwise("integer")
    valued = F.when(~first.rlike(r"[0-9+\-.($€£]"), "text").otherwise(F.coalesce(F.when(number.isNotNull(), kind_of_number), F.when(first.rlike("[0-9]") & cell_date(cell).isNotNull(), F.lit("date")), F.lit("text")))
    return F.when(text.isNull() | (F.length(text) == 0), "null").when(F.lower(text).isin(*NULL_TOKENS), "token").otherwise(valued)
