"""Functions that users of an embedded SQL engine expect, as Spark expressions.

Spark's ANSI mode stays on. Where the other dialect is lenient (division by zero, bad dates, bad casts) these
give NULL instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iif(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def total(c: Column) -> Column:
    """Like sum, but 0.0 for no rows."""
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def group_concat(c: Column, sep: str = ",") -> Column:
    """In order of the values, so that the result is defined."""
    return F.array_join(F.sort_array(F.collect_list(c.cast("string"))), sep)


def scalar_min(*cs: Column) -> Column:
    """NULL if any argument is."""
    return F.when(_any_null(cs), None).otherwise(F.least(*cs))


def scalar_max(*cs: Column) -> Column:
    return F.when(_any_null(cs), None).otherwise(F.greatest(*cs))


def _any_null(cs: tuple[Column, ...]) -> Column:
    out = cs[0].isNull()
    for c in cs[1:]:
        out = out | c.isNull()
    return out


def safe_sqrt(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def int_div(a: Column, b: Column) -> Column:
    """Whole-number division that truncates; NULL for division by zero."""
    return F.when(b != 0, ((a - a % b) / b).cast("long"))


def glob_pattern(glob: str) -> str:
    """``* ? [..] [^..]`` as a regular expression over the whole, case-sensitive string."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            out, i = out + "[" + glob[i + 1 : end].replace("\\", "\\\\") + "]", end
        else:
            out += "\\" + c if not c.isalnum() and c != "_" else c
        i += 1
    return f"(?s)^{out}$"


def glob(c: Column, pattern: str) -> Column:
    return c.rlike(glob_pattern(pattern))


def julianday(c: Column) -> Column:
    """Days since noon of 24 November 4714 BC; midnight ends in .5."""
    return F.unix_date(c.cast("date")).cast("double") + F.lit(2440587.5)


#: Format letters and their Spark patterns.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}


def strftime(fmt: str, c: Column) -> Column:
    """``%Y %m %d %H %M %S %j %w %s %%`` of a date, a timestamp or ISO text; NULL for text that is none."""
    at = F.try_to_timestamp(c.cast("string"))
    parts, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            k = fmt[i + 1]
            if k in STRFTIME:
                parts.append(F.date_format(at, STRFTIME[k]))
            elif k == "j":
                parts.append(F.lpad(F.dayofyear(at).cast("string"), 3, "0"))
            elif k == "w":
                parts.append((F.dayofweek(at) - 1).cast("string"))
            elif k == "s":
                parts.append(F.unix_timestamp(at).cast("string"))
            elif k == "%":
                parts.append(F.lit("%"))
            else:
                raise ValueError(f"strftime does not know %{k}")
            i += 2
        else:
            parts.append(F.lit(fmt[i]))
            i += 1
    return F.concat(*parts) if parts else F.lit("")


def add_months_overflow(c: Column, months: int) -> Column:
    """Month arithmetic that lets days overflow: 31 January plus one month is 2 or 3 March."""
    first = F.add_months(F.trunc(c.cast("date"), "month"), months)
    return F.date_add(first, F.dayofmonth(c) - 1)


def start_of(c: Column, unit: str) -> Column:
    return F.trunc(c.cast("date"), unit)


def typeof(kind: str) -> str:
    """The short name of a Spark type: integer, real, text, blob or null."""
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return "integer"
    if kind in ("float", "double") or kind.startswith("decimal"):
        return "real"
    return {"binary": "blob", "void": "null"}.get(kind, "text")
