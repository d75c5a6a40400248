"""Questions in SQL over named tables: checked, capped in rows, stopped after a time, with clean errors."""

from __future__ import annotations

import math
import threading
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import typeof
from ..operators import tabular
from . import table_functions as table_functions_
from .guard import Checked, NotAllowed, check
from .lenient import Unsupported, typed

# Rows by default and at most, seconds, and the size from which whole numbers go as text.
ROWS, MAX_ROWS, SECONDS, EXACT = 200, 1000, 5.0, 2**53


@dataclass
class Result:
    columns: list[str]
    rows: list[list]
    truncated: bool
    tables_used: list[str]


def json_safe(value):
    """Numbers that JSON loses go as text, other floats rounded to six digits, non-finite ones as null, bytes as their size."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return str(value) if abs(value) >= EXACT else value
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else None
    if isinstance(value, (bytes, bytearray)):
        return f"<{len(value)} bytes>"
    return str(value)


class Tables:
    """Named DataFrames that SQL may read, and nothing else.

    Statements run in a session of their own, a clone in which division by zero, bad casts and comparisons of unlike types give
    NULL, not errors; the given session and what runs in it keep their settings. With ``table_functions`` they may also stand in FROM.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], table_functions: bool = False):
        self.tables, self.functions = dict(tables), table_functions_.NAMES if table_functions else ()
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        self.spark = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        if table_functions:
            table_functions_.register(self.spark)

    def frame(self, sql: str) -> DataFrame:
        """The checked statement as a DataFrame; Catalyst does the rest."""
        return self._frame(check(self.spark, sql, self.tables, self.functions))

    def _frame(self, checked: Checked) -> DataFrame:
        cast = self.spark._jvm.org.apache.spark.sql.catalyst.expressions.Cast.USER_SPECIFIED_CAST()
        analysed = lambda text: self.spark.sql(text)._jdf.queryExecution().analyzed()
        try:
            return self.spark.sql(typed(checked.spark_sql, analysed, cast))
        except Unsupported as e:
            raise NotAllowed(f"Not allowed: {e}") from None

    def schema(self) -> list[dict]:
        """Per table its row count, columns with short type names, categories, and three sample rows."""
        out = []
        for name, df in self.tables.items():
            texts = [c for c, t in df.dtypes if t == "string"]
            found = {r["column"]: list(r["categories"]) for r in tabular.categories(tabular.cells(df, texts)).collect()} if texts else {}
            columns = [{"name": c, "type": typeof(t), "categories": found.get(c, [])} for c, t in df.dtypes]
            out.append({"table": name, "rowCount": df.count(), "columns": columns, "sample": [[json_safe(v) for v in r] for r in df.limit(3).collect()]})
        return out

    def query(self, sql: str, max_rows: int = ROWS, seconds: float = SECONDS) -> Result:
        """Run one checked statement; one row more than asked for is fetched, to tell whether there are more."""
        checked = check(self.spark, sql, self.tables, self.functions)
        most = max(1, min(int(max_rows), MAX_ROWS))
        context, group, late = self.spark.sparkContext, f"leafmill-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(seconds, stop)
        context.setJobGroup(group, "question in SQL", True)
        try:
            df = self._frame(checked)
            timer.start()  # the limit is for running, not for planning
            rows = df.limit(most + 1).collect()
        except AnalysisException as e:
            raise NotAllowed(self._clean(e, checked.tables)) from None
        except NotAllowed:
            raise
        except PySparkException as e:
            raise NotAllowed(f"The query took longer than {seconds:g} seconds" if late.is_set() else str(e).splitlines()[0][:300]) from None
        except Exception as e:
            if late.is_set():
                raise NotAllowed(f"The query took longer than {seconds:g} seconds") from None
            raise NotAllowed(str(e).splitlines()[0][:300]) from None
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        return Result(df.columns, [[json_safe(v) for v in r] for r in rows[:most]], len(rows) > most, checked.tables)

    def _clean(self, e: AnalysisException, used: list[str]) -> str:
        condition = e.getCondition() or ""
        if condition.startswith("UNRESOLVED_COLUMN"):
            name = (e.getMessageParameters() or {}).get("objectName", "").strip("`")
            known = sorted({c for t in used for c in self.tables.get(t, self.tables.get(t.lower())).columns})
            return f"No such column: {name}. Available columns: {', '.join(known)}"
        return str(e).splitlines()[0][:300]


def to_csv(df: DataFrame) -> DataFrame:
    """``line`` for each row: RFC 4180 with the guard against formulas."""
    from ..functions.text import csv_cell

    return df.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in df.columns]).alias("line"))


def markdown_header(columns: list[str]) -> list[str]:
    """The two lines above a Markdown table's body."""
    names = [c.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ") for c in columns]
    return [f"| {' | '.join(names)} |", f"| {' | '.join(['---'] * len(names))} |"]


def to_markdown(df: DataFrame) -> DataFrame:
    """``line`` for each row of a Markdown table's body; ``markdown_header`` gives what stands above it."""
    from ..functions.text import markdown_cell

    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in df.columns]), F.lit(" |")).alias("line"))


def markdown_result(result: Result, rows: int = 50, width: int = 200) -> str:
    """A capped result as a Markdown table with a footer."""
    cell = lambda v: ("NULL" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " "))[:width]
    lines = [f"| {' | '.join(map(cell, r))} |" for r in [result.columns, ["---"] * len(result.columns), *result.rows[:rows]]]
    more = "+" if result.truncated or len(result.rows) > rows else ""
    return "\n".join([*lines, f"{min(rows, len(result.rows))}{more} rows"])
