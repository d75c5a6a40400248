"""Sheets as typed tables: an XLSX reader as a Python data source, CSV files by ranges, and the typing of their columns."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as tx
from ..operators import tabular
from . import csv_ranges

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_ROWS = 500_000
_DATE_FORMATS = frozenset(range(14, 23)) | {45, 46, 47}


def _serial(value: str) -> str:
    import datetime

    at = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(value))
    return at.strftime("%Y-%m-%d") if at.time() == datetime.time() else at.strftime("%Y-%m-%d %H:%M:%S")


def xlsx_rows(content: bytes):
    """(sheet, row number, cells as text) of each row that is not blank; cached values, trailing blanks trimmed."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{_M}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_M}numFmt")}
            for xf in styles.find(f"{_M}cellXfs") or ():
                k = int(xf.get("numFmtId", 0))
                dates.append(k in _DATE_FORMATS or bool(re.search(r"[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, "")), re.I)))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            nth = 0
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_M}row":
                        continue
                    nth = int(row.get("r", nth + 1))
                    if nth > MAX_ROWS:
                        raise ValueError(f"{sheet.get('name')} has more than {MAX_ROWS:,} rows")
                    out: list[str | None] = []
                    for c in row.iter(f"{_M}c"):
                        ref = re.match(r"[A-Z]+", c.get("r", ""))
                        at = 0
                        for ch in ref[0] if ref else "":
                            at = at * 26 + ord(ch) - 64
                        out += [None] * ((at or len(out) + 1) - 1 - len(out))
                        kind, v = c.get("t", "n"), c.find(f"{_M}v")
                        raw = v.text if v is not None else None
                        if kind == "s" and raw is not None:
                            raw = shared[int(raw)]
                        elif kind == "inlineStr":
                            raw = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                        elif kind == "b" and raw is not None:
                            raw = "1" if raw == "1" else "0"
                        elif kind == "n" and raw and int(c.get("s", 0)) < len(dates) and dates[int(c.get("s", 0))]:
                            raw = _serial(raw)
                        out.append(raw)
                    while out and not (out[-1] or "").strip():
                        out.pop()
                    if out:
                        yield sheet.get("name"), nth, out
                    row.clear()


# Workbooks as documents ---------------------------------------------------------------------------

# Rows up to which each is a chunk of its own, characters of a packed chunk, chunks of a sheet at most, rows in which
# a header is looked for, its least score, and columns that are named.
ROW_CHUNKS, PACKED_CHARS, MAX_CHUNKS, HEADER_ROWS, HEADER_SCORE, HINTS = 100, 1200, 250, 12, 2.5, 12


def plain_cell(cell: str | None) -> str:
    """A cell for the index: numbers with decimals are rounded to six and lose closing zeros."""
    text = (cell or "").strip()
    if re.fullmatch(r"-?\d+\.\d+(?:[eE][+-]?\d+)?", text):
        text = f"{float(text):.6f}".rstrip("0").rstrip(".")
    return text


def _header_score(cells: list[str]) -> float:
    one = lambda c: bool(re.search("[A-Za-z]", c)) * 1.0 + (not re.search(r"\d", c)) * 0.35 + (len(c) <= 40) * 0.2 + (bool(re.search("[A-Za-z]", c)) and not re.fullmatch(r"[A-Z]{2,}\d+", c)) * 0.2
    return 0.8 * (len({c.lower() for c in cells}) == len(cells)) + sum(map(one, cells))


def header_names(cells: list[str]) -> list[str]:
    """Headers as they are shown: single spaces, marks at the ends off, blank ones numbered, repeated ones with their column."""
    out, used = [], set()
    for i, c in enumerate(cells, 1):
        name = re.sub(r"\s+", " ", c).strip(" |:-") or f"Column {i}"
        name = f"{name} ({i})" if name.lower() in used else name
        used.add(name.lower())
        out.append(name)
    return out


def row_text(sheet: str, number: int, headers: list[str], cells: list[str]) -> str:
    """``header: value`` lines of the cells that are not blank."""
    named = [f"{headers[i] if i < len(headers) else f'Column {i + 1}'}: {c}" for i, c in enumerate(cells) if c]
    return "\n".join([f"# Sheet: {sheet}", f"Row: {number}", *named])


def packed(sheet: str, rows: list[tuple[int, str]]) -> list[dict]:
    """Rows in chunks of about PACKED_CHARS, MAX_CHUNKS at most; beyond twice that size a chunk's further rows are left to SQL,
    which reads every row."""
    prefix, least = f"# Sheet: {sheet}\n", max(1, -(-len(rows) // MAX_CHUNKS))
    out, group, size, first = [], [], 0, 0

    def close() -> None:
        out.append({"text": f"# Sheet: {sheet}\n\n" + "\n\n".join(group), "chunk_type": "spreadsheet-row", "sheet_name": sheet, "row_number": first})

    for number, text in rows:
        body = text.removeprefix(prefix)
        if len(group) >= least and size + len(body) > PACKED_CHARS and len(out) + 1 < MAX_CHUNKS:
            close()
            group, size = [], 0
        first = first if group else number
        if size < 2 * PACKED_CHARS:
            group.append(body)
            size += len(body)
    if group:
        close()
    return out


def sheet_document(sheets: dict[str, list[tuple[int, list[str]]]]) -> tuple[str, list[dict], dict]:
    """Text, chunks and structure of a workbook for the index; sheets are rows of (number, plain cells)."""
    parts, chunks, profiles, hints = [], [], [], []
    for name, rows in sheets.items():
        parts.append(f"# Sheet: {name}")
        scores = [(_header_score(f), -i) for i, (_, cells) in enumerate(rows[:HEADER_ROWS]) if len(f := [c for c in cells if c]) >= 2]
        best, at = max(scores, default=(0.0, 0))
        headers = header_names(rows[-at][1]) if best >= HEADER_SCORE else []
        body = [row for i, row in enumerate(rows) if not headers or i != -at]
        if headers:
            parts.append(f"# Header: {' | '.join(headers)}")
            hints += headers
        texts = [(n, row_text(name, n, headers, cells)) for n, cells in body]
        parts += [t for _, t in texts[:MAX_CHUNKS]]
        chunks += [{"text": t, "chunk_type": "spreadsheet-row", "sheet_name": name, "row_number": n} for n, t in texts] if len(texts) <= ROW_CHUNKS else packed(name, texts)
        profiles.append({"name": name, "row_count": len(body), "column_count": max([len(headers), *(len(c) for _, c in rows)], default=0), "header_hints": headers[:HINTS]})
    structure = {"sheet_count": len(profiles), "row_count": sum(p["row_count"] for p in profiles), "sheet_names": [p["name"] for p in profiles], "column_hints": list(dict.fromkeys(hints))[:HINTS], "sheets": profiles}
    return "\n\n".join(parts), chunks, structure


def workbook_document(content: bytes) -> tuple[str, list[dict], dict]:
    sheets: dict[str, list[tuple[int, list[str]]]] = {}
    for sheet, number, cells in xlsx_rows(content):
        sheets.setdefault(sheet, []).append((number, [plain_cell(c) for c in cells]))
    return sheet_document(sheets)


def workbook_text(content: bytes) -> str:
    """A workbook as text for the index: headings for sheets and headers, labelled rows."""
    return workbook_document(content)[0]


class SheetSource(DataSource):
    """``spark.read.format("leafmill_sheets").option("paths", "a.xlsx\\nb.csv")``: one partition a file.

    Executors open the files themselves, by path or address (``file:``, ``hdfs:``, ``s3:``), so they must reach them.
    """

    @classmethod
    def name(cls) -> str:
        return "leafmill_sheets"

    def schema(self) -> str:
        return "path string, sheet string, row_num int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _SheetReader([p for p in self.options.get("paths", self.options.get("path", "")).split("\n") if p])


class _SheetReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        from .files import content_of

        content = content_of(partition.value)
        for sheet, n, cells in xlsx_rows(content):
            yield partition.value, sheet, n, cells


def read_sheets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, sheet, row_num, cells`` of all rows of the given workbooks, a task each, and CSV files, a task for each range of bytes."""
    texts, books = ([p for p in paths if p.lower().endswith(".csv") == csv] for csv in (True, False))
    spark.dataSource.register(SheetSource)
    rows = spark.read.format("leafmill_sheets").option("paths", "\n".join(books)).load() if books or not texts else None
    if texts:
        lines = csv_ranges.read_csv(spark, spark.createDataFrame([(p,) for p in texts], "path string"))
        rows = lines if rows is None else rows.unionByName(lines)
    return rows


def sheet_columns(headers: list[str | None]) -> list[str]:
    """Column names from a header row: cleaned, blank ones numbered, repeated ones suffixed."""
    import unicodedata

    out: list[str] = []
    for i, h in enumerate(headers, 1):
        t = unicodedata.normalize("NFKD", (h or "").strip()).encode("ascii", "ignore").decode().lower()
        for sign, word in (("%", " pct "), ("#", " num "), ("&", " and "), ("$", " usd ")):
            t = t.replace(sign, word)
        t = re.sub("[^0-9a-z]+", "_", t).strip("_")[:48] or f"column_{i}"
        t = f"c_{t}" if t[0].isdigit() else f"{t}_" if t in KEYWORDS else t
        out.append(unique(t, set(out)))
    return out


# Names that would need quotes.
KEYWORDS = frozenset(
    "all and as asc between by case check collate column create cross default delete desc distinct drop else end except exists foreign from full glob group having in index inner insert intersect into is join "
    "key left like limit match natural not null offset on or order outer primary references right select set table then to union unique update using values view when where with window over partition range rows".split()
)


def unique(name: str, used: set[str]) -> str:
    """``name``, or with ``_2``, ``_3``, ... what is not used yet."""
    k, out = 2, name
    while out.lower() in used:
        out, k = f"{name}_{k}", k + 1
    return out


def short_name(text: str, fallback: str, most: int = 28) -> str:
    """A part of a table's name: ASCII letters and digits, others as single underscores."""
    import unicodedata

    t = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    t = re.sub("[^0-9a-z]+", "_", t).strip("_")[:most].strip("_") or fallback
    return f"c_{t}" if t[0].isdigit() else t


def table_names(sheets: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """Table of each (path, sheet): ``stem_ext__sheet``, or ``stem_csv``; unique in the order of the paths."""
    out: dict[tuple[str, str], str] = {}
    for path, sheet in sorted(sheets, key=lambda s: s[0].lower()):
        stem, _, ext = path.replace("\\", "/").rpartition("/")[2].rpartition(".")
        name = f"{short_name(stem or ext, 'file')}_{ext.lower()}" + (f"__{short_name(sheet, 'sheet')}" if sheet else "")
        out[path, sheet] = unique(name, set(out.values()))
    return out


def contained(root: str, path: str) -> str:
    """The full path of ``path`` below ``root``; an error if it leads out of it."""
    import os

    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path.replace("\\", "/")))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path} is not inside the folder")
    return full


#: Parsers and suffixes of documents that are tables, and how many can be asked at once.
SHEET_PARSERS, MOST_DOCUMENTS = ("spreadsheet", "spreadsheet-xls", "csv"), 25


def resolved(documents: DataFrame, ids: list[str] | None) -> list[str]:
    """Paths of the spreadsheets among ``documents`` that are asked for, or of all; unknown ids and too many are errors."""
    sheets = documents.where(F.col("parser").isin(*SHEET_PARSERS) | tx.extension(F.col("relative_path")).isin(*tx.SHEET_SUFFIXES))
    if ids:
        wanted = list(dict.fromkeys(i.replace("\\", "/") for i in ids))
        if len(wanted) > MOST_DOCUMENTS:
            raise ValueError(f"At most {MOST_DOCUMENTS} documents can be asked at once")
        known = {r[0] for r in sheets.where(F.col("relative_path").isin(*wanted)).select("relative_path").collect()}
        if missing := [w for w in wanted if w not in known]:
            raise ValueError(f"Not a spreadsheet of this index: {', '.join(missing)}")
        return wanted
    found = [r[0] for r in sheets.orderBy(F.lower("relative_path")).select("relative_path").limit(MOST_DOCUMENTS + 1).collect()]
    if len(found) > MOST_DOCUMENTS:
        raise ValueError(f"More than {MOST_DOCUMENTS} spreadsheets: say which")
    return found


def open_tables(spark: SparkSession, root: str, paths: list[str]) -> dict[str, DataFrame]:
    """A typed table for each sheet of the given files below ``root``, by name."""
    rows = read_sheets(spark, [contained(root, p) for p in paths])
    full = {contained(root, p): p for p in paths}
    sheets = [(r[0], r[1]) for r in rows.select("path", "sheet").distinct().collect()]  # a row for each sheet of MOST_DOCUMENTS files
    names = table_names([(full[p], s) for p, s in sheets])
    return {names[full[p], s]: typed_table(rows.where(F.col("path") == p), s) for p, s in sheets}


def typed_table(rows: DataFrame, sheet: str) -> DataFrame:
    """One sheet of ``read_sheets`` as a typed table with ``_row``; values that a type loses stay in ``<name>_raw``.

    The header is found among the first rows; types come from all rows, by one aggregate over the cells.
    """
    own = rows.where(F.col("sheet") == sheet)
    found = tabular.header_row(own, ["sheet"], "row_num", "cells").first()
    first = own.agg(F.min("row_num"), F.max(F.size("cells"))).first()
    if first[0] is None:
        raise ValueError(f"{sheet}: no rows")
    header, at = (found["cells"], found["row_num"]) if found else ([None] * first[1], first[0] - 1)
    names = sheet_columns([*header, *[None] * max(0, first[1] - len(header))])
    wide = own.where(F.col("row_num") > at).select(F.col("row_num").alias("_row"), *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    votes = {r["column"]: (r["type"], r["failed"] + r["tokens"]) for r in tabular.type_votes(tabular.cells(wide, names), tokens=True).collect()}  # a row for each column
    out = [F.col("_row")]
    for n in names:
        kind, failed = votes.get(n, ("text", 0))
        value = F.trim(n)
        value = F.when((value == "") | F.lower(value).isin(*tx.NULL_TOKENS), None).otherwise(value)
        if kind in ("integer", "real"):
            out.append(tx.cell_number(value).cast("long" if kind == "integer" else "double").alias(n))
        elif kind == "date":
            out.append(tx.cell_date(value).alias(n))
        else:
            out.append(value.alias(n))
        if failed and kind != "text":
            out.append(F.col(n).alias(f"{n}_raw"))
    return wide.select(*out)
