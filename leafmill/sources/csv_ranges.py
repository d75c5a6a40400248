"""CSV files read by byte ranges, so that one large file is many tasks.

A range begins after the first line break at or after its nominal start. There a record begins, or the place lies inside a quoted field;
which of the two depends on everything before it. So a first pass finds for each range what each of the two states at its start becomes at
its end, and counts its lines; the states and line numbers at all starts follow by running sums over a file's ranges. A second pass
reads each range on its own: a row belongs to the range that it starts in, which reads on past its end where a row does.

A quote opens a field only at a field's start, as the csv module has it; in other places it is text.

Defined results: encodings are UTF-8 with or without a mark, else cp1252 for the whole file. The delimiter is the one of ``, ; tab |``
that the first line holds most of, a comma where none is ahead. Rows have the number of their last line. Trailing blank cells go, and
with them blank rows. An empty file gives no rows. Lone carriage returns end lines, but a range only begins after a line feed: a
file without one is one task. A field of more than FIELD characters is an error that names the file.
"""

from __future__ import annotations

import codecs
import collections
import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range, and of what is read on where a row passes a range's end.
RANGE, MORE = 32 << 20, 1 << 16
#: Characters of a field at most, and delimiters; of equally frequent ones the comma, else the first.
FIELD, DELIMITERS = 10_000_000, ",;\t|"
ROWS = "path string, sheet string, row_num int, cells array<string>"
_RANGES = "path string, nth int, start long, stop long, after_start boolean, after_quoted boolean, lines long, utf8 boolean, delimiter string"
_LINE = re.compile(rb"\r\n|\n|\r")
#: From inside a quoted field to its closing quote; to the end where it has none.
_CLOSE = re.compile(rb'[^"]*+(?:""[^"]*+)*+("|\Z)')


def delimiter_of(first_line: str) -> str:
    return max(DELIMITERS, key=lambda d: (first_line.count(d), -DELIMITERS.index(d)))


def _quoted(delimiter: str) -> re.Pattern:
    """A quoted field with the quote that opens it; its last group is empty where it is not closed."""
    d = re.escape(delimiter.encode())
    return re.compile(rb'(?:(?<=[\r\n])|(?<=' + d + rb')|(?<![\s\S]))"[^"]*+(?:""[^"]*+)*+("|\Z)')


def ends_quoted(data: bytes, delimiter: str, quoted: bool) -> bool:
    """Whether ``data``, which begins after a line feed in the given state, ends inside a quoted field."""
    at = 0
    if quoted:
        m = _CLOSE.match(data)
        if not m[1]:
            return True
        at = m.end()
    last = collections.deque(_quoted(delimiter).finditer(data, at), maxlen=1)
    return bool(last) and not last[0][1]


def record_end(data: bytes, at: int, delimiter: str, quoted: bool) -> int:
    """End of the record that goes on at ``at``, its line break included; -1 where ``data`` does not hold it."""
    if quoted:
        m = _CLOSE.match(data, at)
        if not m[1]:
            return -1
        at = m.end()
    for m in re.compile(_quoted(delimiter).pattern + rb"|(\r\n|\n|\r(?!\Z))").finditer(data, at):
        if m[2]:
            return m.end()
        if not m[1]:
            return -1
    return -1


def _open(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path)) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


class _File:
    """A file whose bytes are asked for by place."""

    def __init__(self, path: str):
        self.file = _open(path)
        self.size = self.file.size()

    def read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, min(stop, self.size) - start))

    def after_line_feed(self, at: int) -> int:
        """The place after the first line feed at ``at`` - 1 or later; the size where there is none."""
        at = max(0, at - 1)
        while at < self.size:
            part = self.read(at, at + MORE)
            if (k := part.find(b"\n")) >= 0:
                return at + k + 1
            at += len(part)
        return self.size

    def first_line(self) -> str:
        at, head = 0, b""
        while at < self.size and b"\n" not in head:
            head += self.read(at, at + MORE)
            at = len(head)
        return head.split(b"\n", 1)[0].decode("utf-8-sig", "replace")


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def measured(spark: SparkSession, files: DataFrame, size: int = RANGE) -> DataFrame:
    """A row for each range of ``files`` (path): where it begins and ends, and what it does to the state at its start."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                n = max(1, -(-_File(path).size // size))
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32())], names=["path", "nth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, nth in zip(*(c.to_pylist() for c in batch.columns)):
                f = _File(path)
                start = f.after_line_feed(nth * size) if nth else 0
                stop = max(start, f.after_line_feed((nth + 1) * size) if (nth + 1) * size < f.size else f.size)
                data, delimiter = f.read(start, stop), delimiter_of(f.first_line())
                data = data.removeprefix(codecs.BOM_UTF8) if not nth else data
                row = [path, nth, start, stop, ends_quoted(data, delimiter, False), ends_quoted(data, delimiter, True), len(_LINE.findall(data)), _is_utf8(data), delimiter]
                yield pa.RecordBatch.from_arrays([pa.array([x]) if k not in (1,) else pa.array([x], pa.int32()) for k, x in enumerate(row)], names=[c.split()[0] for c in _RANGES.split(", ")])

    ranges = files.select("path").mapInArrow(listed, "path string, nth int")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(n, "path", "nth").mapInArrow(run, _RANGES)


def placed(ranges: DataFrame) -> DataFrame:
    """Ranges with ``quoted`` (whether one begins inside a quoted field), ``before`` (lines before it) and ``encoding``.

    A range keeps the state at its start, turns it round, or ends in one state whatever it was. So the state at a start is what the last
    range of the third kind before it ended in, turned round as often as ranges since then say: running sums over a file's ranges.
    """
    file = Window.partitionBy("path")
    until, before = (file.orderBy("nth").rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    turns = (F.col("after_start") & ~F.col("after_quoted")).cast("int")
    settles = F.when(F.col("after_start") == F.col("after_quoted"), F.struct(F.col("after_start").alias("state"), F.col("turned").alias("turned")))
    known = ranges.withColumn("turned", F.sum(turns).over(until)).withColumn("settled", settles)
    known = known.withColumn("last", F.last("settled", ignorenulls=True).over(before)).withColumn("so_far", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    odd = (F.col("so_far") - F.coalesce("last.turned", F.lit(0))) % 2 == 1
    return known.select(
        "path", "delimiter", F.when(F.every("utf8").over(file), "utf-8").otherwise("cp1252").alias("encoding"), "nth", "start", "stop",
        (F.coalesce("last.state", F.lit(False)) != odd).alias("quoted"), F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"),
    ).where("start < stop")


def range_rows(f: _File, delimiter: str, encoding: str, start: int, stop: int, quoted: bool, before: int) -> Iterator[tuple[int, list[str]]]:
    """(number of its last line, cells) of each row that starts in the range."""
    data, skipped = f.read(start, stop), 0
    data = data if start else data.removeprefix(codecs.BOM_UTF8)
    if quoted:  # the rest of a row that belongs to a range before this one
        skipped = record_end(data, 0, delimiter, True)
        if skipped < 0:
            return
    data, lines = data[skipped:], before + len(_LINE.findall(data[:skipped]))
    opened = collections.deque(_quoted(delimiter).finditer(data), maxlen=1)
    if opened and not opened[0][1]:  # the last row goes on
        at, size = opened[0].start() + 1, MORE
        while (end := record_end(data, at, delimiter, True)) < 0 and stop < f.size:
            part = f.read(stop, stop + size)
            data, stop, size = data + part, stop + len(part), size * 2
        data = data[:end] if end >= 0 else data
    text = data.decode(encoding, "replace")
    csv.field_size_limit(FIELD)
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    for row in reader:
        while row and not row[-1].strip():
            row.pop()
        if row:
            yield lines + reader.line_num, row


def read_csv(spark: SparkSession, files: DataFrame, size: int = RANGE) -> DataFrame:
    """``path, sheet, row_num, cells`` of all rows of ``files`` (path), a task for each range of about ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, delimiter, encoding, _, start, stop, quoted, before in zip(*(c.to_pylist() for c in batch.columns)):
                out: list[tuple[int, list[str]]] = []
                try:
                    for row in range_rows(_File(path), delimiter, encoding, start, stop, quoted, before):
                        out.append(row)
                        if len(out) == 5000:
                            yield _batch(path, out)
                            out = []
                except csv.Error as e:
                    raise ValueError(f"{path} could not be read as CSV: {e}") from e
                if out:
                    yield _batch(path, out)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed(measured(spark, files, size)).repartition(n, "path", "nth").mapInArrow(run, ROWS)


def _batch(path: str, rows: list[tuple[int, list[str]]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([""] * n, pa.string()), pa.array([r for r, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.list_(pa.string()))], names=["path", "sheet", "row_num", "cells"])
