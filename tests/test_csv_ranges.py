"""CSV files read by ranges: the same rows as the csv module gives in one pass, whatever the ranges are."""

import csv
import io
import random

import pytest

from leafmill.sources import csv_ranges, workbook


def plain(content):
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("cp1252", "replace")
    csv.field_size_limit(csv_ranges.FIELD)
    reader, out = csv.reader(io.StringIO(text, newline=""), delimiter=csv_ranges.delimiter_of(text.split("\n", 1)[0])), []
    for row in reader:
        while row and not row[-1].strip():
            row.pop()
        if row:
            out.append((reader.line_num, row))
    return out


def odd_file(rng):
    d, nl = rng.choice(csv_ranges.DELIMITERS), rng.choice(["\n", "\r\n", "\n", "\r"])
    cells = ["a", "bb", "", "é", "x y", 'q"q', '"qu""oted"', '"with\nbreak"', f'"a{d}b"', '"\n\n"', '"\r\n"', '"odd"tail', '12" pipe', '" lead', '"""x"""', '""', '"é\n"']
    text = nl.join(d.join(rng.choices(cells, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 12))) + rng.choice(["", nl])
    return text.encode(rng.choice(["utf-8", "utf-8", "utf-8-sig", "cp1252"]))


def test_every_range_size(spark, tmp_path, monkeypatch):
    """Odd files in ranges of a few bytes: quoted breaks, stray quotes, rows over many ranges, marks, all line ends."""
    rng, want = random.Random(3), {}
    for i in range(300):
        content = odd_file(rng)
        path = tmp_path / f"{i}.csv"
        path.write_bytes(content)
        want[str(path)] = plain(content)
    files = spark.createDataFrame([(p,) for p in want], "path string")
    for size in (5, 17, 64, 10_000):
        got = {p: [] for p in want}
        for r in csv_ranges.read_csv(spark, files, size).collect():
            got[r.path].append((r.row_num, r.cells))
        assert {p: sorted(r, key=lambda x: x[0]) for p, r in got.items()} == want


def test_a_large_file_is_many_tasks(spark, tmp_path):
    path = tmp_path / "large.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "text", "n"])
        for i in range(60_000):
            out.writerow([i, "line one\nline two, with comma" if i % 3 == 0 else f'say "{i}"', i * 2])
    files = spark.createDataFrame([(str(path),)], "path string")
    size = path.stat().st_size // 40
    ranges = csv_ranges.placed(csv_ranges.measured(spark, files, size)).collect()
    assert len(ranges) >= 40 and any(r.quoted for r in ranges)
    rows = csv_ranges.read_csv(spark, files, size)
    assert [(r.row_num, r.cells) for r in rows.orderBy("row_num").collect()] == plain(path.read_bytes())
    table = workbook.typed_table(workbook.read_sheets(spark, [str(path)]), "")
    assert table.count() == 60_000 and dict(table.dtypes)["n"] == "bigint" and table.where("id = 3").first().text == "line one\nline two, with comma"


def test_small_cases(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "wide.csv").write_bytes(b'a;b\n"' + b"x" * 200_000 + b'";2\n3;4')
    (tmp_path / "bad.csv").write_bytes(b'a,b\n"' + b"y" * (csv_ranges.FIELD + 10) + b'",2\n')
    of = lambda n, size=csv_ranges.RANGE: csv_ranges.read_csv(spark, spark.createDataFrame([(str(tmp_path / n),)], "path string"), size).collect()
    assert of("empty.csv") == []
    assert [(r.row_num, len(r.cells[0])) for r in of("wide.csv", 1000)] == [(1, 1), (2, 200_000), (3, 1)]
    with pytest.raises(Exception, match="bad.csv could not be read as CSV"):
        of("bad.csv")
