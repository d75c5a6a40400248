"""Golden values of chunking, search, tables, the sandbox, sources, the index and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.functions import vectors as vx
from leafmill.operators import chunking, ingest, search, tabular
from leafmill.plans import guard
from leafmill.plans import index as index_module
from leafmill.plans import tables as tables_module
from leafmill.plans.index import Index
from leafmill.plans.tables import Tables, markdown_result, to_csv, to_markdown
from leafmill.sources import files, workbook
from leafmill.sources import files as source_module
from leafmill.sources.filters import Rules, glob_regex
from leafmill.streaming import watch

# Chunks -----------------------------------------------------------------------------------------


def test_borders():
    assert chunking.split_text("A" * 1000 + "\n\n" + "B" * 1500)[0] == "A" * 1000
    assert chunking.split_text("A" * 950 + "\n\n" + "B" * 100 + "\n" + "C" * 1500)[0] == "A" * 950
    assert chunking.split_text("x" * 950 + "\n" + "y" * 1000)[0] == "x" * 950
    assert chunking.split_text("word " * 190 + "End of sentence. " + "tail " * 300)[0].endswith("End of sentence.")
    assert len(chunking.split_text("a" * 100 + "\n\n" + "b" * 2000)[0]) == 1200
    parts = chunking.split_text("".join(chr(97 + i % 26) for i in range(3000)))
    assert len(parts[0]) == 1200 and parts[0][-200:] == parts[1][:200]
    assert chunking.split_text("") == [] and chunking.split_text(None) == [] and chunking.split_text(" \n ") == []


# Search -----------------------------------------------------------------------------------------


def corpus(spark, texts: dict[str, str]):
    return spark.createDataFrame([(p, p, t, False) for p, t in texts.items()], "chunk_id string, relative_path string, text string, has_visual boolean")


def find(c, query, k=8, ids=None):
    return [(r.chunk_id, r.score) for r in search.hybrid(c, search.postings(c), search.statistics(search.lengths(c)), query, k, ids).collect()]


def test_ranking(spark):
    c = corpus(spark, {"notes/apples.txt": "apple apple apple orchard harvest", "notes/mixed.txt": "apple banana cherry date elderberry fig grape honeydew kiwi lemon mango", "notes/other.txt": "nothing relevant here at all", "notes/common.txt": "the the the the apple"})
    assert find(c, "apple harvest")[0][0] == "notes/apples.txt"
    only = spark.createDataFrame([("notes/mixed.txt",)], "relative_path string")
    assert [p for p, _ in find(c, "apple", ids=only)] == ["notes/mixed.txt"]
    assert find(c, "zzz") == [] and find(c, "") == []


def test_rare_terms_and_paths(spark):
    c = corpus(spark, {"a.txt": "report report report quarterly", "b.txt": "report summary", "c.txt": "report overview", "d.txt": "zeppelin report"})
    assert find(c, "report zeppelin")[0][0] == "d.txt"
    c = corpus(spark, {"budget/plan.txt": "numbers for next year", "other/plan.txt": "numbers for next year"})
    best = find(c, "budget numbers")
    assert best[0][0] == "budget/plan.txt" and best[0][1] - best[1][1] == pytest.approx(0.75)


def test_quantised_vectors(spark):
    import numpy as np

    r = np.random.default_rng(42)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(300, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    restored = df.select("vec_id", vx.restored(vx.codes(F.col("embedding")), vx.scale(F.col("embedding"))).alias("v")).collect()
    exact = np.array([v for _, v in rows])
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    assert np.abs(np.array([x.v for x in restored]) - exact).max() < 0.02
    near = search.cosine_top(df, rows[7][1], 3).collect()
    assert near[0].vec_id == 7 and near[0].score == pytest.approx(1)
    assert search.cosine_top(df, [0.0] * 64, 3).count() == 0


# Tables -----------------------------------------------------------------------------------------

CLAIMS = [(1, "TX", "Open", "100.50"), (2, "TX", "Closed", "200"), (3, "CA", "Open", "50.25"), (4, "CA", "Closed", "300"), (5, "TX", "Open", None), (6, "FL", "Closed", "99.99"), (7, "TX", "Open", "N/A")]


@pytest.fixture(scope="module")
def claims(spark):
    df = spark.createDataFrame(CLAIMS, "id int, state string, status string, paid string").withColumn("paid", tx.cell_number(F.col("paid")))
    return Tables(spark, {"claims": df})


def test_aggregates(claims):
    r = claims.query("SELECT count(*) AS n, sum(paid) AS s, avg(paid) AS a, min(paid) AS lo, max(paid) AS hi FROM claims").rows[0]
    assert r == [7, 750.74, 150.148, 50.25, 300.0]
    by = claims.query("SELECT state, count(*) AS n, sum(paid) AS s FROM claims GROUP BY state ORDER BY state")
    assert by.rows == [["CA", 2, 350.25], ["FL", 1, 99.99], ["TX", 4, 300.5]] and by.tables_used == ["claims"]
    assert claims.query("SELECT sum(paid) AS s FROM claims WHERE id > 99").rows == [[None]]


def test_row_cap_timeout_and_errors(claims, spark):
    capped = claims.query("SELECT a.id AS x, b.id AS y FROM claims a CROSS JOIN claims b", max_rows=10)
    assert len(capped.rows) == 10 and capped.truncated and markdown_result(capped).endswith("10+ rows")
    with pytest.raises(guard.NotAllowed, match="Available columns: id, paid, state, status"):
        claims.query("SELECT nope FROM claims")
    big = Tables(spark, {"big": spark.range(3_000_000).selectExpr("id", "id % 7 AS k")})
    with pytest.raises(guard.NotAllowed, match="longer than"):
        big.query("SELECT count(*) AS n FROM big a JOIN big b ON a.k = b.k", seconds=1.5)


def test_schema(claims):
    (t,) = claims.schema()
    assert t["rowCount"] == 7 and {c["name"]: c["categories"] for c in t["columns"]}["state"] == ["CA", "FL", "TX"]


@pytest.mark.parametrize("sql", ["DELETE FROM claims", "SELECT * FROM csv.`/etc/passwd`", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT * FROM claims, LATERAL explode(array(1)) t", "SELECT id FROM claims UNION SELECT id FROM other", "EXPLAIN SELECT 1", "SELECT now()", "SELECT id FROM default.claims", "SET x = 1", "SELECT transform(array(1), x -> x + 1)"])
def test_refused(sql, spark):
    with pytest.raises(guard.NotAllowed):
        guard.check(spark, sql, ["claims"])


def test_cells(spark):
    cells = {"$1,200.50": ("real", 1200.5), "(300.00)": ("real", -300.0), "n/a": ("token", None), "007": ("text", None), "1234567890123456": ("text", None), "5": ("integer", 5.0), "": ("null", None), "1e3": ("real", 1000.0), "abc": ("text", None), "(5": ("text", None)}
    df = spark.createDataFrame([(c,) for c in cells], "c string").select("c", tx.cell_kind(F.col("c")).alias("k"), tx.cell_number(F.col("c")).alias("n"))
    assert {r.c: (r.k, r.n) for r in df.collect()} == cells
    dates = {"01/15/2024": "2024-01-15", "2/3/2024": "2024-02-03", "2024-03-01": "2024-03-01", "13/02/2024": "2024-02-13", "31/31/2020": None, "1/2/69": "2069-01-02", "1/2/70": "1970-01-02", "x": None}
    df = spark.createDataFrame([(c,) for c in dates], "c string").select("c", tx.cell_date(F.col("c")).alias("d"))
    assert {r.c: r.d for r in df.collect()} == dates


def xlsx(path, rows):
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>'
    body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(vs) if v is not None)}</row>' for r, vs in rows)
    m, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{rel}"><sheets><sheet name="Policies" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData>{body}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    (tmp_path / "people.csv").write_text('Policy,Premium,Effective,Count\nP1,"$1,200.50",01/15/2024,3\nP2,(300.00),2/3/2024,\nP3,n/a,2024-03-01,5\nP4,500,13/02/2024,1\n')
    rows = workbook.read_sheets(spark, [str(tmp_path / "people.csv")])
    t = workbook.typed_table(rows, "")
    assert dict(t.dtypes) == {"_row": "int", "policy": "string", "premium": "double", "premium_raw": "string", "effective": "string", "count": "bigint"}
    assert t.agg(F.sum("premium"), F.min("effective"), F.max("effective"), F.sum("count")).first()[:] == (1400.5, "2024-01-15", "2024-03-01", 9)
    xlsx(tmp_path / "p.xlsx", [(1, ["Policy Report 2024"]), (2, ["Policy", "Premium", "Active"]), (3, ["P1", 1000.0, 1]), (4, ["P2", 2500.5, 0]), (6, ["P3", 1500, 1])])
    t = workbook.typed_table(workbook.read_sheets(spark, [str(tmp_path / "p.xlsx")]), "Policies")
    assert [tuple(r) for r in t.orderBy("_row").collect()] == [(3, "P1", 1000.0, 1), (4, "P2", 2500.5, 0), (6, "P3", 1500.0, 1)]


# Files and the index ------------------------------------------------------------------------------


@pytest.mark.parametrize(("pattern", "path", "hit"), [("*.log", "a/b/x.LOG", True), ("old/**", "old/a/b.txt", True), ("old/**", "older/a", False), ("**/x.txt", "x.txt", True), ("a/*.txt", "a/b/c.txt", False), ("[!a]*.md", "b.md", True), ("[!a]*.md", "a.md", False), ("docs/", "docs/x/y.md", True), ("x?.txt", "x1.txt", True)])
def test_globs(pattern, path, hit):
    import re

    assert bool(re.search(glob_regex(pattern), path)) == hit


def test_index(spark, tmp_path):
    root = tmp_path / "root"
    for name, text in {"a.txt": "alpha beta gamma", "b.txt": "beta " * 5, "c.txt": "gamma delta", "node_modules/x.txt": "no", ".git/y": "no", "skip.log": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "e.bin").write_bytes(bytes(range(256)))
    index = Index(spark, str(root), str(tmp_path / "index"), Rules.parse(["*.log"]))
    first = index.build()
    assert (first["added"], first["failed"], first["excluded"]) == (4, 1, 1) and index.status()["indexed"] == 3
    assert index.search("delta").first().relative_path == "c.txt"
    assert index.build()["unchanged"] == 4
    (root / "b.txt").write_text("changed epsilon")
    (root / "c.txt").unlink()
    (root / "d.txt").write_text("delta delta")
    second = index.build()
    assert (second["added"], second["updated"], second["removed"], second["unchanged"]) == (1, 1, 1, 2)
    assert index.search("delta").first().relative_path == "d.txt" and index.search("epsilon").count() == 1
    assert index.search("delta epsilon", document_ids=["b.txt"]).count() == 1
    assert [r.relative_path for r in index.files("failed").collect()] == ["e.bin"]
    assert [r.error_reason for r in index.files("skipped").collect()] == ["Excluded by rule: *.log"]
    assert Index(spark, str(root), str(tmp_path / "index"), Rules.parse(["*.log"])).build(force=True)["updated"] == 4


def test_vectors_in_the_index(spark, tmp_path):
    def broken(texts):
        raise RuntimeError("no credit left")

    word_vectors = index_module.hashed_words
    root, key = tmp_path / "root", "p|http://x|||m1"
    root.mkdir()
    for name, text in {"a.txt": "red apple pie", "b.txt": "green pear tart", "c.txt": "red apple pie"}.items():
        (root / name).write_text(text)
    of = lambda embed=word_vectors, k=key: Index(spark, str(root), str(tmp_path / "index"), embedder=index_module.Embedder(embed, k, 2))
    index = of()
    index.build()
    with pytest.raises(index_module.SearchError, match="not available"):
        index.search("apple", mode="vector")
    assert index.build(mode="vector")["unchanged"] == 3 and index.missing_vectors().count() == 0
    found = [(r.relative_path, r.score) for r in index.search("apple pie", mode="vector").collect()]
    assert [p for p, _ in found][:2] == ["a.txt", "c.txt"] and found[0][1] > 0.7 and index.search("", mode="vector").count() == 0
    with pytest.raises(index_module.SearchError, match="built with p/m1 but search uses p/m2"):
        of(k="p|http://x|||m2").search("apple", mode="vector")
    with pytest.raises(index_module.SearchError, match="dimensions"):
        of(lambda texts: [[1.0] for _ in texts]).search("apple", mode="vector")
    rows, reason = of(k="other").search_or_keywords("pear")
    assert rows[0].relative_path == "b.txt" and "rebuild required" in reason
    (root / "d.txt").write_text("blue plum")
    stats = of(broken).build(mode="vector")
    assert stats["added"] == 1 and "no credit left" in stats["warning"] and index.status()["mode"] == "keyword" and index.search("plum").count() == 1
    index.build(mode="vector")
    assert index.status()["mode"] == "vector" and index.missing_vectors().count() == 0
    of(k="p|http://x|||m2").build(mode="vector")
    assert index.status()["model"] == "p|http://x|||m2" and index.read("vectors").count() == 4 and index.read("chunks").count() == 4


def test_segments_and_cancel(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    root.mkdir()
    for i in range(12):
        (root / f"{i}.txt").write_text(f"word{i} common")
    index = Index(spark, str(root), str(tmp_path / "index"))
    index.build()
    number = index.manifest()["number"]
    assert index.build()["unchanged"] == 12 and index.manifest()["number"] == number
    (root / "3.txt").touch()  # another time, the same content
    assert index.build()["unchanged"] == 12 and index.search("word3").count() == 1 and index.read("chunks").count() == 12
    monkeypatch.setattr(index_module, "SEGMENTS", 4)
    for i in range(4):
        (root / f"{i}.txt").write_text(f"fresh{i}")
        assert index.build()["updated"] == 1
    assert len(index.manifest()["segments"]) < 4 and index.read("chunks").count() == 12 and index.search("word2").count() == 0 and index.search("fresh2").first().relative_path == "2.txt"
    for i in range(12):
        (root / f"{i}.txt").write_text(f"later{i}")
    once = source_module.extracted

    def then_cancel(*args):
        out = once(*args)
        calls.append(1)
        if len(calls) > 1:
            index._cancelled.set()
        return out

    for retain in (False, True):
        calls: list = []
        monkeypatch.setattr(source_module, "extracted", then_cancel)
        assert index.build(rounds=3, retain=retain)["cancelled"]
        monkeypatch.setattr(source_module, "extracted", once)
        new = sum(index.search(f"later{i}").count() for i in range(12))
        assert (0 < new < 12) if retain else new == 0
        assert index.read("chunks").count() == 12
    index.build()
    assert all(index.search(f"later{i}").count() for i in range(12))


@pytest.mark.parametrize("version", [2, 3])
def test_older_indexes_are_taken_over(spark, tmp_path, version, monkeypatch):
    import hashlib

    import numpy as np

    root, old = tmp_path / "root", tmp_path / "old"
    root.mkdir()
    old.mkdir()
    texts, sha = {"a.txt": "solar panels", "b.txt": "wind turbines"}, lambda t: hashlib.sha256(t.encode()).hexdigest()
    for name, t in texts.items():
        (root / name).write_text(t)
    at = {r.relative_path: (r.size, r.mtime) for r in source_module.discover(spark, str(root)).collect()}
    files_ = [{"relativePath": n, "status": "indexed", "size": at[n][0], "mtime": at[n][1], "parser": "text", "chunks": 1, "contentHash": sha(t)} for n, t in texts.items()]
    manifest = {"version": version, "rootPath": str(root), "files": files_, "embeddingDimension": 16, "embeddingModelKey": "p|||"} | ({"retrievalMode": "vector", "indexEngine": "numpy-cosine"} if version == 3 else {})
    (old / "manifest.json").write_text(json.dumps(manifest))
    (old / "documents.json").write_text(json.dumps([{"relativePath": n, "documentId": n, "parser": "text", "summary": t, "sectionHints": []} for n, t in texts.items()]))
    (old / "chunk_metadata.jsonl").write_text("\n".join(json.dumps({"label": i, "chunkId": f"{n}:0:legacy{i}", "relativePath": n, "snippet": t, "text": t, "chunkHash": sha(t)}) for i, (n, t) in enumerate(texts.items())))
    np.save(old / "vectors.npy", np.array(index_module.hashed_words(list(texts.values()), 16), np.float32))
    embed = index_module.Embedder(lambda texts: index_module.hashed_words(texts, 16), "p|||")
    index = Index(spark, str(root), str(tmp_path / "index"), embedder=embed)
    assert index.import_legacy(str(old))["mode"] == "vector"
    monkeypatch.setattr(source_module, "document", lambda *a: pytest.fail("extracted again"))
    assert index.build(mode="vector")["unchanged"] == 2 and [r.summary for r in index.documents().collect()] == ["solar panels", "wind turbines"]
    assert index.search("wind turbines", 1, mode="vector").first().chunk_id == "b.txt:0:legacy1" and index.search("panels").first().chunk_id == "a.txt:0:legacy0"
    (old / "manifest.json").write_text('{"version": 9}')
    with pytest.raises(ValueError, match="Unsupported index version"):
        index.import_legacy(str(old))


def test_diacritics_fold(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "menu.txt").write_text("Caf\u00e9-Men\u00fc und cr\u00e8me br\u00fbl\u00e9e")
    index = Index(spark, str(root), str(tmp_path / "index"))
    index.build()
    for q in ("cafe", "CAF\u00c9", "creme brulee"):
        assert index.search(q).count() == 1


def test_spreadsheet_documents(spark, tmp_path):
    rows = [(1, ["Claim", "Amount"])] + [(i, [f"C{i}", f"{i}.50"]) for i in range(2, 5)]
    text, chunks, structure = workbook.sheet_document({"Claims": [(n, [workbook.plain_cell(c) for c in cells]) for n, cells in rows]})
    assert text.startswith("# Sheet: Claims\n\n# Header: Claim | Amount\n\n# Sheet: Claims\nRow: 2\nClaim: C2\nAmount: 2.5")
    assert [c["row_number"] for c in chunks] == [2, 3, 4] and structure["row_count"] == 3 and structure["column_hints"] == ["Claim", "Amount"]
    many = workbook.packed("S", [(i, f"# Sheet: S\nRow: {i}\nA: {'x' * 90}") for i in range(1, 1001)])
    assert len(many) <= workbook.MAX_CHUNKS and many[0]["row_number"] == 1 and all(c["text"].startswith("# Sheet: S\n\n") for c in many)
    assert workbook.header_names([" A |", "", "a"]) == ["A", "Column 2", "a (3)"] and workbook.plain_cell("3.1400000") == "3.14"
    assert workbook.table_names([("b/Claims 2024.xlsx", "Sheet 1"), ("a/claims 2024.xlsx", "Sheet 1"), ("x.csv", "")]) == {("a/claims 2024.xlsx", "Sheet 1"): "claims_2024_xlsx__sheet_1", ("b/Claims 2024.xlsx", "Sheet 1"): "claims_2024_xlsx__sheet_1_2", ("x.csv", ""): "x_csv"}
    root = tmp_path / "root"
    root.mkdir()
    xlsx(root / "p.xlsx", [(1, ["Policy", "Premium"]), (2, ["P1", 1000.5]), (3, ["P2", 2500])])
    (root / "n.txt").write_text("note")
    index = Index(spark, str(root), str(tmp_path / "index"))
    index.build()
    (doc,) = index.documents().where("structure is not null").collect()
    assert doc.summary.startswith("Spreadsheet document p.xlsx with 2 rows across 1 sheets.") and doc.section_hints[1] == "Columns: Policy | Premium"
    assert index.search("P2").first().text.endswith("Premium: 2500")
    assert index.rows_matching("policy", ["p.xlsx"]).count() == 2
    paths = workbook.resolved(index.documents(), None)
    assert paths == ["p.xlsx"]
    for bad in (["n.txt"], ["nothing.csv"]):
        with pytest.raises(ValueError):
            workbook.resolved(index.documents(), bad)
    with pytest.raises(ValueError):
        workbook.contained(str(root), "../index")
    tables = Tables(spark, workbook.open_tables(spark, str(root), paths))
    (name,) = tables.tables
    assert tables.query(f"SELECT total(premium) AS t, typeof(premium) AS k FROM {name} GROUP BY 2", seconds=60).rows == [[3500.5, "real"]]


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT total(v), total(n) FILTER (WHERE n > 9), group_concat(s), group_concat(DISTINCT s, '; ') FROM t", [[7.5, 0.0, "Cx,a,b", "Cx; a; b"]]),
    ("SELECT iif(n > 1, min(n, 5), max(n, 2, 3)), typeof(n), typeof(v), typeof(s) FROM t WHERE s = 'a'", [[2, "integer", "null", "text"]]),
    ("SELECT strftime('%Y-%m %j %w %W %%', d), date(d, '+1 month'), datetime(d, 'start of month', '+36 hours'), time(d), julianday(d) FROM t WHERE s = 'b'", [["2024-01 031 3 05 %", "2024-03-02", "2024-01-02 12:00:00", "00:00:00", 2460340.5]]),
    ("SELECT date(d), strftime('%Y', d) FROM t WHERE s = 'Cx'", [[None, None]]), ("SELECT n / 0, n % 0, sqrt(-1), CAST('x' AS INT) FROM t WHERE n = 1", [[None, None, None, 0]]),
    ("SELECT s FROM t WHERE s LIKE 'c%' OR glob('[a]', s) ORDER BY s", [["Cx"], ["a"]]), ("SELECT s FROM t WHERE s NOT LIKE 'A' AND like('B', s)", [["b"]]),
    ("SELECT printf('%05.1f|%s', v, s), format('%d', n), trim('xxaxx', 'x'), ltrim('xa', 'x'), rtrim('ax', 'x') FROM t WHERE n = 1", [["005.0|b", "1", "a", "a", "a"]]),
    ("SELECT s, total(v) OVER (ORDER BY s) FROM t ORDER BY s", [["Cx", 2.5], ["a", 2.5], ["b", 7.5]]), ("SELECT max(n), min(s), abs(-2), round(2.5), substr('abc', -2), instr('abc', 'c'), replace('aa', 'a', 'b'), ifnull(NULL, 1), sign(-3), power(2, 3) FROM t", [[2, "Cx", 2, 3.0, "bc", 3, "bb", 1, -1.0, 8.0]]),
])
def test_sql_surface(spark, sql, want):
    """Every function that the sandbox lets through runs, as the embedded engine has it."""
    t = spark.createDataFrame([(1, "b", "2024-01-31", 5.0), (2, "a", "2024-02-29 13:45:10", None), (None, "Cx", "bad", 2.5)], "n int, s string, d string, v double")
    assert Tables(spark, {"t": t}).query(sql, seconds=60).rows == want


def test_dimension_checks(spark):
    v = spark.createDataFrame([("a", 2, [127, 0]), ("b", 3, [1, 2, 3])], "chunk_id string, dim int, codes array<tinyint>")
    with pytest.raises(Exception, match="dimensions"):
        search.code_top(v, [1.0, 0.0], 5).collect()
    assert search.code_top(v.where("dim = 2"), [1.0, 0.0], 5).first().score == pytest.approx(1.0) and search.code_top(v, [0.0, 0.0], 5).count() == 0


def test_extraction(tmp_path):
    assert files.extract("x.json", b'{"a": [1]}') == (json.dumps({"a": [1]}, indent=2), "text")
    assert files.extract("x.csv", b"a, b ,\n,,\nc,,d\n") == ("a | b\nc | d", "csv")
    assert files.extract("x.rtf", b"{\\rtf1{\\fonttbl x}Caf\\'e9 \\u8364?\\par two}") == ("Caf\u00e9 \u20ac\ntwo", "rtf")
    assert files.extract("x", "Grüße".encode()) == ("Grüße", "text")
    for name, content in (("x.bin", b"\0\1"), ("x.pdf", b"%PDF"), ("x.docx", b"PK")):
        with pytest.raises(Exception):
            files.extract(name, content)


def test_dense_ids_and_cost(spark):
    ids = ingest.dense_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), 10, "k").orderBy("k").collect()
    assert [r.id for r in ids] == list(range(11, 1011))
    rows = ingest.cost_batches(spark.range(100).select(F.col("id").cast("string").alias("relative_path"), F.lit(0.1).alias("cost")), 0.25, 2)
    assert rows.groupBy("shard", "batch").count().agg(F.max("count")).first()[0] <= 3


def test_header_and_structure(spark):
    rows = spark.createDataFrame([("s", 1, ["Report 2024", ""]), ("s", 2, ["Name", "City"]), ("s", 3, ["12", "34"])], "sheet string, n int, cells array<string>")
    assert [r.n for r in tabular.header_row(rows, ["sheet"], "n", "cells").collect()] == [2]


def test_output_formats(spark):
    df = spark.createDataFrame([("=1+1", 'a"b'), ("-5", "x|y")], "a string, b string")
    assert [r.line for r in to_csv(df).collect()] == ["'=1+1,\"a\"\"b\"", "-5,x|y"]
    assert [r.line for r in to_markdown(df).collect()][1] == r"| -5 | x\|y |"


def test_synchronise(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, c in enumerate(["a", "b", "a"]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"channel": c}))
    calls: list = []
    changes = spark.readStream.schema("channel string").json(str(tmp_path / "in"))
    watch.synchronise(changes, calls.append, "channel", str(tmp_path / "state")).awaitTermination()
    assert sorted({c for call in calls for c in call}) == ["a", "b"]


def event_files(folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"channel": c, "at": f"2024-01-01 {t}", "n": n}) for c, t, n in rows))


def test_late_rows_do_not_reopen_a_burst(spark, tmp_path):
    """With a watermark a burst is closed for good: a row that comes too late changes nothing."""
    event_files(tmp_path / "in", [[("a", "10:00:00", 1), ("a", "10:00:02", 2)], [("a", "10:10:00", 3)], [("a", "10:20:00", 4)], [("a", "10:00:01", 5), ("b", "10:20:30", 6)], [("a", "10:50:00", 7)]])
    rows = spark.readStream.schema("channel string, at timestamp, n int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in"))
    for i, f in enumerate(sorted((tmp_path / "in").iterdir())):
        import os

        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    out = tmp_path / "out"
    bursts = watch.debounced(rows, "channel", "at", "4 seconds", "1 minute")
    bursts.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.channel, r.start.strftime("%H:%M:%S"), r.changes) for r in spark.read.parquet(str(out)).collect())
    assert got[:2] == [("a", "10:00:00", 2), ("a", "10:10:00", 1)] and all(g[1] != "10:00:01" for g in got)


def test_state_is_merged_by_bucket(spark, tmp_path):
    event_files(tmp_path / "in", [[(f"k{i}", "10:00:00", i) for i in range(20)], [("k3", "11:00:00", 99)], [("k3", "12:00:00", 100), ("k4", "09:00:00", -1)]])
    schema = "channel string, at timestamp, n int"
    for i, f in enumerate(sorted((tmp_path / "in").iterdir())):
        import os

        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    table = str(tmp_path / "table")
    watch.upsert_state(rows, table, "channel", "at", "n", str(tmp_path / "state")).awaitTermination()
    got = {r.channel: r.n for r in watch.read_state(spark, table, rows.schema).collect()}
    assert got == {f"k{i}": i for i in range(20)} | {"k3": 100}
    versions = watch._versions(spark, table)
    assert max(map(len, versions.values())) == 2 and sum(len(v) > 1 for v in versions.values()) <= 2


def test_results_come_in_plan_order(spark):
    plan = spark.createDataFrame([(f"f{i}", 9 - i) for i in range(10)], "path string, place int")
    done = spark.createDataFrame([(f"f{i}",) for i in (3, 7, 1)], "path string")
    assert [r.path for r in watch.in_plan_order(done, plan, "path", "place").collect()] == ["f7", "f3", "f1"]


STATEMENTS = [
    ("SELECT count(*) FROM region", True), ("WITH r AS (SELECT * FROM region) SELECT r_name FROM r", True), ("SELECT r_name FROM region;", True), ("-- note\nSELECT 1 AS x", True),
    ("SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)", True), ("DROP TABLE region", False), ("INSERT INTO region VALUES (9, 'x')", False), ("SELECT * FROM parquet.`/tmp/x`", False),
    ("SELECT reflect('java.lang.System', 'exit', 0)", False), ("SELECT current_date", False), ("SELECT rand()", False), ("SELECT * FROM range(5)", False), ("SELECT 1; SELECT 2", False), ("", False), ("SHOW TABLES", False),
    ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t) SELECT n FROM t", False), ("SELECT * FROM lineitem", False), ("SELECT r_name FROM region WHERE r_name RLIKE 'A'", False), ("SELECT nth_value(r_name, 1) OVER (ORDER BY r_name) FROM region", False),
    ("SELECT explode(array(1, 2))", False), ("SELECT r_name FROM region LATERAL VIEW explode(array(1)) t AS x", False), ("SELECT (SELECT max(x.v) FROM secret x) FROM region", False),
]


def test_what_the_sandbox_lets_through(spark):
    def allowed(sql, functions=()):
        try:
            guard.check(spark, sql, ["region", "nation"], functions)
            return True
        except guard.NotAllowed:
            return False

    assert [allowed(sql) for sql, _ in STATEMENTS] == [ok for _, ok in STATEMENTS]
    lateral = "SELECT j.key FROM region r, LATERAL json_each(r.r_name) j"
    assert not allowed(lateral) and allowed(lateral, ["json_each"]) and not allowed("SELECT * FROM range(5)", ["json_each"]) and not allowed("SELECT j.key FROM region r, LATERAL json_each((SELECT max(x.v) FROM secret x)) j", ["json_each"])
    sql = "WITH c AS (SELECT c_nationkey FROM customer) SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)"
    assert guard.check(spark, sql, ["customer", "nation", "orders"]).tables == ["customer", "nation"]


#: As an embedded engine answers them, computed by it.
DIALECT = [
    "SELECT n/2, (n+1)/2/2, n/2*1.0, v/2, n/v, 7/2, -7/2, n/0 FROM t ORDER BY n", "SELECT CASE WHEN n/2 > 1 THEN n/3 ELSE 10 / CASE WHEN n/7 = 1 THEN 3 ELSE 4 END END FROM t ORDER BY n", "SELECT typeof(n/2), typeof(v/2), count(*)/3 FROM t GROUP BY 1,2 ORDER BY 1,2",
    "SELECT CAST(c AS INTEGER), CAST(c AS REAL), CAST(n AS TEXT), CAST(v AS INTEGER), CAST(CAST(c AS INTEGER)/5 AS TEXT) FROM t ORDER BY n", "SELECT CAST('12abc' AS INT) / 5, CAST('x' AS REAL) FROM t LIMIT 1", "SELECT s FROM t WHERE s COLLATE NOCASE = 'b' ORDER BY s COLLATE NOCASE, n",
    "SELECT s FROM t WHERE s GLOB '[aB]' ORDER BY s", "SELECT s FROM t WHERE s NOT GLOB 'a*' ORDER BY s", "SELECT s, s GLOB g, s GLOB lower(g) FROM t ORDER BY n", "SELECT s FROM t WHERE s GLOB trim('xBx','x')", "SELECT printf('%05.2f|%d|%s|%5s|%-4d|%%|%x', n, v, s, s, n, 255) FROM t WHERE n > 0 ORDER BY n",
    "SELECT printf('%.1f %d %s', NULL, NULL, NULL) FROM t LIMIT 1", "SELECT printf('%d', '12abc') FROM t LIMIT 1", "SELECT strftime(f, d) FROM t ORDER BY n", "SELECT max(n)/2 FROM t HAVING max(n)/2 = 3", "SELECT n FROM t WHERE n/2 = (SELECT max(n)/2 FROM t) ORDER BY n", "SELECT n -- 1/2 / 'x' GLOB\n / 2 /* n / v */ AS x FROM t ORDER BY n",
    "WITH a AS (SELECT n/2 AS h FROM t) SELECT h/2 FROM a WHERE h IS NOT NULL ORDER BY h", "SELECT sum(n) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) / 2 FROM t WHERE n IS NOT NULL ORDER BY n", "SELECT '1/2', \"n\" / 2 FROM t WHERE s <> 'GLOB' ORDER BY n",
]


def test_the_dialect_as_an_embedded_engine_answers(spark):
    import sqlite3

    rows = [(1, "a", 2.5, "12abc", "%Y/%m", "2024-01-31", "a*"), (7, "B", None, " 3.9x", "%d.%%", "2024-02-01", "[B]"), (-7, "b", -1.5, "x", "%H", "bad", "?"), (None, None, 0.0, "-9999999999999999999999", None, None, None)]
    tables = Tables(spark, {"t": spark.createDataFrame(rows, "n bigint, s string, v double, c string, f string, d string, g string")})
    with sqlite3.connect(":memory:") as db:
        db.execute("CREATE TABLE t (n INTEGER, s TEXT, v REAL, c TEXT, f TEXT, d TEXT, g TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
        for sql in DIALECT:
            want = [[tables_module.json_safe(x) for x in r] for r in db.execute(sql)]
            got = [[int(x) if isinstance(x, bool) else x for x in r] for r in tables.query(sql, seconds=60).rows]
            assert got == want, sql
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"  # the given session keeps its settings


def test_table_functions(spark):
    rows = [(1, '[1, "x", null]', "para one.\n\n" * 200), (2, '{"a": 5, "b": [1]}', None), (3, None, " "), (4, "bad", "short"), (5, "[]", "")]
    df = spark.createDataFrame(rows, "id int, j string, x string")
    tables = Tables(spark, {"t": df}, table_functions=True)
    got = tables.query("SELECT t.id, e.key, e.value FROM t, LATERAL json_each(t.j) e ORDER BY 1, 2", seconds=60).rows
    assert got == [[1, "0", "1"], [1, "1", "x"], [1, "2", None], [2, "a", "5"], [2, "b", "[1]"]]
    plan = tables.frame("SELECT t.id, e.key FROM t, LATERAL json_each(t.j) e")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "Python" not in plan
    cut = tables.query("SELECT t.id, s.ordinal, s.text FROM t, LATERAL split_text(t.x) s ORDER BY 1, 2", seconds=60).rows
    assert [r[2] for r in cut if r[0] == 1] == chunking.split_text(rows[0][2]) and [r for r in cut if r[0] != 1] == [[4, 0, "short"]]
    with pytest.raises(guard.NotAllowed):
        Tables(spark, {"t": df}).query("SELECT e.key FROM t, LATERAL json_each(t.j) e")
