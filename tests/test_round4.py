"""Findings of round 4."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import search
from leafmill.plans.index import Index
from leafmill.sources import files as source


def test_section_hints_lose_no_digits(spark):
    """A line's number was taken as the characters to trim: line 1 lost the digit 1 at its ends, and no line its spaces."""
    df = spark.createDataFrame([("0 first 0\n123 second 11\n   \n  third  ",)], "t string")
    assert df.select(tx.section_hints(F.col("t"))).first()[0] == ["0 first 0", "123 second 11", "third"]


def test_a_chunk_keeps_its_text_score_however_many_match_better(spark):
    """Of two chunks whose path counts alike, the one whose text matches too is first, also behind 300 better texts."""
    texts = {f"x/{i}.txt": "apple apple pear" for i in range(300)} | {f"y/{i}.txt": "plum" for i in range(400)}
    texts |= {"beta/b.txt": "apple " + "filler " * 40, "beta/a.txt": "filler " * 41}
    c = spark.createDataFrame([(p, p, t, False) for p, t in texts.items()], "chunk_id string, relative_path string, text string, has_visual boolean")
    stats = search.statistics(search.lengths(c))
    every = {r.chunk_id: r.score for r in search.ranked(c, search.postings(c), stats, "apple beta", None).collect()}
    best = search.hybrid(c, search.postings(c), stats, "apple beta", 8).collect()
    want = sorted(every.items(), key=lambda x: (-x[1], x[0]))[:8]
    assert [(r.chunk_id, pytest.approx(r.score)) for r in best] == want
    assert every["beta/b.txt"] > 0.75 and [p for p, _ in want if p.startswith("beta")][:1] == ["beta/b.txt"]


def test_files_are_listed_and_extracted_by_several_tasks(spark, tmp_path):
    """The short list of files went to one task, which opened them all."""
    for i in range(60):
        folder = tmp_path / f"a{i % 3}" / "b c%20"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"ü{i}.txt").write_text(f"text {i}")
    for hidden in (".x.txt", "_x.txt", "_dir/y.txt", "a0/.git/y.txt"):
        (tmp_path / hidden).parent.mkdir(exist_ok=True)
        (tmp_path / hidden).write_text("hidden")
    found = source.discover(spark, str(tmp_path))
    rows = {r.relative_path: r for r in found.collect()}
    assert sorted(rows) == sorted(f"a{i % 3}/b c%20/ü{i}.txt" for i in range(60))
    spark_lists = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("length", F.col("modificationTime").cast("double"))
    assert sorted(map(tuple, spark_lists.collect())) == sorted((r["size"], r["mtime"]) for r in rows.values())
    assert {r.relative_path for r in source.discover(spark, f"file://{tmp_path}/").collect()} == set(rows)
    done = source.extracted(spark, found).select("status", "text", F.spark_partition_id().alias("task")).collect()
    assert {r.text for r in done} == {f"text {i}" for i in range(60)} and len({r.task for r in done}) > 1


def test_terms_of_a_build_are_those_of_the_columns(spark):
    texts = ["".join(chr(c) for c in range(a, a + 64)) + " İstanbul ΑΣ Å-ñ_x ½ a\u0301b" for a in range(0x20, 0x530, 64)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.index_terms(F.col("t")).alias("terms")).collect()
    assert all(r.terms == tx.terms_of(r.t) for r in got)


def test_postings_of_a_build_count_every_term_of_every_chunk(spark, tmp_path):
    """Blocks of postings give the rows that grouping all terms gives, chunks without a term and files whose content is the old one too."""
    root = tmp_path / "root"
    root.mkdir()
    for i in range(30):
        (root / f"f{i}.txt").write_text("... !!! ---" if i % 10 == 0 else f"w{i % 4} É w{i % 7} und_w{i} " * (1 + i * 9))
    index = Index(spark, str(root), str(tmp_path / "index"))
    index.build()
    (root / "f1.txt").write_text((root / "f1.txt").read_text())
    (root / "f2.txt").write_text("changed w1")
    assert index.build()["updated"] == 1
    chunks = index.read("chunks")
    want = search.postings(chunks).join(chunks.select("chunk_id", "relative_path"), "chunk_id").select("term", "chunk_id", "relative_path", "tf", "dl")
    got = index.read("postings")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
