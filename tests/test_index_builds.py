"""Builders that run at once, statistics kept over many syncs, and what a search reads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import search
from leafmill.plans.index import Index
from leafmill.sources import files as source_module


def recounted(index):
    """Chunks and terms of everything that is visible, from the texts."""
    lengths = search.lengths(index.read("chunks"))
    row = lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return {"chunks": row[0], "terms": row[1]}


def write(root, **texts):
    root.mkdir(exist_ok=True)
    for name, text in texts.items():
        (root / f"{name}.txt").write_text(text)


def beside(monkeypatch, builder, meanwhile):
    """Run ``builder.build`` and, while it extracts, ``meanwhile``; whatever it returns or raises comes back."""
    once = source_module.extracted

    def then(*args):
        monkeypatch.setattr(source_module, "extracted", once)
        out = once(*args)
        meanwhile()
        return out

    monkeypatch.setattr(source_module, "extracted", then)
    try:
        return builder.build()
    finally:
        monkeypatch.setattr(source_module, "extracted", once)


def test_statistics_after_random_syncs(spark, tmp_path):
    """After each sync the totals of the manifest are those of a full recount, and scores are those over all texts."""
    rng, root = random.Random(4), tmp_path / "root"
    words = [f"w{i}" for i in range(12)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(1, 30)))
    write(root, **{f"f{i}": text() for i in range(8)})
    index = Index(spark, str(root), str(tmp_path / "index"))
    index.build()
    for _ in range(10):
        for _ in range(rng.randint(1, 3)):
            path = root / f"f{rng.randrange(10)}.txt"
            if path.exists() and rng.random() < 0.3:
                path.unlink()
            else:
                path.write_text(text())
        index.build()
        totals = index.manifest()["totals"]
        assert totals == recounted(index)
    chunks = index.read("chunks")
    for query in ("w1 w5", "w3 f2", "nothing"):
        plain = search.hybrid(chunks, search.postings(chunks), search.statistics(search.lengths(chunks)), query)
        assert [(r.chunk_id, pytest.approx(r.score), r.text) for r in plain.collect()] == [(r.chunk_id, r.score, r.text) for r in index.search(query).collect()]


def test_a_search_reads_texts_of_winners_only(spark, tmp_path):
    root = tmp_path / "root"
    write(root, a="alpha beta", b="beta gamma", c="gamma chart")
    index = Index(spark, str(root), str(tmp_path / "index"))
    index.build()
    m = index.manifest()
    ranking = search.ranked(index.read("chunks", m), index.read("postings", m), index.statistics(m), "beta chart a", 2, None, index.read("files", m))
    plan = ranking._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.split("\n") if "Relation" in line]
    physical = ranking._jdf.queryExecution().executedPlan().toString()
    assert scans and "text:string" not in physical.split("ReadSchema", 1)[1] and "dl" in plan
    found = index.search("beta", 1)
    assert "In(chunk_id" in found._jdf.queryExecution().executedPlan().toString() or "EqualTo(chunk_id" in found._jdf.queryExecution().executedPlan().toString()
    assert index.search("beta", None).count() == 2 and index.search("beta", 5000).count() == 2 and index.search("beta", 1, ["b.txt"]).first().relative_path == "b.txt"


@pytest.mark.parametrize("first_commits", [True, False])
def test_two_builders_of_one_index(spark, tmp_path, monkeypatch, first_commits):
    """Of two builders that start from one manifest both become visible, whichever ends first, where they settle each file alike."""
    root = tmp_path / "root"
    write(root, a="alpha", b="beta")
    folder = str(tmp_path / "index")
    one, two = (Index(spark, str(root), folder) for _ in range(2))
    one.build()
    write(root, a="alpha changed")

    def meanwhile():
        if first_commits:
            write(root, c="gamma")  # the other builder finds one more file
        two.build()

    stats = beside(monkeypatch, one, meanwhile)
    assert stats["updated"] == 1 and one.manifest()["number"] == 3
    assert one.manifest()["totals"] == recounted(one)
    assert one.search("changed").count() == 1 and one.search("gamma").count() == int(first_commits) and one.read("chunks").count() == 2 + int(first_commits)


def test_a_builder_that_saw_other_contents_is_refused(spark, tmp_path, monkeypatch):
    """The index stays as the builder that came first left it, and nothing of the other one is left."""
    root = tmp_path / "root"
    write(root, a="alpha", b="beta")
    folder = tmp_path / "index"
    one, two = (Index(spark, str(root), str(folder)) for _ in range(2))
    one.build()
    write(root, a="seen by the first")
    once = source_module.extracted

    def then(*args):
        monkeypatch.setattr(source_module, "extracted", once)
        out = once(*args)
        out = spark.createDataFrame(out.collect(), out.schema)  # what it has read is fixed
        write(root, a="seen by the second one")
        two.build()
        return out

    monkeypatch.setattr(source_module, "extracted", then)
    with pytest.raises(OSError, match="settled files of this one otherwise"):
        one.build()
    monkeypatch.setattr(source_module, "extracted", once)
    after = one.manifest()
    assert after["number"] == 2 and one.search("second").count() == 1 and one.search("first").count() == 0
    assert {p.name for p in folder.iterdir()} == {"manifests", *(s["name"] for s in after["segments"])}
    assert one.build()["unchanged"] == 2 and one.manifest() == after


def test_a_manifest_is_put_once(spark, tmp_path):
    index = Index(spark, str(tmp_path), str(tmp_path / "index"))
    assert index._put({"number": 1, "who": "a"}) and not index._put({"number": 1, "who": "b"})
    assert json.loads((tmp_path / "index/manifests/1.json").read_text())["who"] == "a" and len(list((tmp_path / "index/manifests").glob("*.json"))) == 1
