"""What passes by the shared folder, what workers hold, and what line dedup leaves to the stage after it."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.llm import graph, line_dedup, minmax_dedup
from leafmill.llm.common import passing, scratch, written


def tables(spark):
    folder = scratch(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def corpus(spark, n=30):
    rows = [(k, f"first line of {k} with words of its own {k * 7}\nand a line that all have\nthe tail {k * 13} of it") for k in range(n)]
    return spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_only_results_stay_in_the_shared_folder(spark):
    docs = written(corpus(spark), "docs")
    for call, label in ((lambda: line_dedup.dedup_lines(docs), "drops"), (lambda: line_dedup.dedup_lines(docs, 7, emptied=False), "drops"), (lambda: minmax_dedup.kept_documents(docs), "gone")):
        before = tables(spark)
        out = call()
        assert [name.split("-")[0] for name in tables(spark) - before] == [label]
        assert out.count() == 30  # nothing that is read later has gone


def test_passing_within_passing(spark):
    with passing(spark) as keep:
        first = written(spark.range(3), "first")
        with passing(spark) as inner:
            written(spark.range(2), "inner")
            second = inner(first, "second")
        assert second.count() == 3 and "inner" not in {t.split("-")[0] for t in tables(spark)}
        last = keep(second, "last")
    left = {t.split("-")[0] for t in tables(spark)}
    assert last.count() == 3 and "last" in left and not {"first", "second"} & left


def test_a_write_leaves_no_shuffle_files(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.name().toString() for f in ()} | {str(store.getAllFiles().apply(i).getName()) for i in range(store.getAllFiles().size())}
    before = files()
    written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    assert not {f for f in files() - before if f.startswith("shuffle_")}


def peak(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_full_blocks_and_tasks():
    rng = np.random.default_rng(0)
    base = [rng.integers(0, 1 << 60, 470) for _ in range(16)]
    arrays = [np.unique(np.r_[base[k % 16], rng.integers(0, 1 << 60, 20)]) for k in range(2048)]
    a, b = np.arange(1024), np.arange(1024, 2048)
    found = []
    assert peak(lambda: found.append(graph.overlapping(arrays, a, b, 80))) < 75
    i, j = found[0]
    assert len(i) == 1024 * 64 and (i % 16 == j % 16).all()
    x = rng.integers(0, 1 << 40, graph.EDGES)
    batch = pa.RecordBatch.from_arrays([pa.array(x), pa.array(x - rng.integers(1, 1000, len(x)))], names=["a", "b"])
    assert peak(lambda: list(graph._stars(iter([batch])))) < 100


def test_every_repeat_goes_but_those_of_copies(spark):
    """A line that occurs twice goes from a document of its own; a copy keeps its lines for the stage that compares documents."""
    own = lambda k, n=8: "\n".join(f"{'abcdefgh'[j] * 3} sentence {j} of text {k} about matter {k * 91 + j * 17} and nothing else {j * k}" for j in range(n))
    shared = "a sentence that stands in two texts which have little else in common"
    rows = [(1, own(1) + "\n" + shared), (2, own(2) + "\n" + shared), (3, own(3)), (4, own(3)), (5, own(5) + "\ntwice here, and nowhere else in the corpus\ntwice here, and nowhere else in the corpus")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs, 7, emptied=False).collect()}
    assert shared in out[1].text and out[2].text == own(2) and out[2].n_chars == len(own(2))
    assert out[3].text == out[4].text == own(3) and out[4].n_chars == len(own(3))
    assert out[5].text == own(5) + "\ntwice here, and nowhere else in the corpus"
