"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles of five words (hashes of 64 bits). Under each of the
permutations both the minimum and the maximum are kept, two unbiased and nearly independent values for one
evaluation. Bands of the values give buckets; documents with equal sets are one class, represented once.
Pairs that meet in a bucket are confirmed on their full sets, and links are closed by union-find.

With 75 permutations (150 values) in 30 bands of 5, a pair at the threshold of 0.75 meets with a probability of
1 - (1 - 0.75^5)^30 = 99.97 %, one at 0.85 practically always.

Defined results: null or blank text has the empty set and is linked with nothing; a null id is linked with
nothing and kept. Rows with one id belong together: where an id carries several texts, each text's set is
compared, and the id joins their components. Repeated rows are copies. An empty table gives no rows. Only doc_id and
text are read, so further columns may have any name. Text of any length is taken whole; its permutations are evaluated in
parts of a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, passing, pieces, rows, written
from .fingerprints import _powers
from .graph import arrays_of, crowded, linked, named_classes

WIDTH, PERCENT = 5, 75
PERMUTATIONS, BAND = 75, 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_ODD = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACE = mix64(np.arange(101, 101 + BAND, dtype=np.uint64)) | np.uint64(1)
_SHIFT = mix64(np.arange(201, 201 + WIDTH, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, by array operations over its bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    solid = ~_SPACE[raw]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    up, down = _powers(len(at))
    words = mix64(np.add.reduceat(_LOWER[raw[at]] * up, starts) * down[starts] + np.diff(np.r_[starts, len(at)]).astype(np.uint64))
    n = min(WIDTH, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * _SHIFT[k]
    return np.unique(mix64(out))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each band, from the minimum and maximum under each permutation."""
    values = np.empty((PERMUTATIONS, 2), np.uint64)
    for start in range(0, PERMUTATIONS, 25):  # blocks keep the table small for very long texts
        for part in range(0, len(hashes), 1 << 14):
            y = hashes[None, part : part + (1 << 14)] * _ODD[start : start + 25, None]
            y ^= y >> np.uint64(32)
            low, high = y.min(1), y.max(1)
            v = values[start : start + 25]
            v[:, 0], v[:, 1] = (low, high) if not part else (np.minimum(v[:, 0], low), np.maximum(v[:, 1], high))
    table = values.reshape(-1, BAND)
    return mix64((mix64(table) * _PLACE).sum(1, dtype=np.uint64) + np.arange(len(table), dtype=np.uint64)).view(np.int64)


def _key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n, key, bands`` of every row; key (16 bytes) is equal for equal sets, null for the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            n, keys, buckets = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingles(text or "")
                n.append(len(hashes))
                keys.append(_key(hashes) if len(hashes) else None)
                buckets.append(bands(hashes) if len(hashes) else np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, buckets)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(buckets), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], names=["doc_id", "n", "key", "bands"])

    return rows(docs, "doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n long, key binary, bands array<long>").fields]))


def full_sets(docs: DataFrame) -> DataFrame:
    """``key, set`` (array of long) of every row that has a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            sets = [x for t in batch.column(0).to_pylist() if len(x := shingles(t or ""))]
            offsets = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *[x.view(np.int64) for x in sets]]), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in sets], pa.binary()), lists], names=["key", "set"])

    return rows(docs, "text").mapInArrow(run, "key binary, set array<long>")


def may_link(a: Column, b: Column) -> Column:
    """Sets whose sizes lie further apart cannot reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= PERCENT * union; stays in the JVM."""
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("of_a"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(a, "a").join(b, "b").where(both * 100 >= (F.size("of_a") + F.size("of_b") - both) * PERCENT).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    A class is a set of shingles, with a number of its own; its ids are joined to it by the set's key.
    """
    signed = written(signatures(docs), "signatures")
    known = signed.where("key is not null and doc_id is not null")
    classes = known.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("size"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written, so that the numbers stay
    members = written(crowded(classes.select("id", "size", F.explode("bands").alias("bucket"))), "members")
    # texts of one document of each class that has met another one; what else has its id is told apart by the key
    wanted = written(classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "key", F.col("first").alias("doc_id")), "wanted")
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = full_sets(texts).join(wanted.select("id", "key"), "key").groupBy("id").agg(F.first("set").alias("set"))
    sets = written(sets, "sets")
    labels = linked(members, sets, PERCENT, may_link, lambda pairs: confirm(pairs, sets), arrays_of)
    named = named_classes(known, classes, labels, "doc_id")
    component = F.coalesce("component_id", "doc_id")
    with_id = F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")
    return signed.select("doc_id", "n", with_id).join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component; of rows with one id all or none."""
    with passing(docs.sparkSession) as keep:
        gone = keep(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
