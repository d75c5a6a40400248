"""Distributed union-find, and components over candidate buckets without a row for every pair of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, written

#: Buckets up to this size are compared pair by pair; larger ones through pivots first.
SMALL = 6
#: Rounds of pivots before what is still apart in a large bucket is compared block by block.
ROUNDS = 2
#: Ids in a block, about, and the sum of their sets' sizes (4 MB of hashes), whichever is reached first.
BLOCK, WEIGHT = 1024, 1 << 19
#: Edges that one task of the union-find holds at most (16 MB).
EDGES = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (its smallest id) of every id in ``edges`` (a, b) that is not its component's smallest.

    Distributed union-find in rounds. First, tasks of at most EDGES edges, dealt evenly and not by key, each
    reduce their edges to stars around the smallest id. One task has then seen everything, and is done, or a
    large and a small star step (Kiveris et al., 2014) joins the tasks' stars, by sums and joins on ids in which AQE
    splits a hub's edges, and the next round follows, until a round changes nothing.
    """
    now = written(edges.where("a <> b").select("a", "b"), "edges")
    state = None
    while True:
        count = now.count()
        parts = -(-count // EDGES)
        stars = written(now.repartition(max(1, parts)).mapInArrow(_stars, "a long, b long"), "stars")
        if parts <= 1:
            return stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        near = large.join(least, large["a"] == least["u"])
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).distinct()
        now = written(small, "edges")
        before, state = state, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a task -> an edge from each id to the smallest one that the task's edges connect it with."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    if a:
        ends = np.concatenate([*a, *b])
        a = b = batch = None
        order = np.argsort(ends, kind="stable")
        ends = ends[order]
        first = np.ones(len(ends), bool)
        np.not_equal(ends[1:], ends[:-1], out=first[1:])
        ids, at = ends[first], np.empty(len(ends), np.int32)
        del ends
        at[order] = np.cumsum(first, dtype=np.int32) - 1
        del order, first
        i, j = np.split(at, 2)
        label = np.arange(len(ids), dtype=np.int32)
        while True:
            before = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            label = label[label]
            if (label == before).all():
                break
        moved = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[label[moved]], pa.int64())], names=["a", "b"])


def named_classes(known: DataFrame, classes: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    """``key, component_id`` of the classes (key, id, first, copies) that have other rows in their component.

    ``known`` has a row's id and key. Rows with one id and several keys join these keys' classes. A component is named by the
    smallest id of its rows (``first`` is a class's).
    """
    repeated = written(known.groupBy(id_column).agg(F.count("*").alias("n")).where("n > 1").select(id_column), "repeated")
    several = known.select(id_column, "key").join(repeated, id_column, "left_semi").distinct().join(classes.select("key", "id"), "key")
    least = several.groupBy(id_column).agg(F.min("id").alias("least"))
    bridges = several.join(least, id_column).where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(bridges))
    named = classes.select("key", "id", "first", "copies").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("sets"))
    return named.join(smallest, "component").where("copies > 1 or sets > 1").select("key", "component_id")


def crowded(members: DataFrame) -> DataFrame:
    """Rows (bucket, id, ...) of the buckets with two ids or more, with ``crowd``, their number of rows.

    Buckets are counted with partial sums, and the counts of crowded ones are written, so that Spark knows their size:
    small ones are broadcast and no row moves; beyond that AQE splits a hot bucket's rows in the join.
    """
    count = written(members.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1"), "crowds")
    return members.join(count, "bucket")


def linked(members: DataFrame, sets: DataFrame, percent: int, may_link: Callable, verify: Callable[[DataFrame], DataFrame], as_arrays: Callable[[pa.Array], list[np.ndarray]]) -> DataFrame:
    """Components over the pairs that share a bucket and whose sets overlap enough: ``id, component`` as above.

    ``members`` has bucket, id, size, crowd; ids are distinct within a bucket. ``sets`` has id and set.
    ``may_link(size_a, size_b)`` is a condition that every link meets; ``verify`` gets pairs (a, b), each once,
    and returns the linked ones; ``as_arrays`` turns the column ``set`` into arrays of whole numbers.

    Which pairs are compared does not matter to the result as long as every pair of a bucket that is left out
    lies within one component. Buckets up to SMALL are compared pair by pair. A larger one is compared with
    one pivot a round, skipping what is already joined to it: m copies of one text cost about m pairs. What is
    then still apart in a bucket is compared block by block (see ``compare_blocks``), without a row for a pair.
    """
    members = written(members.select("bucket", "id", "size", "crowd"), "members")

    def compared(a: DataFrame, b: DataFrame, more) -> DataFrame:
        """Linked ones among the pairs that a and b (bucket, id, size, ...) form in their buckets."""
        on = (F.col("x.bucket") == F.col("y.bucket")) & may_link(F.col("x.size"), F.col("y.size")) & more
        pairs = a.alias("x").join(b.alias("y"), on)
        return verify(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())

    large = members.where(F.col("crowd") > SMALL)
    few = members.where(F.col("crowd") <= SMALL)
    links = written(compared(few, few, F.col("x.id") < F.col("y.id")), "links")
    labels = components(links)
    for turn in range(ROUNDS + 1):
        named = large.join(labels.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        pivot = F.min_by(F.struct("id", "size", "label"), F.xxhash64("id", F.lit(turn)))
        apart = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("id").alias("first"), pivot.alias("pivot")).where("low < high")
        left = written(named.select("bucket", "id", "size", "label").join(apart.select("bucket", "first", "pivot"), "bucket"), "apart")
        if left.isEmpty():
            return labels
        if turn < ROUNDS:
            pivots = left.select("bucket", F.col("pivot.id").alias("id"), F.col("pivot.size").alias("size"), F.col("pivot.label").alias("label")).distinct()
            found = compared(pivots, left, F.col("x.label") != F.col("y.label"))
        else:
            found = compare_blocks(left, sets, percent, as_arrays)
        links = links.union(written(found, "links"))
        labels = components(links)
    return labels


def block_pairs(members: DataFrame, most: int, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Deal each part's ids into blocks: ``part, id, owner, block``, and the pairs of blocks to compare: ``lo, hi``.

    ``members`` has part, id, owner and weight; ids of one owner need no comparison with each other. An owner with
    half a block or more gets blocks of its own, which never meet; the others of a part share blocks, which also
    meet themselves. Blocks hold about ``most`` ids or a weight of ``heavy``. What is joined by part has one row
    for an owner or a block, never for an id, so a part with a third of all ids is no task's own.
    """
    sums = written(members.groupBy("part", "owner").agg(F.count("*").alias("n"), F.sum("weight").alias("w")), "owners")
    blocks = lambda n, w: F.ceil(F.greatest(F.col(n) / most, F.col(w) / heavy)).cast("int")
    own = (F.col("n") * 2 >= most) | (F.col("w") * 2 >= heavy)
    rest = written(sums.where(~own).groupBy("part").agg(F.sum("n").alias("rest_n"), F.sum("w").alias("rest_w")), "rest")
    plan = sums.join(rest, "part", "left").select("part", "owner", F.when(own, F.col("owner")).alias("of"), F.greatest(F.lit(1), F.when(own, blocks("n", "w")).otherwise(blocks("rest_n", "rest_w"))).alias("blocks"))
    plan = written(plan, "plan")
    name = lambda k: F.concat_ws(":", F.col("part").cast("string"), F.coalesce(F.col("of").cast("string"), F.lit("rest")), k.cast("string")).alias("block")
    dealt = members.join(plan, ["part", "owner"]).select("part", "id", "owner", name(F.pmod(F.xxhash64("id"), F.col("blocks"))))
    each = plan.select("part", "of", "blocks").distinct().select("part", "of", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select("part", "of", name(F.col("k")))
    each = written(each, "blocks")
    x, y = each.alias("x"), each.alias("y")
    apart = F.col("x.of").isNull() | F.col("y.of").isNull() | (F.col("x.of") != F.col("y.of"))
    pairs = x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.block") <= F.col("y.block")) & apart)
    return dealt, written(pairs.select(F.col("x.block").alias("lo"), F.col("y.block").alias("hi")), "pairs")


def met_blocks(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """``same, x, y, lo`` of each pair of blocks: whether it is one block, the rows of both (``packed``: block, rows), the first's name.

    A block is one row, packed once and written; a pair of blocks moves two rows.
    """
    packed = written(packed, "packed")
    x, y = (packed.select(F.col("block").alias(on), F.col("rows").alias(name)) for on, name in (("lo", "x"), ("hi", "y")))
    return rows(pairs.join(x, "lo").join(y, "hi"), (F.col("lo") == F.col("hi")).alias("same"), "x", "y", "lo")


def compare_blocks(left: DataFrame, sets: DataFrame, percent: int, as_arrays: Callable[[pa.Array], list[np.ndarray]]) -> DataFrame:
    """Links (a, b) between ids of different labels, from buckets (bucket, first, id, size, label).

    Buckets that share ids form a family, in which every id is compared with all of other labels, once,
    however many buckets they share. A task holds two blocks of a family and counts all intersections by matrix
    products; it returns at most one link for each id.
    """
    family = components(left.select(F.col("id").alias("a"), F.col("first").alias("b")).distinct())
    ids = left.select("id", F.col("label").alias("owner"), F.col("size").alias("weight")).distinct().join(family, "id", "left")
    ids = written(ids.select(F.coalesce("component", "id").alias("part"), "id", "owner", "weight"), "families")
    dealt, pairs = block_pairs(ids, BLOCK, WEIGHT)
    packed = dealt.join(sets.select("id", "set"), "id").groupBy("block").agg(F.collect_list(F.struct("id", "owner", "set")).alias("rows"))  # a block's, about BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, same in enumerate(batch.column(0).to_pylist()):
                sides = [batch.column(c).slice(k, 1).flatten() for c in ((1,) if same else (1, 2))]
                ids, label = (np.concatenate([s.field(f).to_numpy(zero_copy_only=False) for s in sides]) for f in ("id", "owner"))
                a = np.arange(len(sides[0]))
                b = a if same else np.arange(len(a), len(ids))
                i, j = overlapping([x for s in sides for x in as_arrays(s.field("set"))], a, b, percent)
                new = (label[i] != label[j]) & (i != j)
                if new.any():
                    low, touched = local_components(ids, i[new], j[new])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[touched], pa.int64()), pa.array(low[touched], pa.int64())], names=["a", "b"])

    return met_blocks(pairs, packed).mapInArrow(run, "a long, b long").where("a <> b")


def arrays_of(lists: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow array of lists of whole numbers, as arrays."""
    at = lists.offsets.to_numpy()
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), (at - at[0])[1:-1]) if len(lists) else []


def overlapping(arrays: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of a, one of b) with 100 * intersection >= percent * union, by matrix products over the numbers that occur twice."""
    size = np.array([len(x) for x in arrays], np.int64)
    values = np.concatenate(arrays)
    order = np.argsort(values, kind="stable")
    values, row = values[order], np.repeat(np.arange(len(arrays), dtype=np.int32), size)[order]
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    del values, order
    number = np.cumsum(first, dtype=np.int32) - 1
    count = np.bincount(number)
    shared = count[number] > 1
    row, column = row[shared], (np.cumsum(count > 1, dtype=np.int32) - 1)[number[shared]]
    del first, number, shared
    both = np.zeros((len(a), len(b)), np.int64)
    place_a, place_b = np.full(len(arrays), -1), np.full(len(arrays), -1)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    width = 2048  # two matrices of 8 MB for full blocks
    for at in range(0, int((count > 1).sum()), width):
        s, e = np.searchsorted(column, [at, at + width])
        r, c = row[s:e], column[s:e] - at
        m, n = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        of_a, of_b = place_a[r] >= 0, place_b[r] >= 0
        m[place_a[r[of_a]], c[of_a]] = 1
        n[place_b[r[of_b]], c[of_b]] = 1
        both += np.rint(m @ n.T).astype(np.int64)
    i, j = np.nonzero(both * 100 >= (size[a][:, None] + size[b][None, :] - both) * percent)
    return a[i], b[j]


def local_components(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row is connected with by the links (i, j), and the rows that have a link."""
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[order] = np.arange(len(ids))
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        if (before == label).all():
            return ids[order[label]], np.unique(np.r_[i, j])
