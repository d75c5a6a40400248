"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are normalised; a table's bucket is the tuple of ``floor((a.v + b) / WIDTH)`` over its random
projections. Vectors that share a bucket in any table are compared by their exact cosine in double precision.

Equal vectors are one class with a count, so a group of copies costs one comparison. A bucket of more than SMALL
classes first gets a pivot, its class of the smallest hash, so that the buckets of one family mostly get the same few.
Every class is compared with the pivots of its buckets, and those within half the threshold's angle of a pivot
(cosine CORE) are its *core*: any two of a core are linked, which needs no comparison, only a count. What is
left are pairs of different cores: in small buckets as pairs, each once; in large ones in blocks by matrix products.
A block is packed into one row, and a pair that meets in several buckets counts in the first of them. So a tight family
of any size moves each vector a few times, and no pair within it is ever a row.

At the threshold (cosine 0.95, distance 0.316) one projection agrees with a probability of 0.874, so 28 tables
of 16 find a pair with 97 %, closer pairs with more. Unrelated vectors share a bucket with 10^-5.

Defined results: vectors that are null, empty, zero, or that hold null or non-finite components link with nothing: no
links, their own component, kept. So do rows with a null id. Vectors of different lengths are never linked. Repeated rows
are copies. Rows with one id and different vectors have their own links and join each other's components. An empty table
gives no rows. Only vec_id and embedding are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, rows, written
from .graph import block_pairs, components, crowded, local_components, met_blocks, named_classes

COSINE, TABLES, PROJECTIONS, WIDTH, SEED = 0.95, 28, 16, 2.0, 7
#: Just above the cosine of half the threshold's angle: two vectors that near to a third have a cosine of 0.9501 or more.
CORE = 0.98745
#: Buckets up to this size are compared pair by pair; vectors in a block.
SMALL, BLOCK = 8, 2048


def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng((SEED, dim))
    return r.normal(size=(dim, TABLES * PROJECTIONS)), r.uniform(0, WIDTH, TABLES * PROJECTIONS)


def hashed(vectors: DataFrame) -> DataFrame:
    """``vec_id, key, vector, buckets``: normalised vector (binary doubles) and its bucket in each table; nulls for unusable ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        place = mix64(np.arange(1, PROJECTIONS + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            rows: list[tuple] = []
            by_dim: dict[int, list[tuple[int, np.ndarray, bytes]]] = {}
            for i, v in enumerate(batch.column(1).to_pylist()):
                rows.append((None, None, None))
                if not v or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if not np.isfinite(top) or top == 0 or np.isnan(x).any():
                    continue
                x = x / top
                by_dim.setdefault(len(x), []).append((i, x / np.sqrt(x @ x), np.array(v, np.float64).tobytes()))
            for dim, items in by_dim.items():
                if dim not in made:
                    made[dim] = projections(dim)
                units = np.array([u for _, u, _ in items])
                cells = np.floor((units @ made[dim][0] + made[dim][1]) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(items), TABLES, PROJECTIONS)
                keys = mix64((mix64(cells) * place).sum(2, dtype=np.uint64) + np.arange(TABLES, dtype=np.uint64) + np.uint64(1000 * dim)).view(np.int64)
                for (i, u, raw), k in zip(items, keys):
                    rows[i] = (hashlib.blake2b(raw, digest_size=16).digest(), u.tobytes(), k.tolist())
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.list_(pa.int64()))], names=["vec_id", "key", "vector", "buckets"])

    schema = T.StructType([vectors.schema["vec_id"], *T._parse_datatype_string("key binary, vector binary, buckets array<long>").fields])
    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def _vectors(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, va, vb) -> (a, b, cosine). The vectors of a pair are equally long, pairs may differ."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
        for n in np.unique(size):
            part = batch.filter(pa.array(size == n))
            cosine = np.einsum("ij,ij->i", _vectors(part.column(2)), _vectors(part.column(3)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cosine)], names=["a", "b", "cosine"])


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``a, b, cosine`` of pairs of ids of ``vectors`` (id, vector)."""
    a, b = (vectors.select(F.col("id").alias(c), F.col("vector").alias(f"v{c}")) for c in "ab")
    return rows(pairs.join(a, "a").join(b, "b"), "a", "b", "va", "vb").mapInArrow(_cosines, "a long, b long, cosine double")


def cores(large: DataFrame, vectors: DataFrame) -> DataFrame:
    """``id, owner``: the nearest pivot among those of its buckets (bucket, id), of the ids that lie in a core."""
    pivots = written(large.groupBy("bucket").agg(F.min_by("id", F.xxhash64("id")).alias("b")), "pivots")
    near = cosines(large.join(pivots, "bucket").select(F.col("id").alias("a"), "b").distinct(), vectors).where(F.col("cosine") >= CORE)
    return near.groupBy(F.col("a").alias("id")).agg(F.max_by("b", F.struct("cosine", -F.col("b"))).alias("owner"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks -> id, links (with copies) and the smallest id that it is connected with here."""
    for batch in batches:
        for k, (same, name) in enumerate(zip(batch.column("same").to_pylist(), batch.column("lo").to_pylist())):
            sides = [batch.column(c).slice(k, 1).flatten() for c in (("x",) if same else ("x", "y"))]
            ids, owner, copies = (np.concatenate([s.field(f).to_numpy(zero_copy_only=False) for s in sides]) for f in ("id", "owner", "copies"))
            units, n = np.concatenate([_vectors(s.field("vector")) for s in sides]), len(sides[0])
            # a class's bucket in each table where it is one of those compared by blocks; 0 where not
            spread = np.concatenate([s.field("spread").flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(len(s), -1) for s in sides])
            bucket = int(name.split(":")[0])
            i, j = np.nonzero(units[:n] @ units[0 if same else n :].T >= COSINE)
            j = j + (0 if same else n)
            keep = (owner[i] != owner[j]) & ((i < j) | (not same))
            i, j = i[keep], j[keep]
            first = np.ones(len(i), bool)
            for at in range(0, len(i), 1 << 15):  # the first bucket that a pair shares is the one where it counts
                x, y = spread[i[at : at + (1 << 15)]], spread[j[at : at + (1 << 15)]]
                shared = (x == y) & (x != 0)
                first[at : at + (1 << 15)] = x[np.arange(len(x)), shared.argmax(1)] == bucket
            i, j = i[first], j[first]
            if len(i):
                links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                low, touched = local_components(ids, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(ids[touched]), pa.array(links[touched].astype(np.int64)), pa.array(low[touched])], names=["id", "links", "low"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    signed = written(hashed(vectors), "vectors")
    known = signed.where("key is not null and vec_id is not null")
    classes = known.groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("buckets").alias("buckets"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written, so that the numbers stay
    met = written(crowded(classes.select("id", F.explode("buckets").alias("bucket"))), "met")
    large = met.where(F.col("crowd") > SMALL)
    core = written(cores(large, classes), "cores")
    owned = met.join(core, "id", "left").select("bucket", "id", "crowd", F.coalesce("owner", "id").alias("owner"))
    owned = written(owned, "owned")
    # large buckets that hold more than one core, and in which tables a class is in such
    mixed = owned.where(F.col("crowd") > SMALL).groupBy("bucket").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low < high").select("bucket")
    spread = written(owned.join(written(mixed, "mixed"), "bucket").select("bucket", "id", "owner"), "spread")
    of_id = spread.groupBy("id").agg(F.collect_set("bucket").alias("these"))  # at most one a table
    placed = classes.join(of_id, "id", "left").join(core, "id", "left")
    placed = written(placed.select("id", "copies", "vector", F.coalesce("owner", "id").alias("owner"), F.transform("buckets", lambda b: F.when(F.array_contains("these", b), b)).alias("spread")), "placed")

    few = owned.where(F.col("crowd") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.owner") != F.col("y.owner"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    near = cosines(pairs, placed).where(F.col("cosine") >= COSINE)
    of_a, of_b = (placed.select(F.col("id").alias(c), F.col("copies").alias(f"n{c}"), F.col("spread").alias(f"s{c}")) for c in "ab")
    near = near.join(of_a, "a").join(of_b, "b").where(~F.coalesce(F.arrays_overlap("sa", "sb"), F.lit(False)))  # else counted in a block
    near = written(near.select("a", "b", "na", "nb"), "pairs")

    dealt, blocks = block_pairs(spread.select(F.col("bucket").alias("part"), "id", "owner", F.lit(1).alias("weight")), BLOCK, BLOCK)
    packed = dealt.select("block", "id").join(placed, "id").groupBy("block").agg(F.collect_list(F.struct("id", "owner", "copies", "vector", "spread")).alias("rows"))  # a block's, about BLOCK
    crossing = written(met_blocks(blocks, packed).mapInArrow(_compare, "id long, links long, low long"), "links")

    size = core.join(classes.select("id", "copies"), "id").groupBy("owner").agg(F.sum("copies").alias("size"))
    inside = core.join(size, "owner").join(classes.select("id", "copies"), "id").select("id", (F.col("size") - F.col("copies")).alias("links"))
    across = near.select(F.col("a").alias("id"), F.col("nb").alias("links")).union(near.select("b", "na")).union(crossing.select("id", "links"))
    links = inside.union(across).groupBy("id").agg(F.sum("links").alias("links"))
    edges = core.select(F.col("id").alias("a"), F.col("owner").alias("b")).union(near.select("a", "b")).union(crossing.select("id", "low"))
    named = named_classes(known, classes, components(edges), "vec_id")
    counted = classes.select("key", "id", "copies").join(links, "id", "left").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).where("n_links > 0")
    found = counted.join(named, "key", "full_outer")
    component = F.coalesce("component_id", "vec_id")
    with_id = F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")
    return signed.select("vec_id", with_id).join(found, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
