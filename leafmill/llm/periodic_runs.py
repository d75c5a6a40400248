"""Periodic runs of words by the method of Gusfield and Stoye for tandem repeats.

A run is a stretch of words with smallest period q (words q apart are equal) that no neighbouring word extends, of at
least ``LENGTH`` words and ``TIMES`` periods. A square is a word sequence that stands twice in a row; a run of
period q is a row of squares of root length q at neighbouring places.

1. *LZ blocks.* From the left, each block is the longest stretch that also begins earlier (or one new word). A square that
   stands nowhere further left has its centre in a block whose start or end it crosses, and ends in the next block at most. So
   extending both ways from the borders, for each root length up to two blocks, gives squares that cover every leftmost one:
   each is a neighbour, to the right, of one that is found.
2. *Vocabulary.* The suffix tree is held as a suffix array: a node, or a place on an edge, is an interval of suffixes with a
   depth. From each covering square one goes along suffix links, that is to the next suffix and up to the depth of a square,
   while the square's first word follows. A place that has been reached before counts once. The result is every distinct square.
3. *Occurrences.* The suffixes of a place's interval are all the places where its square stands. Those of one root length at
   neighbouring places are merged into runs.

Only squares whose root is no repetition itself are followed: each run has such ones for its smallest period, and no text has
more than n log n of them. Documents are worked on in batches: words are numbered by their document, so that no suffix is
shared, and all steps but the chain of blocks are done for a whole batch in arrays. Extensions in both directions compare
the ranks of stretches of 2^k words, which sorting the suffixes by doubling leaves behind.

Defined results: null, empty and blank texts have no words and no runs. Runs are reported by their start, then period, so there are no
ties; of runs with one length in periods the one that starts first, then the one of smaller period, is the strongest. Repeated
rows give equal rows; an empty table gives none. Only the id and the text are read, so further columns may have any name.
Texts are taken whole; one of n words takes n log n steps and 4 n log(longest repeat) bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, pieces, rows

#: A run has this many words, and its period this many times, at least.
LENGTH, TIMES = 24, 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _table(values: np.ndarray, most: int) -> list[np.ndarray]:
    """Minima of the 2^k values that end at each place, for stretches up to ``most``."""
    levels, k = [values], 1
    while k < most:
        last = levels[-1]
        levels.append(np.minimum(last, np.concatenate([np.full(k, -1, last.dtype), last[:-k]])[: len(last)]))
        k *= 2
    return levels


def _back_to(levels: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each place the number of values, it and what comes before it, that are all ``least`` or more."""
    n = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        place = at - n
        more = (place >= 0) & (levels[k][np.maximum(place, 0)] >= least)
        n += more.astype(np.int64) << k
    return n


class Suffixes:
    """The suffix tree of a batch of documents, as a suffix array with the ranks that doubling gives."""

    def __init__(self, documents: list[np.ndarray]):
        sizes = np.array([len(d) for d in documents], np.int64)
        self.n = n = int(sizes.sum())
        self.document = np.repeat(np.arange(len(documents)), sizes)
        self.end = np.repeat(np.cumsum(sizes), sizes)
        words = np.concatenate([np.zeros(0, np.int64), *documents]).astype(np.int64)
        self._sort(self.document << 32 | words)
        self._heights()

    def _sort(self, first: np.ndarray) -> None:
        """Ranks of the stretches of 2^k words at each place: equal stretches have one rank, those cut off by a document's end one of their own."""
        n = self.n
        order = np.argsort(first, kind="stable")
        new = np.concatenate([[True], first[order][1:] != first[order][:-1]]) if n else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        rank = np.empty(n, np.int32)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        self.ranks = [rank]
        self.largest = int(np.diff(np.append(starts, n)).max(initial=0))
        alone = np.concatenate([new[1:], [True]]) & new if n else new
        open_ = np.flatnonzero(~alone)  # places of the order in groups of several suffixes
        k = 1
        while len(open_):
            at = order[open_].astype(np.int64)
            group = rank[at].astype(np.int64)
            later = at + k
            inside = later < self.end[at]
            key = np.where(inside, rank[np.minimum(later, n - 1)].astype(np.int64) + n + 1, n - at)  # a suffix that ends comes first
            by = np.lexsort((key, group))
            at, group, key = at[by], group[by], key[by]
            order[open_] = at
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
            starts = np.flatnonzero(new)
            rank = rank.copy()
            rank[at] = np.repeat(open_[starts], np.diff(np.append(starts, len(at))))
            self.ranks.append(rank)
            alone = np.concatenate([new[1:], [True]]) & new
            open_ = open_[~alone]
            k *= 2
        self.order, self.rank = order, rank.astype(np.int64)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``i`` and ``j`` (different places) have in common."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b, last = i + n, j + n, self.n - 1
            same = (np.maximum(a, b) <= last) & (self.ranks[k][np.minimum(a, last)] == self.ranks[k][np.minimum(b, last)])
            n += same.astype(np.int64) << k
        return n

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common that end at ``i`` and at ``j``, these two included."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - n - (1 << k) + 1, j - n - (1 << k) + 1
            same = (np.minimum(a, b) >= 0) & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])
            n += same.astype(np.int64) << k
        return n

    def _heights(self) -> None:
        """Words that each suffix has in common with the one before it in the order."""
        n = self.n
        self.height = np.zeros(n, np.int64)
        if n:
            both = np.flatnonzero(self.ranks[0][self.order[1:]] == self.ranks[0][self.order[:-1]]) + 1
            self.height[both] = self.forward(self.order[both - 1].astype(np.int64), self.order[both].astype(np.int64))
        self.up = _table(self.height, self.largest)
        self.down = _table(self.height[::-1].copy(), self.largest)

    def interval(self, place: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes, as a stretch of the order (first, one past the last), that share ``depth`` words with the one at ``place``."""
        r = self.rank[place]
        low = r - _back_to(self.up, r, depth)
        high = r + 1 + _back_to(self.down, self.n - 2 - r, depth)
        return low, high

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The LZ blocks of every document: starts, ends, and ends of the block after it (its own end for a document's last)."""
        n = self.n
        # the longest stretch that begins earlier is shared with the next suffix up or down the order that begins earlier
        order = self.order.astype(np.int64)
        r = np.arange(n)
        before = _back_to(_table(order, self.largest), r - 1, order)
        after = _back_to(_table(order[::-1].copy(), self.largest), n - 2 - r, order)
        up, down = r - 1 - before, r + 1 + after
        longest = np.zeros(n, np.int64)
        for other in (up, down):
            there = np.clip(other, 0, max(n - 1, 0))
            ok = np.flatnonzero((other >= 0) & (other < n) & (self.ranks[0][order[there]] == self.ranks[0][order]))
            longest[order[ok]] = np.maximum(longest[order[ok]], self.forward(order[ok], order[there[ok]]))
        step = (np.arange(n) + np.maximum(longest, 1)).tolist()
        starts, i = [], 0
        while i < n:
            starts.append(i)
            i = step[i]
        start = np.array(starts, np.int64)
        end = np.append(start[1:], n) if n else start
        following = np.append(end[1:], n) if n else end
        last = self.document[np.minimum(end, n - 1)] != self.document[start] if n else np.zeros(0, bool)
        return start, end, np.where(last | (end == n), end, following)


def _many(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, nth): ``counts[i]`` times i, numbered from 0 each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def covering(tree: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, root length, squares of it at neighbouring places from there on) that cover all leftmost squares."""
    h, h1, h2 = tree.blocks()
    found = []
    # inside from the block's start on, and across its end
    which, nth = _many(h1 - h)
    border, k = h1[which], nth + 1
    q = border - k
    fine = border < tree.n
    fine[fine] &= tree.ranks[0][border[fine]] == tree.ranks[0][q[fine]]
    border, k, q, lowest = border[fine], k[fine], q[fine], np.zeros(int(fine.sum()), np.int64)
    right = tree.forward(q, border)
    left = np.where(q > 0, tree.backward(np.maximum(q - 1, 0), border - 1), 0)
    start = np.maximum(q - left, q - k + 1)
    found.append((start, k, q + right - k - start + 1))
    # from before the block's start, with its centre in the block
    which, nth = _many(h2 - h)
    border, top, k = h[which], h1[which], nth + 1
    fine = (border > 0) & (border + k - 1 < tree.n)
    fine[fine] &= tree.ranks[0][border[fine] - 1] == tree.ranks[0][border[fine] + k[fine] - 1]
    border, top, k = border[fine], top[fine], k[fine]
    left = tree.backward(border - 1, border + k - 1)
    on = border + k < tree.n
    right = np.where(on, tree.forward(border, np.minimum(border + k, tree.n - 1)), 0)
    start = np.maximum(border - left, border - k)
    found.append((start, k, np.where(start + k < top, border + right - k - start + 1, 0)))
    start, k, count = (np.concatenate(x) for x in zip(*found))
    good = count > 0
    start, k, count = start[good], k[good], count[good]
    return _primitive(tree, start, k, np.minimum(count, k))


def _primitive(tree: Suffixes, start: np.ndarray, k: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the squares whose root is itself a shorter one several times: for a prime p, it would be one of k / p words."""
    fine, rest, p = np.ones(len(k), bool), k.copy(), 2
    while len(rest) and p <= rest.max():
        if p * p > rest.max():  # what is left is 1 or a prime each
            divides = rest > 1
            primes = np.where(divides, rest, 1)
            rest = np.ones_like(rest)
        else:
            divides = rest % p == 0
            primes = np.full(len(k), p)
            while (again := rest % p == 0).any():
                rest[again] //= p
        at = np.flatnonzero(divides & fine)
        short = k[at] // primes[at]
        fine[at] = tree.forward(start[at], start[at] + short) < k[at] - short
        p += 1
    return start[fine], k[fine], count[fine]


def vocabulary(tree: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, root length) of every distinct square with a primitive root: the suffixes low to high of the order begin with it."""
    start, k, count = covering(tree)
    which, nth = _many(count)
    place, root = start[which] + nth, k[which]  # along suffix links: the next place, the same length
    low, high = tree.interval(place, 2 * root)
    _, first = np.unique(low << 32 | root, return_index=True)
    return low[first], high[first], root[first]


def runs_of(documents: list[np.ndarray], length: int = LENGTH, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, a sequence of numbers for words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    tree = Suffixes(documents)
    if not tree.n:
        return out
    low, high, root = vocabulary(tree)
    which, nth = _many(high - low)
    place, root = tree.order[low[which] + nth].astype(np.int64), root[which]
    by = np.lexsort((place, root))
    place, root = place[by], root[by]
    new = np.concatenate([[True], (root[1:] != root[:-1]) | (place[1:] != place[:-1] + 1) | (tree.document[place[1:]] != tree.document[place[:-1]])]) if len(place) else np.zeros(0, bool)
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(place)) - 1 if len(firsts) else firsts
    start, period = place[firsts], root[firsts]
    size = place[lasts] - start + 2 * period
    long_enough = size >= np.maximum(length, times * period)
    start, period, size = start[long_enough], period[long_enough], size[long_enough]
    document = tree.document[start]
    begin = np.concatenate([[0], np.cumsum([len(d) for d in documents])])
    by = np.lexsort((period, start))
    for d, s, n, p in zip(document[by].tolist(), (start - begin[document])[by].tolist(), size[by].tolist(), period[by].tolist()):
        out[d].append((s, n, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without what each run repeats after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """``id_column``, ``runs`` (array of start, length, period; words from 0) and ``collapsed`` (the text without repeated periods) of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_column, 2 << 20):
            numbers: dict[bytes, int] = {}
            words = [t.encode().split() if t else [] for t in batch.column(1).to_pylist()]  # bytes.split() takes ASCII white space alone
            documents = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int64, len(ws)) for ws in words]
            found = runs_of(documents, length, times)
            as_rows = [[{"start": s, "length": n, "period": p} for s, n, p in rs] for rs in found]
            kept = [collapsed(ws, rs).decode() for ws, rs in zip(words, found)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_rows, kind), pa.array(kept, pa.string())], names=schema.fieldNames())

    schema = T.StructType([df.schema[id_column], T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType())])
    return rows(df, id_column, text_column).mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """Of an array of runs the one with the greatest exact length / period; of equal ones the one that starts first, then of smaller period; null if none."""
    def better(a: Column, b: Column) -> Column:
        # cross products of lengths and periods of words: 2^31 words at most, so they are exact
        mine, other = b["length"] * a["period"], a["length"] * b["period"]
        before = (b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))
        return F.when(a.isNull() | (mine > other) | ((mine == other) & before), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast(RUNS[6:-1]), better)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where of one document in ten, by the hash of its id, the words from a place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", f"[{WHITE}]+"), lambda w: w != "")).alias("words"))
    n = F.size("words")
    a = F.col("g") % n
    with_start = chosen.withColumn("a", F.when(n > 0, a))
    with_period = with_start.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return with_period.select("doc_id", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """What the query reports of ``periodic_runs``."""
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.select("*", strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
