"""Document fingerprints: a Merkle tree over sections, paragraphs and passages.

The tree of a text has four levels. A *paragraph* is a line that is not blank. Paragraphs form *sections*: a
blank line or a Markdown heading starts one, and so does, in long runs without either, a paragraph whose
own digest says so (about one in eight), so that an insertion never moves all later borders. Under a
paragraph are its *passages*: runs of words that end after a word whose last bytes are in a fixed class
(one in three), again a border that depends on the text around it alone. In a passage of more than 63 bytes, such as
a line without white space, borders also follow six bytes in a fixed class (one code point in 16), and
what is still longer is cut every 63 bytes. Passages are the leaves: a paragraph's digest is the SHA-256 of its passages'
hashes and sizes, a section's that of its paragraphs' digests, and the root that of the sections' digests.

The fingerprint is the tree as text: 32 hexadecimal digits of the root, then ``/`` and 8 digits for each
section, ``.`` and 8 digits for each of its paragraphs, followed by 5 characters for each passage (24 bits
of its hash, and its size). ``likeness`` and ``locate`` walk down two such trees from their roots and enter only branches
that differ: what equal roots, sections or paragraphs hold is shared without looking into them, and in those that differ
passages are compared. The likeness is twice the shared passages' size over both texts' sizes.

White space does not count within the tree, nor do blank lines as such, except through the
root, which also takes in the digest of the exact text: two texts share a root only if they are equal.

Defined results: null text counts as empty; the empty text has a root and no branches. Equal texts are alike (1.0), and a
text without words is not like any other text (0.0). Rows with one id, repeated rows among them, all appear, in the order of
their text; rows with null ids come last. An empty table gives no rows, and of the table only doc_id and text are read, so
further columns may have any name. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, n_parts, pieces, rows

#: Characters of the compact passage codes.
CODE = np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_", np.uint8)
_FACTOR = pow(0x9E3779B97F4A7C15, 1, 1 << 64) | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
#: White-space bytes.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The largest size that a passage's code can hold.
MOST = 63
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        for k, base in enumerate((_FACTOR, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _shortened(solid: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts with those added that leave no passage longer than MOST."""
    sizes = np.diff(np.r_[starts, len(solid)])
    if sizes.max() <= MOST:
        return starts
    at = np.flatnonzero(np.repeat(sizes > MOST, sizes))
    at = at[(at - np.repeat(starts, sizes)[at] >= 6) & ((solid[at] & 0xC0) != 0x80)]
    six = np.zeros(len(at), np.uint64)
    for k in range(1, 7):
        six = six * np.uint64(256) + solid[at - k]
    starts = np.union1d(starts, at[(mix64(six) >> np.uint64(40)) % np.uint64(16) == 0])
    sizes = np.diff(np.r_[starts, len(solid)])
    more = [np.arange(s + MOST, s + n, MOST) for s, n in zip(starts[sizes > MOST], sizes[sizes > MOST])]
    return np.sort(np.concatenate([starts, *more]))


def passages(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and sizes (bytes without white space) of a text's passages, all by array operations.

    A passage's hash is a polynomial over its bytes other than white space, taken from prefix sums.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[raw]
    # a border: white space after a word whose last three bytes are in the class, or any end of line
    border = np.zeros(len(raw), bool)
    ends = np.flatnonzero(space[1:] & ~space[:-1])
    last3 = raw[ends] + raw[np.maximum(ends - 1, 0)] * np.uint64(257) + raw[np.maximum(ends - 2, 0)] * np.uint64(66_049)
    border[ends[(mix64(last3) >> np.uint64(40)) % np.uint64(3) == 0] + 1] = True
    border |= raw == 10
    solid = raw[~space]
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    nth = np.cumsum(border)[~space]
    starts = _shortened(solid, np.flatnonzero(np.r_[True, nth[1:] != nth[:-1]]))
    up, down = _powers(len(solid))
    sums = np.add.reduceat((solid.astype(np.uint64) + np.uint64(1)) * up, starts) * down[starts]
    return np.flatnonzero(~space)[starts], mix64(sums), np.diff(np.r_[starts, len(solid)])


def _codes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.empty((len(hashes), 5), np.uint8)
    for k in range(4):
        out[:, k] = CODE[((hashes >> np.uint64(40 + 6 * k)) & np.uint64(63)).astype(np.int64)]
    out[:, 4] = CODE[sizes]
    return out


#: A section's digest with its paragraphs: their digests and the codes of their passages.
Sections = list[tuple[str, list[tuple[str, str]]]]


def fingerprint(text: str) -> tuple[str, Sections]:
    """The tree as text, and its branches as ``branches`` gives them."""
    data = text.encode()
    exact = hashlib.sha256(data).digest()
    starts, hashes, sizes = passages(data)
    codes = _codes(hashes, sizes).tobytes().decode("ascii")
    leaves = np.stack([hashes, sizes.astype(np.uint64)], 1).tobytes()
    ends_of_lines = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    cuts = np.searchsorted(starts, np.r_[ends_of_lines, len(data)]).tolist()
    digests: list[list[bytes]] = []
    sections: list[list[tuple[str, str]]] = []
    fresh, at, sha = True, 0, hashlib.sha256
    for line, cut in zip(data.split(b"\n"), cuts):
        if cut == at:
            fresh = True
            continue
        digest = sha(leaves[16 * at : 16 * cut]).digest()
        if fresh or line.lstrip().startswith(b"#"):
            sections.append([])
            digests.append([])
        digests[-1].append(digest)
        sections[-1].append((digest[:4].hex(), codes[5 * at : 5 * cut]))
        fresh, at = digest[4] < 32, cut
    of_sections = [sha(b"".join(d)).digest() for d in digests]
    root = sha(exact + b"".join(of_sections)).hexdigest()[:32]
    tree = [(d.hex()[:8], p) for d, p in zip(of_sections, sections)]
    return root + "".join("/" + h + "".join(f".{d}{c}" for d, c in p) for h, p in tree), tree


_SIZE = {chr(c): i for i, c in enumerate(CODE)}


def branches(tree: str) -> Sections:
    """Sections of a fingerprint with their paragraphs' digests and passages."""
    out = []
    for section in tree[32:].split("/")[1:]:
        head, *paragraphs = section.split(".")
        out.append((head, [(p[:8], p[8:]) for p in paragraphs]))
    return out


def _size(codes: str) -> int:
    return sum(map(_SIZE.__getitem__, codes[4::5]))


def _differing(a: list[tuple], b: list[tuple]) -> tuple[list, list, list]:
    """Branches (digest, content) in both, as often as in both, and the contents of those only in a and only in b."""
    both, out = Counter(h for h, _ in a) & Counter(h for h, _ in b), []
    for side in (a, b):
        left, same, other = Counter(both), [], []
        for head, content in side:
            if left[head]:
                left[head] -= 1
                same.append(content)
            else:
                other.append(content)
        out.append((same, other))
    return out[0][0], out[0][1], out[1][1]


def _likeness(a: Sections, b: Sections) -> float:
    """Walks down two trees of different roots: what equal branches hold is shared, differing ones are entered."""
    total = sum(_size(c) for side in (a, b) for _, ps in side for _, c in ps)
    if not total:
        return 0.0
    same, ours, theirs = _differing(a, b)
    shared = sum(_size(c) for ps in same for _, c in ps)
    same, ours, theirs = _differing([p for ps in ours for p in ps], [p for ps in theirs for p in ps])
    shared += sum(map(_size, same))
    count = lambda codes: Counter(c[i : i + 5] for c in codes for i in range(0, len(c), 5))
    return 2.0 * (shared + sum(_SIZE[k[4]] * n for k, n in (count(ours) & count(theirs)).items())) / total


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, 0 to 1: twice the shared passages' size over both sizes; 1.0 for equal roots."""
    return 1.0 if a[:32] == b[:32] else _likeness(branches(a), branches(b))


def locate(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a`` whose digest ``b`` lacks: equal roots and equal branches are not entered."""
    if a[:32] == b[:32]:
        return []
    theirs = branches(b)
    sections, paragraphs = {h for h, _ in theirs}, {p for _, ps in theirs for p, _ in ps}
    return [(i, j) for i, (h, ps) in enumerate(branches(a)) if h not in sections for j, (p, _) in enumerate(ps) if p not in paragraphs]


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``fingerprint`` of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_column):
            out = [fingerprint(t or "")[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_column, "fingerprint"])

    return rows(df, id_column, text_column).mapInArrow(run, T.StructType([df.schema[id_column], T.StructField("fingerprint", T.StringType())]))


EDITED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, halo) in order -> a row for each that is not halo, compared with the row after it."""
    last, out, held = None, [], 0
    for batch in pieces(batches, "text"):
        for doc_id, text, halo in zip(*(batch.column(k).to_pylist() for k in range(3))):
            text = text or ""
            tree, parts = fingerprint(text)
            if last is not None:
                out.append(_compared(*last, text, tree, parts))
                held += len(out[-1][3]) + len(out[-1][4])
            last = None if halo else (doc_id, text, tree, parts)
            if halo:
                break  # one row of the next part is enough; ties follow it
        if held > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=EDITED.fieldNames())
            out, held = [], 0
        if last is None:
            break
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()])], names=EDITED.fieldNames())


def _compared(doc_id, text: str, tree: str, parts: Sections, next_text: str, next_tree: str, next_parts: Sections) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    edited_tree, edited_parts = fingerprint(edited)
    near = lambda other, its: 1.0 if other[:32] == tree[:32] else _likeness(parts, its)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), tree, edited_tree, near(edited_tree, edited_parts), near(next_tree, next_parts)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document (descending id).

    The order is cut at quantiles of the ids, so each part is one task and the texts are shuffled once. The
    first document of a part also goes, as its halo, to the part before, where it follows the last one; the
    part of the smallest ids gets the largest id's, since the order goes round. Rows with equal ids are
    ordered by their text; null ids come last. A single document is its own next.
    """
    spark = docs.sparkSession
    parts = n_parts(spark)
    ids = docs.select("doc_id", "text")
    low, top = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    place = lambda cuts: F.size(F.filter(cuts, lambda c: c >= F.coalesce(F.col("doc_id"), F.lit(-(2**63))))) - 1
    cuts = []
    if top is not None:
        # quantiles are doubles, near ids but not equal to large ones; they only say about where to cut
        offset = (F.col("doc_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")).cast("double").alias("offset")
        near = {min(top, low + int(c)) for c in ids.select(offset).approxQuantile("offset", [i / parts for i in range(1, parts)], 0.25 / parts)}
        bounds = F.array(*[F.lit(c).cast("long") for c in sorted(near | {top}, reverse=True)])
        # the first id of each part that has rows: one number for each part, not for documents
        maxima = ids.where("doc_id is not null").groupBy(place(bounds).alias("part")).agg(F.max("doc_id").alias("first_id"))
        cuts = sorted((r.first_id for r in maxima.collect()), reverse=True)
    firsts = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    last = max(0, len(cuts) - 1)
    own = F.greatest(F.lit(0), place(firsts))
    before = F.when(F.col("own") == 0, F.lit(last)).otherwise(F.col("own") - 1)
    is_first = F.col("doc_id") == F.element_at(firsts, F.col("own") + 1) if cuts else F.lit(True)
    dealt = (
        ids.withColumn("own", own)
        .withColumn("at", F.explode(F.when(is_first, F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("halo")), F.struct(before.alias("part"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("halo"))))))
        .select("doc_id", "text", F.col("at.halo").alias("halo"), F.col("at.part").alias("part"))
        .repartitionById(last + 1, F.col("part"))
        .sortWithinPartitions(F.col("halo"), F.col("doc_id").desc_nulls_last(), F.col("text"))
    )
    return rows(dealt, "doc_id", "text", "halo").mapInArrow(_in_order, EDITED)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
