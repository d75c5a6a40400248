"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three code points of the lower-cased text, every run of other
characters than letters being one space. Document frequencies come from *all* training documents. The
weights are fitted on a bounded sample, by follow-the-regularised-leader with elastic-net penalties: of each language
``PER_LANGUAGE`` distinct ids at most, those of the smallest hashes, so that a rare language is learned from all its
documents however large the corpus is. Languages weigh alike, up to a factor of ``MOST_WEIGHT``. A temperature is then
fitted on a fifth of each language's sample that the weights have not seen (where a language has ten documents or more).
Texts become features where they are stored, whole; one task fits, and the driver gets the weights.

Defined results: text that is null or has no letter is ``und`` with score 0. Predictions depend on the text alone, so
repeated rows get equal ones; of equally likely languages the first by name is taken. Where there is no labelled text to
learn from, every text is ``und``. An empty table gives no rows. Where one id has several texts in a language, the one of the smallest
hash is learned from. Only doc_id, text and lang are read, so further columns may have any name. Texts of any length are
taken whole, in one pass.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, pieces, rows, written

#: Hashed features; labelled documents of each language that the weights are fitted on at most.
FEATURES, PER_LANGUAGE = 1 << 14, 500
#: Parts that a language's ids are ranked in.
PARTS = 64
#: Passes over them, and updates that there are in any case (more passes for small samples); the largest weight of a language.
PASSES, UPDATES, MOST_WEIGHT = 3, 3000, 20.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-3, 1e-3
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Lower-cased letter of each code point of the basic plane; 32 for any other character."""
    table = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
        elif unicodedata.category(chr(c)) == "Mn":
            table[c] = c
    return table


_TABLE: list[np.ndarray] = []


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Indices and counts of a text's n-grams; None without a letter."""
    if not text:
        return None
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    high = points > 0xFFFF
    x = _TABLE[0][np.minimum(points, 0xFFFF)]
    if high.any():
        x[high] = [c if chr(c).isalpha() else 32 for c in points[high].tolist()]
    x = np.r_[np.uint32(32), x, np.uint32(32)]
    x = x[(x != 32) | np.r_[True, x[:-1] != 32]]
    if not (x != 32).any() or not any(map(str.isalpha, map(chr, np.unique(x).tolist()))):
        return None
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    two = h[1:] + (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    three = two[1:] + (h[:-2] ^ (h[:-2] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) if len(x) > 2 else two[:0]
    ids = np.concatenate([mix64(h + np.uint64(1)), mix64(two + np.uint64(2)), mix64(three + np.uint64(3))]) & np.uint64(FEATURES - 1)
    counts = np.bincount(ids.astype(np.int64), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1.0 + np.log(counts)) * self.idf[at]
        return v / max(1e-12, float(np.sqrt(v @ v)))

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text)
        if found is None or not self.langs:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*found) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(min(1.0, p[best]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], frequency: np.ndarray, n_docs: int) -> Model:
    """FTRL-proximal with elastic net over (lang, indices, counts); every fifth row of a language only sets the temperature."""
    langs = sorted({lang for lang, _, _ in sample})
    idf = np.log((1.0 + n_docs) / (1.0 + frequency)) + 1.0
    k = len(langs)
    model = Model(langs, idf, np.zeros((FEATURES, k)), np.zeros(k))
    if k == 0:
        return model
    data = [(at, model.vector(at, counts), langs.index(lang)) for lang, at, counts in sample]
    size = np.bincount([lang for _, _, lang in data], minlength=k)
    nth, train, held = np.zeros(k, int), [], []
    for x in data:
        nth[x[2]] += 1
        (held if size[x[2]] >= 10 and nth[x[2]] % 5 == 0 else train).append(x)
    held = held or train
    weight = np.minimum(MOST_WEIGHT, size.max() / size)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
    rng = np.random.default_rng(0)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0.0
        return w

    for _ in range(max(PASSES, -(-UPDATES // len(train)))):
        for i in rng.permutation(len(train)):
            at, v, lang = train[i]
            at, v = np.r_[at, FEATURES], np.r_[v, 1.0]
            w = weights(at)
            p = _softmax(v @ w)
            p[lang] -= 1.0
            g = v[:, None] * (p * weight[lang])
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(FEATURES + 1))
    model.weights, model.bias = w[:-1], w[-1]
    scores = np.array([v @ model.weights[at] + model.bias for at, v, _ in held])
    truth = np.array([lang for _, _, lang in held])

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

    # the temperature stays above 0.05: on data that are told apart without error, smaller is always better
    model.temperature = float(min(np.geomspace(0.05, 20.0, 121), key=loss))
    return model


def bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame) -> Model:
    """Learn from the text and lang of the rows whose bucket is not 0. Counts cover all of them."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket(F.col("doc_id")) != 0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in pieces(batches, "text"):
            for text in batch.column(0).to_pylist():
                if (found := features(text)) is not None:
                    total[found[0]] += 1
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1], pa.int64()), pa.array(np.r_[total[at], n], pa.int64())], names=["feature", "n"])

    # at most FEATURES + 1 rows reach the driver
    counted = rows(labelled, "text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    frequency, n_docs = np.zeros(FEATURES), 0
    for feature, n in counted:
        if feature < 0:
            n_docs = n
        else:
            frequency[feature] = n
    return _fitted(sample(labelled), frequency, n_docs)


def sample(labelled: DataFrame, most: int | None = None) -> DataFrame:
    """``lang, at, doc_id, ids, counts``: features of ``most`` distinct ids of each language, those of the smallest hashes."""
    most = most or PER_LANGUAGE
    hashed = labelled.select("lang", "doc_id", F.xxhash64("text").alias("th"))
    ids = hashed.groupBy("lang", "doc_id").agg(F.min("th").alias("th")).withColumn("at", F.xxhash64("doc_id"))
    # first within parts of a language, so that no task ranks all ids of one: what is left is PARTS * most ids a language at most
    ids = ids.withColumn("part", F.pmod("at", F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("at", "doc_id"))
        ids = ids.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    chosen = written(ids.drop("part"), "chosen")
    texts = labelled.withColumn("th", F.xxhash64("text")).join(chosen, ["lang", "doc_id", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [features(t) for t in batch.column(3).to_pylist()]
            keep = pa.array([f is not None for f in found], pa.bool_())
            lists = [pa.array([f[c].astype(np.int32) for f in found if f], pa.list_(pa.int32())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).filter(keep) for c in range(3)], *lists], names=["lang", "at", "doc_id", "ids", "counts"])

    made = rows(texts, "lang", "at", "doc_id", "text").mapInArrow(run, T.StructType([labelled.schema["lang"], *T._parse_datatype_string("at long").fields, labelled.schema["doc_id"], *T._parse_datatype_string("ids array<int>, counts array<int>").fields]))
    return made.groupBy("lang", "at", "doc_id").agg(F.first("ids").alias("ids"), F.first("counts").alias("counts"))  # repeated rows are one


def _fitted(sampled: DataFrame, frequency: np.ndarray, n_docs: int) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(lang, np.array(ids), np.array(counts)) for batch in batches for lang, ids, counts in zip(*(batch.column(c).to_pylist() for c in range(3)))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(got, frequency, n_docs))], pa.binary())], names=["model"])

    one = sampled.repartition(1).sortWithinPartitions("at", "doc_id", "lang")  # bounded: PER_LANGUAGE documents of each language
    found = rows(one, "lang", "ids", "counts").mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit([], frequency, n_docs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from the text alone; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in pieces(batches, "text"):
            out = [m.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows(docs, "doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("lang_pred string, score double").fields]))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told with a score of ``least`` or more."""
    model = train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in pieces(batches, "text"):
            keep = [lang != UNKNOWN and score >= least for lang, score in map(m.predict, batch.column(names.index("text")).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows(docs, *names).mapInArrow(run, docs.schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(bucket(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return predict(docs, train(docs)).select("doc_id", held, "lang_pred", "score")
