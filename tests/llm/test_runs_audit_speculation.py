"""Source divergence, periodic runs and speculative BPE against plain versions, the tokenizers library, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from compare import differences
from test_operators import EDGE, QUERY_TEXTS, frame
from tokenizers import Tokenizer

from leafmill.llm import divergence, periodic_runs, queries, speculative_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def model():
    return speculative_bpe.Model(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


RUNS = {"op11": divergence.audit, "op12": periodic_runs.periodic_runs, "op12 planted": periodic_runs.planted, "op13": lambda d: speculative_bpe.encode(d, VOCABULARY, decoded=True)}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_and_odd_tables(name, spark):
    assert RUNS[name](frame(spark).limit(0)).count() == 0
    for more in (False, True):
        rows = RUNS[name](frame(spark, more=more)).collect()
        if name != "op11":
            assert len(rows) == len(EDGE)


# 11 ---------------------------------------------------------------------------------------------


def plain_audit(rows, least, top):
    """``rows``: (text, lang, source); the definition word for word."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        counts, docs = {}, Counter()
        for text, of, source in rows:
            if of == lang:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                terms = "".join(c if "a" <= c <= "z" or c > "\x7f" else " " for c in lower).split(" ")
                terms = [t for t in terms if t]
                docs.update(set(terms))
                counts.setdefault(source, Counter()).update(terms)
        kept = {t for t, n in docs.items() if n >= least}
        counts = {s: {t: n for t, n in c.items() if t in kept} for s, c in counts.items()}
        whole = Counter()
        for c in counts.values():
            whole.update(c)
        share = lambda c, t: 1 + 10**9 * (c.get(t, 0) + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(sum(abs(share(c, t) - share(d, t)) for t in kept), o) for o, d in counts.items() if o != s]
            terms = [(share(c, t) - share(whole, t), t) for t in kept if c.get(t) and share(c, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def test_audit_against_the_definition(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "été", "ÉTÉ", "x1y", "delta_eps", "日本", "zeta"]
    rows = [(" ".join(rng.choices(words[: rng.randint(2, 9)], k=rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, ""])) for _ in range(150)]
    rows += [(None, "xx", "only"), ("alpha", "xx", "only"), ("", "yy", "p"), ("rare words", "yy", "q")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = divergence.audit(df, least=4, top=3).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == plain_audit(rows, 4, 3)


def test_audit_shares_are_exact(spark):
    """Counts whose product with the scale does not fit in 64 bits."""
    c, n, v = 10**12 + 7, 3 * 10**13 + 1, 123_457
    got = spark.range(1).select(divergence.share(*(divergence.F.lit(x) for x in (c, n, v)))).first()[0]
    assert got == 1 + 10**9 * (c + 5) // (n + 5 * v)


# 12 ---------------------------------------------------------------------------------------------


def plain_runs(w, length=24, times=3):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(length, times * q) and not any(w[i + p : i + size] == w[i : i + size - p] for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5]), rng.choice([0, 1, 2, 5, 10, 30, 60])
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.5:
        p = rng.randint(1, n)
        w = (w[:p] * 10)[:n] if rng.random() < 0.5 else w + w[:p] * rng.randint(1, 5)
    if rng.random() < 0.2:
        a, w = [0], [0, 1]
        while len(w) < n:
            a, w = w, w + a
    return w


def test_runs_against_brute_force():
    rng, total = random.Random(5), 0
    for _ in range(600):
        docs = [odd_words(rng) for _ in range(rng.randint(1, 4))]
        for length, times in ((2, 2), (6, 2), (24, 3)):
            want = [plain_runs(d, length, times) for d in docs]
            total += sum(map(len, want))
            assert periodic_runs.runs_of([np.array(d, np.int64) for d in docs], length, times) == want
    assert total > 5000


def test_runs_of_long_texts():
    """Texts whose squares are all there are: one word, a long period, and a text of n log n squares."""
    of = lambda w: periodic_runs.runs_of([np.array(w, np.int64)])[0]
    assert of([0] * 100_000) == [(0, 100_000, 1)] and of([*range(30_000)] * 4) == [(0, 120_000, 30_000)]
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    assert len(of(b)) > 1000


def test_runs_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [*QUERY_TEXTS, "a b  a\tb " * 12, "x " * 23, "x " * 24, " ".join("abcdefgh") + " " + "p q r " * 8 + "p p " * 12, "p q r p q r p " * 9, *(" ".join(map(str, odd_words(rng))) for _ in range(150))]
    spark.createDataFrame([(i * 3, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        w, i = (t or "").encode().split(), k * 3
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
        dropped = {x for s, size, q in runs for x in range(s + q, s + size)}
        milli = 1000 * best[1] // best[2] if runs else None
        kept = b" ".join(x for at, x in enumerate(w) if at not in dropped).decode()
        assert tuple(got[i]) == (i, len(runs), *best, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(kept))


# 13 ---------------------------------------------------------------------------------------------


def odd_texts():
    rng = random.Random(1)
    parts = ["a", "b", "é", " ", "  ", "\n", "'s", "'S", "1", "²", "࢏", "՘", "　", "<|endoftext|>", "<|endof", "th", "ing", "\x00", "\x1c", "\x85", "🙂", "中"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x3FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x3FFFF)])) for _ in range(30)) for _ in range(500)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 60))) for _ in range(2000)]
    return [*texts, "é" * 50_000, "a" * 100_000, "ab" * 30_000, "\n" * 5000, "", *[t for t in QUERY_TEXTS if t]]


def test_speculation_equals_the_library(model, library):
    encoder, texts = speculative_bpe.Encoder(model), odd_texts()
    ids = [i.tolist() for i in encoder.encode(texts)]
    assert ids == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert 0 < encoder.failed < len(encoder.memo)  # some words are merged exactly, most are not
    assert [model.decoded(i) for i in ids] == texts


def test_decoding_any_ids(model, library):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.randint(0, 50_300) for _ in range(8)]
        assert model.decoded(ids) == library.decode(ids, skip_special_tokens=False)


def test_neighbours_are_compatible_where_merging_keeps_them(model):
    rng = np.random.default_rng(4)
    usable = np.flatnonzero(model.rank >= -1)
    common = usable[usable < 600]
    a, b = np.concatenate([rng.choice(usable, 2000), rng.choice(common, 3000)]), np.concatenate([rng.choice(usable, 2000), rng.choice(common, 3000)])
    got = model.compatible(a, b)
    assert got.tolist() == [model.merged(model.tokens[x] + model.tokens[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())] and 0 < got.sum() < len(got)


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        speculative_bpe.Model(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_query(spark, tmp_path, library):
    texts = [*QUERY_TEXTS, "one <|endoftext|>two", *odd_texts()[:200]]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.QUERIES["op13_speculative_bpe"](spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert tuple(r) == (r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_decode_frames(spark):
    df = spark.createDataFrame([(1, [64, 50256, 10**6, -1]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert [r.decoded for r in speculative_bpe.decode(df, VOCABULARY).orderBy("doc_id").collect()] == ["a<|endoftext|>", "", ""]


def test_sql_of_the_audit(spark, sf_dir, duck):
    assert differences(queries.QUERIES["op11_source_divergence"](spark, sf_dir), queries.ORACLES["op11_source_divergence"], duck) == ""
