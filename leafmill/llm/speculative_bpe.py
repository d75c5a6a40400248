"""Byte-level BPE by speculation: greedy longest matches are proposed, verified in bulk, and mended where they fail.

A vocabulary is the JSON file of a byte-level BPE model with an ordered list of merges. The text is cut at the strings of
added tokens (each is one id), then by the byte-level pattern; each piece, a word, is encoded on its own.

*Speculate.* From a word's start one goes from longest match to longest match. Short words are looked up; of the long ones of a batch
an Aho-Corasick automaton gives the longest token at every byte, and they are followed side by side.
*Verify.* Two neighbouring tokens are compatible if merging the bytes of both gives exactly these two. The merges of all
pairs of the batch are undone side by side in arrays, the latest first; a pair fails if the two parts that touch at its
border would have been merged before. Words whose neighbours are all compatible are what merging gives, since merging has one
result and no merge crosses a border of such a sequence.
*Mend.* Words with a pair that fails are merged exactly, lowest rank and leftmost first, with a heap.

Words are remembered up to a bound. Decoding joins the bytes of ids; bytes that are no UTF-8 become replacement characters,
ids that the vocabulary lacks are left out.

Letters and numbers are those of the tokenizers library, whose tables are older than those of the pattern engine: characters
that only the latter knows are no letters here.

Defined results: null text encodes to no ids (and decodes to the empty text), like the empty text. The result is unique, so there
are no ties. Repeated rows get equal ids; an empty table gives no rows. Only the id and the text are read, so further
columns may have any name. Texts of any length are taken whole; a word of n bytes takes n log n steps at most.
"""

from __future__ import annotations

import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, rows

#: Words that a worker remembers, and code points of the longest one of them.
MEMO, MEMO_WORD = 300_000, 64
#: Words that are followed side by side; fewer are followed one by one.
SIDE_BY_SIDE = 48
#: How a byte-level model cuts text (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE, _LOW = int(np.iinfo(np.int64).max), 0xFFFFFFFF
#: Bytes of short words: they are matched by looking up their parts and merged by looking for the least rank each time; longer ones go
#: through an automaton and a heap.
SHORT = 64


def _characters() -> dict[str, int]:
    """The visible character that stands for each byte in the file: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def _late_characters(cut) -> str:
    """Letters and numbers that the pattern engine knows and ``cut``, the library's own splitter, does not."""
    either = regex.compile(r"[\p{L}\p{N}]")
    new = [c for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn" and either.match(c)]
    text = "".join(f" a{c} 1{c}" for c in new)
    whole = {text[a:b] for _, (a, b) in cut(text)} if new else set()
    return "".join(c for c in new if f" a{c}" not in whole and f" 1{c}" not in whole)


class Model:
    """A vocabulary in arrays: tokens by id, the merge that makes each, and all merges by their pair."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], file.get("pre_tokenizer") or {}
        plain = not file.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        added = file.get("added_tokens") or []
        if model.get("type") != "BPE" or not plain or not level or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError(f"{path} is not a plain byte-level BPE model")
        byte, vocab = _characters(), model["vocab"]
        self.added: dict[str, int] = {a["content"]: a["id"] for a in added}
        self.tokens: list[bytes | None] = [None] * (max([*vocab.values(), *self.added.values()]) + 1)
        for text, i in vocab.items():
            if text not in self.added:
                self.tokens[i] = bytes(byte[c] for c in text)
        for text, i in self.added.items():
            self.tokens[i] = text.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: A pair of tokens, in one number, and the rank of the merge that joins it with what it makes, in one number.
        self.merges = {vocab[a] << 32 | vocab[b]: rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.of_byte = [vocab[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        size = len(self.tokens)
        #: Of each token its halves and the rank of the merge that joins them; -1 for single bytes, -2 for what merging never gives.
        self.left, self.right, self.rank = (np.full(size, -2, np.int64) for _ in range(3))
        for i in self.of_byte:
            self.left[i] = self.right[i] = self.rank[i] = -1
        for pair, merge in self.merges.items():
            i = merge & _LOW
            if self.merged(self.tokens[i]) == [i]:
                self.left[i], self.right[i], self.rank[i] = pair >> 32, pair & _LOW, merge >> 32
        made = self.rank >= 0
        if (self.rank[made] <= np.maximum(self.rank[self.left[made]], self.rank[self.right[made]])).any():
            raise ValueError(f"{path}: a merge comes before those of its parts")
        keys = np.array(list(self.merges), np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(self.merges.values()), np.int64)[order] >> 32
        self.late = _late_characters(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: of all neighbours that a merge joins the one of lowest rank, of these the leftmost, first."""
        merges, ids = self.merges, [self.of_byte[b] for b in word]
        if len(ids) > SHORT:
            return self._merged_by_heap(ids)
        found = [merges.get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != _NONE:
            i = found.index(best)  # the leftmost one
            ids[i : i + 2] = [made := best & _LOW]
            del found[i]
            if i:
                found[i - 1] = merges.get(ids[i - 1] << 32 | made, _NONE)
            if i < len(found):
                found[i] = merges.get(made << 32 | ids[i + 1], _NONE)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i) for i in range(n - 1) if (m := merges.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            merge, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or merges.get(ids[i] << 32 | ids[j]) != merge:
                continue  # one of the two has been merged with another one meanwhile
            made = merge & _LOW
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get(made << 32 | ids[k]):
                    heapq.heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := merges.get(ids[h] << 32 | made)):
                heapq.heappush(heap, (m, h))
        return [i for i in ids if i >= 0]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether merging the bytes of both gives these two."""
        fine = np.ones(len(a), bool)
        at, x, y, bound = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64), np.full(len(a), _NONE)
        while len(at):
            key = x << 32 | y
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crosses = (self.keys[place] == key) & (self.ranks[place] < bound)
            fine[at[crosses]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~crosses & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[more], x[more], y[more], rx[more], ry[more]
            # the merge of higher rank came last; of two equal ones the right one did
            undo_x = rx > ry
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            bound = np.where(undo_x, rx, ry + 1)
        return fine

    def decoded(self, ids) -> str:
        tokens = self.tokens
        return b"".join(t for i in ids if 0 <= i < len(tokens) and (t := tokens[i]) is not None).decode("utf-8", "replace")


class Encoder:
    """Encodes batches of texts with one model; lives in a Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.whole = {t: i for i, t in enumerate(model.tokens) if t and model.rank[i] >= -1}
        self.lengths = np.array([len(t or b"") for t in model.tokens], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in self.whole.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        late = regex.escape(model.late)
        self.late, self.high = frozenset(model.late), regex.compile(f"[{min(model.late)}-\U0010FFFF]+").findall if late else lambda text: []
        self.split_late = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{late}]]").replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{late}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{late}]]+"), regex.V1).findall if late else self.split
        self.at_added = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(model.added, key=len, reverse=True)) + ")").split
        self.memo: dict[str, tuple[int, ...]] = {}
        self.failed = 0  # words that had to be merged exactly

    def words(self, text: str) -> list[str]:
        """Added tokens and words, in order."""
        out: list[str] = []
        parts = self.at_added(text) if any(a in text for a in self.model.added) else [text]
        for nth, part in enumerate(parts):
            if nth % 2:
                out.append(part)
            elif part:
                out += (self.split_late if self._has_late(part) else self.split)(part)
        return out

    def _has_late(self, text: str) -> bool:
        try:
            text.encode("latin-1")  # far quicker than looking for the characters, and enough for most texts
            return False
        except UnicodeEncodeError:
            return not self.late.isdisjoint("".join(self.high(text)))

    def _greedy(self, word: bytes) -> list[int]:
        """Tokens of a short word by greedy longest match, looked up from the longest on."""
        whole, n, i, out = self.whole, len(word), 0, []
        while i < n:
            j = n
            while (token := whole.get(word[i:j])) is None:
                j -= 1
            out.append(token)
            i = j
        return out

    def _proposed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words by greedy longest match, and which word each belongs to; long words go through the automaton together."""
        by_word = [self._greedy(w) if len(w) <= SHORT else None for w in words]
        if long := [k for k, tokens in enumerate(by_word) if tokens is None]:
            tokens, word = self._by_automaton([words[k] for k in long])
            for k, part in zip(long, np.split(tokens, np.flatnonzero(np.diff(word)) + 1)):
                by_word[k] = part.tolist()
        sizes = np.fromiter(map(len, by_word), np.int64, len(words))
        return np.array(list(itertools.chain.from_iterable(by_word)), np.int64), np.repeat(np.arange(len(words)), sizes)

    def _by_automaton(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        joined = "Ā".join(w.decode("latin-1") for w in words)
        hits = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        longest = np.full(len(joined) + 1, -1, np.int64)
        longest[hits[:, 0] + 1 - self.lengths[hits[:, 1]]] = hits[:, 1]  # matches come by their ends, so the longest one is last
        step = np.where(longest >= 0, self.lengths[longest], 0)
        chosen = np.zeros(len(joined) + 1, bool)
        at, end = first, first + sizes
        while len(at) >= SIDE_BY_SIDE:
            chosen[at] = True
            at = at + step[at]
            on = at < end
            at, end = at[on], end[on]
        if len(at):
            steps = step.tolist() if len(joined) < 1 << 16 else step
            for i, stop in zip(at.tolist(), end.tolist()):
                while i < stop:
                    chosen[i] = True
                    i += int(steps[i])
        places = np.flatnonzero(chosen)
        return longest[places], np.searchsorted(first, places, "right") - 1

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word."""
        raw = [w.encode() for w in words]
        ids = [(i,) if (i := self.whole.get(w)) is not None else () for w in raw]
        open_words = [k for k, i in enumerate(ids) if not i]
        if open_words:
            tokens, word = self._proposed([raw[k] for k in open_words])
            inside = word[1:] == word[:-1]
            pairs, back = np.unique(tokens[:-1][inside] << 32 | tokens[1:][inside], return_inverse=True)
            fine = self.model.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
            wrong = set(word[1:][inside][~fine].tolist())
            self.failed += len(wrong)
            borders = np.flatnonzero(np.concatenate([[True], ~inside, [True]])).tolist()
            listed = tokens.tolist()
            for nth, k in enumerate(open_words):
                ids[k] = tuple(self.model.merged(raw[k])) if nth in wrong else tuple(listed[borders[nth] : borders[nth + 1]])
        return ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        memo.update((text, (i,)) for text, i in self.model.added.items())
        cut = [self.words(t) if t else [] for t in texts]
        new = list({w for words in cut for w in words if w not in memo})
        memo.update(zip(new, self.encode_words(new)))
        out = [np.array(list(itertools.chain.from_iterable(map(memo.__getitem__, words))), np.int32) for words in cut]
        for w in new:
            if len(w) > MEMO_WORD:
                del memo[w]
        return out


_MODELS: dict[tuple[str, str], object] = {}
_ENCODERS: dict[str, Encoder] = {}


def _model(spark: SparkSession, path: str):
    """The model, broadcast: about 150 bytes a token, whatever the corpus."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _MODELS:
        _MODELS[key] = spark.sparkContext.broadcast(Model(path))
    return _MODELS[key]


def encode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", decoded: bool = False) -> DataFrame:
    """``id_column`` and ``token_ids`` (array of int) of every row; nothing is shuffled.

    ``vocabulary`` is the path of a model file on the driver; its tables go to the workers once. With ``decoded`` the ids are
    also decoded again, in the same pass, into a column of that name.
    """
    model = _model(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Encoder(model.value)
        encoder = _ENCODERS[vocabulary]
        for batch in pieces(batches, text_column, 4 << 20):
            ids = encoder.encode(batch.column(1).to_pylist())
            offsets = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))
            back = [pa.array([encoder.model.decoded(i.tolist()) for i in ids], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *back], names=schema.fieldNames())

    schema = T.StructType([df.schema[id_column], T.StructField("token_ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decoded else [])])
    return rows(df, id_column, text_column).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` (string): the text of ``ids_column``. Null ids decode to the empty text."""
    model = _model(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.value.decoded(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_column, ids_column, "decoded"])

    schema = T.StructType([df.schema[id_column], df.schema[ids_column], T.StructField("decoded", T.StringType())])
    return rows(df, id_column, ids_column).mapInArrow(run, schema)


def op13_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
