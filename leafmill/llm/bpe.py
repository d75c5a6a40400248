"""Byte-level BPE: encoding in linear time by backtracking over longest matches, and decoding.

A vocabulary is a rank file (base64 token, rank). The text is cut by the vocabulary's pattern and each
match is encoded on its own, without special tokens.

*How a match is encoded.* Its bytes are read as Latin-1, so that an Aho-Corasick automaton (pyahocorasick)
finds the longest token at every position in one pass. From the left, the longest token is taken; it stands
if it is *compatible* with its left neighbour, that is, if BPE merges of the two tokens' bytes give exactly
these two tokens. If not, its next shorter prefix token is tried, and where there is none, the last token is
taken back. Positions from which no encoding goes on are marked, so each is left once. Compatibility only
depends on the two tokens and is memoised. The encoding in which all neighbours are compatible is the one
that merging by rank gives.

Defined results: null text encodes to no ids (and decodes to no bytes), like the empty text. There are no ties: the encoding is
unique. Repeated rows get equal ids; an empty table gives no rows. Only the id and the text are read, so further columns
may have any name. Texts of any length are taken whole, in linear time and with memory in proportion to the text.
"""

from __future__ import annotations

import array
import base64
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import pieces, rows

#: Entries of the per-worker memory of token pairs, emptied when full, and of words: of those met lately and of those before (some
#: 20 MB for pairs and for words).
MEMO, WORDS = 300_000, 65_000
#: Bytes of text that are encoded at once.
PIECE = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of their rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Plain BPE: merge the lowest-ranked neighbours first, using ranks under ``below`` only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def last_merges(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each token the two tokens whose merge makes it; (-1, -1): a single byte; (-2, -2): no merge reaches it."""
    ranks = {t: i for i, t in enumerate(tokens) if t}
    left, right = np.full(len(tokens), -1, np.int32), np.full(len(tokens), -1, np.int32)
    for i, token in enumerate(tokens):
        if len(token) > 1:
            parts = merge_by_rank(token, ranks, i)
            left[i], right[i] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (-2, -2)
    return left, right


class Encoder:
    """Encodes pieces of text with one vocabulary; lives in a Python worker."""

    def __init__(self, tokens: list[bytes], left: np.ndarray, right: np.ndarray, pattern: str):
        self.tokens, self.left, self.right = tokens, left.tolist(), right.tolist()
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        reachable = [bool(t) and self.left[i] != -2 for i, t in enumerate(tokens)]
        for i, token in enumerate(tokens):
            if reachable[i]:
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(tokens)
        for i, token in enumerate(tokens):
            for n in range(len(token) - 1, 0, -1):
                j = self.ranks.get(token[:n], -1)
                if j >= 0 and reachable[j]:
                    self.shorter[i] = j
                    break
        self.lengths = [len(t) for t in tokens]
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}  # of a word its ids, packed: a third of what a tuple of numbers takes
        self.older: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of token a followed by token b leaves just these two tokens."""
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo merges from the latest backwards. At each step, x and y are the tokens that touch at the
        # border; if they form a token of lower rank than the merges undone so far, BPE joins them first.
        x, y, tokens, ranks = a, b, self.tokens, self.ranks
        bound = len(tokens)
        while True:
            joined = ranks.get(tokens[x] + tokens[y])
            if joined is not None and joined < bound:
                return False
            # Of the two, the merge of higher rank came last. On a tie (the same token twice) the left one
            # was merged first, so the right one is undone first.
            inner_x, inner_y = self.right[x], self.left[y]
            if inner_x < 0 and inner_y < 0:
                return True
            if inner_y < 0 or (inner_x >= 0 and x > y):
                x, bound = inner_x, x
            else:
                y, bound = inner_y, y + 1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, lengths, shorter, known = len(piece), self.lengths, self.shorter, self.pairs
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # ends only grow, so the longest comes last
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + lengths[token]
                if not dead[end]:
                    if not out:
                        break
                    fits = known.get(out[-1] << 32 | token)
                    if fits or (fits is None and self.compatible(out[-1], token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, token = end, longest[end]
            else:
                dead[at] = 1
                last = out.pop()
                at -= lengths[last]
                token = shorter[last]
        return out

    def encode(self, text: str) -> array.array:
        ids, memo, older = array.array("i"), self.memo, self.older
        for word in self.split(text):
            got = memo.get(word)
            if got is None:
                got = older.get(word)
                if got is None:
                    got = array.array("i", self.encode_piece(word.encode())).tobytes()
                if len(word) <= 64:
                    if len(memo) >= WORDS:
                        self.older, self.memo = older, memo = memo, {}
                    memo[word] = got
            ids.frombytes(got)
        return ids


_TABLES: dict[str, tuple] = {}
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _tables(spark: SparkSession, path: str):
    """The vocabulary with its last merges, broadcast: about 50 bytes a token, whatever the corpus."""
    app = spark.sparkContext.applicationId
    if (app, path) not in _TABLES:
        tokens = read_ranks(path)
        _TABLES[app, path] = spark.sparkContext.broadcast((tokens, *last_merges(tokens)))
    return _TABLES[app, path]


def decode_ids(ids: list[int], tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def encode(df: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", decoded: bool = False) -> DataFrame:
    """``id_column`` and ``token_ids`` (array of int) of every row; nothing is shuffled.

    ``vocabulary`` is the path of a rank file on the driver; its tables go to the workers once. With
    ``decoded`` the ids are also decoded again, in the same pass, into a column of that name.
    """
    tables = _tables(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (vocabulary, pattern) not in _ENCODERS:
            _ENCODERS[vocabulary, pattern] = Encoder(*tables.value, pattern)
        encoder = _ENCODERS[vocabulary, pattern]
        for batch in pieces(batches, text_column, PIECE):
            values, offsets, back = array.array("i"), [0], []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text) if text else ()
                values.extend(ids)
                offsets.append(len(values))
                if decoded:
                    back.append(decode_ids(ids, encoder.tokens))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, np.int32) if values else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *([pa.array(back, pa.binary())] if decoded else [])], names=schema.fieldNames())

    schema = T.StructType([df.schema[id_column], T.StructField("token_ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.BinaryType())] if decoded else [])])
    return rows(df, id_column, text_column).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of ``ids_column``. Null ids decode to no bytes."""
    tables = _tables(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            out = [decode_ids(ids or (), tables.value[0]) for ids in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(out, pa.binary())], names=[id_column, ids_column, "decoded"])

    schema = T.StructType([df.schema[id_column], df.schema[ids_column], T.StructField("decoded", T.BinaryType())])
    return rows(df, id_column, ids_column).mapInArrow(run, schema)


def checked(encode_piece: Callable[[bytes], list[int]], tokens: list[bytes], piece: bytes) -> bool:
    """Whether ``encode_piece`` gives what merging by rank gives (for tests)."""
    ranks = {t: i for i, t in enumerate(tokens) if t}
    plain = [ranks[piece]] if piece in ranks else [ranks[p] for p in merge_by_rank(piece, ranks, len(tokens))]
    return encode_piece(piece) == plain


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, from the ids and the bytes decoded from them."""
    import public_tokenizers
    from pyspark.sql import functions as F

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode(docs, vocabulary, public_tokenizers.PATTERN, decoded=True)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
