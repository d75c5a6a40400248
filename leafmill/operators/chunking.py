"""Overlapping chunks of document texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chunk length, overlap, and the share of a chunk's end in which a border is looked for.
LENGTH, OVERLAP, SEARCHED = 1200, 200, 0.25
#: Borders, best first; the last match within the searched part counts.
BORDERS = tuple(re.compile(p, re.S) for p in (r".*\n\n", r".*\n", r""".*[.!?。！？]["'’)\]]*\s"""))


def spans(text: str, length: int = LENGTH, overlap: int = OVERLAP, searched: float = SEARCHED) -> list[tuple[int, int]]:
    """Start and end of each window: an end moves back to the last paragraph, else line, else sentence end in its last part."""
    out, at = [], 0
    back = int(length * searched)
    while at < len(text):
        end = min(at + length, len(text))
        if end < len(text):
            low = max(end - back, at + overlap + 1)
            part = text[low:end]
            end = next((low + m.end() for b in BORDERS if (m := b.match(part))), end)
        out.append((at, end))
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def split_text(text: str | None) -> list[str]:
    return [c for a, b in spans(text or "") if (c := text[a:b].strip())]


def chunks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id_column, ordinal, text, chunk_hash`` of each chunk that is not blank. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [split_text(t) for t in batch.column(1).to_pylist()]
            owner = pa.array([i for i, c in enumerate(cut) for _ in c], pa.int64())
            ordinal = pa.array([k for c in cut for k in range(len(c))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), ordinal, pa.array([x for c in cut for x in c], pa.string())], names=[id_column, "ordinal", "text"])

    schema = T.StructType([docs.schema[id_column], T.StructField("ordinal", T.IntegerType()), T.StructField("text", T.StringType())])
    return docs.select(id_column, text_column).mapInArrow(run, schema).withColumn("chunk_hash", F.sha2("text", 256))


def chunk_id(path: Column, ordinal: Column, chunk_hash: Column) -> Column:
    """``path:ordinal:8 hexadecimal digits``, the same each time."""
    tail = F.substring(F.sha2(F.concat(path, ordinal.cast("string"), chunk_hash), 256), 1, 8)
    return F.concat_ws(":", path, ordinal.cast("string"), tail)


def joined_text(chunk_rows: DataFrame, id_column: str) -> DataFrame:
    """The full text of each document: its chunks in order, with a blank line between. A document's chunks are its own."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda c: c["text"])
    return chunk_rows.groupBy(id_column).agg(F.array_join(ordered, "\n\n").alias("full_text"))
