"""Indexes of the JSON formats 2 and 3 as tables: a manifest, documents, lines of chunks, and a NumPy matrix of vectors."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from . import files as source

# What the files of such an index hold.
_FILE = "struct<relativePath:string,status:string,size:bigint,mtime:double,parser:string,chunks:int,contentHash:string,errorReason:string>"
_MANIFEST = f"version int, rootPath string, retrievalMode string, indexEngine string, embeddingModelKey string, embeddingDimension int, files array<{_FILE}>"
_SHEET = "struct<name:string,rowCount:int,columnCount:int,headerHints:array<string>>"
_DOCUMENT = f"relativePath string, parser string, size bigint, mtime double, contentHash string, chunks int, tokenEstimate bigint, summary string, sectionHints array<string>, structure struct<sheetCount:int,rowCount:int,sheetNames:array<string>,columnHints:array<string>,sheets:array<{_SHEET}>>"
_CHUNK = "label int, chunkId string, relativePath string, text string, chunkHash string, chunkType string, sheetName string, rowNumber int, visualAssets array<struct<kind:string,pageNumber:int,label:string,mediaPath:string,anchorText:string>>"
VERSIONS = (2, 3)


def legacy_tables(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of an index in ``folder`` and its settings; an error if its format is another.

    Chunks and documents are read in parallel; the rows of the matrix are joined to the chunks that name them.
    """
    manifest = spark.read.schema(_MANIFEST).json(f"{folder}/manifest.json", multiLine=True)
    head = manifest.select("version", "retrievalMode", "indexEngine", "embeddingModelKey", "embeddingDimension").first()
    if head is None or head[0] not in VERSIONS:
        raise ValueError("Unsupported index version.")
    vector_mode = head[0] == 2 or (head[1] or "vector") == "vector"
    f = manifest.select(F.explode("files").alias("f")).where("f.relativePath <> ''")
    files = f.select("f.relativePath", "f.status", F.coalesce("f.size", F.lit(0)), F.coalesce("f.mtime", F.lit(0.0)), F.coalesce("f.parser", F.lit("")), F.coalesce("f.chunks", F.lit(0)), "f.contentHash", "f.errorReason")
    d = spark.read.schema(_DOCUMENT).json(f"{folder}/documents.json", multiLine=True).where("relativePath <> ''")
    documents = d.select("relativePath", "parser", "size", "mtime", "contentHash", "chunks", "tokenEstimate", "summary", "sectionHints", F.col("structure").cast(source.STRUCTURE), F.lit(None).cast(source.ASSETS))
    lines = spark.read.schema(_CHUNK).json(f"{folder}/chunk_metadata.jsonl").withColumn("nth", F.monotonically_increasing_id()).where("chunkId is not null")
    ordinal = (F.row_number().over(Window.partitionBy("relativePath").orderBy("nth")) - 1).alias("ordinal")
    assets = F.transform("visualAssets", lambda a: F.struct(a["kind"], a["pageNumber"], a["label"], a["mediaPath"], a["anchorText"])).cast(source.ASSETS)
    chunks = lines.select("chunkId", "relativePath", ordinal, "text", "chunkHash", F.coalesce(F.size("visualAssets") > 0, F.lit(False)), "chunkType", "sheetName", "rowNumber", assets)
    tables = {"files": files, "documents": documents, "chunks": chunks}
    if vector_mode:
        tables["vectors"] = _vectors(lines, f"{folder}/vectors.npy")
    return tables, {"mode": "vector" if vector_mode else "keyword", "engine": head[2] or ("codes" if vector_mode else None), "model": head[3], "dim": head[4]}


def _vectors(lines: DataFrame, path: str) -> DataFrame:
    """Vectors of the chunks that name a row of the matrix, which is read by its address, wherever it lies; an error if it is not there.

    A NumPy file cannot be split, and one of more than 2 GB is refused by Spark's reader: one task turns it into rows, in batches.
    """
    spark = lines.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there):
        raise FileNotFoundError(f"The index has vectors, but {path} is not there.")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                matrix = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                if matrix.ndim != 2:
                    raise ValueError(f"{path} holds no matrix")
                for at in range(0, len(matrix), 1000):
                    part = matrix[at : at + 1000].astype(np.float64)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part)), pa.int32()), values], names=["label", "v"])

    matrix = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "label int, v array<double>")
    found = lines.where("label is not null").select("chunkId", "relativePath", "chunkHash", "label").join(matrix, "label")
    return found.select("chunkId", "relativePath", "chunkHash", F.size("v").alias("dim"), vx.scale(F.col("v")).alias("scale"), vx.codes(F.col("v")).alias("codes"))
