"""All queries of the library, for the driver's entry file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ORACLES, QUERIES, answers, built, index_queries, relational, scalar  # noqa: F401  the modules register their queries
from .functions import text as tx
from .operators import chunking, search


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of the document corpus for a query: split, index, score, rank, fetch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("path", scalar.file_path())
    cut = chunking.chunks(docs, "path", "text")
    corpus = cut.select(chunking.chunk_id(F.col("path"), F.col("ordinal"), F.col("chunk_hash")).alias("chunk_id"), F.col("path").alias("relative_path"), "text", F.lit(False).alias("has_visual"))
    return search.hybrid(corpus, search.postings(corpus), search.statistics(search.lengths(corpus)), "the ering of tion", 8).withColumn("n_chars", F.length("text")).select("chunk_id", "relative_path", "score", tx.snippet(F.col("snippet")).alias("snippet"), "n_chars")
