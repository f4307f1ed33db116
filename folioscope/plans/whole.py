"""Queries over the whole way from files to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import engine
from folioscope.plans.common import kept, load
from folioscope.plans.texts import letter_vectors


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown, text and CSV files, their copies included, and pages as HTML files."""
    ext = F.element_at(F.array(F.lit(".md"), F.lit(".txt"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = load(spark, sf_dir, "documents").select(F.concat(F.lit("file"), F.col("doc_id").cast("string"), ext).alias("filename"), F.col("text").cast("binary").alias("content"))
    pages = load(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), F.col("html").cast("binary").alias("content"))
    return docs.unionByName(pages)


def _embedder():
    return letter_vectors


def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each distinct file: its format and status, and its chunks."""
    c = engine.ingest(_files(spark, sf_dir), kept=kept, target=256, overlap=32)
    n = c.chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("char_end").alias("char_end"))
    return c.documents.join(n, "document_id", "left").select("sha256", "original_name", "extension", "family", "status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def ask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items asked of the ingested files."""
    # one batch of questions reads vectors and links once: they are made as they are read
    c = engine.stored(engine.ingest(_files(spark, sf_dir), embedder=_embedder, kept=kept, target=256, overlap=32), kept, ("documents", "postings"))
    words = F.split("text", r"\s+")
    questions = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " or ").alias("text"))
    got = engine.ask(c, questions, _embedder, kept=kept)
    return got.select("query_id", "position", "chunk_id", "document_name", "score", "n_retrievers", "char_start", "char_end")


QUERIES = {"ingest_documents": ingest_documents, "ask_documents": ask_documents}
ORACLES: dict[str, str] = {}
