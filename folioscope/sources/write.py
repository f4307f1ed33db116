"""Idempotent writes: rerunning one replaces what it wrote before, and adds nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_documents(uploads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """uploads (tenant_id, sha256, document_id, created_at, ...) with created and the id that stands.

    The first upload of a content wins, by time, then id; contents that are there keep their id.
    """
    key = ["tenant_id", "sha256"]
    order = Window.partitionBy(*key).orderBy("created_at", "document_id")
    rows = uploads.withColumn("_first", F.first("document_id").over(order)).withColumn("_n", F.row_number().over(order))
    if existing is not None:
        there = existing.groupBy(*key).agg(F.min("document_id").alias("_there"))
        rows = rows.join(there, key, "left")
    else:
        rows = rows.withColumn("_there", F.lit(None).cast("string"))
    return rows.withColumn("created", F.col("_there").isNull() & (F.col("_n") == 1)).withColumn("stands", F.coalesce("_there", F.col("_first").cast("string"))).drop("_first", "_n", "_there")


def upserted(existing: DataFrame, changes: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """existing with changes by key; columns in keep hold their old value, null changes too."""
    old = existing.select(*key, *[F.col(c).alias(f"_old_{c}") for c in existing.columns if c not in key], F.lit(True).alias("_there"))
    new = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in existing.columns if c not in key and c in changes.columns])
    both = old.join(new, key, "full")
    value = lambda c: F.when(F.col("_there"), F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}")) if c in keep else F.coalesce(f"_new_{c}", f"_old_{c}")
    return both.select(*[F.col(c) if c in key else (value(c) if c in changes.columns else F.col(f"_old_{c}")).alias(c) for c in existing.columns])


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write df so that exactly those partitions that it has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def without_documents(table: DataFrame, documents: DataFrame, by: str = "document_id") -> DataFrame:
    """table without the rows of some documents, a table of ids; null ids stay."""
    return table.join(documents.select(by).distinct(), by, "left_anti").select(*table.columns)


def chunk_links(chunks: DataFrame, key: list[str]) -> DataFrame:
    """key, block_id and ordinal: a chunk's blocks in order; a block that is named twice keeps its first place."""
    rows = chunks.select(*key, F.posexplode("block_ids").alias("ordinal", "block_id"))
    return rows.groupBy(*key, "block_id").agg(F.min("ordinal").alias("ordinal"))


def block_rows(blocks: DataFrame) -> DataFrame:
    """Blocks as they are stored: a page number only where there is a box, and an id that a retry repeats."""
    return blocks.withColumn("page_no", F.when(F.col("bbox").isNotNull(), F.col("page_no"))).withColumn("block_id", F.sha2(F.concat_ws("/", "document_id", F.col("reading_order").cast("string")), 256))


def chunk_ids(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """chunks with chunk_id, the same whenever the same chunk is made."""
    return chunks.withColumn("chunk_id", F.substring(F.sha2(F.concat_ws("/", F.col(key).cast("string"), "strategy", F.col("seq").cast("string")), 256), 1, 32))


def with_prefixes(chunks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """chunks with context_prefix from (chunk_id, context_prefix), of every strategy; a chunk without one keeps null."""
    return chunks.drop("context_prefix").join(prefixes.select("chunk_id", "context_prefix"), "chunk_id", "left")


def updated_documents(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """documents with found formats: mime, family and page_count where a change has them; status becomes processing."""
    new = changes.select("document_id", *[F.col(c).alias(f"_{c}") for c in ("mime", "family", "page_count")], F.lit("processing").alias("_status"))
    out = documents.join(new, "document_id", "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in ("mime", "family", "page_count", "status") else F.col(c) for c in documents.columns])
