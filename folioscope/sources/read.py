"""Reading files and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import geometry, text

MOST_UPLOAD = 100 << 20


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """filename, content and length of each file below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "length", "content")


def intake(files: DataFrame, content: str = "content", most: int = MOST_UPLOAD) -> DataFrame:
    """files with sha256 and status: 200, 400 for an empty file, 413 for one above the limit (neither is hashed)."""
    size = F.coalesce(F.length(content), F.lit(0))
    status = F.when(size == 0, 400).when(size > most, 413).otherwise(200)
    return files.withColumn("status", status).withColumn("sha256", F.when(status == 200, F.sha2(F.col(content), 256)))


def decoded_text(content: Column) -> Column:
    """Bytes as text if they are UTF-8, else null: such a file is a permanent failure."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def recordset(df: DataFrame, json: str, schema: str) -> DataFrame:
    """A row for each object of a JSON array, with the columns of a schema; other columns of df stay in front."""
    keys = [c for c in df.columns if c != json]
    return df.select(*keys, F.inline(F.from_json(F.col(json), f"array<struct<{schema}>>")))


def variant_records(df: DataFrame, json: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """df without json, with valid and a column for each name -> (path, type) of records whose fields differ from row to row.

    A value of another type, or one that isn't there, is null; text that is no JSON is not valid. A path: ``$.device.os``.
    """
    rows = df.withColumn("_v", F.try_parse_json(json))
    found = [F.try_variant_get("_v", path, kind).alias(name) for name, (path, kind) in fields.items()]
    return rows.select(*[c for c in df.columns if c != json], (F.col("_v").isNotNull() | F.col(json).isNull()).alias("valid"), *found)


def variant_fields(df: DataFrame, json: str, path: str = "$") -> DataFrame:
    """df without json, with pos, key, value and type of each field (or element) of the object (or array) at a path; records without one give no row."""
    df.select(*df.columns, F.try_variant_get(F.try_parse_json(json), path, "variant").alias("_v")).createOrReplaceTempView(view := f"variant_{uuid.uuid4().hex}")
    keys = ", ".join(f"r.`{c}`" for c in df.columns if c != json)
    return df.sparkSession.sql(f"SELECT {keys}{', ' if keys else ''}f.pos, f.key, f.value, schema_of_variant(f.value) AS type FROM {view} r, LATERAL variant_explode(r._v) f")


def document_blocks(blocks: DataFrame, document_id: str) -> DataFrame:
    """One document's blocks in reading order; flow blocks, which have no page, first."""
    return blocks.where(F.col("document_id") == document_id).orderBy(F.coalesce("page_no", F.lit(0)), "reading_order")


def list_documents(documents: DataFrame, chunks: DataFrame, limit: int = 50) -> DataFrame:
    """The newest documents with their number of chunks under each strategy; chunk_count is that of layout, and 0 without any."""
    newest = documents.orderBy(F.desc("created_at"), "document_id").limit(limit)
    counts = chunks.join(F.broadcast(newest.select("document_id")), "document_id", "left_semi").groupBy("document_id", "strategy").agg(F.count(F.lit(1)).alias("n"))  # limit rows
    per_document = counts.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("strategy", "n")))).alias("chunks"), F.sum(F.when(F.col("strategy") == "layout", F.col("n"))).alias("chunk_count"))
    return newest.join(per_document, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def pdf_fragments(rects: DataFrame) -> DataFrame:
    """Located paragraph blocks from a table of text rectangles of PDF pages.

    rects: document_id, page_no, rect_no, text, x0, y0, x1, y1 (points), width, height, rotation.
    Rectangles without text or without a size on the page are skipped; reading_order counts a
    document's kept fragments from 1.
    """
    place = ("x0", "y0", "x1", "y1", "width", "height", "rotation")
    written = rects.where(F.col("text").rlike(text.NOT_BLANK))
    rows = written.select("document_id", "page_no", "rect_no", text.strip(F.col("text")).alias("text"), *place)
    rows = geometry.with_boxes(rows, *[F.col(c) for c in place]).where(geometry.is_valid(F.col("bbox")))
    order = Window.partitionBy("document_id").orderBy("page_no", "rect_no", "bbox")
    return rows.select("document_id", "page_no", F.row_number().over(order).alias("reading_order"), F.lit("paragraph").alias("kind"), "text", "bbox", F.lit("native").alias("origin"))
