"""What the queries share: tables, and SQL fragments of the same meaning in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import geometry
from folioscope.functions.text import approx_tokens
from folioscope.sources.scratch import kept, scratch  # noqa: F401 - the plans take them from here

TOKENS = r"""CASE WHEN regexp_replace({0}, '^\s+|\s+$', '', 'g') = '' OR {0} IS NULL THEN 0 ELSE greatest(1, CAST(round_even(len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) * 1.3::DOUBLE, 0) AS INTEGER)) END"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens_sql(col: str) -> str:
    return TOKENS.format(col)


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each non-blank line of documents: document_id, reading_order, text, tokens."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("reading_order", "text"))
    return docs.where(F.trim("text") != "").withColumn("tokens", approx_tokens(F.col("text")))


LINE_BLOCKS = f"""
lines AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS reading_order FROM documents),
blocks AS (SELECT document_id, reading_order, text, {tokens_sql("text")} AS tokens FROM lines WHERE trim(text) <> '')"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles on pages, made of lineitem's numbers: order, line, corners in points, rotation."""
    li = load(spark, sf_dir, "lineitem")
    x = ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 500).cast("double")
    y = ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 29) % 700).cast("double")
    w, h = (F.col("l_quantity").cast("double") * 2 + 10), (F.col("l_quantity").cast("double") + 5)
    return li.select("l_orderkey", "l_linenumber", x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"), ((F.col("l_linenumber") % 4) * 90).cast("int").alias("rotation"))


RECTS = """
rects AS (
  SELECT l_orderkey, l_linenumber, x AS x0, y AS y0, x + w AS x1, y + h AS y1, CAST((l_linenumber % 4) * 90 AS INTEGER) AS rotation
  FROM (SELECT l_orderkey, l_linenumber, CAST((l_partkey * 37 + l_linenumber * 11) % 500 AS DOUBLE) AS x, CAST((l_suppkey * 53 + l_linenumber * 29) % 700 AS DOUBLE) AS y,
          CAST(l_quantity AS DOUBLE) * 2 + 10 AS w, CAST(l_quantity AS DOUBLE) + 5 AS h FROM lineitem)),
turned AS (
  SELECT *, CASE rotation WHEN 0 THEN x0 WHEN 90 THEN y0 WHEN 180 THEN 612.0 - x1 ELSE 792.0 - y1 END AS l, CASE rotation WHEN 0 THEN 792.0 - y1 WHEN 90 THEN x0 WHEN 180 THEN y0 ELSE 612.0 - x1 END AS t,
    CASE rotation WHEN 0 THEN x1 WHEN 90 THEN y1 WHEN 180 THEN 612.0 - x0 ELSE 792.0 - y0 END AS r, CASE rotation WHEN 0 THEN 792.0 - y0 WHEN 90 THEN x1 WHEN 180 THEN y1 ELSE 612.0 - x0 END AS b,
    CASE WHEN rotation IN (0, 180) THEN 612.0::DOUBLE ELSE 792.0::DOUBLE END AS w, CASE WHEN rotation IN (0, 180) THEN 792.0::DOUBLE ELSE 612.0::DOUBLE END AS h FROM rects),
snapped AS (
  SELECT l_orderkey, l_linenumber, rotation,
    CASE WHEN l / w < 1e-9 THEN 0 WHEN l / w > 1 - 1e-9 THEN 1 ELSE l / w END AS x0, CASE WHEN t / h < 1e-9 THEN 0 WHEN t / h > 1 - 1e-9 THEN 1 ELSE t / h END AS y0,
    CASE WHEN r / w < 1e-9 THEN 0 WHEN r / w > 1 - 1e-9 THEN 1 ELSE r / w END AS x1, CASE WHEN b / h < 1e-9 THEN 0 WHEN b / h > 1 - 1e-9 THEN 1 ELSE b / h END AS y1
  FROM turned)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rectangles as boxes on the displayed page of 612 by 792 points."""
    placed = geometry.with_boxes(rects(spark, sf_dir), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(612.0), F.lit(792.0), F.col("rotation"))
    return placed.select("l_orderkey", "l_linenumber", "rotation", "bbox")


def r6(c: Column) -> Column:
    """Rounded for comparison."""
    return F.round(c, 6)
