"""Queries over stores, untyped records, intervals, boxes and table functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import boxes as boxes_
from folioscope.operators import spans, tablefunctions
from folioscope.plans.common import boxes, kept, load, r6, scratch
from folioscope.plans.texts import MARKDOWN_SQL
from folioscope.sources import formats, heads, read, store


def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines as spans of one long document, and the ranges of orders that they touch."""
    li, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    start = F.col("l_orderkey") * 40 + F.col("l_linenumber") * 5
    blocks = li.select(F.lit("all").alias("document_id"), start.alias("span_start"), (start + F.col("l_quantity").cast("long") % 9 + 1).alias("span_end"))
    ranges = o.select(F.lit("all").alias("document_id"), "o_orderkey", (F.col("o_orderkey") * 40 - 7).alias("range_start"), (F.col("o_orderkey") * 40 + 60 + F.col("o_custkey") % 100).alias("range_end"))
    found = spans.overlapping(blocks, ranges, ["document_id"])
    return found.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("span_start").alias("first_start"), F.max("span_end").alias("last_end"))


SPANS_SQL = """
WITH s AS (SELECT l_orderkey * 40 + l_linenumber * 5 AS a, l_orderkey * 40 + l_linenumber * 5 + CAST(l_quantity AS BIGINT) % 9 + 1 AS b FROM lineitem),
r AS (SELECT o_orderkey, o_orderkey * 40 - 7 AS c, o_orderkey * 40 + 60 + o_custkey % 100 AS d FROM orders)
SELECT o_orderkey, count(*) AS n_blocks, min(a) AS first_start, max(b) AS last_end FROM s JOIN r ON a < d AND b > c GROUP BY o_orderkey
"""


def merge_one_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of all order lines, moved apart by order, as one page that grows with the table."""
    flat = boxes(spark, sf_dir).withColumn("dx", (F.col("l_orderkey") % 64).cast("double") / 3).withColumn("dy", (F.floor(F.col("l_orderkey") / 64)).cast("double") / 3)
    moved = F.struct(*[(F.col("bbox")[c] + F.col("d" + c[0])).alias(c) for c in ("x0", "y0", "x1", "y1")])
    page = flat.select(F.lit(1).alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"), moved.alias("bbox"))
    merged = boxes_.merge_overlapping(page, ["page"], kept, at_least=0.3)
    return merged.select("page", "seed", "n_boxes", *[r6(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def dedupe_against_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document uploaded against a bucketed store that holds a third of them: what exists keeps its id."""
    docs = load(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = docs.select(F.lit("default").alias("tenant_id"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("created_at"))
    table = f"store_{uuid.uuid4().hex}"
    old = rows.withColumn("document_id", F.concat(F.lit("old-"), F.lpad("document_id", 12, "0"))).where("created_at % 3 = 1")
    store.create(old.groupBy("tenant_id", "sha256").agg(F.min("document_id").alias("document_id")), table, scratch(spark))
    return store.insert_or_get(rows, table).select("document_id", "sha256", "created", "stands")


STORE_SQL = """
WITH d AS (SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL),
old AS (SELECT sha256, min('old-' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS there FROM d WHERE doc_id % 3 = 1 GROUP BY sha256)
SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256, there IS NULL AND doc_id = min(doc_id) OVER (PARTITION BY sha256) AS created, coalesce(there, CAST(min(doc_id) OVER (PARTITION BY sha256) AS VARCHAR)) AS stands
FROM d LEFT JOIN old USING (sha256)
"""


def upsert_in_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages: a bucketed table of older ones takes updates and new rows; the render address holds."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_no"), F.col("o_totalprice").cast("double").alias("width"))
    table = f"pages_{uuid.uuid4().hex}"
    store.create(o.where("page_no % 3 > 0").withColumn("render_uri", F.lit("old")), table, scratch(spark), ("document_id", "page_no"))
    changes = o.where("page_no % 3 < 2").select("document_id", "page_no", (F.col("width") + 1).alias("width"), F.lit("new").alias("render_uri"))
    return store.upsert(changes, table, ("document_id", "page_no"), ("render_uri",))


STORE_UPSERT_SQL = "SELECT o_custkey AS document_id, o_orderkey AS page_no, CAST(o_totalprice AS DOUBLE) + CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 0 END AS width, CASE WHEN o_orderkey % 3 > 0 THEN 'old' ELSE 'new' END AS render_uri FROM orders"


def variant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of clicks' properties, which are numbers or words, nested, missing or broken from row to row."""
    fields = {"k": ("$.k", "bigint"), "k_text": ("$.k", "string"), "os": ("$.device.os", "string"), "ver": ("$.device.ver", "string"), "first_sku": ("$.items[0].sku", "bigint"), "tag": ("$.tags[1]", "string")}
    return read.variant_records(load(spark, sf_dir, "clicks").select("click_id", "props"), "props", fields)


VARIANT_SQL = """
SELECT click_id, props IS NULL OR json_valid(props) AS valid, TRY_CAST(CASE WHEN json_valid(props) THEN props ->> '$.k' END AS BIGINT) AS k,
  CASE WHEN json_valid(props) THEN props ->> '$.k' END AS k_text, CASE WHEN json_valid(props) THEN props ->> '$.device.os' END AS os, CASE WHEN json_valid(props) THEN props ->> '$.device.ver' END AS ver,
  CAST(CASE WHEN json_valid(props) THEN props ->> '$.items[0].sku' END AS BIGINT) AS first_sku, CASE WHEN json_valid(props) THEN props ->> '$.tags[1]' END AS tag
FROM clicks
"""


def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field of the properties has each type."""
    rows = read.variant_fields(load(spark, sf_dir, "clicks").select("click_id", "props"), "props")
    kind = F.regexp_replace(F.lower(F.regexp_extract("type", r"^\w+", 0)), "bigint|decimal|double", "number")
    return rows.groupBy("key", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


FIELDS_SQL = """
WITH v AS (SELECT CAST(props AS JSON) AS j FROM clicks WHERE json_valid(props)),
f AS (SELECT j, unnest(json_keys(j)) AS key FROM v)
SELECT key, CASE json_type(j, '$.' || key) WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'void' ELSE lower(json_type(j, '$.' || key)) END AS kind, count(*) AS n
FROM f GROUP BY ALL
"""


def variant_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of all clicks as rows: their place, number and quantity."""
    rows = read.variant_fields(load(spark, sf_dir, "clicks").select("click_id", "props"), "props", "$.items")
    return rows.select("click_id", "pos", F.try_variant_get("value", "$.sku", "bigint").alias("sku"), F.try_variant_get("value", "$.qty", "bigint").alias("qty"))


ITEMS_SQL = """
WITH i AS (SELECT click_id, unnest(CAST(props -> '$.items' AS JSON[])) AS item, generate_subscripts(CAST(props -> '$.items' AS JSON[]), 1) - 1 AS pos FROM clicks WHERE json_valid(props) AND json_type(props, '$.items') = 'ARRAY')
SELECT click_id, CAST(pos AS INTEGER) AS pos, CAST(item ->> '$.sku' AS BIGINT) AS sku, CAST(item ->> '$.qty' AS BIGINT) AS qty FROM i
"""


def split_flow_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose short lines are headings, split by a table function from SQL."""
    tablefunctions.register(spark)
    marked = F.regexp_replace("text", r"(?m)^([^ \n]+ ?[^ \n]*)$", "## $1")
    load(spark, sf_dir, "documents").select("doc_id", marked.alias("text"), F.lit("md").alias("extension")).createOrReplaceTempView(view := f"files_{uuid.uuid4().hex}")
    return spark.sql(f"SELECT doc_id, reading_order, kind, char_start, char_end, array_join(section_path, ' > ') AS section FROM split_flow(TABLE(SELECT * FROM {view}), 'text', 'extension')")


def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of the tables are, told from their first bytes."""
    found = heads.file_heads(spark, sf_dir).where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", F.col("head").alias("content"))
    return formats.detect(found.withColumn("parquet", F.substring("content", 1, 4) == F.lit(bytearray(b"PAR1"))), containers=False).select("filename", "length", "parquet", "family", "error")


QUERIES = {
    "span_overlaps": span_overlaps, "merge_one_page": merge_one_page, "dedupe_against_store": dedupe_against_store, "upsert_in_store": upsert_in_store, "variant_records": variant_records,
    "variant_fields": variant_fields, "variant_items": variant_items, "split_flow_sql": split_flow_sql, "file_formats": file_formats,
}
ORACLES = {
    "span_overlaps": SPANS_SQL, "dedupe_against_store": STORE_SQL, "upsert_in_store": STORE_UPSERT_SQL, "variant_records": VARIANT_SQL, "variant_fields": FIELDS_SQL, "variant_items": ITEMS_SQL, "split_flow_sql": MARKDOWN_SQL,
}
