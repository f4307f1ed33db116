"""From chunks to places that can be shown: pages and boxes, or character ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import geometry


def citation_targets(chunks: DataFrame, documents: DataFrame, chunk_blocks: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each chunk with its document's name and regions: page_no and the box around its blocks there, in page order.

    chunks: chunk_id, document_id, text, char_start, char_end, section_path; documents:
    document_id, original_name; chunk_blocks: chunk_id, block_id; blocks: block_id, page_no, bbox.
    Blocks without a page or box give no region. A link may be there twice. Blocks are shuffled by
    their chunk alone, which serves pages, regions and the chunks' join.
    """
    placed = chunk_blocks.join(blocks.select("block_id", "page_no", "bbox"), "block_id", "left")
    placed = placed.where(F.col("page_no").isNotNull() & F.col("bbox").isNotNull())
    pages = placed.repartition("chunk_id").groupBy("chunk_id", "page_no").agg(geometry.union(F.col("bbox")).alias("bbox"))
    regions = pages.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "bbox"))).alias("regions"))
    kind = "array<struct<page_no:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"
    out = chunks.join(documents.select("document_id", F.col("original_name").alias("document_name")), "document_id").join(regions, "chunk_id", "left")
    return out.withColumn("regions", F.coalesce(F.col("regions").cast(kind), F.array().cast(kind)))


def is_locatable(bbox: Column, char_start: Column) -> Column:
    """A block must lie in a box or at characters."""
    return bbox.isNotNull() | char_start.isNotNull()


def passage_fields(score: str = "score") -> Column:
    """A passage's score as it is shown: six decimals, half to even."""
    return F.bround(F.col(score), 6)


def highlight_pages(regions: Column) -> Column:
    """A citation's pages, each once, ascending."""
    return F.array_sort(F.array_distinct(F.transform(regions, lambda r: r["page_no"])))


def percent_box(bbox: Column) -> Column:
    """A box as left, top, width and height in percent of the page."""
    p = lambda x: x * 100.0
    return F.struct(p(bbox["x0"]).alias("left"), p(bbox["y0"]).alias("top"), p(geometry.width(bbox)).alias("width"), p(geometry.height(bbox)).alias("height"))
