"""Citations, prompts, answers, chat requests, costs, and relational smoke queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import highlight_window, marker_split
from folioscope.operators import answer, chunk, resolve
from folioscope.plans.common import RECTS, boxes, load, r6


def citation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks, customers as documents, lines as blocks on three pages."""
    chunks = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"))
    docs = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("original_name"))
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    links = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), key.alias("block_id"))  # links need no boxes
    b = boxes(spark, sf_dir).select(key.alias("block_id"), F.col("l_linenumber").alias("n"), "bbox")
    # the least of structs is found by sorting: one sort, by the join's key, behind one shuffle
    blocks = b.repartition("block_id").groupBy("block_id", "n").agg(F.min("bbox").alias("bbox"))
    blocks = blocks.withColumn("page_no", F.when(F.col("n") != 7, F.col("n") % 3).cast("int"))
    got = resolve.citation_targets(chunks, docs, links, blocks.select("block_id", "page_no", "bbox"))
    return got.select("chunk_id", "document_name", F.size("regions").alias("n_regions"), F.array_join(resolve.highlight_pages(F.col("regions")), ",").alias("pages"), r6(F.try_element_at("regions", F.lit(1))["bbox"]["y1"]).alias("y1"))


TARGETS_SQL = f"""
WITH {RECTS},
blocks AS (SELECT l_orderkey, l_linenumber AS n, arg_min(y1, (x0, y0, x1, y1)) AS y1 FROM snapped GROUP BY ALL),
pages AS (SELECT l_orderkey, n % 3 AS page_no, max(y1) AS y1 FROM blocks WHERE n <> 7 GROUP BY ALL),
regions AS (SELECT l_orderkey, count(*) AS n, string_agg(page_no, ',' ORDER BY page_no) AS pages, arg_min(y1, page_no) AS y1 FROM pages GROUP BY ALL)
SELECT o_orderkey AS chunk_id, c_name AS document_name, CAST(coalesce(n, 0) AS INTEGER) AS n_regions, coalesce(pages, '') AS pages, round(y1, 6) AS y1
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN regions ON l_orderkey = o_orderkey
"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's eight passages: documents in a fixed pattern, with a section for some and a page for others."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    docs = load(spark, sf_dir, "documents")
    n = items.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("position")).withColumn("doc_id", (F.col("query_id") * 8 + F.col("position")) * 7919 % max(1, docs.count()))
    return n.join(docs.select("doc_id", "source", "text"), "doc_id").select("query_id", "position", F.col("source").alias("document_name"), "text", F.when(F.col("position") % 2 == 0, F.array(F.lit("A"), F.lit("B"))).alias("section_path"), F.when(F.col("position") % 3 == 0, F.col("position")).alias("page_no"))


PASSAGES_SQL = "passages AS (SELECT item_id AS query_id, position, source AS document_name, d.text, position % 2 = 0 AS has_path, CASE WHEN position % 3 = 0 THEN position END AS page_no FROM benchmark, range(1, 9) AS r(position) JOIN documents d ON d.doc_id = (item_id * 8 + position) * 7919 % (SELECT count(*) FROM documents))"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.build_prompts(_questions(spark, sf_dir), _passages(spark, sf_dir)).select("query_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


PROMPT_SQL = f"""
WITH {PASSAGES_SQL},
j AS (SELECT query_id, string_agg('[' || position || '] ' || document_name || CASE WHEN has_path THEN ' — A > B' ELSE '' END || CASE WHEN page_no IS NOT NULL THEN ' (page ' || page_no || ')' ELSE '' END || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS s FROM passages GROUP BY query_id),
p AS (SELECT query_id, 'Passages:' || chr(10) || chr(10) || s || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || b.text AS prompt FROM j JOIN benchmark b ON b.item_id = query_id)
SELECT query_id, CAST(length(prompt) AS INTEGER) AS n_chars, md5(prompt) AS prompt_md5 FROM p
"""


def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with its passages, and each once more as a question that found none."""
    asked = _questions(spark, sf_dir)
    asked = asked.unionByName(asked.withColumn("query_id", -1 - F.col("query_id")))
    return answer.extractive_answers(asked, _passages(spark, sf_dir)).select("query_id", F.md5("answer").alias("answer_md5"))


SNIPPET_SQL = "CASE WHEN length({0}) > 600 THEN CASE WHEN contains(left({0}, 600), ' ') THEN regexp_replace(left({0}, 600), '(?s) [^ ]*$', '') ELSE left({0}, 600) END || '…' ELSE {0} END"
EXTRACTIVE_SQL = f"""
WITH {PASSAGES_SQL},
t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS inside FROM passages),
j AS (SELECT query_id, '_{answer.NO_MODEL}_' || chr(10) || chr(10) || string_agg('**[' || position || '] ' || document_name || '**' || chr(10) || {SNIPPET_SQL.format("inside")} || chr(10), chr(10) ORDER BY position) AS a FROM t GROUP BY query_id)
SELECT item_id AS query_id, md5(coalesce(a, '{answer.NOTHING_FOUND}')) AS answer_md5 FROM benchmark LEFT JOIN j ON query_id = item_id
UNION ALL SELECT -1 - item_id, md5('{answer.NOTHING_FOUND}') FROM benchmark
"""


def extractive_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", answer.snippet(F.col("text")).alias("snippet"))


def resolve_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite in and out of range, and twice."""
    text = F.concat(F.lit("So ["), (F.col("item_id") % 12).cast("string"), F.lit("] and [3], again [3]; see [99] [0] ["), (F.col("item_id") % 5 + 1).cast("string"), F.lit("]."))
    answers = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("answer"))
    got = answer.resolve_citations(answers, _passages(spark, sf_dir))
    return answer.citation_payload(got).select("query_id", "marker", "document_name", "page_no")


MARKERS_SQL = f"""
WITH {PASSAGES_SQL},
m AS (SELECT DISTINCT item_id AS query_id, unnest([item_id % 12, 3, 99, 0, item_id % 5 + 1]) AS marker FROM benchmark)
SELECT m.query_id, CAST(marker AS INTEGER) AS marker, document_name, CAST(page_no AS INTEGER) AS page_no FROM m JOIN passages p ON p.query_id = m.query_id AND p.position = marker
"""


def marker_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.substring("text", 1, 20), F.lit("[1][23] x"), F.expr("substring(text, 21)"), F.lit("[4]"))
    return load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(marker_split(text)).alias("part_no", "part"))


PARTS_SQL = "SELECT item_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS part_no, unnest(p) AS part FROM (SELECT item_id, [left(text, 20), '[1]', '[23]', ' x' || substr(text, 21), '[4]'] AS p FROM benchmark)"


def flow_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", highlight_window(F.col("text"), F.lit(30), F.lit(50), 25).alias("h")).select("doc_id", "h.*")


FLOW_SQL = "SELECT doc_id, substr(text, 6, 25) AS before, substr(text, 31, 20) AS marked, substr(text, 51, 25) AS after FROM documents"


def paged_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "bbox", resolve.percent_box(F.col("bbox")).alias("p"))
    return b.select("l_orderkey", "l_linenumber", *[r6(F.col(f"p.{c}")).alias(c) for c in ("left", "top", "width", "height")], resolve.is_locatable(F.col("bbox"), F.lit(None).cast("int")).alias("locatable"))


PAGED_SQL = f'WITH {RECTS} SELECT l_orderkey, l_linenumber, round(x0 * 100, 6) AS "left", round(y0 * 100, 6) AS top, round((x1 - x0) * 100, 6) AS width, round((y1 - y0) * 100, 6) AS height, true AS locatable FROM snapped'


def last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.last_user_turns(load(spark, sf_dir, "conversations"))


TURN_SQL = "SELECT conv_id, arg_max(text, (turn, text)) AS query FROM conversations WHERE role = 'user' AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY conv_id"


def model_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested model names made of events."""
    names = F.array(*[F.lit(x) for x in ("folio", "folio-fixed", "folio-semantic", "folio-none", "other", "")])
    e = load(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("model"))
    return e.select("event_id", answer.strategy_of(F.col("model"), "folio").alias("s")).select("event_id", "s.strategy", "s.error")


MODEL_SQL = "SELECT event_id, (['layout', 'fixed', 'semantic', NULL, NULL, 'layout'])[event_id % 6 + 1] AS strategy, CASE WHEN event_id % 6 = 3 THEN 'model not found: folio-none' WHEN event_id % 6 = 4 THEN 'model not found: other' END AS error FROM events"


def message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as the parts of one message; turns of the assistant are images here."""
    c = load(spark, sf_dir, "conversations")
    parts = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", "text").otherwise("image_url").alias("type"), "text"))).alias("p"))
    return parts.select("conv_id", F.md5(answer.flat_content(F.col("p"))).alias("text_md5"))


PARTS_TEXT_SQL = "SELECT conv_id, md5(coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'user'), '')) AS text_md5 FROM conversations GROUP BY conv_id"


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("user_id") % 100).alias("output_tokens"))
    prices = answer.price_table(spark, [("click", 2.5, 10.0), ("view", 0.15, 0.6)])
    return answer.usage_cost(e, prices).select("event_id", "model", "priced", F.round("cost_usd", 9).alias("cost_usd"))


COST_SQL = """
SELECT event_id, event_type AS model, event_type IN ('click', 'view') AS priced,
  round(CASE event_type WHEN 'click' THEN (event_id % 1000 * 2.5::DOUBLE + user_id % 100 * 10.0::DOUBLE) / 1000000 WHEN 'view' THEN (event_id % 1000 * 0.15::DOUBLE + user_id % 100 * 0.6::DOUBLE) / 1000000 ELSE 0 END, 9) AS cost_usd FROM events
"""


def deepest_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of the section paths of an order's lines, the first of equally long ones."""
    li = load(spark, sf_dir, "lineitem")
    path = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("l_partkey") % 4).cast("int"))
    rows = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).withColumn("p", F.transform(path, lambda x: F.concat(x, F.col("l_linenumber").cast("string"))))
    return rows.groupBy("l_orderkey").agg(F.array_join(chunk.deepest(F.col("p"), F.col("l_linenumber")), ">").alias("section"))


DEEPEST_SQL = """
WITH r AS (SELECT l_orderkey, l_linenumber AS n, min(l_partkey) % 4 AS k FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey, arg_max((n, k), (k, -n)) AS x FROM r GROUP BY l_orderkey)
SELECT l_orderkey, CASE x[2] WHEN 0 THEN '' WHEN 1 THEN 'a' || x[1] WHEN 2 THEN 'a' || x[1] || '>b' || x[1] ELSE 'a' || x[1] || '>b' || x[1] || '>c' || x[1] END AS section FROM b
"""


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    price, discount = F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("sum_qty"), F.round(F.sum(price * (1 - discount)), 2).alias("revenue"), F.round(F.avg(discount), 6).alias("avg_discount"))


PRICING_SQL = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(CAST(l_quantity AS DOUBLE)), 2) AS sum_qty, round(sum(CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE))), 2) AS revenue, round(avg(CAST(l_discount AS DOUBLE)), 6) AS avg_discount FROM lineitem GROUP BY ALL"


def customer_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with a pre-aggregated count, as a correlated subquery would say it, and a top-k a nation."""
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    c = load(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
    top = c.withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n_orders"), "c_custkey"))).where("rank <= 3")
    return top.join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "n_orders", "rank")


ACTIVITY_SQL = """
WITH c AS (SELECT c_custkey, c_nationkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer)
SELECT n_name, c_custkey, n_orders, row_number() OVER (PARTITION BY c_nationkey ORDER BY n_orders DESC, c_custkey) AS rank FROM c JOIN nation ON n_nationkey = c_nationkey QUALIFY rank <= 3
"""

QUERIES = {
    "citation_targets": citation_targets, "prompt_build": prompt_build, "extractive_answer": extractive_answer, "extractive_snippet": extractive_snippet, "resolve_markers": resolve_markers, "marker_parts": marker_parts,
    "flow_highlight": flow_highlight, "paged_highlight": paged_highlight, "last_user_turn": last_user_turn, "model_route": model_route, "message_text": message_text, "usage_cost": usage_cost, "deepest_section": deepest_section,
    "pricing_summary": pricing_summary, "customer_activity": customer_activity,
}
ORACLES = {
    "citation_targets": TARGETS_SQL, "prompt_build": PROMPT_SQL, "extractive_answer": EXTRACTIVE_SQL, "extractive_snippet": f"SELECT doc_id, {SNIPPET_SQL.format('inside')} AS snippet FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS inside FROM documents)",
    "resolve_markers": MARKERS_SQL, "marker_parts": PARTS_SQL, "flow_highlight": FLOW_SQL, "paged_highlight": PAGED_SQL, "last_user_turn": TURN_SQL, "model_route": MODEL_SQL, "message_text": PARTS_TEXT_SQL,
    "usage_cost": COST_SQL, "deepest_section": DEEPEST_SQL, "pricing_summary": PRICING_SQL, "customer_activity": ACTIVITY_SQL,
}
