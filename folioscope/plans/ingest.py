"""Format, message, write and stage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.plans.common import LINE_BLOCKS, RECTS, line_blocks, load, r6, rects, scratch
from folioscope.sources import formats, messages, read, write
from folioscope.streaming import machine, stages

FAMILY_OF = "element_at(array('pdf', 'office', 'image', 'web', 'flow'), CAST(pmod({0}, 5) AS INT) + 1)"
FAMILY_SQL = "(['pdf', 'office', 'image', 'web', 'flow'])[{0} % 5 + 1]"


def format_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as uploaded files, with names that sometimes lie."""
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 == 0, "page.csv").otherwise("page.html").alias("filename"), F.col("html").alias("t"))
    names = F.element_at(F.array(*[F.lit(x) for x in ("a.txt", "b.md", "c.csv", "d", "e.LOG", "f.pdf", "g.json")]), (F.col("doc_id") % 7 + 1).cast("int"))
    docs = load(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000_000).alias("id"), names.alias("filename"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("%PDF-1.7 "), "text")).otherwise(F.col("text")).alias("t"))
    files = pages.unionByName(docs).withColumn("content", F.col("t").cast("binary"))
    got = formats.detect(files, containers=False)
    return got.select("id", "filename", "mime", "family", "extension", formats.provenance_mode(F.col("family")).alias("mode"), formats.needs_conversion(F.col("family")).alias("needs_conversion"))


ROUTE_SQL = """
WITH files AS (
  SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'page.csv' ELSE 'page.html' END AS filename, 'html' AS extension FROM pages
  UNION ALL SELECT doc_id + 1000000000, (['a.txt', 'b.md', 'c.csv', 'd', 'e.LOG', 'f.pdf', 'g.json'])[doc_id % 7 + 1], CASE WHEN doc_id % 11 = 0 THEN 'pdf' ELSE (['txt', 'md', 'csv', 'txt', 'txt', 'txt', 'json'])[doc_id % 7 + 1] END FROM documents),
known(extension, mime, family) AS (VALUES ('html', 'text/html', 'web'), ('pdf', 'application/pdf', 'pdf'), ('txt', 'text/plain', 'flow'), ('md', 'text/markdown', 'flow'), ('csv', 'text/csv', 'flow'), ('json', 'application/json', 'flow'))
SELECT id, filename, mime, family, extension, CASE WHEN family = 'flow' THEN 'flow' ELSE 'paged' END AS mode, family IN ('office', 'web') AS needs_conversion FROM files JOIN known USING (extension)
"""


def message_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made of events, some with a fault of each kind."""
    e = load(spark, sf_dir, "events")
    k = F.col("event_id") % 9
    body = F.concat(
        F.lit('{"document_id":"d'), F.col("user_id").cast("string"), F.lit('","run_id":"r'), F.col("user_id").cast("string"),
        F.when(k == 1, '"').otherwise('","stage":"chunk"'), F.when(k == 2, ',"family":"tape"').otherwise(',"family":"pdf"'), F.lit(',"pipeline_version":"1"'),
        F.when(k == 3, ',"attempt":0').when(k == 4, ',"attempt":2').when(k == 5, ',"attempt":"2"').otherwise(""), F.when(k == 6, ',"meta":[1]').when(k == 4, ',"meta":{"a":"b"}').otherwise(""), F.lit(',"trace_id":"t"}'),
    )
    raw = F.when(k == 7, F.substring(body, 1, 20)).when(k == 8, F.lit("[1, 2]")).otherwise(body)
    got = messages.decode(e.select("event_id", raw.cast("binary").alias("raw")))
    return got.select("event_id", "error", F.col("message.document_id").alias("document_id"), F.col("message.attempt").alias("attempt"), F.col("message.tenant_id").alias("tenant_id"), F.when(F.col("error").isNull(), messages.encode(messages.retried(F.col("message")))).alias("again"))


MESSAGE_SQL = """
SELECT event_id, CASE event_id % 9 WHEN 1 THEN 'missing fields stage' WHEN 2 THEN 'unknown family tape' WHEN 3 THEN 'attempt must be a positive whole number' WHEN 5 THEN 'attempt must be a positive whole number'
    WHEN 6 THEN 'meta must be an object' WHEN 7 THEN 'undecodable message' WHEN 8 THEN 'expected an object' END AS error,
  CASE WHEN event_id % 9 IN (0, 4) THEN 'd' || user_id END AS document_id, CASE event_id % 9 WHEN 0 THEN 1 WHEN 4 THEN 2 END AS attempt, CASE WHEN event_id % 9 IN (0, 4) THEN 'default' END AS tenant_id,
  CASE event_id % 9 WHEN 0 THEN '{"attempt":2,"document_id":"d' || user_id || '","family":"pdf","meta":{},"pipeline_version":"1","run_id":"r' || user_id || '","stage":"chunk","tenant_id":"default","trace_id":"t"}'
    WHEN 4 THEN '{"attempt":3,"document_id":"d' || user_id || '","family":"pdf","meta":{"a":"b"},"pipeline_version":"1","run_id":"r' || user_id || '","stage":"chunk","tenant_id":"default","trace_id":"t"}' END AS again
FROM events
"""


def json_recordset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a JSON array, and back to typed rows."""
    li = load(spark, sf_dir, "lineitem")
    packed = li.groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("l_quantity")))).alias("j"))
    return read.recordset(packed, "j", "l_linenumber int, l_partkey bigint, l_quantity double").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_quantity")


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    got = read.intake(docs.select("doc_id", F.col("text").cast("binary").alias("content")))
    return got.select(F.lit("default").alias("tenant_id"), "sha256", F.col("doc_id").alias("document_id"), F.col("doc_id").alias("created_at"), "status")


def dedupe_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write.new_documents(_uploads(spark, sf_dir)).select("document_id", "sha256", "status", "created", F.col("stands").cast("long").alias("stands"))


DEDUPE_SQL = "SELECT doc_id AS document_id, sha256(text) AS sha256, 200 AS status, doc_id = min(doc_id) OVER (PARTITION BY text) AS created, min(doc_id) OVER (PARTITION BY text) AS stands FROM documents"


def upsert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages: some are updated, some are new, and the render address holds."""
    o = load(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_no"), F.col("o_totalprice").cast("double").alias("width"), F.lit("old").alias("render_uri"))
    new = o.where("o_orderkey % 3 < 2").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_no"), (F.col("o_totalprice").cast("double") + 1).alias("width"), F.lit("new").alias("render_uri"))
    return write.upserted(old, new, ["document_id", "page_no"], keep=["render_uri"])


UPSERT_SQL = "SELECT o_custkey AS document_id, o_orderkey AS page_no, CAST(o_totalprice AS DOUBLE) + CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 0 END AS width, CASE WHEN o_orderkey % 3 > 0 THEN 'old' ELSE 'new' END AS render_uri FROM orders"


def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their number of layout chunks, which are lines, beside those of another strategy; the limit is the page that is shown."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang", F.col("doc_id").alias("created_at"))
    lines = line_blocks(spark, sf_dir)
    chunks = lines.select("document_id", F.lit("layout").alias("strategy")).unionByName(lines.where("tokens > 8").select("document_id", F.lit("fixed").alias("strategy")))
    return read.list_documents(docs, chunks, 50).select("document_id", "lang", "chunk_count")


LIST_SQL = f"WITH {LINE_BLOCKS} SELECT doc_id AS document_id, lang, (SELECT count(*) FROM blocks b WHERE b.document_id = d.doc_id) AS chunk_count FROM documents d ORDER BY doc_id DESC LIMIT 50"


def pdf_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rectangles of lineitem's numbers as blocks; some are blank, some off the page."""
    r = rects(spark, sf_dir).select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") % 3).cast("int").alias("page_no"), F.col("l_linenumber").alias("rect_no"), F.when(F.col("l_linenumber") == 2, "  ").otherwise(F.concat(F.lit(" line "), F.col("l_linenumber").cast("string"))).alias("text"), (F.col("x0") + 150).alias("x0"), "y0", (F.col("x1") + 150).alias("x1"), "y1", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(0).alias("rotation"))
    b = read.pdf_fragments(r)
    return b.select("document_id", "page_no", "reading_order", "text", r6(F.col("bbox.x0")).alias("x0"), r6(F.col("bbox.y1")).alias("y1"))


PDF_SQL = f"""
WITH {RECTS},
b AS (SELECT l_orderkey AS document_id, CAST(l_linenumber % 3 AS INTEGER) AS page_no, l_linenumber AS rect_no, 'line ' || l_linenumber AS text, least(1, (x0 + 150) / 612.0::DOUBLE) AS x0, least(1, (x1 + 150) / 612.0::DOUBLE) AS x1, greatest(0, (792 - y1) / 792.0::DOUBLE) AS y0, (792 - y0) / 792.0::DOUBLE AS y1 FROM rects WHERE l_linenumber <> 2)
SELECT document_id, page_no, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_no, rect_no, x0, y0, x1, y1) AS INTEGER) AS reading_order, text, round(x0, 6) AS x0, round(y1, 6) AS y1 FROM b WHERE x0 < x1 AND y0 < y1
"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user of events: its family, and a growing part of its path as completed."""
    users = load(spark, sf_dir, "events").select("user_id").distinct().withColumn("family", F.expr(FAMILY_OF.format("user_id")))
    path = stages.paths(spark).groupBy(F.col("family").alias("f")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "stage"))).alias("p"))
    runs = users.join(F.broadcast(path), F.col("family") == F.col("f"))
    n = F.least((F.col("user_id") % 7).cast("int"), F.size("p"))
    done = F.transform(F.slice("p", F.lit(1), n), lambda x: x["stage"])
    flying = F.transform(F.slice("p", n + 1, F.when(F.col("user_id") % 2 == 0, 1).otherwise(0)), lambda x: x["stage"])
    return runs.select(F.col("user_id").alias("run_id"), F.col("user_id").alias("document_id"), "family", F.lit("t").alias("trace_id"), done.alias("completed"), F.concat(done, flying).alias("dispatched"))


GRAPH = """
graph(ordinal, stage, families, deps, most) AS (VALUES
  (0, 'detect', ['pdf', 'office', 'image', 'web', 'flow'], []::VARCHAR[], 3), (1, 'convert', ['office', 'web'], ['detect'], 2), (2, 'parse', ['pdf', 'office', 'image', 'web'], ['detect', 'convert'], 3), (3, 'parse_flow', ['flow'], ['detect'], 3),
  (4, 'ocr', ['pdf', 'office', 'image', 'web'], ['parse'], 3), (5, 'tables', ['pdf', 'office', 'image', 'web'], ['parse', 'ocr'], 3), (6, 'figures', ['pdf', 'office', 'image', 'web'], ['parse', 'ocr'], 4),
  (7, 'chunk', ['pdf', 'office', 'image', 'web', 'flow'], ['tables', 'figures', 'parse_flow'], 3), (8, 'contextualize', ['pdf', 'office', 'image', 'web', 'flow'], ['chunk'], 5), (9, 'embed', ['pdf', 'office', 'image', 'web', 'flow'], ['contextualize'], 5)),
on_path AS (SELECT ordinal, stage, deps, unnest(families) AS family FROM graph),
names AS (SELECT family, list(stage) AS names FROM on_path GROUP BY family),
paths AS (SELECT p.family, p.ordinal, p.stage, list_filter(p.deps, lambda d: list_contains(names, d)) AS deps FROM on_path p JOIN names USING (family))"""
RUNS = f"""{GRAPH},
users AS (SELECT DISTINCT user_id, {FAMILY_SQL.format("user_id")} AS family FROM events),
ordered AS (SELECT u.user_id, u.family, p.stage, p.ordinal, p.deps, row_number() OVER (PARTITION BY u.user_id ORDER BY p.ordinal) AS i FROM users u JOIN paths p USING (family)),
runs AS (SELECT user_id, family, coalesce(list(stage ORDER BY i) FILTER (i <= user_id % 7), []) AS done, coalesce(list(stage ORDER BY i) FILTER (i <= user_id % 7 + (user_id % 2 = 0)::INT), []) AS sent FROM ordered GROUP BY ALL)"""


def ready_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.ready_stages(_runs(spark, sf_dir)).select("run_id", "family", "stage")


READY_SQL = f"WITH {RUNS} SELECT r.user_id AS run_id, r.family, o.stage FROM runs r JOIN ordered o USING (user_id) WHERE NOT list_contains(sent, o.stage) AND len(list_filter(o.deps, lambda d: NOT list_contains(done, d))) = 0"


def next_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.next_messages(_runs(spark, sf_dir))


NEXT_SQL = f"SELECT run_id, run_id AS document_id, family, 't' AS trace_id, stage, 1 AS attempt FROM ({READY_SQL})"


def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.resume_plan(_runs(spark, sf_dir)).select("run_id", "stage", "why")


RESUME_SQL = f"""
WITH {RUNS}
SELECT user_id AS run_id, unnest(list_filter(sent, lambda s: NOT list_contains(done, s))) AS stage, 'in_flight' AS why FROM runs
UNION ALL SELECT run_id, stage, 'ready' FROM ({READY_SQL})
"""


def run_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.is_complete(_runs(spark, sf_dir)).select("run_id", "family", "ready")


DONE_SQL = f"WITH {RUNS} SELECT user_id AS run_id, r.family, len(done) = (SELECT count(*) FROM paths p WHERE p.family = r.family) AS ready FROM runs r"


def stage_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    rows = runs.select("run_id", F.explode("completed").alias("stage")).select("run_id", "stage", F.lit("completed").alias("status"), F.lit(1).alias("attempt"), F.lit(None).cast("string").alias("error"))
    return stages.stage_view(runs.select("run_id", "family"), rows).select("run_id", "ordinal", "stage", "status", "attempt")


VIEW_SQL = f"WITH {RUNS} SELECT user_id AS run_id, ordinal, stage, CASE WHEN i <= user_id % 7 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN i <= user_id % 7 THEN 1 ELSE 0 END AS attempt FROM ordered"


def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures made of events: stages in turn (one unknown), attempts 1 to 5, some permanent."""
    names = F.array(*[F.lit(s.name) for s in stages.PIPELINE], F.lit("polish"))
    e = load(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.col("event_id") % 11 + 1).cast("int")).alias("stage"), (F.col("event_id") % 5 + 1).cast("int").alias("attempt"), F.when(F.col("event_id") % 13 == 0, "unsupported_format").otherwise("timeout").alias("error_class"))
    return stages.plan_failures(e)


RETRY_SQL = f"""
WITH {GRAPH},
f AS (SELECT event_id, (['detect', 'convert', 'parse', 'parse_flow', 'ocr', 'tables', 'figures', 'chunk', 'contextualize', 'embed', 'polish'])[event_id % 11 + 1] AS stage, CAST(event_id % 5 + 1 AS INTEGER) AS attempt, CASE WHEN event_id % 13 = 0 THEN 'unsupported_format' ELSE 'timeout' END AS error_class FROM events),
j AS (SELECT f.*, g.most, CASE WHEN most IS NULL THEN 'unknown stage' WHEN event_id % 13 = 0 THEN 'permanent' WHEN attempt >= most THEN 'attempts exhausted' END AS reason FROM f LEFT JOIN graph g USING (stage))
SELECT event_id, stage, attempt, error_class, CASE WHEN reason IS NULL THEN 'retry' ELSE 'dead_letter' END AS action, reason, CASE WHEN reason IS NULL THEN ([5000, 30000, 300000])[least(attempt, 3)] END AS delay_ms, CASE WHEN reason IS NULL THEN attempt + 1 END AS next_attempt FROM j
"""


def _outcomes(events: DataFrame) -> DataFrame:
    """Events as outcomes of stages: a run for each user, stages in turn, some failed."""
    names = F.array(*[F.lit(s.name) for s in stages.PIPELINE])
    return events.select(
        "event_id", F.col("user_id").cast("string").alias("run_id"), F.expr(FAMILY_OF.format("user_id")).alias("family"), F.element_at(names, (F.col("event_id") % 10 + 1).cast("int")).alias("stage"),
        F.when(F.col("event_id") % 4 == 0, "failed").otherwise("ok").alias("outcome"), F.when(F.col("event_id") % 8 == 0, "unsupported_format").otherwise("timeout").alias("error_class"),
    )


def pipeline_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage machine's rows from the table of events."""
    return machine.replay(_outcomes(load(spark, sf_dir, "events")))


def pipeline_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from the events as a stream of files, until all that is there is read."""
    schema = load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    top = scratch(spark)
    out = machine.run_stages(_outcomes(stream)).writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{top}/rows")


# A stage is sent out at the event that completes the last of the stages it waits for, unless it is complete by then; one that waits for none, at a run's first success.
MACHINE_SQL = f"""
WITH {GRAPH},
ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS run_id, {FAMILY_SQL.format("user_id")} AS family, (['detect', 'convert', 'parse', 'parse_flow', 'ocr', 'tables', 'figures', 'chunk', 'contextualize', 'embed'])[event_id % 10 + 1] AS stage, event_id % 4 <> 0 AS ok, event_id % 8 = 0 AS permanent FROM events),
completed AS (SELECT run_id, stage, min(event_id) AS at FROM ev WHERE ok GROUP BY ALL),
begun AS (SELECT run_id, family, min(event_id) AS at FROM ev WHERE ok GROUP BY ALL),
waits AS (SELECT b.run_id, p.stage, b.at AS begun, p.deps, unnest(CASE WHEN len(p.deps) = 0 THEN [NULL] ELSE p.deps END) AS dep FROM begun b JOIN paths p USING (family)),
due AS (SELECT w.run_id, w.stage, CASE WHEN any_value(len(w.deps)) = 0 THEN any_value(begun) WHEN count(c.at) = any_value(len(w.deps)) THEN max(c.at) END AS at FROM waits w LEFT JOIN completed c ON c.run_id = w.run_id AND c.stage = w.dep GROUP BY w.run_id, w.stage),
failures AS (SELECT e.*, g.most, CAST(row_number() OVER (PARTITION BY run_id, e.stage ORDER BY event_id) AS INTEGER) AS n FROM ev e JOIN graph g USING (stage) WHERE NOT ok)
SELECT d.run_id, 'dispatch' AS action, d.stage, 1 AS attempt, NULL AS reason FROM due d LEFT JOIN completed c ON c.run_id = d.run_id AND c.stage = d.stage WHERE d.at IS NOT NULL AND (c.at IS NULL OR c.at > d.at)
UNION ALL
SELECT run_id, CASE WHEN permanent OR n >= most THEN 'dead_letter' ELSE 'retry' END, stage, CASE WHEN permanent OR n >= most THEN n ELSE n + 1 END,
  CASE WHEN permanent THEN 'permanent' WHEN n >= most THEN 'attempts exhausted' ELSE 'after ' || ([5000, 30000, 300000])[least(n, 3)] || ' ms' END FROM failures
"""


def chunk_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a chunk whose blocks are its lines' parts, some named twice."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5).alias("block_id"))
    chunks = li.groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "block_id"))), lambda x: x["block_id"]).alias("block_ids"))
    return write.chunk_links(chunks, ["chunk_id"])


LINK_ROWS_SQL = """
WITH r AS (SELECT l_orderkey AS chunk_id, l_partkey % 5 AS block_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 5) - 1 AS o FROM lineitem)
SELECT chunk_id, block_id, CAST(min(o) AS INTEGER) AS ordinal FROM r GROUP BY ALL
"""

QUERIES = {
    "format_route": format_route, "message_decode": message_decode, "json_recordset": json_recordset, "dedupe_upload": dedupe_upload, "upsert_pages": upsert_pages, "list_documents": list_documents, "pdf_fragments": pdf_fragments,
    "ready_stages": ready_stages, "next_messages": next_messages, "resume_plan": resume_plan, "run_ready": run_ready, "stage_view": stage_view, "retry_plan": retry_plan, "pipeline_batch": pipeline_batch, "pipeline_stream": pipeline_stream, "chunk_link_rows": chunk_link_rows,
}
ORACLES = {
    "format_route": ROUTE_SQL, "message_decode": MESSAGE_SQL, "json_recordset": "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem", "dedupe_upload": DEDUPE_SQL, "upsert_pages": UPSERT_SQL,
    "list_documents": LIST_SQL, "pdf_fragments": PDF_SQL, "ready_stages": READY_SQL, "next_messages": NEXT_SQL, "resume_plan": RESUME_SQL, "run_ready": DONE_SQL, "stage_view": VIEW_SQL, "retry_plan": RETRY_SQL, "pipeline_batch": MACHINE_SQL, "pipeline_stream": MACHINE_SQL, "chunk_link_rows": LINK_ROWS_SQL,
}
