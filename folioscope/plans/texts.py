"""Text, number, geometry, splitting and chunking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import geometry, numbers
from folioscope.functions.text import approx_tokens, locating_prefix, sentences, text_gate, word_shape
from folioscope.operators import boxes as boxes_
from folioscope.operators import chunk, split
from folioscope.plans.common import LINE_BLOCKS, RECTS, boxes, kept, line_blocks, load, r6, tokens_sql

TARGET, OVERLAP = 64, 16


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", approx_tokens(F.col("text")).alias("tokens"))


def word_shape_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", r6(word_shape(F.col("text"))).alias("shape"))


SHAPE_SQL = """CASE WHEN len(regexp_extract_all(text, '[A-Za-z]{2,}')) < 8 THEN 1.0::DOUBLE
  ELSE len(list_filter(regexp_extract_all(text, '[A-Za-z]{2,}'), lambda w: regexp_matches(w, '[aeiouyAEIOUY]'))) / len(regexp_extract_all(text, '[A-Za-z]{2,}')) END"""


def page_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", text_gate(F.col("text"), F.lit(612.0), F.lit(792.0)).alias("g"))
    return docs.select("doc_id", r6(F.col("g.confidence")).alias("confidence"), F.col("g.needs_ocr").alias("needs_ocr"), F.array_join("g.reasons", "; ").alias("reasons"))


GATE_SQL = f"""
WITH m AS (
  SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS inside, {SHAPE_SQL} AS shape,
    (length(text) - length(regexp_replace(text, '\\(cid:\\d+\\)', '', 'g'))) / length(text) AS glyphs, (length(text) - length(replace(text, chr(65533), ''))) / length(text) AS broken FROM documents),
d AS (SELECT *, inside / (612.0::DOUBLE * 792.0::DOUBLE / 1000.0::DOUBLE) AS density FROM m),
c AS (SELECT doc_id, inside, concat_ws('; ', CASE WHEN glyphs > 0.02 THEN 'cid_glyphs=' || format('{{:.0f}}%', glyphs * 100) END, CASE WHEN broken > 0.005 THEN 'replacement_chars=' || format('{{:.1f}}%', broken * 100) END,
      CASE WHEN density < 0.35 THEN 'sparse_text density=' || format('{{:.2f}}', density) END, CASE WHEN shape < 0.65 THEN 'unwordlike_text=' || format('{{:.2f}}', shape) END) AS reasons,
    CASE WHEN glyphs > 0.02 THEN greatest(0, 1 - 3 * glyphs) ELSE 1 END * CASE WHEN broken > 0.005 THEN greatest(0, 1 - 10 * broken) ELSE 1 END
    * CASE WHEN density < 0.35 THEN greatest(0.15::DOUBLE, density / 0.35::DOUBLE) ELSE 1 END * CASE WHEN shape < 0.65 THEN shape ELSE 1 END AS confidence FROM d)
SELECT doc_id, round(CASE WHEN inside = 0 THEN 0.0 ELSE least(1, greatest(0, confidence)) END, 6) AS confidence, CASE WHEN inside = 0 THEN true ELSE confidence < 0.72 END AS needs_ocr,
  CASE WHEN inside = 0 THEN 'empty_text_layer' ELSE reasons END AS reasons FROM c
"""


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))
    return docs


SENTENCE_SQL = r"""
WITH marked AS (SELECT doc_id, regexp_replace(text, '([.!?]["'')\]]?)\s+([A-Z("''])', '\1' || chr(1) || '\2', 'g') AS once FROM documents),
twice AS (SELECT doc_id, regexp_replace(once, '([.!?]["'')\]]?)\s+([A-Z("''])', '\1' || chr(1) || '\2', 'g') AS marked FROM marked),
parts AS (SELECT doc_id, list_filter(list_transform(string_split(marked, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM twice)
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sentence_no, unnest(s) AS sentence FROM parts
"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.line_spans(load(spark, sf_dir, "documents").select("doc_id", "text"))


LINES_SQL = """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
rows AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s, len(p) AS n FROM parts),
lines AS (SELECT doc_id, i, CASE WHEN i < n THEN s || chr(10) ELSE s END AS line FROM rows WHERE i < n OR s <> '')
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, line, CAST(sum(length(line)) OVER w - length(line) AS INTEGER) AS char_start, CAST(sum(length(line)) OVER w AS INTEGER) AS char_end
FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
"""


def plain_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines of one word stand for blank ones, so that there are paragraphs to find."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^[^ \n]*$", " ").alias("text"), F.lit("txt").alias("extension"))
    return split.split_flow(docs).select("doc_id", "reading_order", "kind", "text", "char_start", "char_end")


PARAGRAPHS_SQL = r"""
WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN contains(l, ' ') THEN l ELSE ' ' END), chr(10)) AS text FROM documents),
lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS l FROM t),
placed AS (SELECT *, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l) - 1 AS pos, sum((trim(l) = '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lines),
groups AS (SELECT doc_id, g, min(pos) AS pos, string_agg(l, chr(10) ORDER BY i) AS p FROM placed WHERE trim(l) <> '' GROUP BY ALL),
trimmed AS (SELECT doc_id, g, regexp_replace(p, '^\s+|\s+$', '', 'g') AS text, pos + length(p) - length(regexp_replace(p, '^\s+', '')) AS char_start FROM groups)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS reading_order, 'paragraph' AS kind, text, CAST(char_start AS INTEGER) AS char_start, CAST(char_start + length(text) AS INTEGER) AS char_end FROM trimmed
"""


def csv_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as one CSV file in groups of four rows."""
    n = load(spark, sf_dir, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("line"), "n_nationkey")
    one = n.agg(F.concat(F.lit("key,name\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n")).alias("text"))
    return split.split_flow(one.select(F.lit(1).alias("file_id"), "text", F.lit("csv").alias("extension")), rows=4).select("file_id", "reading_order", "kind", "text", "char_start", "char_end")


CSV_SQL = """
WITH l AS (SELECT n_nationkey AS k, CAST(n_nationkey AS VARCHAR) || ',' || n_name AS line, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation),
p AS (SELECT *, 9 + sum(length(line) + 1) OVER (ORDER BY i) - length(line) - 1 AS pos FROM l)
SELECT 1 AS file_id, CAST(i // 4 AS INTEGER) AS reading_order, 'table' AS kind, 'key,name' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text, CAST(min(pos) AS INTEGER) AS char_start, CAST(max(pos + length(line)) AS INTEGER) AS char_end
FROM p GROUP BY i // 4
"""


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose short lines are headings; every block slices back to its text."""
    docs = load(spark, sf_dir, "documents")
    marked = F.regexp_replace("text", r"(?m)^([^ \n]+ ?[^ \n]*)$", "## $1")
    return split.split_flow(docs.select("doc_id", marked.alias("text"), F.lit("md").alias("extension"))).select("doc_id", "reading_order", "kind", "char_start", "char_end", F.array_join("section_path", " > ").alias("section"))


MARKDOWN_SQL = r"""
WITH lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS raw FROM documents),
kinds AS (SELECT doc_id, i, regexp_matches(raw, '^[^ ]+ ?[^ ]*$') AS h, CASE WHEN regexp_matches(raw, '^[^ ]+ ?[^ ]*$') THEN '## ' || raw ELSE raw END AS l, raw FROM lines),
placed AS (
  SELECT *, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l) - 1 AS pos, trim(l) = '' AS blank,
    CASE WHEN h THEN 'heading' WHEN regexp_matches(l, '^\s*\|') THEN 'table' WHEN regexp_matches(l, '^\s*([-*+]|\d+[.)])\s+') THEN 'list' ELSE 'paragraph' END AS kind FROM kinds),
flags AS (SELECT *, h OR blank OR coalesce(lag(h OR blank) OVER w, true) OR kind <> lag(kind) OVER w AS new FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
breaks AS (SELECT *, sum(new::INT) OVER w AS g, last_value(CASE WHEN h THEN trim(regexp_replace(raw, '\s*#*\s*$', '')) END IGNORE NULLS) OVER w AS section FROM flags WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
blocks AS (SELECT doc_id, g, any_value(kind) AS kind, any_value(section) AS section, min(pos) AS pos, string_agg(l, chr(10) ORDER BY i) AS p FROM breaks WHERE NOT blank GROUP BY doc_id, g),
trimmed AS (SELECT *, regexp_replace(p, '^\s+|\s+$', '', 'g') AS text, pos + length(p) - length(regexp_replace(p, '^\s+', '')) AS char_start FROM blocks)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS reading_order, kind, CAST(char_start AS INTEGER) AS char_start, CAST(char_start + length(text) AS INTEGER) AS char_end, coalesce(section, '') AS section FROM trimmed
"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = line_blocks(spark, sf_dir)
    return b.withColumn("block_id", F.concat_ws("-", F.col("document_id").cast("string"), F.col("reading_order").cast("string"))).withColumn("kind", F.lit("paragraph")).withColumn("page_no", F.lit(0))


def flatten_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.flattened(_blocks(spark, sf_dir)).select("document_id", "reading_order", "span_start", "span_end")


TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
SPANS_SQL = f"""
WITH {LINE_BLOCKS},
ends AS (SELECT document_id, reading_order, length({TRIM}) AS n, sum(length({TRIM}) + 2) OVER (PARTITION BY document_id ORDER BY reading_order) - 2 AS span_end FROM blocks)
SELECT document_id, CAST(reading_order AS INTEGER) AS reading_order, CAST(span_end - n AS BIGINT) AS span_start, CAST(span_end AS BIGINT) AS span_end FROM ends
"""


def layout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunk each line belongs to under greedy packing."""
    docs = line_blocks(spark, sf_dir).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("reading_order", "tokens"))).alias("b"))
    packed = docs.select("document_id", F.explode(F.arrays_zip(F.col("b.reading_order").alias("reading_order"), chunk.pack_groups(F.col("b.tokens"), TARGET).alias("seq"))).alias("x"))
    return packed.select("document_id", F.col("x.reading_order").alias("reading_order"), F.col("x.seq").alias("seq"))


PACKED = f"""{LINE_BLOCKS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY reading_order) AS i FROM blocks),
packed AS (
  SELECT document_id, i, reading_order, text, tokens, 0 AS seq, tokens AS spent FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.document_id, n.i, n.reading_order, n.text, n.tokens, CASE WHEN p.spent + n.tokens > {TARGET} THEN p.seq + 1 ELSE p.seq END, CASE WHEN p.spent + n.tokens > {TARGET} THEN n.tokens ELSE p.spent + n.tokens END
  FROM packed p JOIN numbered n ON n.document_id = p.document_id AND n.i = p.i + 1)"""
GROUPS_SQL = f"WITH RECURSIVE {PACKED} SELECT document_id, CAST(reading_order AS INTEGER) AS reading_order, seq FROM packed"


def layout_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout chunks of lines, the last short line of the chunk before in front."""
    made = chunk.chunk(_blocks(spark, sf_dir), ("layout",), target=TARGET, overlap=OVERLAP)
    return made.select("document_id", "seq", F.md5("text").alias("text_md5"), "token_count", F.array_join("block_ids", ",").alias("block_ids"))


LAYOUT_SQL = f"""
WITH RECURSIVE {PACKED},
last AS (SELECT document_id, seq, arg_max(reading_order, i) AS o, arg_max(text, i) AS t, arg_max(tokens, i) AS k FROM packed GROUP BY ALL),
rows AS (
  SELECT document_id, seq, i, reading_order, text FROM packed
  UNION ALL SELECT document_id, seq + 1, 0, o, t FROM last l WHERE k <= {OVERLAP} AND EXISTS (SELECT 1 FROM last m WHERE m.document_id = l.document_id AND m.seq = l.seq + 1)),
made AS (SELECT document_id, seq, string_agg({TRIM}, chr(10) || chr(10) ORDER BY i) AS text, string_agg(CAST(document_id AS VARCHAR) || '-' || CAST(reading_order AS VARCHAR), ',' ORDER BY i) AS block_ids FROM rows GROUP BY ALL)
SELECT document_id, seq, md5(text) AS text_md5, {tokens_sql("text")} AS token_count, block_ids FROM made
"""


def chunk_block_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed ranges of 500 characters of each document's flat text, and the blocks they touch."""
    spans = chunk.flattened(_blocks(spark, sf_dir)).select("document_id", "reading_order", "span_start", "span_end")
    size = spans.groupBy("document_id").agg(F.max("span_end").alias("n"))
    ranges = size.select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 500))).alias("range_no")).withColumn("range_start", F.col("range_no") * 500).withColumn("range_end", (F.col("range_no") + 1) * 500)
    found = chunk.links(spans, ranges)
    return found.groupBy("document_id", "range_no").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("reading_order").alias("first_block"), F.max("reading_order").alias("last_block"))


LINKS_SQL = f"""
WITH {LINE_BLOCKS},
ends AS (SELECT document_id, reading_order, length({TRIM}) AS n, sum(length({TRIM}) + 2) OVER (PARTITION BY document_id ORDER BY reading_order) - 2 AS e FROM blocks),
sized AS (SELECT document_id, max(e) AS n FROM ends GROUP BY ALL),
ranges AS (SELECT document_id, unnest(range(0, CAST((n - 1) // 500 AS BIGINT) + 1)) AS range_no FROM sized)
SELECT r.document_id, r.range_no, count(*) AS n_blocks, CAST(min(reading_order) AS INTEGER) AS first_block, CAST(max(reading_order) AS INTEGER) AS last_block
FROM ranges r JOIN ends s ON s.document_id = r.document_id AND s.e - s.n < (r.range_no + 1) * 500 AND s.e > r.range_no * 500 GROUP BY ALL
"""


def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents under the fixed and recursive strategies (sequential, so without SQL)."""
    made = chunk.chunk(_blocks(spark, sf_dir), ("fixed", "recursive"), target=TARGET, overlap=OVERLAP)
    return made.select("document_id", "strategy", "seq", "token_count", F.size("block_ids").alias("n_blocks"), F.md5("text").alias("text_md5"))


def letter_vectors(texts: list[str]) -> list[list[float]]:
    """A stand-in embedder: how often each of a few letters comes."""
    return [[float(t.lower().count(c)) for c in "aeinorst"] for t in texts]


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunk.chunk(_blocks(spark, sf_dir), ("semantic",), target=TARGET, embed=letter_vectors)
    return made.select("document_id", "seq", "token_count", F.size("block_ids").alias("n_blocks"), F.col("meta")["cut_similarity"].alias("cut_similarity"))


def semantic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as sentences in a row by label: each gap, and the percentile that a cut lies below."""
    v = load(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    gaps = v.withColumn("next", F.lead("embedding").over(w)).where(F.col("next").isNotNull()).select("label", "vec_id", chunk.cosine_column(F.col("embedding"), F.col("next")).alias("gap"))
    limit = F.expr("percentile(gap, 0.25)").over(Window.partitionBy("label"))
    return gaps.withColumn("limit", limit).select("label", "vec_id", r6(F.col("gap")).alias("gap"), r6(F.col("limit")).alias("cut_below"), (F.col("gap") < F.col("limit")).alias("is_cut"))


GAPS_SQL = """
WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
g AS (SELECT label, vec_id, list_cosine_similarity(e, n) AS gap FROM v WHERE n IS NOT NULL),
q AS (SELECT *, quantile_cont(gap, 0.25) OVER (PARTITION BY label) AS lim FROM g)
SELECT label, vec_id, round(gap, 6) AS gap, round(lim, 6) AS cut_below, gap < lim AS is_cut FROM q
"""


def bbox_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return b.select("l_orderkey", "l_linenumber", *[r6(F.col(f"bbox.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")], geometry.is_valid(F.col("bbox")).alias("valid"), r6(geometry.area(F.col("bbox"))).alias("area"))


BOX_SQL = f"WITH {RECTS} SELECT l_orderkey, l_linenumber, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, x0 < x1 AND y0 < y1 AS valid, round((x1 - x0) * (y1 - y0), 6) AS area FROM snapped"


def bbox_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both sides have the same columns, so that one shuffle serves both
    b = boxes(spark, sf_dir).drop("rotation")
    pairs = b.alias("a").join(b.alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    return pairs.select("a.l_orderkey", "a.l_linenumber", F.col("b.l_linenumber").alias("other_line"), r6(geometry.iou(F.col("a.bbox"), F.col("b.bbox"))).alias("iou"))


IOU_SQL = f"""
WITH {RECTS},
p AS (SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other_line, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS total, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h
  FROM snapped a JOIN snapped b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, l_linenumber, other_line, round(CASE WHEN w > 0 AND h > 0 THEN w * h / (total - w * h) ELSE 0.0 END, 6) AS iou FROM p
"""


def union_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = boxes(spark, sf_dir).groupBy("l_orderkey").agg(geometry.union(F.col("bbox")).alias("u"))
    return u.select("l_orderkey", *[r6(F.col(f"u.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")])


UNION_SQL = f"WITH {RECTS} SELECT l_orderkey, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1 FROM snapped GROUP BY l_orderkey"


def merge_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select((F.col("l_orderkey") % 1000).alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"), "bbox")
    merged = boxes_.merge_overlapping(rows, ["page"], kept, at_least=0.3)
    return merged.select("page", "seed", "n_boxes", *[r6(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


_OVERLAP = "least(s.x1, x.x1) > greatest(s.x0, x.x0) AND least(s.y1, x.y1) > greatest(s.y0, x.y0) AND (least(s.x1, x.x1) - greatest(s.x0, x.x0)) * (least(s.y1, x.y1) - greatest(s.y0, x.y0)) / (s.a + x.a - (least(s.x1, x.x1) - greatest(s.x0, x.x0)) * (least(s.y1, x.y1) - greatest(s.y0, x.y0))) >= 0.3::DOUBLE"
MERGE_SQL = f"""
WITH RECURSIVE {RECTS},
sized AS (SELECT l_orderkey % 1000 AS page, l_orderkey * 8 + l_linenumber AS o, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS a FROM snapped),
pages AS (SELECT page, list(struct_pack(o := o, x0 := x0, y0 := y0, x1 := x1, y1 := y1, a := a) ORDER BY a DESC, o, x0, y0, x1, y1) AS rest FROM sized GROUP BY page),
merged AS (
  SELECT page, NULL::STRUCT(o BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, a DOUBLE) AS s, []::STRUCT(o BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, a DOUBLE)[] AS g, rest FROM pages
  UNION ALL
  SELECT page, s, list_concat([s], list_filter(rest, lambda x: {_OVERLAP})), list_filter(rest, lambda x: NOT ({_OVERLAP})) FROM (SELECT page, rest[1] AS s, rest[2:] AS rest FROM merged WHERE len(rest) > 0))
SELECT page, s.o AS seed, CAST(len(g) AS INTEGER) AS n_boxes, round(list_min(list_transform(g, lambda x: x.x0)), 6) AS x0, round(list_min(list_transform(g, lambda x: x.y0)), 6) AS y0, round(list_max(list_transform(g, lambda x: x.x1)), 6) AS x1, round(list_max(list_transform(g, lambda x: x.y1)), 6) AS y1
FROM merged WHERE s IS NOT NULL
"""


def numeric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells made of lineitem's prices in eight notations."""
    li = load(spark, sf_dir, "lineitem")
    p = F.format_number(F.col("l_extendedprice").cast("double"), 2)
    n = F.col("l_linenumber")
    cell = (
        F.when(n == 1, p).when(n == 2, F.concat(F.lit("$("), p, F.lit(")"))).when(n == 3, F.concat(F.lit("("), p, F.lit(")(1)"))).when(n == 4, F.concat(p, F.lit("%")))
        .when(n == 5, F.concat(F.lit("(($ "), p, F.lit("))"))).when(n == 6, F.concat(F.lit("-"), p, F.lit("x"))).otherwise(F.lit("n/a"))
    )
    got = li.select("l_orderkey", "l_linenumber", cell.alias("raw")).withColumn("p", numbers.parse_number(F.col("raw"), ascii_only=True))
    return got.select("l_orderkey", "l_linenumber", "raw", F.col("p.value").cast("decimal(18,2)").alias("value"), F.col("p.is_percent").alias("is_percent"), F.col("p.is_negative").alias("is_negative"), F.col("p.had_footnote").alias("had_footnote"))


NUMERIC_SQL = """
WITH b AS (SELECT l_orderkey, l_linenumber AS n, CAST(l_extendedprice AS DECIMAL(18, 2)) AS v, format('{:,.2f}', CAST(l_extendedprice AS DOUBLE)) AS p FROM lineitem)
SELECT l_orderkey, n AS l_linenumber, CASE n WHEN 1 THEN p WHEN 2 THEN '$(' || p || ')' WHEN 3 THEN '(' || p || ')(1)' WHEN 4 THEN p || '%' WHEN 5 THEN '(($ ' || p || '))' WHEN 6 THEN '-' || p || 'x' ELSE 'n/a' END AS raw,
  CASE WHEN n > 6 THEN NULL WHEN n IN (2, 3, 6) THEN -v ELSE v END AS value, CASE WHEN n <= 6 THEN n = 4 END AS is_percent, CASE WHEN n <= 6 THEN n IN (2, 3, 6) END AS is_negative, CASE WHEN n <= 6 THEN n = 3 END AS had_footnote FROM b
"""


def template_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    company = F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderstatus"))
    form = F.when(F.col("o_custkey") % 2 == 0, F.lit("10-K"))
    year = F.when(F.col("o_custkey") % 4 == 0, F.year(F.to_date("o_orderdate")))
    path = F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit("Item 1"), F.col("o_orderstatus")))
    return o.select("o_orderkey", locating_prefix(company, form, year, F.lit("file.pdf"), path, (F.col("o_orderkey") % 3).cast("int")).alias("prefix"))


PREFIX_SQL = """
SELECT o_orderkey, 'From ' || CASE WHEN o_custkey % 3 = 0 AND o_custkey % 2 <> 0 THEN 'file.pdf'
    ELSE concat_ws(' ', CASE WHEN o_custkey % 3 > 0 THEN o_orderstatus END, CASE WHEN o_custkey % 2 = 0 THEN '10-K' END, CASE WHEN o_custkey % 4 = 0 THEN CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR) END) END
  || CASE WHEN o_orderkey % 10 = 0 THEN ', section Item 1 > ' || o_orderstatus ELSE '' END || CASE WHEN o_orderkey % 3 > 0 THEN ', page ' || CAST(o_orderkey % 3 AS VARCHAR) ELSE '' END || '.' AS prefix
FROM orders
"""

QUERIES = {
    "token_count": token_count, "word_shape": word_shape_score, "text_gate": page_gate, "sentence_split": sentence_split, "line_blocks": text_lines, "plain_blocks": plain_paragraphs,
    "csv_blocks": csv_groups, "markdown_blocks": markdown_blocks, "flatten_spans": flatten_spans, "layout_groups": layout_groups, "layout_chunks": layout_chunks, "chunk_block_links": chunk_block_links,
    "fixed_recursive_chunks": all_chunks, "semantic_chunks": semantic_chunks, "semantic_gaps": semantic_gaps, "bbox_normalise": bbox_normalise, "bbox_iou": bbox_iou, "union_bbox": union_bbox,
    "merge_overlapping": merge_boxes, "numeric_parse": numeric_parse, "template_prefix": template_prefix,
}
ORACLES = {
    "token_count": f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents", "word_shape": f"SELECT doc_id, round({SHAPE_SQL}, 6) AS shape FROM documents", "text_gate": GATE_SQL, "sentence_split": SENTENCE_SQL,
    "line_blocks": LINES_SQL, "plain_blocks": PARAGRAPHS_SQL, "csv_blocks": CSV_SQL, "markdown_blocks": MARKDOWN_SQL, "flatten_spans": SPANS_SQL, "layout_groups": GROUPS_SQL, "layout_chunks": LAYOUT_SQL,
    "chunk_block_links": LINKS_SQL, "semantic_gaps": GAPS_SQL, "bbox_normalise": BOX_SQL, "bbox_iou": IOU_SQL, "union_bbox": UNION_SQL, "merge_overlapping": MERGE_SQL, "numeric_parse": NUMERIC_SQL, "template_prefix": PREFIX_SQL,
}
