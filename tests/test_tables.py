"""Interval joins in bins, merging boxes in rounds, bucketed stores, untyped records, table functions, heads of files."""

import itertools
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from folioscope.functions import geometry
from folioscope.operators import boxes, spans, split, tablefunctions
from folioscope.plans.common import kept
from folioscope.sources import formats, heads, read, store


@pytest.mark.parametrize("width", [1, 3, 64, None])
def test_spans_meet_once(spark, width):
    rng = random.Random(width or 0)
    some = lambda n, long: [(rng.choice(["a", "b", None]), rng.choice([None, *range(n)]) if rng.random() < 0.1 else i, s, s + rng.choice([0, 1, 2, 5, long])) for i in range(n) for s in [rng.randrange(-40, 60)]]
    left, right = some(60, 30), some(40, 90)
    left += [("a", 99, None, 5), ("a", 98, 3, None)]
    a = spark.createDataFrame(left, "doc string, n int, span_start long, span_end long")
    b = spark.createDataFrame(right, "doc string, r int, range_start long, range_end long").withColumn("n_", F.lit(1))
    got = spans.overlapping(a, b, ["doc"], width=width)
    assert got.columns == ["doc", "n", "span_start", "span_end", "r", "range_start", "range_end", "n_"]
    want = [(*x, *y[1:], 1) for x, y in itertools.product(left, right) if x[0] is not None and x[0] == y[0] and None not in (x[2], x[3]) and x[2] < y[3] and x[3] > y[2]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_one_long_document_spreads(spark):
    a = spark.range(200_000).select(F.lit("d").alias("doc"), (F.col("id") * 10).alias("span_start"), (F.col("id") * 10 + 8).alias("span_end"))
    b = spark.range(2_000).select(F.lit("d").alias("doc"), (F.col("id") * 1000).alias("range_start"), (F.col("id") * 1000 + 1000).alias("range_end"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = spans.overlapping(a.hint("merge"), b, ["doc"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r[1] for r in per_task) == 200_000 and len(per_task) == 4 and max(r[1] for r in per_task) < 70_000


@pytest.mark.parametrize("at_least", [0.3, 0.6])
def test_merging_in_rounds_is_greedy_merging(spark, at_least):
    rng, rows = random.Random(4), []
    for page in range(3):
        for o in range(120):
            x, y, w, h = rng.randrange(12) / 4, rng.randrange(12) / 4, rng.randrange(1, 9) / 4, rng.randrange(1, 9) / 4
            rows.append((f"p{page}", o % 100, (x, y, x + w, y + h)))
    # a chain in which each box overlaps the next, and only every other one is a seed
    rows += [("chain", i, (i * 0.1, 0.0, i * 0.1 + 1 - i * 0.001, 1.0)) for i in range(40)] + [("null", 1, None), ("one", 5, (0.0, 0.0, 1.0, 1.0))]
    frame = spark.createDataFrame(rows, "page string, ordinal int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    got = boxes.merge_overlapping(frame, ["page"], kept, at_least=at_least)
    want = geometry.merge_overlapping(frame.where("bbox IS NOT NULL"), ["page"], at_least=at_least)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("at_least", [0.05, 0.3, 0.6])
def test_merging_in_parts_is_greedy_merging(spark, monkeypatch, at_least):
    monkeypatch.setattr(boxes, "THICK", 3)
    rng, rows = random.Random(6), []
    for page in range(2):
        for o in range(200):
            x, y, w, h = rng.random() * 2, rng.random() * 2, 2 ** rng.uniform(-3, 1), 2 ** rng.uniform(-3, 1)
            rows.append((f"p{page}", o, (x, y, x + w, y + h)))
    frame = spark.createDataFrame(rows, "page string, ordinal int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    got = boxes.merge_overlapping(frame, ["page"], kept, at_least=at_least)
    want = geometry.merge_overlapping(frame, ["page"], at_least=at_least)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_thick_pages_make_few_pairs(spark, monkeypatch):
    pairs, found = [], boxes.neighbours
    monkeypatch.setattr(boxes, "neighbours", lambda *a: pairs.append((e := kept(found(*a))).count()) or e)
    made = []
    for n in (4_000, 16_000):
        x, y = (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(10_000)) / 5_000 for c in "xy")
        frame = spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("ordinal"), x.alias("x"), y.alias("y"))
        frame = frame.select("page", "ordinal", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 1).alias("x1"), (F.col("y") + 1).alias("y1")).alias("bbox"))
        pairs.clear()
        assert boxes.merge_overlapping(frame, ["page"], kept).agg(F.sum("n_boxes")).first()[0] == n
        made.append(sum(pairs) / n)
    assert made[1] < 1.5 * made[0] and made[1] < 100


def test_a_large_page_is_no_row(spark):
    n = 40_000
    frame = spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("ordinal"), F.struct(*[(F.col("id") % 200 + d).cast("double").alias(c) if c[0] == "x" else (F.floor(F.col("id") / 200) % 100 + d).cast("double").alias(c) for c, d in (("x0", 0.0), ("y0", 0.0), ("x1", 0.9), ("y1", 0.9))]).alias("bbox"))
    frame = frame.withColumn("bbox", F.struct(F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"), (F.col("bbox.x1") - F.col("ordinal") / 1e6).alias("x1"), F.col("bbox.y1").alias("y1")))
    got = boxes.merge_overlapping(frame, ["page"], kept)
    assert got.agg(F.count(F.lit(1)), F.sum("n_boxes"), F.max("seed")).first()[:] == (20_000, n, 19_999)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    old = spark.range(500).select(F.lit("t").alias("tenant_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.concat(F.lit("d"), "id").alias("document_id"))
    store.create(old, "stored_documents", str(tmp_path_factory.mktemp("store")), buckets=8)
    yield "stored_documents"
    spark.sql("DROP TABLE stored_documents")


def test_uploads_against_a_bucketed_store(spark, table):
    new = spark.range(400, 600).select(F.lit("t").alias("tenant_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.concat(F.lit("n"), "id").alias("document_id"), F.col("id").alias("created_at"))
    twice = new.union(new.withColumn("document_id", F.concat(F.lit("z"), "document_id")).withColumn("created_at", F.lit(10**6)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = store.insert_or_get(twice, table, buckets=8)
        found = {r.document_id: (r.created, r.stands) for r in got.collect()}
        plan = got._jdf.queryExecution().sparkPlan().toString()
        done = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 400 and "SortMergeJoin" in plan
    assert found["n420"] == (False, "d420") and found["zn420"] == (False, "d420") and found["n555"] == (True, "n555") and found["zn555"] == (False, "n555")
    # what is read from the store is joined as it lies: no exchange between its scan and the join
    lines = done.split("Initial Plan")[0].split("\n")
    right = lines[max(i for i, x in enumerate(lines) if x.lstrip().startswith(":")) + 1 :]
    assert any("FileScan" in x and "Bucketed: true" in x for x in right) and not any("Exchange" in x for x in right)
    assert sum("Exchange" in x for x in lines) == 1


def test_look_up_of_a_few_contents(spark, table):
    one = rows(spark.table(table).where("document_id = 'd7'"))[0][1]
    found = store.lookup(spark, table, [one, "0" * 64])
    assert [r.document_id for r in found.collect()] == ["d7"] and "PushedFilters: [In(sha256" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="too many"):
        store.lookup(spark, table, ["x"] * 1001)


def test_upsert_and_append_keep_the_buckets(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, 5.0, "old"), (1, 2, 6.0, "old")], "document_id long, page_no long, width double, render_uri string")
    store.create(old, "stored_pages", str(tmp_path / "p"), ("document_id", "page_no"), 4)
    try:
        store.append(old.withColumn("document_id", F.lit(2).cast("long")), "stored_pages", str(tmp_path / "p"), ("document_id", "page_no"), 4)
        new = spark.createDataFrame([(1, 2, 7.0, "new"), (3, 1, 8.0, "new")], old.schema)
        assert rows(store.upsert(new, "stored_pages", ("document_id", "page_no"), ("render_uri",))) == [(1, 1, 5.0, "old"), (1, 2, 7.0, "old"), (2, 1, 5.0, "old"), (2, 2, 6.0, "old"), (3, 1, 8.0, "new")]
    finally:
        spark.sql("DROP TABLE stored_pages")


def test_records_of_varying_fields(spark):
    texts = ['{"k": 1, "d": {"o": "x"}}', '{"k": "1"}', '{"k": [1]}', '{"d": 3}', "{broken", None, "7", "null", '{"k": 99999999999999999999}', '{"a": [{"q": 1}, {"q": "z"}, 4]}']
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, j string")
    got = {r.id: tuple(r)[1:] for r in read.variant_records(frame, "j", {"k": ("$.k", "bigint"), "o": ("$.d.o", "string")}).collect()}
    assert got[0] == (True, 1, "x") and got[1] == (True, 1, None) and got[2] == (True, None, None) and got[3] == (True, None, None)
    assert got[4] == (False, None, None) and got[5] == (True, None, None) and got[6] == (True, None, None) and got[8][1] is None
    fields = sorted((r.id, r.pos, r.key, r.type) for r in read.variant_fields(frame, "j").select("id", "pos", "key", "type").where("id < 4").collect())
    assert [f[2] for f in fields] == ["d", "k", "k", "k", "d"] and fields[0][3].startswith("OBJECT")
    items = read.variant_fields(frame, "j", "$.a").select("id", "pos", F.try_variant_get("value", "$.q", "int").alias("q"))
    assert rows(items.fillna(-1)) == [(9, 0, 1), (9, 1, -1), (9, 2, -1)]


def test_split_flow_from_sql_equals_the_dataframe_form(spark):
    texts = [("# A\nb\n\n- c\n", "md"), ("h\n" + "x,1\n" * 90, "csv"), ("one\n\n two \n\t\nthree", "txt"), ("  ", "txt"), (None, "md"), ("a\tb\n1\t2", "TSV"), ("p\n\nq", None), ("é\n \n\U0001f600 z", "log")]
    frame = spark.createDataFrame([(i, t, e, f"x{i}") for i, (t, e) in enumerate(texts)], "id long, body string, ext string, more string")
    frame.createOrReplaceTempView("flow_files")
    tablefunctions.register(spark)
    sql = "SELECT id, ext, more, reading_order, kind, text, char_start, char_end, section_path FROM split_flow(TABLE(SELECT * FROM flow_files), 'body', 'ext')"
    want = split.split_flow(frame, "body", "ext").select("id", "ext", "more", "reading_order", "kind", "text", "char_start", "char_end", "section_path")
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert key(spark.sql(sql)) == key(want)
    assert key(spark.sql(sql.replace("flow_files)", "flow_files) PARTITION BY (id)"))) == key(want)
    with pytest.raises(AnalysisException, match="no column"):
        spark.sql("SELECT * FROM split_flow(TABLE(SELECT * FROM flow_files), 'nothing', 'ext')").collect()


def test_heads_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in {"a.pdf": b"%PDF-1.7 " + b"x" * 5000, "b.txt": b"some words", "sub/c.png": b"\x89PNG\r\n\x1a\n" + b"0" * 90, "empty.md": b""}.items():
        (tmp_path / name).write_bytes(body)
    top = f"file://{tmp_path}"
    got = {r.path.split("/")[-1]: (r.length, len(r.head)) for r in heads.file_heads(spark, top, 100).collect()}
    assert got == {"a.pdf": (5009, 100), "b.txt": (10, 10), "c.png": (98, 98), "empty.md": (0, 0)}
    some = heads.file_heads(spark, str(tmp_path), 100).where(F.col("path").endswith("pdf") | (F.col("length") > 5)).where("length > 0 AND length <= 98")
    assert sorted(r.path.split("/")[-1] for r in some.collect()) == ["b.txt", "c.png"]
    (tmp_path / "b.txt").chmod(0)  # what a filter leaves out is never opened
    assert heads.file_heads(spark, top).where(F.col("path").contains("/sub/")).count() == 1
    found = formats.detect(heads.file_heads(spark, top, 100).where("path NOT LIKE '%b.txt'").select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("head").alias("content")), containers=False)
    assert {r.filename: r.extension for r in found.collect() if r.filename != "b.txt"} == {"a.pdf": "pdf", "c.png": "png", "empty.md": None}
