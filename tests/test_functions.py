import random
import re
from decimal import Decimal

import pytest

from folioscope.operators import split
from pyspark.sql import functions as F

from folioscope import plans
from folioscope.functions import geometry, numbers
from folioscope.functions.text import approx_tokens, locating_prefix, sentences, strip, text_gate
from folioscope.operators import chunk, resolve
from folioscope.sources import read


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "  ", "word", "two words, and signs!", "été ² ½", "a\x1cb", "日本 語", "x" * 50, "1 2 3 4 5"])
def test_tokens_agree_with_python(spark, text):
    assert one(spark, approx_tokens(F.lit(text))) == chunk.approx_tokens(text)


def test_strip_takes_all_white_space(spark):
    assert one(spark, strip(F.lit(" \t a b \n "))) == "a b"


def test_sentences_end_before_capitals(spark):
    assert one(spark, sentences(F.lit('One two. "Three" he said. four (five). Six!'))) == ["One two.", '"Three" he said. four (five).', "Six!"]


def gate(spark, text, **how):
    return one(spark, text_gate(F.lit(text), F.lit(612.0), F.lit(792.0), **how))


def test_gate_passes_prose_and_flags_trouble(spark):
    prose = "The company reported revenue for the fiscal year in line with its plan. " * 10
    assert gate(spark, prose) == (1.0, False, [])
    assert gate(spark, "") == (0.0, True, ["empty_text_layer"])
    assert gate(spark, " \n ").reasons == ["empty_text_layer"]
    assert gate(spark, "Stamp 12").needs_ocr
    assert gate(spark, "(cid:12)(cid:7) " * 40).confidence == 0.0
    assert gate(spark, prose + "�" * 120).needs_ocr
    assert gate(spark, "bcdfg hjklm npqrs tvwxz " * 20).needs_ocr
    assert not gate(spark, "Stamp 12", threshold=0.0).needs_ocr


def test_gate_refuses_pages_without_a_size(spark):
    with pytest.raises(Exception, match="positive"):
        one(spark, text_gate(F.lit("x"), F.lit(0.0), F.lit(1.0)))


CELLS = [
    ("1,234", "1234", False, False, False), ("$1,234.50", "1234.5", False, False, False), ("(1,234)", "-1234", False, True, False), ("($1,234)", "-1234", False, True, False),
    ("$(1,234)", "-1234", False, True, False), ("-5", "-5", False, True, False), ("−5", "-5", False, True, False), ("12%", "12", True, False, False), ("(3.5)%", "-3.5", True, True, False),
    ("25bps", "25", False, False, False), ("2.5x", "2.5", False, False, False), ("1,234(1)", "1234", False, False, True), ("1,234¹", "1234", False, False, True), ("(12)", "-12", False, True, False),
    ("((12))", "12", False, False, False), ("(-5)", "5", False, False, False), ("１２", "12", False, False, False), ("(12)(3)", "-12", False, True, True), ("+7", "7", False, False, False), (".5", "0.5", False, False, False), ("5.", "5", False, False, False),
]


@pytest.mark.parametrize("raw,value,percent,negative,noted", CELLS)
def test_cells(spark, raw, value, percent, negative, noted):
    got = one(spark, numbers.parse_number(F.lit(raw)))
    assert (got.value, got.is_percent, got.is_negative, got.had_footnote) == (Decimal(value), percent, negative, noted)


@pytest.mark.parametrize("raw", ["", "-", "—", "n/a", "NM", "nil", "*", "see note", "1.2.3", "12 March 2024", "(12", "--", None, "   "])
def test_cells_without_numbers(spark, raw):
    assert one(spark, numbers.parse_number(F.lit(raw).cast("string"))) is None


@pytest.mark.parametrize("turn,want", [(0, (0.1, 0.8, 0.2, 0.9)), (90, (0.1, 0.1, 0.2, 0.2)), (180, (0.8, 0.1, 0.9, 0.2)), (270, (0.8, 0.8, 0.9, 0.9)), (450, (0.1, 0.1, 0.2, 0.2))])
def test_rotations(spark, turn, want):
    got = one(spark, geometry.normalised(*[F.lit(x) for x in (20.0, 20.0, 10.0, 10.0)], F.lit(100.0), F.lit(100.0), F.lit(turn)))
    assert tuple(round(x, 9) for x in got) == want


def test_bad_rotation_is_an_error(spark):
    with pytest.raises(Exception, match="multiple of 90"):
        one(spark, geometry.normalised(*[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0, 10.0, 10.0)], F.lit(45)))


def box(*x):
    return geometry.box(*[F.lit(v) for v in x])


def test_iou_and_edges(spark):
    assert one(spark, geometry.iou(box(0.0, 0.0, 0.5, 0.5), box(0.0, 0.0, 0.5, 0.5))) == 1.0
    assert one(spark, geometry.iou(box(0.0, 0.0, 0.5, 0.5), box(0.5, 0.0, 1.0, 0.5))) == 0.0


def test_merge_takes_the_largest_first(spark):
    rows = [(1, 0, 0.0, 0.0, 0.2, 0.2), (1, 1, 0.0, 0.0, 0.21, 0.21), (1, 2, 0.5, 0.5, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "page int, ordinal int, a double, b double, c double, d double").select("page", "ordinal", geometry.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("bbox"))
    got = sorted(tuple(r) for r in geometry.merge_overlapping(df, ["page"]).collect())
    assert got == [(1, 1, 2, 0.0, 0.0, 0.21, 0.21), (1, 2, 1, 0.5, 0.5, 0.9, 0.9)]


def test_prefixes(spark):
    def prefix(company, form, year, name, path, page):
        return one(spark, locating_prefix(F.lit(company).cast("string"), F.lit(form).cast("string"), F.lit(year).cast("int"), F.lit(name).cast("string"), F.array(*[F.lit(p) for p in path]).cast("array<string>"), F.lit(page).cast("int")))

    assert prefix("Acme", "10-K", 2024, "f.pdf", ["Item 1", "Risk"], 3) == "From Acme 10-K 2024, section Item 1 > Risk, page 3."
    assert prefix(None, None, None, "f.pdf", [], None) == "From f.pdf."
    assert prefix(None, None, None, None, [], 0) == "From document."


def test_markdown_blocks_by_their_first_lines():
    text = "# One #\r\nfirst\nline\n\n## Two\n- a\n- b\n-\n| x | y |\n~~~py\n# no heading\n\n~~~\ntail\n#none\n# \n  ```\nopen"
    got = [(b["kind"], b["text"], b["section_path"]) for b in split.markdown(text)]
    one, two = ["One"], ["One", "Two"]
    assert got == [
        ("heading", "# One #", one), ("paragraph", "first\nline", one), ("heading", "## Two", two), ("list", "- a\n- b", two), ("paragraph", "-", two), ("table", "| x | y |", two),
        ("paragraph", "~~~py\n# no heading\n\n~~~", two), ("paragraph", "tail\n#none", two), ("heading", "#", [""]), ("paragraph", "```\nopen", [""]),
    ]
    assert all(text[b["char_start"] : b["char_end"]] == b["text"] for b in split.markdown(text)) and split.markdown(" \n ") == []


def test_a_turn_is_told_once_a_box(spark):
    edges = geometry.normalised(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height", "rotation")])
    frame = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0, 10.0, 20.0, 90)], "x0 double, y0 double, x1 double, y1 double, width double, height double, rotation int").select(edges.alias("b"))
    assert frame._jdf.queryExecution().analyzed().toString().count("pmod(") <= 5
    assert [round(v, 6) for v in frame.first()["b"]] == [0.1, 0.1, 0.25, 0.3]


PLACE = ("x0", "y0", "x1", "y1", "width", "height", "rotation")


def code_sizes(df, capsys):
    """Bytes of the longest method of each compiled part of a plan; the JVM interprets those over 8,000."""
    session = df.sparkSession
    session.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.select("*").explain("codegen")
    finally:
        session.conf.unset("spark.sql.adaptive.enabled")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]


def test_boxes_of_a_table_are_those_of_columns(spark):
    rng = random.Random(3)
    rows = [(*[rng.choice([None, -3.0, 0.0, 1e-9, 9.999999999, 50.0, rng.uniform(-5, 60)]) for _ in range(4)], rng.choice([10.0, 50.0, None]), 20.0, rng.choice([0, 90, 180, 270, 450, -90])) for _ in range(300)]
    frame = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double, width double, height double, rotation int").withColumn("a.b", F.lit(1))
    columns = [F.col(c) for c in PLACE]
    got = geometry.with_boxes(frame.withColumn("same", geometry.normalised(*columns)), *columns)
    assert got.columns == [*PLACE, "a.b", "same", "bbox"]
    assert got.count() == 300 and got.where(~F.col("bbox").eqNullSafe(F.col("same"))).count() == 0
    for turn, wide, says in ((45, 10.0, "multiple of 90"), (0, 0.0, "positive")):
        with pytest.raises(Exception, match=says):
            geometry.with_boxes(frame.limit(1), *[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0, wide, 10.0, turn)]).collect()


@pytest.mark.parametrize("name", ["bbox_iou", "bbox_normalise", "union_bbox", "citation_targets"])
def test_boxes_are_compiled(spark, capsys, name):
    sizes = code_sizes(plans.QUERIES[name](spark, "/root/testdata/sf0.001"), capsys)
    assert sizes and max(sizes) < 8000


def test_pairs_of_boxes_shuffle_them_once(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = plans.QUERIES["bbox_iou"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert plan.count("ReusedExchange") == 1 and plan.count("FileScan") == 1


def test_targets_make_boxes_once_and_shuffle_blocks_by_chunk_once(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = plans.QUERIES["citation_targets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert plan.count("Generate inline(") == 1
    # links, blocks, placed blocks, chunks by document and by id, documents
    assert plan.count("Exchange hashpartitioning(") == 6
    assert len(re.findall(r"Sort \[block_id#", plan)) == 2  # a sort for each side of the join, none for the least box


def test_targets_of_links_that_are_there_twice(spark):
    chunks = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "chunk_id int, document_id int")
    docs = spark.createDataFrame([(7, "a"), (8, None)], "document_id int, original_name string")
    links = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (1, 12), (1, 13), (2, 11), (2, 14), (2, 15), (2, None), (3, 99), (None, 10)], "chunk_id int, block_id int")
    near = (0.1, 0.2, 0.3, 0.4)
    blocks = spark.createDataFrame([(10, 2, near), (11, 1, near), (12, 2, (0.2, 0.1, 0.2, 0.9)), (13, 0, None), (14, None, near), (15, 1, (0.0, 0.3, 0.1, 0.5)), (None, 1, near)], "block_id int, page_no int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    got = {r.chunk_id: (r.document_name, [(x.page_no, tuple(x.bbox)) for x in r.regions]) for r in resolve.citation_targets(chunks, docs, links, blocks).collect()}
    assert got == {1: ("a", [(1, near), (2, (0.1, 0.1, 0.3, 0.9))]), 2: ("a", [(1, (0.0, 0.2, 0.3, 0.5))]), 3: (None, [])}


def test_fragments_are_compiled_and_stripped_once(spark, capsys):
    fragments = plans.QUERIES["pdf_fragments"](spark, "/root/testdata/sf0.001")
    assert max(code_sizes(fragments, capsys)) < 8000
    assert fragments._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_fragments_leave_out_what_is_blank_or_has_no_size(spark):
    texts = ["", " ", "\x1c", " \n", None, " a\x1f\n", "b\n", "\nc d\x85", "off", "flat"]
    rows = [(1, 1, i, t, 20.0 if t == "off" else 1.0, 1.0, 30.0 if t == "off" else 3.0, 1.0 if t == "flat" else 4.0, 10.0, 10.0, 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, f"document_id int, page_no int, rect_no int, text string, {', '.join(f'{c} double' for c in PLACE[:-1])}, rotation int")
    got = read.pdf_fragments(frame).orderBy("reading_order").collect()
    assert [(r.reading_order, r.text) for r in got] == [(1, "a"), (2, "b"), (3, "c d")]
    assert [tuple(round(v, 9) for v in r.bbox) for r in got] == [(0.1, 0.6, 0.3, 0.9)] * 3
