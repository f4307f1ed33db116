import io
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.operators import answer, chunk, dense, fuse, lexical, split
from folioscope.operators.chunk import Block, Document, approx_tokens, chunk_document
from folioscope.sources import formats, messages, write

A, B = ("Part I", "Item 1"), ("Part I", "Item 7")
FILING = [
    Block("h", "Running head", "header", 1, 1, True), Block("t", "Business", "heading", 1, 2, True, section_path=A), Block("p1", "We make tools. They are good.", "paragraph", 1, 3, True, section_path=A),
    Block("p2", "We sell them.", "paragraph", 1, 4, True, section_path=A), Block("tab", "a | b", "table", 2, 1, True, section_path=A), Block("t2", "Results", "heading", 2, 2, True, section_path=B),
    Block("p3", "Sales rose. Costs fell.", "paragraph", 2, 3, True, section_path=B), Block("no", "2", "page_number", 2, 4, True),
]


def embed(texts):
    return [[1.0, 0.0] if "tools" in t or "sell" in t or "good" in t else [0.0, 1.0] for t in texts]


@pytest.mark.parametrize("strategy", chunk.STRATEGIES)
def test_every_chunk_is_located_and_all_blocks_are_covered(strategy):
    got = chunk_document(strategy, FILING, target=12, overlap=4, embed=embed)
    assert got and all(c.block_ids and c.text.strip() and c.page_from <= c.page_to for c in got)
    named = {i for c in got for i in c.block_ids}
    assert named == {b.block_id for b in FILING} - {"h", "no"}
    assert chunk_document(strategy, [], embed=embed) == []


def test_layout_keeps_sections_and_tables_apart():
    got = chunk_document("layout", FILING, target=100, overlap=0)
    assert [c.block_ids for c in got] == [["t", "p1", "p2"], ["tab"], ["t2", "p3"]]
    assert [c.section_path for c in got] == [A, A, B]


def test_layout_carries_a_short_block():
    blocks = [Block(str(i), f"Sentence number {i} is here.", reading_order=i) for i in range(6)]
    got = chunk_document("layout", blocks, target=20, overlap=10)
    assert got[1].block_ids[0] == got[0].block_ids[-1]


def test_fixed_windows_fit_and_overlap():
    got = chunk_document("fixed", [Block("b", " ".join(f"w{i}" for i in range(400)))], target=64, overlap=16)
    assert all(c.token_count <= 64 for c in got)
    assert set(got[0].text.split()) & set(got[1].text.split())
    assert len(chunk_document("fixed", [Block("b", "x" * 500)], target=1)) == 1


def test_recursive_splits_at_coarse_separators_first():
    text = "\n\n".join(["Alpha beta gamma. Delta epsilon; zeta, eta theta."] * 6)
    got = chunk_document("recursive", [Block("b", text)], target=15, overlap=0)
    assert all(c.token_count <= 17 for c in got) and " ".join(c.text for c in got).split() == text.split()


def test_recursive_overlap_uses_the_chunk_before_as_it_was_cut():
    blocks = [Block(str(i), f"Paragraph {i} with some words in it.", reading_order=i, char_start=40 * i, char_end=40 * i + 30) for i in range(4)]
    plain = chunk_document("recursive", blocks, target=12, overlap=0)
    got = chunk_document("recursive", blocks, target=12, overlap=4)
    for before, p, c in zip(plain, plain[1:], got[1:], strict=False):
        words = c.text[: -len(p.text)].split()
        assert words and before.text.split()[-len(words) :] == words and c.block_ids[0] == before.block_ids[-1]


def test_semantic_cuts_where_topics_change():
    blocks = [Block("a", "We make tools. All tools are good. Tools sell well."), Block("b", "Snow fell. The rain came.", reading_order=1)]
    got = chunk_document("semantic", blocks, embed=embed, target=500)
    assert [c.block_ids for c in got] == [["a"], ["b"]] and got[0].meta == {"cut_similarity": 0.0} and got[1].meta == {}
    with pytest.raises(ValueError, match="vectors"):
        chunk_document("semantic", blocks, embed=lambda t: embed(t)[:-1])


def test_unknown_strategy_names_the_known_ones():
    with pytest.raises(ValueError, match="fixed, recursive, layout, semantic"):
        chunk_document("other", FILING)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n;,", min_size=0, max_size=60), max_size=8), st.integers(1, 12), st.integers(0, 6))
def test_chunks_of_any_text_cover_their_words(texts, target, overlap):
    blocks = [Block(str(i), t, reading_order=i) for i, t in enumerate(texts)]
    want = [w for b in Document(blocks).blocks for w in b.text.split()]
    for strategy in ("fixed", "recursive", "layout"):
        plain = chunk_document(strategy, blocks, target=target, overlap=0)
        assert [w for c in plain for w in c.text.split()] == want or strategy == "recursive" and "".join("".join(c.text.split()) for c in plain) == "".join(want)
        assert all(c.block_ids for c in chunk_document(strategy, blocks, target=target, overlap=overlap))


def test_packing():
    assert chunk.pack([3, 3, 3], 6) == [0, 0, 1] and chunk.pack([9, 1, 1], 6) == [0, 1, 1] and chunk.pack([], 5) == [] and chunk.pack([0, 7, 0], 6) == [0, 1, 2]


def test_chunk_dataframe(spark):
    rows = [("d1", b.block_id, b.text, b.kind, b.page_no, b.reading_order, list(b.section_path)) for b in FILING]
    df = spark.createDataFrame(rows, "document_id string, block_id string, text string, kind string, page_no int, reading_order int, section_path array<string>")
    got = chunk.chunk(df, ("layout", "fixed"), target=100, overlap=0).orderBy("strategy", "seq").collect()
    assert [r.strategy for r in got] == ["fixed", "layout", "layout", "layout"] and got[1].block_ids == ["t", "p1", "p2"] and got[1].token_count == approx_tokens(got[1].text) and got[0].char_start is None
    with pytest.raises(ValueError):
        chunk.chunk(df, ("other",))


MARKDOWN = "# One\n\nText here.\nMore.\n\n## Two\n- a\n- b\n\n| x | y |\n|---|---|\n\n```\n# no heading\n\n```\n\n### Three ###\n## Four\nEnd\n"


def test_markdown():
    got = split.markdown(MARKDOWN)
    assert [(b["kind"], b["section_path"]) for b in got] == [
        ("heading", ["One"]), ("paragraph", ["One"]), ("heading", ["One", "Two"]), ("list", ["One", "Two"]), ("table", ["One", "Two"]), ("paragraph", ["One", "Two"]),
        ("heading", ["One", "Two", "Three"]), ("heading", ["One", "Four"]), ("paragraph", ["One", "Four"]),
    ]
    assert all(MARKDOWN[b["char_start"] : b["char_end"]] == b["text"] for b in got)


def test_delimited():
    text = "a,b\n" + "".join(f"{i},{i}\n" for i in range(100))
    got = split.delimited(text)
    assert len(got) == 3 and all(b["text"].startswith("a,b\n") for b in got) and text[got[1]["char_start"] : got[1]["char_end"]].startswith("40,40")
    assert split.delimited("a,b\n") == [] and split.delimited("") == []


def test_split_flow(spark):
    rows = [(1, "One.\n\nTwo\nlines.\n  \nThree.", "txt"), (2, MARKDOWN, "md"), (3, "h\n1\n2", "csv"), (4, "  ", "txt"), (5, None, "md")]
    df = spark.createDataFrame(rows, "id int, text string, extension string")
    got = split.split_flow(df).orderBy("id", "reading_order").collect()
    assert [r.text for r in got if r.id == 1] == ["One.", "Two\nlines.", "Three."] and {r.id for r in got} == {1, 2, 3}
    assert all(rows[0][1][r.char_start : r.char_end] == r.text for r in got if r.id == 1)


def packed(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, data in names:
            z.writestr(n, data)
    return out.getvalue()


FILES = [
    (b"%PDF-1.7", "a.txt", "pdf"), (b"\x89PNG\r\n\x1a\n..", "a", "png"), (b"\xff\xd8\xff\xe0", "a.png", "jpg"), (b"GIF89a", "", "gif"), (b"II*\x00", "", "tiff"), (b"BM..", "", "bmp"), (b"RIFF\0\0\0\0WEBP", "", "webp"),
    (b"{\\rtf1", "", "rtf"), (bytes.fromhex("D0CF11E0A1B11AE1") + b"..", "x.XLS", "xls"), (bytes.fromhex("D0CF11E0A1B11AE1"), "x.bin", None), (packed(("word/document.xml", "")), "x.zip", "docx"),
    (packed(("mimetype", "application/vnd.oasis.opendocument.text")), "x", "odt"), (packed(("other", "")), "x.bin", None), (packed(("other", "")), "x.md", "md"), (b"PK\x03\x04junk", "x.docx", None),
    (b" \n<!DOCTYPE HTML><p>", "x.txt", "html"), (b"# Title", "x.md", "md"), (b"a,b", "x.CSV", "csv"), ("été ".encode() * 4000, "x", "txt"), (("a" + "é" * 5000).encode(), "x", "txt"), (b"a\0b", "x.txt", None), (b"\xff\xfe", "x.txt", None), (b"", "x.txt", None),
    (b"\x01\x02\x03 abc", "x.txt", None), (b"text", "x.pdf", "txt"),
]


def test_formats(spark):
    df = spark.createDataFrame([(i, bytearray(c), n) for i, (c, n, _) in enumerate(FILES)], "i int, content binary, filename string")
    got = {r.i: r for r in formats.detect(df).collect()}
    assert [got[i].extension for i in range(len(FILES))] == [e for _, _, e in FILES]
    assert all((got[i].error is None) == (e is not None) for i, (_, _, e) in enumerate(FILES)) and got[22].error == "empty file"


def test_fusion(spark):
    rows = [(1, "a", 1, "x"), (1, "a", 2, "y"), (1, "a", 3, "x"), (1, "b", 1, "y"), (1, "b", 2, "z")]
    df = spark.createDataFrame(rows, "query_id int, retriever string, position int, id string")
    got = fuse.reciprocal_rank_fusion(df).orderBy("position").collect()
    assert [r.id for r in got] == ["y", "x", "z"] and got[0].ranks == {"a": 2, "b": 1} and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-15
    got = fuse.reciprocal_rank_fusion(df, weights={"b": 0.0}, limit=1).collect()
    assert [r.id for r in got] == ["x"] and got[0].ranks == {"a": 1}
    assert fuse.reciprocal_rank_fusion(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fuse.reciprocal_rank_fusion(df, k=0)


def test_porter_and_queries():
    assert [lexical.stem(w) for w in ("caresses", "ponies", "cats", "agreed", "plastered", "motoring", "hopping", "falling", "happy", "relational", "adjustable", "rate", "controlling")] == ["caress", "poni", "cat", "agre", "plaster", "motor", "hop", "fall", "happi", "relat", "adjust", "rate", "control"]
    assert lexical.parse('risk factors or "net sales" -cost', False) == [[(True, ["risk"]), (True, ["factors"])], [(True, ["net", "sales"]), (False, ["cost"])]]
    assert lexical.parse("-only") == [] and lexical.parse("") == [] and lexical.parse(None) == []
    assert lexical.cover_density(["a", "b"], {"a": [1, 10], "b": [2]}) > lexical.cover_density(["a", "b"], {"a": [1], "b": [9]})


def test_search(spark):
    docs = spark.createDataFrame([(1, "Net sales rose sharply"), (2, "Sales of net assets"), (3, "Costs of sales"), (4, None)], "chunk_id int, text string")
    index = lexical.postings(docs)
    ask = lambda q: [r.id for r in lexical.search(spark.createDataFrame([(1, q)], "query_id int, text string"), index).orderBy("position").collect()]
    assert ask('"net sales"') == [1] and ask("net sale") == [1, 2] and ask("sales -net") == [3] and ask("rise or cost") == [3] and ask("the") == []


def test_knn_filters_before_it_ranks(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(6)], "vec_id int, embedding array<float>, label int")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query_vector array<float>")
    assert [r.id for r in dense.knn(q, v, 2, {"label": 0, "x": None}).orderBy("position").collect()] == [4, 2]
    assert dense.ensure_width(v) == 2
    with pytest.raises(dense.DimensionMismatch):
        dense.ensure_width(v, width=3)
    with pytest.raises(Exception, match="differ"):
        dense.knn(q, v.withColumn("embedding", F.array(F.lit(1.0))), 2).collect()


def test_embed_keeps_order_and_counts(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(200)], "i int, text string")
    got = df.select("i", dense.embed(F.col("text"), lambda: lambda t: [[len(x)] for x in t], batch=7).alias("v")).collect()
    assert all(r.v == [float(r.i)] for r in got)


def test_percentile_and_cosine():
    assert chunk.percentile([1, 2, 4, 9], 0.25) == 1.75 and chunk.percentile([], 0.5) == 0.0 and chunk.cosine([0, 0], [1, 1]) == 0.0 and np.isclose(chunk.cosine([1, 1], [2, 2]), 1)
    with pytest.raises(ValueError):
        chunk.cosine([1], [1, 2])


def test_messages(spark):
    good = '{"document_id":"d","run_id":"r","stage":"chunk","family":"pdf","pipeline_version":"1"}'
    rows = [good, good.replace('"pdf"', '"tape"'), "[1]", "{oops", good.replace("}", ',"attempt":true}'), good.replace("}", ',"meta":{"k":1}}'), '{"stage":"x"}', ""]
    got = [r for r in messages.decode(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")).orderBy("i").collect()]
    assert [r.error is None for r in got] == [True, False, False, False, False, True, False, False]
    assert got[0].message.attempt == 1 and got[0].message.tenant_id == "default" and got[5].message.meta == {"k": "1"} and got[6].error.startswith("missing fields document_id")


def test_idempotent_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "document_id int, x string")
    path = str(tmp_path / "t")
    write.replace_partitions(df, path, ["document_id"])
    write.replace_partitions(df.where("document_id = 2").withColumn("x", F.lit("c")), path, ["document_id"])
    write.replace_partitions(df.where("document_id = 2").withColumn("x", F.lit("c")), path, ["document_id"])
    assert sorted((r.document_id, r.x) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    assert [r.x for r in write.without_documents(df, df.where("document_id = 1")).collect()] == ["b"]


def test_answers(spark):
    n = lambda text, k: spark.range(1).select(answer.cited_markers(F.lit(text), F.lit(k)).alias("m")).first().m
    assert n("see [2], [1] and [2]; [9] [0]", 3) == [1, 2] and n("none", 3) == []
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", " "), (2, 0, "system", "x")], "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in answer.last_user_turns(turns).collect()] == [(1, "a")]


def test_semantic_chunks_are_slices_of_the_flat_text():
    blocks = [chunk.Block("1", "First one. Second one."), chunk.Block("2", "Third one.\nFourth one.", reading_order=1)]
    alike = chunk.chunk_document("semantic", blocks, embed=lambda texts: [[1.0, 0.0]] * len(texts))
    assert [c.text for c in alike] == ["First one. Second one.\n\nThird one.\nFourth one."]
    seen = []
    parts = chunk.chunk_document("semantic", blocks, embed=lambda texts: seen.extend(texts) or [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])
    assert seen == ["First one.", "Second one.", "Third one.", "Fourth one."]
    assert [(c.text, c.block_ids, c.meta) for c in parts] == [("First one. Second one.", ["1"], {"cut_similarity": 0.0}), ("Third one.\nFourth one.", ["2"], {})]


@pytest.mark.parametrize("seed", range(4))
def test_windows_and_overlaps_keep_to_their_budgets(seed):
    """Fixed windows follow each other without gaps, fit their target, and step back by as many words as the overlap allows."""
    rng = random.Random(seed)
    text = " ".join("".join(rng.choices("ab-.", k=rng.randrange(1, 9))) + str(i) for i in range(300))
    words = text.split()
    for target, overlap in ((20, 0), (20, 6), (7, 6), (1, 1)):
        made = [c.text.split() for c in chunk.chunk_document("fixed", [chunk.Block("1", text)], target, overlap)]
        at = 0
        for before, window in zip([None, *made], made, strict=False):
            back = 0 if before is None else next(n for n in range(len(before), -1, -1) if words[at - n : at - n + len(window)] == window and (n == 0 or sum(map(chunk.approx_tokens, before[-n:])) <= overlap))
            at += len(window) - back
            assert chunk.approx_tokens(" ".join(window)) <= target or len(window) == 1
        assert at == len(words)


def test_alternatives_of_a_batch_are_ranked_once(spark):
    docs = spark.createDataFrame([(i, " ".join(["ising"] * (i % 7) + ["gas"] * (i % 5) + ["red cap"] * (i % 3))) for i in range(60)], "chunk_id long, text string")
    index = lexical.postings(docs)
    asked = ["ising or gas", "gas or ising", 'ising gas or "red cap" -gas', "cap red", "ising or cap or gas red"]
    queries = spark.createDataFrame([(n, q) for n, q in enumerate(asked * 3)], "query_id int, text string")
    where = {r["chunk_id"]: {} for r in docs.collect()}
    for r in index.collect():
        where[r["id"]][r["term"]] = list(r["positions"])
    for k in (4, None):
        got = {}
        for r in lexical.search(queries, index, k).collect():
            got.setdefault(r["query_id"], []).append((r["position"], r["id"], round(r["score"], 9)))
        for n, q in enumerate(asked * 3):
            scores = [(-round(max(lexical.cover_density(m, w) for m in met), 9), i) for i, w in where.items() if (met := lexical.matches(lexical.parse(q), w))]
            want = [(p, i, -s) for p, (s, i) in enumerate(sorted(scores)[:k], 1)]
            assert sorted(got.get(n, [])) == want, q


def test_a_stored_corpus_is_made_once(spark):
    files = spark.createDataFrame([("a.txt", bytearray(b"net sales rose"))], "filename string, content binary")
    from folioscope import engine
    from folioscope.plans.common import kept

    c = engine.stored(engine.ingest(files, kept=kept), kept)
    for t in (c.documents, c.blocks, c.chunks, c.chunk_blocks, c.postings):
        assert t.inputFiles() and not any(w in t._jdf.queryExecution().toString() for w in ("MapInPandas", "Generate"))


def test_postings_of_a_corpus_are_not_shuffled_and_tables_stored_once(spark, monkeypatch):
    from folioscope import engine
    from folioscope.plans.common import kept

    said = ["Net sales rose; sales of nets fell, the rising sale.", "Red cap, red caps and a red-capped café. " * 30, "  \n ", "Été of 12 été"]
    files = spark.createDataFrame([(f"{i}.txt", bytearray(t.encode())) for i, t in enumerate(said)] + [("again.txt", bytearray(said[0].encode()))], "filename string, content binary")
    c = engine.ingest(files, kept=kept, target=20, overlap=0)
    assert "Exchange" not in c.postings._jdf.queryExecution().executedPlan().toString()
    held = engine.stored(c, kept)
    assert (held.blocks, held.chunks) == (c.blocks, c.chunks) and held.documents is not c.documents and held.postings.inputFiles()
    assert sorted(r["status"] for r in held.documents.collect()) == ["failed", "ready", "ready", "ready"]
    # what would take as much disk as the files themselves goes no further than detection
    assert "content" not in {f.name for t in (c.documents, c.blocks, c.chunks) for f in t.schema}
    docs = c.chunks.select("chunk_id", "text", F.lit("t").alias("tenant_id"))
    for run in (1, 9, 1 << 20):
        for stemmed in (True, False):
            monkeypatch.setattr(lexical, "RUN_WORDS", run)
            got = lexical.placed(docs, stemmed=stemmed, payload=("tenant_id",)).collect()
            want = lexical.postings(docs, stemmed=stemmed).collect()
            assert sorted((r.term, r.id, list(r.positions)) for r in got) == sorted((r.term, r.id, list(r.positions)) for r in want)
            assert {r.tenant_id for r in got} == {"t"}


def test_a_text_is_blank_if_nothing_is_left_of_it(spark):
    from folioscope.functions.text import is_blank, strip

    said = [None, "", " ", "\n\t\r", "\x1c\x1f", "\u00a0\u2003\u3000", "\u200b", "x", " \n x \n", "\x00", "\x85"]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", is_blank(F.col("t")).alias("b"), (strip(F.col("t")) == "").alias("s")).collect()
    assert [r.b for r in rows] == [r.t is None or r.s for r in rows] and [r.b for r in rows][7:10] == [False] * 3


def test_chunks_leave_python_in_batches(spark, monkeypatch):
    # two hundred documents in one part: as many frames before, one batch now
    blocks = spark.range(200).coalesce(1).select(F.col("id").alias("document_id"), F.concat(F.lit("b"), "id").alias("block_id"), F.concat(F.lit("Some words. Other words "), "id").alias("text"))
    made = chunk.chunk(blocks, ("layout", "fixed", "semantic"), embed=lambda texts: [[1.0, float(len(t))] for t in texts])
    plan = made._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    want = {(i, s): (f"Some words. Other words {i}", [f"b{i}"]) for i in range(200) for s in ("layout", "fixed", "semantic")}
    got = {(r["document_id"], r["strategy"]): (r["text"], r["block_ids"]) for r in made.collect()}
    assert got == want
