"""The pipeline's stages against brute force, and on awkward tables."""

import random

import pytest
from test_ops import AWKWARD, plain_ids

import corpus_pipeline as cp
from folioscope.llm import jaccard as near
from folioscope.llm import simhash

TOP = "/root/testdata/sf0.001"


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TOP}/documents.parquet")


def test_stages_are_named_in_order():
    assert [n for n, _ in cp.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "tokens"]


def test_run(spark, docs):
    kept, at = docs, {}
    for name, stage in cp.STAGES[:-1]:
        kept = cp.stored(stage(spark, kept, TOP))
        assert kept.columns == docs.columns
        at[name] = kept.collect()
    tokens = sorted(cp.run(spark, TOP).collect(), key=lambda r: r.start)
    last = sorted(at["mix"], key=lambda r: (r.doc_id, r.text))
    ids = plain_ids([r.text for r in last])
    assert [(r.doc_id, r.n_tokens) for r in tokens] == [(r.doc_id, len(i)) for r, i in zip(last, ids, strict=True)]
    assert len(at["language"]) == docs.count()


def test_near_dedup_against_exact_similarity(spark, docs):
    rows = {r.doc_id: five(r.text) for r in docs.collect()}
    kept = {r.doc_id for r in cp.near_dedup(spark, docs, TOP).collect()}
    ids = sorted(rows)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and root[i] != root[j] and jaccard(rows[i], rows[j]) >= 0.8:
                x, y = sorted((root[i], root[j]))
                root = {k: x if r == y else r for k, r in root.items()}
    assert kept == set(root.values()) and len(kept) < len(ids)


def test_near_dedup_of_planted_copies(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(30):
        base = rng.choices(words, k=300)
        rows.append((1000 * g, " ".join(base)))
        for k in range(1, 4):
            w = list(base)
            for i in rng.sample(range(300), 4):
                w[i] = rng.choice(words)
            rows.append((1000 * g + k, " ".join(w)))
    rows += [(10**6 + i, " ".join(rng.choices(words, k=200))) for i in range(50)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.near_dedup(spark, df, TOP).collect()}
    assert {10**6 + i for i in range(50)} <= kept and {1000 * g for g in range(30)} <= kept and len(kept) <= 82


def test_near_dedup_keeps_short_texts_that_differ(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(5 + i % 3))) for i in range(1500)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.near_dedup(spark, df, TOP).count() == 1500


def test_near_dedup_decides_by_exact_similarity(spark):
    rng = random.Random(3)
    word = lambda: f"u{rng.randrange(10**7)}"
    rows, apart = [], 0
    for g in range(150):
        short, long = [word() for _ in range(8)], [word() for _ in range(104)]
        rows += [(10 * g, short), (10 * g + 1, [*short, word()])]  # 4 of 5 shingles: exactly 0.8
        if g % 3 == 0:  # 3 of 5, and 83 of 117: 0.60 and 0.71
            other = [word() for _ in range(8)]
            rows += [(10 * g + 2, other), (10 * g + 3, [*other[:7], word()]), (10 * g + 4, long), (10 * g + 5, [*long[:87], *(word() for _ in range(17))])]
            apart += 4
    rows = [(i, " ".join(w)) for i, w in rows]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.near_dedup(spark, df, TOP).collect()}
    assert kept == {i for i, _ in rows if i % 10 != 1} and len(kept) == 150 + apart


def test_near_dedup_is_whole_on_overlapping_copies(spark, docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=100)
    texts = [" ".join(base)]
    for _ in range(150):  # copies of copies, on both sides of 0.8
        w = rng.choice(texts).split()
        for i in rng.sample(range(100), rng.randrange(1, 5)):
            w[i] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [r.text for r in docs.collect()]
    shingles, root = [five(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(shingles[i], shingles[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_dedup(spark, df, TOP).collect()} == set(root)


def test_near_dedup_removes_rows_and_not_ids(spark):
    a, b, c = "a text that stands under two ids here", "another text under an id that is taken", "a third text that stands here two times"
    rows = [(3, a), (5, a), (5, b), (9, c), (9, c), (None, a), (None, b), (None, "without an id but not like any"), (None, "without an id but not like any")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in cp.near_dedup(spark, df, TOP).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (5, b), (9, c), (None, "without an id but not like any")], key=str)


@pytest.mark.parametrize("sampled,heavy,tile", [(16, 64, 8192), (1, 12, 8192), (1, 12, 20), (2, 4, 20)])
def test_near_groups_among_shared_passages(spark, monkeypatch, sampled, heavy, tile):
    """Passages that many texts share, alone and with more or fewer words of their own, on both sides of 0.8."""
    monkeypatch.setattr(simhash.shard_links, "__defaults__", (tile,))
    monkeypatch.setattr(near.cluster_links, "__defaults__", (tile,))
    monkeypatch.setattr(near.overlaps, "__defaults__", (tile * 3,))
    rng = random.Random(heavy)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [[word() for _ in range(n)] for n in (60, 30, 12)]
    texts = []
    for _ in range(260):
        p, n = rng.choice(shared), rng.choice([0, 1, 2, 3, 5, 8, 12, 40, 120])
        own = [word() for _ in range(n)]
        texts.append(own[: n // 2] + p + own[n // 2 :])
    for _ in range(120):
        w = list(rng.choice(texts))
        for i in rng.sample(range(len(w)), rng.randrange(0, 3)):
            w[i] = word()
        texts.append(w)
    texts = [" ".join(t) for t in texts]
    grams, root = [five(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(grams[i], grams[j]) >= 0.8 and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_groups(df, sampled=sampled, heavy=heavy).collect()}
    assert got == dict(enumerate(root))


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_awkward(spark, name, stage):
    long = " ".join(f"word{i % 977} the and of" for i in range(20_000))
    texts = [(1, None), (2, ""), (3, " \n "), (4, "one two three"), (4, "one two three"), (5, "one two three"), (6, long), (None, "no id here at all"), (None, None), (7, "12 34"), (8, "x" * 70_000)]
    df = spark.createDataFrame([(i, t, "en" if i else None, None if i == 6 else "s", None, 0.5, 1, "x", 2, 3, 4, "w") for i, t in texts], AWKWARD)
    got = stage(spark, df, TOP)
    rows = got.collect()
    if name != "tokens":
        assert got.columns == df.columns
    if name == "language":
        assert {r.doc_id for r in rows} == {4, 5, 6, 8, None}
    if name == "near_dedup":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 4, 6, 7, 8] and {r.text for r in rows if r.doc_id is None} == {"no id here at all"}
    if name == "decontaminate":
        assert len(rows) == len(texts)
    if name == "tokens":
        assert len(rows) == len(texts)
    empty = stage(spark, df.limit(0), TOP)
    assert empty.count() == 0
