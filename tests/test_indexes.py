"""Stored indexes: approximate vector search with bitmaps, posting blocks with pruning and upkeep, phrases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import ann, dense, lexical, lexindex

TOP = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    """3,000 vectors around 30 centres, a third of them equal, with nulls and payloads."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[::3] = x[0]
    rows = [(i, None if i % 500 == 7 else [float(v) for v in x[i]], None if i % 11 == 0 else int(i % 4), f"t{i % 3}") for i in range(3000)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, third string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ann"))
    ann.build(vectors, path, payload=("label", "third"), parts=4, bucket=512)
    return path


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("vec_id % 50 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def test_every_vector_is_in_the_index_once(spark, vectors, index):
    rows = spark.read.parquet(f"{index}/vectors")
    assert sorted(r.id for r in rows.select("id").collect()) == sorted(r.vec_id for r in vectors.where("embedding IS NOT NULL").collect())
    assert rows.select("bucket", "pos").distinct().count() == rows.count() and rows.agg(F.max("pos")).first()[0] < 512
    assert rows.select("bucket").distinct().count() >= 6


def test_recall_with_a_third_of_all_vectors_equal(spark, vectors, index, asked):
    exact = dense.knn(asked, vectors, k=50)
    got = ann.recall(ann.search(spark, index, asked, k=50), exact).agg(F.sum("n_found"), F.sum("n_exact")).first()
    # ties among equal vectors go to the least ids in both
    assert got[1] == 50 * asked.count() and got[0] / got[1] >= 0.9


def test_all_cells_and_candidates_are_exact(spark, vectors, index, asked):
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "id", "score", "position").collect())
    assert key(ann.search(spark, index, asked, k=20, probes=10**6, rerank=10**4)) == key(dense.knn(asked, vectors, k=20))


@pytest.mark.parametrize("labels", [c for n in range(1, 5) for c in itertools.combinations(range(4), n)])
def test_bitmaps_equal_filters(spark, vectors, index, labels):
    conditions = {"label": list(labels), "third": ["t0", "t2"], "tenant": None}
    want = vectors.where("embedding IS NOT NULL").where(F.col("label").isin(list(labels)) & F.col("third").isin("t0", "t2"))
    assert sorted(r.id for r in ann.filtered(spark, index, conditions).collect()) == sorted(r.vec_id for r in want.collect())


def test_filters_apply_before_scoring(spark, vectors, index, asked):
    conditions = {"label": 2, "third": "t1"}
    got = ann.search(spark, index, asked, k=15, filters=conditions, probes=10**6, rerank=10**4)
    want = dense.knn(asked, vectors, k=15, filters=conditions)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ann.search(spark, index, asked, filters={"label": 99}).count() == 0 and ann.filtered(spark, index, {"nothing": 1}).count() == 0


def test_index_of_no_vectors(spark, vectors, asked, tmp_path):
    ann.build(vectors.limit(0), str(tmp_path), payload=("label",), parts=4)
    assert ann.search(spark, str(tmp_path), asked).count() == 0


WORDS = "apple banana cherry the of bank england river stone light water fire tree cloud".split()


def texts(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(0, 40), p=np.arange(14, 0, -1) / 105)) if i % 13 else None) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def queries(spark):
    rows = [(1, "apple"), (2, "cloud tree"), (3, "the bank of england"), (4, "nowhere"), (5, None), (6, "fire water stone apple banana"), (7, "Cloud cloud CLOUD")]
    return spark.createDataFrame(rows, "query_id long, text string")


def full(queries, docs, k, stemmed):
    return sorted(map(tuple, lexical.bm25(queries, lexical.postings(docs, "doc_id", "text", stemmed), lexical.lengths(docs, "doc_id", "text"), k, stemmed).collect()))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("stemmed", [False, True])
def test_pruned_search_equals_scoring_everything(spark, tmp_path, stemmed):
    docs = texts(spark, 3000)
    lexindex.upsert(docs, str(tmp_path), "doc_id", stemmed=stemmed)
    for k in (1, 7):
        assert rows(lexindex.search(spark, str(tmp_path), queries(spark), k, stemmed)) == full(queries(spark), docs, k, stemmed)


def test_blocks_are_skipped(spark, tmp_path):
    docs = texts(spark, 6000).withColumn("text", F.when(F.col("doc_id").between(64, 90), F.lit("cloud tree " * 3)).otherwise(F.col("text")))
    lexindex.upsert(docs.coalesce(1), str(tmp_path), "doc_id", stemmed=False)
    search = lexindex.Search(spark, str(tmp_path), queries(spark), k=5, stemmed=False)
    read = {r.query_id: (r.n_blocks, r.n_read) for r in search.report().collect()}
    assert read[2][1] * 4 < read[2][0] and all(n <= m for m, n in read.values())
    assert rows(search.hits()) == full(queries(spark), docs, 5, False)


def test_what_is_read_for_a_query_grows_with_its_rarer_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"every word{i} other{i % 3}") for i in range(3000)], "doc_id long, text string")
    lexindex.upsert(docs.coalesce(1), str(tmp_path), "doc_id", stemmed=False)
    asked = spark.createDataFrame([(i, f"every word{i * 70}") for i in range(40)] + [(40, "every"), (41, "every other1")], "query_id int, text string")
    search = lexindex.Search(spark, str(tmp_path), asked, k=5, stemmed=False)
    # all 24 ranges hold "every" in equal measure, and are not read again for each of the 40 queries
    assert search.read.where("query_id < 40").count() == 40
    assert rows(search.hits()) == full(asked, docs, 5, False)


@pytest.mark.parametrize("stemmed", [False, True])
def test_terms_are_counted_a_run_at_a_time(spark, monkeypatch, stemmed):
    from collections import Counter

    said = [(1, "The Bank banks, banking: the bank"), (2, None), (3, ""), (4, "the of and"), (5, "Straße ÉTÉ 12 x_y été"), (6, "light lights " * 50), (7, "stone")]
    docs = spark.createDataFrame(said, "doc_id long, text string").coalesce(1)
    want = {}
    for r in docs.select("doc_id", lexical.words(F.coalesce("text", F.lit(""))).alias("w")).collect():
        left = [lexical.stem(w) if stemmed else w for w in r.w if w not in lexical.STOP]
        want[r.doc_id] = (len(left), dict(Counter(left)))
    for run in (1, 8, 1 << 20):
        monkeypatch.setattr(lexindex, "RUN", run)
        got = lexindex.analysed(docs, "doc_id", "text", stemmed).collect()
        assert {r.id: (r.n_terms, {t.term: t.tf for t in r.terms}) for r in got} == want and all(len(r.terms) == len(want[r.id][1]) for r in got)


def test_blocks_read_asks_for_the_rarest_word_too(spark, tmp_path):
    from folioscope.plans import indexes

    spark.createDataFrame([(i, f"longestofall longerword longword {'rare' if i == 7 else 'many'} gone") for i in range(300)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "many rare longword longerword longestofall"), (2, "nowhere"), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.query_id: r for r in indexes.indexed_blocks_read(spark, str(tmp_path)).collect()}
    index = lexindex._blocks(lexindex.analysed(load_docs(spark, tmp_path), "doc_id", "text", False).withColumn("doc_no", F.monotonically_increasing_id()))
    n = {r.term: r["count"] for r in index.groupBy("term").count().collect()}
    assert got[1].n_blocks == n["longestofall"] + n["longerword"] + n["longword"] + n["rare"] and n["rare"] == 1
    assert 0 < got[1].n_read <= got[1].n_blocks and got[1].n_hits == 10
    assert [tuple(got[q])[1:] for q in (2, 3)] == [(0, 0, 0)] * 2


def load_docs(spark, folder):
    return spark.read.parquet(str(folder / "documents.parquet"))


def test_index_upkeep_equals_a_rebuild(spark, tmp_path):
    path, first = str(tmp_path), texts(spark, 900)
    lexindex.upsert(first, path, "doc_id", stemmed=False)
    changed = texts(spark, 950, seed=9).where("doc_id % 5 = 2 OR doc_id >= 900")
    now = first.join(changed, "doc_id", "left_anti").unionByName(changed)
    lexindex.upsert(changed, path, "doc_id", stemmed=False)
    check = lambda docs: rows(lexindex.search(spark, path, queries(spark), 9, False)) == full(queries(spark), docs, 9, False)
    assert check(now)
    gone = now.where("doc_id % 7 = 1 OR doc_id = 902").unionByName(spark.createDataFrame([(10**6, "not there")], "doc_id long, text string"))
    lexindex.delete(spark, path, gone, "doc_id")
    now = now.where("NOT (doc_id % 7 = 1 OR doc_id = 902)").cache()
    assert check(now)
    lexindex.delete(spark, path, gone, "doc_id")  # once more: nothing is taken twice
    lexindex.upsert(now.where("doc_id = 2"), path, "doc_id", stemmed=False)  # the same text again
    assert check(now)
    lexindex.merge(spark, path)
    assert check(now) and [p["kind"] for p in lexindex._manifest(spark, path)[1]] == ["segment"]
    with pytest.raises(ValueError, match="unique"):
        lexindex.upsert(now.limit(1).union(now.limit(1)), path, "doc_id")


def test_a_retriever_that_fails_is_left_out(spark):
    from folioscope.operators import fuse
    from folioscope.plans.common import kept

    good = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id int, id int, position int")
    broken = good.withColumn("position", F.when(F.col("id") == 8, F.raise_error(F.lit("index is gone"))).otherwise(F.col("position")).cast("int"))
    hits = fuse.fused_or_degraded({"dense": lambda: broken, "lexical": lambda: good}, kept)
    assert [(r.id, r.n_retrievers) for r in hits.orderBy("position").collect()] == [(7, 1), (8, 1)]
    assert fuse.fused_or_degraded({"dense": lambda: lexindex.search(spark, "/nowhere/at/all", good), "lexical": lambda: good}, kept).count() == 2
    with pytest.raises(RuntimeError, match="all retrievers failed"):
        fuse.fused_or_degraded({"dense": lambda: broken}, kept)


def test_phrases_equal_positions(spark, tmp_path):
    docs = texts(spark, 400, seed=3)
    lexindex.next_words(docs, str(tmp_path), "doc_id")
    asked = ["bank of england", "apple apple", "apple apple apple", "the of", "apple", "", None, "banana cherry apple the", "apple nowhere", "Cherry, BANANA!"]
    got = lexindex.phrases(spark, str(tmp_path), spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"))
    want = []
    held = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    for q, text in enumerate(asked):
        p = [w.strip(",!").lower() for w in (text or "").split()]
        want += [(q, i, n + 1) for i, w in held.items() for n in range(len(w) - len(p) + 1) if len(p) > 1 and w[n : n + len(p)] == p]
    assert rows(got) == sorted(want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_queries_of_the_same_terms_are_searched_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(["red"] * (i % 7) + ["cap"] * (i % 5) + ["x"] * (i % 11))) for i in range(400)], "chunk_id long, text string")
    lexindex.upsert(docs, str(tmp_path / "same"))
    queries = spark.createDataFrame([(n, ("red cap", "cap red red", "cap")[n % 3]) for n in range(30)], "query_id int, text string")
    got = lexindex.Search(spark, str(tmp_path / "same"), queries, k=5)
    assert got.met.select("query_id").distinct().count() == 2
    hits = {}
    for r in got.hits().collect():
        hits.setdefault(r["query_id"], set()).add((r["position"], r["id"], r["score"]))
    assert len(hits) == 30 and all(len(h) == 5 and h == hits[n % 3] for n, h in hits.items()) and hits[0] == hits[1] != hits[2]
    assert got.report().count() == 30


def test_blocks_and_tombstones_shuffle_no_postings(spark, tmp_path, monkeypatch):
    docs = texts(spark, 1500)
    lexindex.upsert(docs, str(tmp_path), "doc_id", stemmed=False)
    lexindex.delete(spark, str(tmp_path), docs.where("doc_id < 200"), "doc_id")
    parts = lexindex._manifest(spark, str(tmp_path))[1]
    held = lexindex._named(spark, str(tmp_path), parts, "segment", "docs")
    rows_ = held.select("doc_no", F.col("n_terms").cast("int").alias("size"), F.explode("terms").alias("t"))
    want = sorted((r.t.term, r.doc_no >> 7, r.doc_no % 128, r.t.tf, r.size) for r in rows_.collect())
    for run in (1, 700, 1 << 20):  # runs of one range, of some, of all
        monkeypatch.setattr(lexindex, "RUN", run)
        blocks = lexindex._blocks(held)
        assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
        made = blocks.collect()
        assert sorted((b.term, b.range, d, tf, n) for b in made for d, tf, n in zip(b.docs, b.tfs, b.sizes, strict=True)) == want
        assert len({(b.term, b.range) for b in made}) == len(made)
        assert all(b.n == len(b.docs) and b.max_tf == max(b.tfs) and b.min_ratio == min(n / tf for n, tf in zip(b.sizes, b.tfs, strict=True)) for b in made)
    gone = lexindex._named(spark, str(tmp_path), parts, "gone", "docs")
    assert gone.count() == gone.select("segment", "range").distinct().count() and gone.agg(F.sum(F.size("docs"))).first()[0] == 200


def test_next_words_are_not_shuffled_and_only_rows_of_the_pairs_asked_go_on(spark, tmp_path):
    docs = texts(spark, 300, seed=5).repartition(spark.sparkContext.defaultParallelism)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plan = lexindex._next_words(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism or "Exchange" not in plan
    assert "rangepartitioning" not in plan
    lexindex.next_words(docs, str(tmp_path), "doc_id")
    stored = []

    def kept(df):
        df.write.parquet(str(tmp_path / f"kept{len(stored)}"))
        stored.append(spark.read.parquet(str(tmp_path / f"kept{len(stored)}")))
        return stored[-1]

    asked = spark.createDataFrame([(1, "the bank of"), (2, "stone stone")], "query_id long, text string")
    got = rows(lexindex.phrases(spark, str(tmp_path), asked, kept))
    assert got and got == rows(lexindex.phrases(spark, str(tmp_path), asked))
    pairs = {("the", "bank"), ("bank", "of"), ("stone", "stone")}
    index = spark.read.parquet(f"{tmp_path}/next")
    assert {(r.first, r.second) for r in stored[1].collect()} == pairs
    assert stored[1].count() == sum(index.where((F.col("first") == a) & (F.col("second") == b)).count() for a, b in pairs) < index.count() / 10


def peak_mb(run):
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_an_exact_search_does_not_grow_with_its_queries():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(10_000, 8))
    rank, got = np.arange(len(v)), []
    peaks = [peak_mb(lambda n=n: got.append([x for x in dense._best(v[:n], v, rank, 50)])) for n in (200, 900)]
    assert peaks[1] < 40 and got[1][0][0][0] == 0 and sum(len(r) for r, _, _ in got[1]) == 900 * 50
    s = np.round(v[:900] @ v.T, 9)
    rows_, cols, _ = (np.concatenate(x) for x in zip(*got[1], strict=True))
    for i in (0, 137, 899):
        assert list(cols[rows_ == i]) == list(np.lexsort((rank, -s[i]))[:50])


def test_memory_of_a_bucket_does_not_grow_with_its_queries():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 16)).astype(np.float32)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    m = ann.fit(x[:2000], 8, 4)
    cell = m.cells_of(x)
    codes, got = m.encode(x, cell), []
    of, looked = np.repeat(np.arange(128), 8), np.tile(np.arange(8), 128)
    peak = peak_mb(lambda: got.extend(ann._candidates(m, x[:128], of, looked, cell, codes, 400)))
    who, at, near = (np.concatenate([g[i] for g in got]) for i in range(3))
    assert peak < 60 and len(who) == 128 * 400 and len(got) > 1
    for i in (0, 77, 127):
        full_ = np.empty(len(x), np.float32)
        for c in range(8):
            full_[cell == c] = m.scores(x[i : i + 1], c, codes[cell == c])[0]
        assert np.allclose(np.sort(near[who == i]), np.sort(full_)[-400:], atol=1e-5) and len(set(at[who == i])) == 400
