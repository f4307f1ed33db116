"""Dense, lexical and hybrid retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import dense, fuse, lexical
from folioscope.plans.common import kept, load, r6

#: The stated query set: vectors whose id is a multiple of this, against all.
EVERY = 50


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set."""
    v = load(spark, sf_dir, "embeddings")
    return v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = dense.knn(_vector_queries(spark, sf_dir), load(spark, sf_dir, "embeddings"))
    return hits.select("query_id", F.col("id").alias("vec_id"), r6(F.col("score")).alias("score"), "position")


def _knn_sql(where: str = "true", k: int = dense.CANDIDATES) -> str:
    return f"""
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS position
  FROM embeddings q, embeddings v WHERE q.vec_id % {EVERY} = 0 AND ({where}) QUALIFY position <= {k}"""


def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = dense.knn(_vector_queries(spark, sf_dir), load(spark, sf_dir, "embeddings"), k=10, filters={"label": [1, 3, 5], "tenant_id": None})
    return hits.select("query_id", F.col("id").alias("vec_id"), r6(F.col("score")).alias("score"), "position")


def _text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark: SparkSession, sf_dir: str, queries: DataFrame, stemmed: bool) -> DataFrame:
    return lexical.postings(load(spark, sf_dir, "documents"), "doc_id", "text", stemmed, only=lexical.terms(queries, "query_id", "text", stemmed))


def lexical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as a web-style query: all its words; or else the last one without the first."""
    words = F.filter(lexical.words(F.col("text")), lambda w: ~w.isin(*sorted(lexical.STOP)))
    q = _text_queries(spark, sf_dir).select("query_id", words.alias("w")).where(F.size("w") > 0)
    q = q.select("query_id", F.concat(F.array_join("w", " "), F.lit(" OR "), F.element_at("w", -1), F.lit(" -"), F.col("w")[0]).alias("text"))
    asked = lexical.terms(q, "query_id", "text", False).select("term").distinct()
    # a document's words are made distinct before they are rows
    index = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(lexical.words(F.col("text")))).alias("term")).join(asked, "term", "left_semi").distinct()
    return lexical.match(q, index.withColumn("positions", F.array().cast("array<int>")), stemmed=False).select("query_id", F.col("id").alias("doc_id"))


STOP_SQL = ", ".join(f"'{w}'" for w in sorted(lexical.STOP))
WORDS_SQL = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({STOP_SQL}))"
MATCH_SQL = f"""
WITH q AS (SELECT item_id AS query_id, {WORDS_SQL} AS w FROM benchmark),
d AS (SELECT doc_id, list_distinct({WORDS_SQL}) AS t FROM documents),
t AS (SELECT doc_id, unnest(t) AS term FROM d),
near AS (SELECT query_id, w, doc_id FROM (SELECT query_id, w, w[-1] AS term FROM q WHERE len(w) > 0) JOIN t USING (term))
SELECT n.query_id, n.doc_id FROM near n JOIN d USING (doc_id)
WHERE list_has_all(t, w) OR NOT list_contains(t, w[1])
"""


def lexical_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, queries = load(spark, sf_dir, "documents"), _text_queries(spark, sf_dir)
    index = lexical.counts(docs, "doc_id", "text", False, only=lexical.terms(queries, "query_id", "text", False))
    hits = lexical.bm25(queries, index, lexical.lengths(docs, "doc_id", "text"), k=20, stemmed=False)
    return hits.select("query_id", F.col("id").alias("doc_id"), r6(F.col("score")).alias("score"), "position")


BM25_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
tf AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d),
counts AS (SELECT doc_id, any_value(size) AS size, term, count(*) AS tf FROM tf GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS_SQL}) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / a))), 9) AS score
  FROM q JOIN df USING (term) JOIN counts USING (term), stats GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM s QUALIFY position <= 20
"""


def lexical_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as a phrase, or all its words anywhere, ranked by cover density."""
    words = F.filter(lexical.words(F.col("text")), lambda w: ~w.isin(*sorted(lexical.STOP)))
    q = _text_queries(spark, sf_dir).select("query_id", words.alias("w")).where(F.size("w") > 0)
    q = q.select("query_id", F.concat(F.lit('"'), F.array_join("w", " "), F.lit('" or '), F.array_join("w", " ")).alias("text"))
    return lexical.search(q, kept(_index(spark, sf_dir, q, False)), k=20, stemmed=False).select("query_id", F.col("id").alias("doc_id"), r6(F.col("score")).alias("score"), "position")


COVER_SQL = f"""
WITH q AS (SELECT item_id AS query_id, list_distinct({WORDS_SQL}) AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
met AS (SELECT query_id, doc_id, w, ws FROM q, d WHERE len(w) > 0 AND list_has_all(ws, w)),
places AS (SELECT query_id, doc_id, len(w) AS n, p, term FROM (SELECT query_id, doc_id, w, unnest(ws) AS term, generate_subscripts(ws, 1) AS p FROM met) WHERE list_contains(w, term)),
lasts AS (SELECT a.query_id, a.doc_id, a.n, a.p, b.term, max(b.p) AS last FROM places a JOIN places b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.p <= a.p GROUP BY ALL),
stretches AS (SELECT query_id, doc_id, n, p, min(last) AS first FROM lasts GROUP BY ALL HAVING count(*) = n),
covers AS (SELECT query_id, doc_id, n, first, min(p) AS last FROM stretches GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum({lexical.COVER_WEIGHT}::DOUBLE * n / (last - first + 1) ORDER BY first) AS score FROM covers GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM s QUALIFY position <= 20
"""


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rankings of vectors for each query: by cosine among all, among even labels, and among odd ones."""
    v, q = load(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir)
    a = dense.knn(q, v, k=20).withColumn("retriever", F.lit("all"))
    b = dense.knn(q, v, k=20, filters={"label": [0, 2, 4, 6, 8]}).withColumn("retriever", F.lit("even"))
    c = dense.knn(q, v, k=20, filters={"label": [1, 3, 5, 7, 9]}).withColumn("retriever", F.lit("odd"))
    cols = ["query_id", "retriever", "position", "id"]
    return a.select(cols).unionByName(b.select(cols)).unionByName(c.select(cols))


RANKINGS_SQL = f"""
rankings AS (
  SELECT query_id, 'all' AS retriever, position, vec_id AS id FROM ({_knn_sql(k=20)})
  UNION ALL SELECT query_id, 'even', position, vec_id FROM ({_knn_sql('v.label IN (0, 2, 4, 6, 8)', 20)})
  UNION ALL SELECT query_id, 'odd', position, vec_id FROM ({_knn_sql('v.label IN (1, 3, 5, 7, 9)', 20)})),
firsts AS (SELECT query_id, retriever, id, min(position) AS r FROM rankings GROUP BY ALL)"""


def _fused(hits: DataFrame) -> DataFrame:
    ranks = F.array_join(F.transform(F.array_sort(F.map_entries("ranks")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return hits.select("query_id", F.col("id").alias("vec_id"), r6(F.col("score")).alias("score"), "position", "n_retrievers", ranks.alias("ranks"))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(fuse.reciprocal_rank_fusion(_rankings(spark, sf_dir)))


def _fuse_sql(weight: str, where: str = "true", limit: int | None = None) -> str:
    return f"""
WITH {RANKINGS_SQL},
f AS (SELECT query_id, id AS vec_id, sum({weight} / (60.0::DOUBLE + r) ORDER BY retriever) AS score, CAST(count(*) AS INTEGER) AS n_retrievers, string_agg(retriever || '=' || r, ',' ORDER BY retriever) AS ranks FROM firsts WHERE {where} GROUP BY ALL)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, n_retrievers DESC, vec_id) AS position, n_retrievers, ranks FROM f {f"QUALIFY position <= {limit}" if limit else ""}
"""


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(fuse.reciprocal_rank_fusion(_rankings(spark, sf_dir), weights={"even": 2.0, "odd": 0.0}, limit=12))


def _hybrid(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> DataFrame:
    """All documents and all vectors; a query is a vector and two words of the document of its id."""
    v, docs = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "documents")
    longest = F.try_element_at(F.array_sort(F.transform(lexical.words(F.col("text")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), F.lit(-1))["w"]
    q = docs.select(F.col("doc_id").alias("query_id"), "text").join(_vector_queries(spark, sf_dir), "query_id", "right")
    q = q.withColumn("text", F.concat(longest, F.lit(" or "), F.try_element_at(lexical.words(F.col("text")), F.lit(-1))))
    q = kept(q.select("query_id", "text", "query_vector"))
    index = kept(lexical.postings(docs, "doc_id", "text", stemmed, only=lexical.terms(q, "query_id", "text", stemmed)))
    return fuse.hybrid_search(q, v, index, candidates=50, limit=fuse.TOP, stemmed=stemmed)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("query_id", F.col("id").alias("doc_id"), r6(F.col("score")).alias("score"), "position", "n_retrievers")


HYBRID_SQL = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM words),
q AS (SELECT doc_id AS query_id, unnest([(SELECT arg_max(x, (length(x), x)) FROM unnest(w) AS t(x)), w[-1]]) AS term FROM words WHERE doc_id % {EVERY} = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),
wanted AS (SELECT DISTINCT query_id, term FROM q WHERE term NOT IN ({STOP_SQL})),
lex AS (SELECT query_id, doc_id, max(s) AS s FROM (SELECT query_id, term, doc_id, count(*) * 0.1::DOUBLE AS s FROM wanted JOIN pos USING (term) GROUP BY ALL) GROUP BY ALL),
lexical AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS r FROM lex QUALIFY r <= 50),
dense AS (SELECT query_id, vec_id AS id, position AS r FROM ({_knn_sql()})),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + r) ORDER BY n) AS score, CAST(count(*) AS INTEGER) AS n_retrievers FROM (SELECT *, 'dense' AS n FROM dense UNION ALL SELECT *, 'lexical' FROM lexical) GROUP BY ALL)
SELECT query_id, id AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, n_retrievers DESC, id) AS position, n_retrievers FROM f QUALIFY position <= 8
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with an order of rows: the engine's read path."""
    return hybrid_search(spark, sf_dir).orderBy("query_id", "position")


def vector_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    width = dense.ensure_width(v)
    return v.groupBy().agg(F.count(F.lit(1)).alias("n_vectors"), F.min(F.size("embedding")).alias("width")).where(F.col("width") == width)


QUERIES = {
    "dense_topk": dense_topk, "dense_topk_filtered": dense_topk_filtered, "lexical_match": lexical_match, "lexical_bm25": lexical_bm25, "lexical_cover_density": lexical_cover_density,
    "rrf_fuse": rrf_fuse, "rrf_weighted": rrf_weighted, "hybrid_search": hybrid_search, "vector_width": vector_width,
}
ORACLES = {
    "dense_topk": f"SELECT query_id, vec_id, round(score, 6) AS score, position FROM ({_knn_sql()})", "dense_topk_filtered": f"SELECT query_id, vec_id, round(score, 6) AS score, position FROM ({_knn_sql('v.label IN (1, 3, 5)', 10)})",
    "lexical_match": MATCH_SQL, "lexical_cover_density": COVER_SQL, "lexical_bm25": BM25_SQL, "rrf_fuse": _fuse_sql("1.0::DOUBLE"), "rrf_weighted": _fuse_sql("CASE retriever WHEN 'even' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END", "retriever <> 'odd'", 12),
    "hybrid_search": HYBRID_SQL, "vector_width": "SELECT count(*) AS n_vectors, CAST(min(len(embedding)) AS INTEGER) AS width FROM embeddings",
}
