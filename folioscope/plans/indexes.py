"""Queries over stored indexes: vectors by cells, codes and bitmaps; texts by posting blocks and next words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import ann, dense, fuse, lexical, lexindex
from folioscope.plans.common import kept, load, r6, scratch
from folioscope.plans.retrieval import BM25_SQL, EVERY, WORDS_SQL, _knn_sql, _text_queries, _vector_queries


def _vector_index(spark: SparkSession, sf_dir: str) -> str:
    """All vectors, with bitmaps of their label and of a second payload field."""
    path = scratch(spark)
    vectors = load(spark, sf_dir, "embeddings").withColumn("third", F.col("vec_id") % 3)
    ann.build(vectors, path, payload=("label", "third"))
    return path


def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 nearest vectors of the stated query set, by the stored index."""
    hits = ann.search(spark, _vector_index(spark, sf_dir), _vector_queries(spark, sf_dir))
    return hits.select("query_id", F.col("id").alias("vec_id"), r6(F.col("score")).alias("score"), "position")


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each query's 50 true neighbours the index finds."""
    queries = _vector_queries(spark, sf_dir)
    found = ann.search(spark, _vector_index(spark, sf_dir), queries)
    return ann.recall(found, dense.knn(queries, load(spark, sf_dir, "embeddings")))


#: Two fields, one with several values.
CONDITIONS = {"label": [1, 3, 5], "third": 0}


def ann_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest that meet two conditions, bitmaps anded before codes are scored."""
    hits = ann.search(spark, _vector_index(spark, sf_dir), _vector_queries(spark, sf_dir), k=10, filters=CONDITIONS)
    return hits.select("query_id", F.col("id").alias("vec_id"), r6(F.col("score")).alias("score"), "position")


def bitmap_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conditions answered by bitmaps, then the exact scan."""
    some = ann.filtered(spark, _vector_index(spark, sf_dir), CONDITIONS)
    hits = dense.knn(_vector_queries(spark, sf_dir), some, k=10, id_col="id", vector="vector")
    return hits.select("query_id", F.col("id").alias("vec_id"), r6(F.col("score")).alias("score"), "position")


def bitmap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors have each label and each value of a second field, counted in anded bitmaps alone."""
    held = spark.read.parquet(f"{_vector_index(spark, sf_dir)}/bitmaps")
    a = held.where("field = 'label'").select("bucket", F.col("value").cast("int").alias("label"), "bitmap")
    b = held.where("field = 'third'").select("bucket", F.col("value").cast("long").alias("third"), "bitmap")
    both = a.join(b.withColumnRenamed("bitmap", "other"), "bucket")
    bits = both.select("bucket", "label", "third", F.explode(F.array("bitmap", "other")).alias("bitmap")).groupBy("bucket", "label", "third").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))
    return bits.groupBy("label", "third").agg(F.sum(F.bitmap_count("bitmap")).alias("n_vectors")).where("n_vectors > 0")


def _bm25(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("id").alias("doc_id"), r6(F.col("score")).alias("score"), "position")


def indexed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items asked of a stored index of all documents: pruned, and equal to scoring everything."""
    path = scratch(spark)
    lexindex.upsert(load(spark, sf_dir, "documents"), path, "doc_id", stemmed=False)
    return _bm25(lexindex.search(spark, path, _text_queries(spark, sf_dir), k=20, stemmed=False, kept=kept))


def _rarest_and_longest(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Each item's rarest word in the index (the least of equally rare ones), and its three longest, as a query."""
    items = kept(_text_queries(spark, sf_dir))
    found = kept(lexical.terms(items, "query_id", "text", False).select(F.col("id").alias("query_id"), "term").distinct())
    rarest = found.join(lexindex.frequencies(spark, path, found), "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("rarest"))
    long = F.slice(F.reverse(F.array_sort(F.transform(F.array_distinct(lexical.words(F.col("text"))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), 1, 3)
    return items.join(rarest, "query_id", "left").select("query_id", F.concat_ws(" ", "rarest", F.array_join(F.transform(long, lambda x: x["w"]), " ")).alias("text"))


def indexed_blocks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's rarest word and its three longest: blocks that have its terms, those that were read, and the hits that they gave."""
    path = scratch(spark)
    lexindex.upsert(load(spark, sf_dir, "documents"), path, "doc_id", stemmed=False)
    queries = kept(_rarest_and_longest(spark, sf_dir, path))
    search = lexindex.Search(spark, path, queries, k=10, stemmed=False, kept=kept)
    hits = search.hits().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    found = queries.select("query_id").join(search.report(), "query_id", "left").join(hits, "query_id", "left")
    return found.select("query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_blocks", "n_read", "n_hits")])


def _two_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: a vector, and the longest and the last word of the document of its id."""
    docs = load(spark, sf_dir, "documents")
    longest = F.try_element_at(F.array_sort(F.transform(lexical.words(F.col("text")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), F.lit(-1))["w"]
    q = docs.select(F.col("doc_id").alias("query_id"), "text").join(_vector_queries(spark, sf_dir), "query_id", "right")
    return q.select("query_id", "query_vector", F.concat_ws(" ", longest, F.try_element_at(lexical.words(F.col("text")), F.lit(-1))).alias("text"))


def hybrid_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dense hits and pruned hits of the stored text index, fused; a retriever that fails would be left out."""
    path, queries = scratch(spark), kept(_two_words(spark, sf_dir))
    lexindex.upsert(load(spark, sf_dir, "documents"), path, "doc_id", stemmed=False)
    retrievers = {"dense": lambda: dense.knn(queries, load(spark, sf_dir, "embeddings")), "lexical": lambda: lexindex.search(spark, path, queries, k=50, stemmed=False, kept=kept)}
    hits = fuse.fused_or_degraded(retrievers, kept)
    return hits.select("query_id", F.col("id").alias("doc_id"), r6(F.col("score")).alias("score"), "position", "n_retrievers")


HYBRID_INDEXED_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
tf AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d),
counts AS (SELECT doc_id, any_value(size) AS size, term, count(*) AS tf FROM tf GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id % {EVERY} = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),
q AS (SELECT DISTINCT doc_id AS query_id, unnest([(SELECT arg_max(x, (length(x), x)) FROM unnest(w) AS t(x)), w[-1]]) AS term FROM words),
s AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / a))), 9) AS score
  FROM q JOIN df USING (term) JOIN counts USING (term), stats GROUP BY query_id, doc_id),
lexical AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s QUALIFY r <= 50),
dense AS (SELECT query_id, vec_id AS id, position AS r FROM ({_knn_sql()})),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + r) ORDER BY n) AS score, CAST(count(*) AS INTEGER) AS n_retrievers FROM (SELECT *, 'dense' AS n FROM dense UNION ALL SELECT *, 'lexical' FROM lexical) GROUP BY ALL)
SELECT query_id, id AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, n_retrievers DESC, id) AS position, n_retrievers FROM f QUALIFY position <= 8
"""


def _kept_up(spark: SparkSession, sf_dir: str) -> str:
    """An index that has seen an older version of each tenth document, the others, documents that went, and the newest texts."""
    path, docs = scratch(spark), load(spark, sf_dir, "documents").select("doc_id", "text")
    older = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("an older version "), F.reverse("text"))).otherwise(F.col("text")))
    gone = docs.select((-1 - F.col("doc_id")).alias("doc_id"), F.concat_ws(" ", "text", F.lit("that will go")).alias("text"))
    lexindex.upsert(older.unionByName(gone), path, "doc_id", stemmed=False)
    lexindex.delete(spark, path, gone.where("doc_id % 2 = 0"), "doc_id")
    lexindex.upsert(docs.where("doc_id % 10 = 3"), path, "doc_id", stemmed=False)
    lexindex.delete(spark, path, gone, "doc_id")
    return path


def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After updates and deletes an index answers like one built anew."""
    return _bm25(lexindex.search(spark, _kept_up(spark, sf_dir), _text_queries(spark, sf_dir), k=20, stemmed=False, kept=kept))


def index_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after its segments were merged into one."""
    path = _kept_up(spark, sf_dir)
    lexindex.merge(spark, path)
    return _bm25(lexindex.search(spark, path, _text_queries(spark, sf_dir), k=20, stemmed=False, kept=kept))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's first four words, its first two, and its last three, stop words included."""
    items = _text_queries(spark, sf_dir).select("query_id", lexical.words(F.col("text")).alias("w"))
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias("part"), p.alias("w")) for i, p in enumerate((F.slice("w", 1, 4), F.slice("w", 1, 2), F.slice(F.reverse("w"), 1, 3)))])
    rows = items.select("query_id", F.explode(parts).alias("p"))
    return rows.select((F.col("query_id") * 3 + F.col("p.part")).alias("query_id"), F.array_join(F.when(F.col("p.part") == 2, F.reverse("p.w")).otherwise(F.col("p.w")), " ").alias("text"))


def phrase_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where phrases begin, by the next-word index of all documents."""
    path = scratch(spark)
    lexindex.next_words(load(spark, sf_dir, "documents"), path, "doc_id")
    return lexindex.phrases(spark, path, _phrases(spark, sf_dir), kept).select("query_id", F.col("id").alias("doc_id"), "position")


_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
PHRASES_SQL = f"""
WITH i AS (SELECT item_id, {_W} AS w FROM benchmark),
q AS (
  SELECT item_id * 3 AS query_id, w[1:4] AS p FROM i UNION ALL SELECT item_id * 3 + 1, w[1:2] FROM i
  UNION ALL SELECT item_id * 3 + 2, w[greatest(1, len(w) - 2):] FROM i),
d AS (SELECT doc_id, {_W} AS w FROM documents),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS n FROM d),
found AS (SELECT query_id, p, doc_id, n FROM q JOIN places ON word = p[1] WHERE len(p) > 1)
SELECT query_id, doc_id, CAST(n AS INTEGER) AS position FROM found JOIN d USING (doc_id) WHERE w[n : n + len(p) - 1] = p
"""


FILTERED_SQL = f"""
SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS position
FROM embeddings q, embeddings v WHERE q.vec_id % {EVERY} = 0 AND v.label IN (1, 3, 5) AND v.vec_id % 3 = 0 QUALIFY position <= 10
"""

QUERIES = {
    "ann_topk": ann_topk, "ann_recall": ann_recall, "ann_filtered": ann_filtered, "bitmap_filtered_topk": bitmap_filtered_topk, "bitmap_counts": bitmap_counts,
    "indexed_bm25": indexed_bm25, "indexed_blocks_read": indexed_blocks_read, "index_upkeep": index_upkeep, "index_merged": index_merged, "phrase_places": phrase_places, "hybrid_indexed": hybrid_indexed,
}
ORACLES = {
    "bitmap_filtered_topk": FILTERED_SQL,
    "bitmap_counts": "SELECT label, vec_id % 3 AS third, count(*) AS n_vectors FROM embeddings WHERE label IS NOT NULL GROUP BY ALL",
    "indexed_bm25": BM25_SQL, "index_upkeep": BM25_SQL, "index_merged": BM25_SQL, "phrase_places": PHRASES_SQL, "hybrid_indexed": HYBRID_INDEXED_SQL,
}
