"""Dense retrieval: embedding, pre-filters, exact cosine top-k for batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

CANDIDATES = 50
#: Query vectors that are sent to all executors at once, in bytes; more are joined in parts.
MOST_QUERY_BYTES = 64 << 20
#: Scores that are held at once.
MOST_CELLS = 1 << 20

Embed = Callable[[list[str]], Sequence[Sequence[float]]]
EMBEDDERS: dict[str, Callable[[], Embed]] = {}


class DimensionMismatch(ValueError):
    """Vectors of another width than the collection's; retrying cannot help."""


def register_embedder(name: str, make: Callable[[], Embed]) -> None:
    """make() is called once in each Python worker and gives a function from texts to vectors."""
    EMBEDDERS[name] = make


def get_embedder(name: str) -> Callable[[], Embed]:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}; expected one of {sorted(EMBEDDERS)}")
    return EMBEDDERS[name]


def embed(text: Column, make: Callable[[], Embed], batch: int = 96) -> Column:
    """Vectors of texts; the model is made once a worker, and called with batches of texts in order."""

    @pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for k in range(0, len(texts), batch):
                some = [list(map(float, v)) for v in model(texts[k : k + batch])]
                if len(some) != len(texts[k : k + batch]):
                    raise ValueError(f"the embedder gave {len(some)} vectors for {len(texts[k : k + batch])} texts")
                out += some
            yield pd.Series(out)

    return run(text)


def payload_filter(conditions: dict[str, object]) -> Column:
    """All conditions: equality, or membership for a list; those with None are left out."""
    parts = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in conditions.items() if v is not None]
    return reduce(and_, parts) if parts else F.lit(True)


def ensure_width(vectors: DataFrame, vector: str = "embedding", width: int | None = None) -> int:
    """The one width of all vectors, which must be the given one."""
    found = [r[0] for r in vectors.select(F.size(vector).alias("n")).where("n >= 0").distinct().limit(3).collect()]
    if len(found) > 1 or (found and width is not None and found[0] != width):
        raise DimensionMismatch(f"vectors of {sorted(found)} numbers, expected {width or 'one width'}")
    return found[0] if found else width or 0


def knn(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, filters: dict[str, object] | None = None, query_id: str = "query_id", query_vector: str = "query_vector", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, position): the k vectors most alike to each query's, by cosine to nine decimals; ties go to the least id.

    Filters apply before scoring. Queries are a stated set: they go to the vectors' tasks in
    parts of MOST_QUERY_BYTES at most. Each batch of vectors is scored against a part by one
    matrix product, and only its k best of a query go on. Null vectors are no hits; a vector of zeros has score 0.
    """
    spark = vectors.sparkSession
    there = vectors.where(payload_filter(filters or {})).select(F.col(id_col).alias("id"), F.col(vector).alias("_v")).where(F.col("_v").isNotNull())
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("_q")).where(F.col("_q").isNotNull())
    size = asked.agg(F.sum(F.size("_q") * 8 + 64)).first()[0]
    parts = max(1, -(-(size or 0) // MOST_QUERY_BYTES))
    kinds = {"query_id": queries.schema[query_id].dataType, "id": vectors.schema[id_col].dataType}
    schema = T.StructType([*(T.StructField(n, t) for n, t in kinds.items()), T.StructField("score", T.DoubleType())])
    out = None
    for p in range(parts):
        some = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p)
        shared = spark.sparkContext.broadcast(some.toArrow())  # MOST_QUERY_BYTES, about

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value.column(0).combine_chunks(), _matrix(shared.value.column(1).combine_chunks())
            for b in batches:
                if not b.num_rows or not len(q):
                    continue
                v, rank = _matrix(b.column(1)), pc.rank(b.column(0), sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
                if v.shape[1] != q.shape[1]:
                    raise DimensionMismatch(f"vectors differ in length: {q.shape[1]} and {v.shape[1]} numbers")
                for rows, cols, scores in _best(q, v, rank, k):
                    yield pa.record_batch([names.take(pa.array(rows)), b.column(0).take(pa.array(cols)), pa.array(scores)], names=["query_id", "id", "score"])

        scored = there.mapInArrow(score, schema)
        best = scored.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("position") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def _best(q: np.ndarray, v: np.ndarray, rank: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, score) of the k best of v for each query, ties by rank; no more than MOST_CELLS scores are held at once."""
    step = max(1, MOST_CELLS // len(v))
    for lo in range(0, len(q), step):
        rows, cols, scores = [], [], []
        near = q[lo : lo + step] @ v.T
        for i, s in enumerate(np.round(near, 9, out=near), lo):
            best = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
            best = best[np.lexsort((rank[best], -s[best]))[:k]]
            rows.append(np.full(len(best), i))
            cols.append(best)
            scores.append(s[best])
        yield np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise DimensionMismatch("vectors differ in length")
    x = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1) if len(sizes) else np.zeros((0, 0))
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)
