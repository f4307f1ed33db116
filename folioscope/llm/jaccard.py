"""Near-duplicates by exact Jaccard similarity of word shingles, with SimHash as candidate search.

Method. A text is the set of the hashes of its word shingles; equal sets are one point,
known by its 256-bit SimHash fingerprint and a hash of the set. Points meet in shards that
are named by shingles; vantage-point trees (see ``simhash``) find the pairs of a shard whose
fingerprints differ in ``radius`` bits at most, and such a pair is a link only if the exact
similarity of its sets reaches ``similarity``. Bits of a fingerprint are independent, so the
chance that a similar pair is no candidate has a bound at every length: pairs at 0.8 differ
in 48 of 256 bits on average at worst (four shingles against five), with a deviation of 6.3.

Shards. Shingles have one order for all sets: heavy ones, which very many texts hold, come
last, all others by hash. Of n shingles, u = n - ceil(t n) at most are not in a set of
similarity t. So similar sets share one of the first u + 1 of their order (prefix
filtering), and, if L shingles are not heavy, one of the first k of these but for a chance
of (u / L)^k; a point goes to the shards of its first k, the least number that brings this
chance below ``MISS``, or of all u + 1. That is eight for a text without heavy shingles, as a
passage that many texts share says nothing of their similarity. A point with no more than u others
goes by all shingles besides, to shards for such points alone. Only these can be large;
they are cut into tiles. Which shingles are heavy is found on a part of the documents; any
choice is right and changes the cost alone.

Pairs of fingerprints within the radius, of each shard a spanning forest, make clusters.
The sets of a cluster's points then meet, once, and all its pairs within the radius are held
against each other as rows of bits; of the similar ones a spanning forest goes on, and
connected components make the groups. So these are the components of all similar candidate
pairs, without links that are not similar, and no step writes all pairs of a group.

Scale. Work grows in proportion to the input, but for clusters: texts that are like each
other are compared, pair by pair, within their cluster (fingerprints, and bits of sets).
Large clusters are cut into tiles. Sets, of 32 bits a shingle here (two shingles of one
pair of texts of a thousand words collide with a chance of 1 in 4,000), are shuffled only
for points that are in a cluster.

Defined results: a null or wordless text has the empty set; texts with equal sets are one
group; rows with a null id get the component of their group; columns other than id and
text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.shared import dropped, pieces, stored
from folioscope.llm.simhash import Forest, blobs, group_pairs, majority, numbers, shard_links, starts, tiled, whole_groups
from folioscope.llm.wordhash import Words, mix

#: 64-bit words of a fingerprint; a key has the hash of the set after them.
WORDS = 4
#: Bits that candidates may differ in: five deviations above the worst average at 0.8, and six below that of unrelated texts.
RADIUS = 80
#: The chance that similar sets share none of the shingles that name their shards.
MISS = 3e-6
#: Points of a side of a cluster's tile.
CLUSTER_POINTS = 4096
#: Of one in so many documents shingles are counted; those that so many of these hold are heavy, and so many at most, the most frequent.
SAMPLED, HEAVY, MOST_HEAVY = 16, 64, 1 << 20


def heavy_shingles(docs: DataFrame, words: int, text_col: str, sampled: int = SAMPLED, heavy: int = HEAVY) -> np.ndarray:
    """Sorted hashes of frequent shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            h = distinct(*Words(b.column(0).to_pylist()).shingles(words))[1]
            h, n = np.unique(h, return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    some = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64(F.lit("heavy"), "text"), F.lit(sampled)) == 0)
    top = some.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= heavy).orderBy(F.desc("n"), "h").limit(MOST_HEAVY).collect()
    return np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))


def distinct(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) sorted by both, without repeats."""
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return of[new], h[new]


def first_few(of: np.ndarray, h: np.ndarray, n: np.ndarray, hot: np.ndarray, similarity: float, miss: float = MISS) -> tuple[np.ndarray, np.ndarray]:
    """(shards of all texts, number of each text's). of, h: distinct(); n: each text's number of shingles."""
    at = np.minimum(np.searchsorted(hot, h), max(0, len(hot) - 1))
    light = hot[at] != h if len(hot) else np.ones(len(h), bool)
    most = n - np.ceil(np.round(n * similarity, 6)).astype(np.int64)  # u
    count = np.bincount(of[light], minlength=len(n))  # L

    def few(total: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            k = np.ceil(np.log(miss) / np.log(most / total))
        return np.minimum(np.where((most > 0) & (most < total), k, most + 1), np.minimum(most + 1, total)).astype(np.int64)

    def place(some: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.arange(len(some)) - np.repeat(np.cumsum(size) - size, size)

    dense = count <= most  # nearly no others: by all shingles, besides
    some = np.flatnonzero(light)
    some = some[place(some, count) < few(count)[of[some]]]
    more = np.flatnonzero(dense[of])
    size = np.where(dense, n, 0)
    more = more[place(more, size) < few(n)[of[more]]]
    to = np.concatenate([of[some], of[more]])
    shard = np.concatenate([h[some], mix(h[more])])
    return shard[np.argsort(to, kind="stable")], np.bincount(to, minlength=len(n))


def sets(docs: DataFrame, words: int, similarity: float, hot: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, key, shingles, shards) for each row: distinct hashes, the key of equal sets, and the names of its shards."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col, 1 << 20):
            of, h = distinct(*Words(b.column(2).to_pylist()).shingles(words))
            n = np.bincount(of, minlength=b.num_rows)
            parts, x = [], h
            for _ in range(WORDS):
                parts.append(majority(of, x, b.num_rows))
                x = mix(x)
            whole = np.zeros(b.num_rows, np.uint64)
            np.add.at(whole, of, x)
            shard, few = first_few(of, h, n, shared.value, similarity)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(v)) for size, v in ((n, (h >> np.uint64(32)).astype(np.uint32).view(np.int32)), (few, shard.view(np.int64)))]
            yield pa.record_batch([b.column(0), b.column(1), blobs(np.stack([*parts, mix(whole)], 1)), *lists], names=[id_col, "text_hash", "key", "shingles", "shards"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), text_col).mapInArrow(run, f"`{id_col}` {kind}, text_hash long, key binary, shingles array<int>, shards array<long>")


def overlaps(i: np.ndarray, j: np.ndarray, group: np.ndarray, of: np.ndarray, shingle: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many shingles rows i and j have in common, for pairs within a group. group: of each row; of, shingle: row and hash of each shingle, by row."""
    g = group[of]
    order = np.lexsort((of, shingle, g))
    g, h, of = g[order], shingle[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, len(h)))
    shared = np.repeat(size > 1, size)  # what one row has alone is common to no pair
    number = np.cumsum(size > 1) - 1  # of shared shingles
    first = np.searchsorted(g[run][size > 1], np.arange(int(group.max()) + 1 if len(group) else 0))
    column = np.repeat(number, size)[shared] - first[g[shared]]  # counted from 0 in each group
    of = of[shared]
    out = np.zeros(len(i), np.int64)
    for lo in range(0, int(column.max()) + 1 if len(column) else 0, columns):
        on = (column >= lo) & (column < lo + columns)
        width = min(columns, int(column.max()) + 1 - lo)
        rows = np.unique(of[on])
        bits = np.zeros((len(rows) + 1, -(-width // 64)), np.uint64)  # the last row, of zeros, is for rows that have none
        place = np.full(len(group), len(rows))
        place[rows] = np.arange(len(rows))
        at = column[on] - lo
        np.bitwise_or.at(bits, (place[of[on]], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        some = np.flatnonzero((place[i] < len(rows)) & (place[j] < len(rows)))
        step = max(1, (1 << 22) // bits.shape[1])
        for k in range(0, len(some), step):
            p = some[k : k + step]
            out[p] += np.bitwise_count(bits[place[i[p]]] & bits[place[j[p]]]).sum(1, dtype=np.int64)
    return out


def cluster_links(members: DataFrame, similarity: float, radius: int, tile_points: int = CLUSTER_POINTS) -> DataFrame:
    """(a, b): spanning forests of the similar candidate pairs. members: distinct cluster long, point, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            x, side, first = numbers(b.column(3), WORDS + 1), b.column(2).to_numpy(), starts(b)
            n = pc.list_value_length(b.column(4)).to_numpy(zero_copy_only=False).astype(np.int64)
            shingle, ends = pc.list_flatten(b.column(4)).to_numpy(), np.cumsum(n)
            trees = Forest(len(x))
            size = np.diff(np.append(first, len(x)))
            cut = np.flatnonzero(np.concatenate([[True], (size[1:] > 64) | (size[:-1] > 64)]))  # large groups alone, small ones between them together
            for lo, hi in zip(first[cut].tolist(), [*first[cut[1:]].tolist(), len(x)], strict=True):
                here = np.arange(lo, hi)
                begin = first[(first >= lo) & (first < hi)] - lo
                group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, hi - lo)))
                found = [(i, j) for i, j in group_pairs(x[here][:, :WORDS], begin, side[here], radius) for on in [np.minimum(n[lo + i], n[lo + j]) >= similarity * np.maximum(n[lo + i], n[lo + j]) - 1e-9] for i, j in [(i[on], j[on])] if len(i)]
                if not found:
                    continue
                i, j = (np.concatenate(v) for v in zip(*found, strict=True))
                common = overlaps(i, j, group, np.repeat(here - lo, n[here]), shingle[ends[lo] - n[lo] : ends[hi - 1]])
                on = common / (n[lo + i] + n[lo + j] - common) >= similarity
                trees.join(lo + i[on], lo + j[on])
            yield trees.links(x)

    # a tile's sets take about 32 MB at most, but that of one text
    rows = tiled(members.select("cluster", "point", "shingles"), "cluster", tile_points, F.size("shingles").cast("double"), float(4 << 20))
    return rows.mapInArrow(run, "a binary, b binary")


def near_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS, sampled: int = SAMPLED, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, root, component_id) for each row: a name of its group, and the least id in it; text_hash is xxhash64 of the text."""
    whole = stored(sets(docs, words, similarity, heavy_shingles(docs, words, text_col, sampled, heavy), id_col, text_col))
    size = F.size("shingles").alias("n")
    row = F.struct(F.col(id_col).alias("id"), "text_hash")
    points = stored(whole.groupBy("key").agg(F.min(id_col).alias("least"), F.max(row).alias("row"), F.min(size).cast("long").alias("n"), F.first("shards").alias("shards")))
    # Sets with fewer members are never similar without being equal.
    able = points.where(F.col("n") >= math.ceil(round(similarity / (1 - similarity), 6)))
    members = able.select(F.explode("shards").alias("shard"), F.col("key").alias("point"))
    clusters = components(shard_links(members, WORDS + 1, WORDS, radius))
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    clusters = clusters.select(F.col("node").alias("key"), F.xxhash64("root").alias("cluster"))
    # one row's set for each point: the join is on the row and not the key alone, which very many copies may have
    one = points.join(clusters, "key").select(F.col("key").alias("point"), "cluster", F.col("row.id").alias("_id"), F.col("row.text_hash").alias("_h"))
    same = (F.col("key") == F.col("point")) & (F.col("text_hash") == F.col("_h")) & F.col(id_col).eqNullSafe(F.col("_id"))
    inside = stored(whole.join(one, same).groupBy("point").agg(F.first("cluster").alias("cluster"), F.first("shingles").alias("shingles")))
    roots = components(cluster_links(inside, similarity, radius))
    named = stored(points.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root")))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = stored(whole.select(id_col, "text_hash", "key").join(named.join(first, "root").select("key", "root", "component_id"), "key").select(id_col, "text_hash", "root", "component_id"))
    dropped(whole, points, named, inside)
    return out


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, component_id) for each row: the least id that links of similar sets reach."""
    return near_rows(docs, words, similarity, id_col=id_col, text_col=text_col, **how).select(id_col, "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group, with all columns of docs: the one with the least id (null last), of these the one with the least hash of the text; of equal ones any."""
    found = near_rows(docs, words, similarity, id_col=id_col, text_col=text_col, **how).select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_h"), "root")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_h").alias("h"))
    best = found.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("c")).where("c > 1").select("root", "best")
    inside = stored(found.join(best, "root").withColumn("stays", F.col("best.id").eqNullSafe(F.col("_id")) & (F.col("best.h") == F.col("_h"))))
    gone = stored(inside.where(~F.col("stays")).select("_id", "_h").distinct())
    again = stored(inside.where("stays").groupBy("_id", "_h").count().where(F.col("count") > 1).select("_id", "_h"))
    rows = docs.withColumn("_h0", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h0") == F.col("_h"))
    kept = rows.join(gone, same, "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, same, "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, "_h0"]).select(*docs.columns))
