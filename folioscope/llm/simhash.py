"""SimHash near-duplicates, searched with vantage-point trees.

Method. Each text gets a fingerprint: bit i is 1 if it is set in over half of the hashes
of the text's word shingles. Equal fingerprints collapse to one point first. Points go to
overlapping shards by a part of their bits: of ``radius + k`` bands of bits, two points within
``radius`` agree on ``k`` at least, so that each choice of k bands names shards, and each
such pair meets in one (k grows with the number of points, so that shards stay small). Of a
choice's bits only so many name a shard that about ``shard_points`` points share it.
Within a shard a vantage-point tree parts points by their Hamming distance to a vantage
point; a ring is compared with those rings only that overlap it within the radius, as the
triangle inequality bounds the distance of two points from below. Each ring and those it
overlaps are parted again by another vantage point, down to leaves, where what remains is compared
bit by bit, so every pair within the radius is found, and no other. A shard passes on a
spanning forest of its links instead of all pairs; connected components join the forests.

Scale. Hashing is one narrow pass; only points are shuffled, once for each choice of
bands. Shards with too many points are cut into tiles, so that one dense group does not load one
task. With N points and k bands of b bits, N / 2^(kb) points share a shard by chance at least.

Defined results: a null or wordless text has fingerprint zero and is linked like any
other; repeated rows each keep their row; rows with a null id get the component of their
group (null if no row of the group has an id); an empty table gives an empty table;
columns other than id and text are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.shared import dropped, pieces, stored
from folioscope.llm.wordhash import Words, mix

#: Points of a shard by chance, for which one more band is taken; and points of a tile's side, to which larger shards are cut.
CHANCE_POINTS, TILE_POINTS = 4096, 8192
#: Points of a shard by chance, about, while its bands have bits enough; and pairs up to which a tree's leaf is compared rather than parted.
SHARD_POINTS, LEAF_PAIRS = 1024, 1 << 15
#: Choices of bands at most: beyond, shards by chance grow and are cut into tiles.
MOST_CHOICES = 70
#: Pairs compared at once.
BLOCK_PAIRS = 1 << 20


def majority(of: np.ndarray, h: np.ndarray, texts: int) -> np.ndarray:
    """For each text the 64 bits set in over half of its hashes; zero without hashes. of: the text of each hash, ascending."""
    out = np.zeros(texts, np.uint64)
    if not len(h):
        return out
    total = np.bincount(of, minlength=texts)
    row = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total)
    seg = np.flatnonzero(row % 255 == 0)  # 255 rows fill a byte counter
    seg_of = of[seg]
    first = np.flatnonzero(np.concatenate([[True], seg_of[1:] != seg_of[:-1]]))
    at = seg_of[first]
    for k in range(8):
        lanes = (h >> np.uint64(k)) & np.uint64(0x0101010101010101)
        counts = np.add.reduceat(lanes, seg).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(counts, first, axis=0, dtype=np.int64)
        for byte in range(8):
            out[at] |= (2 * counts[:, byte] > total[at]).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def blobs(x: np.ndarray) -> pa.Array:
    """Rows of unsigned 64-bit numbers as binaries, most significant byte first."""
    raw = np.ascontiguousarray(x.astype(">u8"))
    return pa.BinaryArray.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * raw.shape[1] * 8).astype(np.int32)), pa.py_buffer(raw)])


def numbers(col: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` numbers of binaries that blobs() made."""
    return np.frombuffer(b"".join(col.to_pylist()), ">u8").astype(np.uint64).reshape(-1, width)


def fingerprints(docs: DataFrame, words: int = 4, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp binary of bits/8 bytes in the order of its hex digits) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col, 1 << 20):
            texts = b.column(1).to_pylist()
            of, h = Words(texts).shingles(words)
            parts = [majority(of, h, len(texts))]
            for _ in range(bits // 64 - 1):
                h = mix(h)
                parts.append(majority(of, h, len(texts)))
            yield pa.record_batch([b.column(0), blobs(np.stack(parts, 1))], names=[id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp binary")


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of numbers."""
    near = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int16)
    for w in range(1, x.shape[-1]):
        near += np.bitwise_count(x[..., w] ^ y[..., w])
    return near


class Forest:
    """Labels of points that links join; the label is the least point's number."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            on = a != b
            if not on.any():
                return
            i, j, a, b = i[on], j[on], a[on], b[on]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def links(self, x: np.ndarray) -> pa.RecordBatch:
        """(a, b): each point that is not its tree's least, and that."""
        on = np.flatnonzero(self.label != np.arange(len(x)))
        return pa.record_batch([blobs(x[on]), blobs(x[self.label[on]])], names=["a", "b"])


def leaves(x: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, leaf_pairs: int = BLOCK_PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What a vantage-point tree leaves to compare: numbers of rows of x, some of a with some of b. All pairs within the radius are in one of the leaves."""
    todo = [(a, b, 0)]
    while todo:
        a, b, depth = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) > leaf_pairs and depth < 6 and min(len(a), len(b)) > 64:
            v = x[a[len(a) // 2]]
            da, db = distance(x[a], v[None]), distance(x[b], v[None])
            oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
            a, da, b, db = a[oa], da[oa], b[ob], db[ob]
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(da)) + 1, [len(a)]]))
            thin, ring, parts = min(128, len(a) // 8), 0, []
            for c in cuts[1:]:  # rings of equal distance; thin ones are taken together
                if c - ring >= thin or c == len(a):
                    parts.append((ring, c))
                    ring = c
            spans = [(lo, hi, np.searchsorted(db, da[lo] - radius), np.searchsorted(db, da[hi - 1] + radius, "right")) for lo, hi in parts if hi > lo]
            if sum((hi - lo) * (t - f) for lo, hi, f, t in spans) < 0.9 * len(a) * len(b):
                todo += [(a[lo:hi], b[f:t], depth + 1) for lo, hi, f, t in spans]
                continue
        yield a, b


def search(x: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, leaf_pairs: int = BLOCK_PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of all pairs (one of a, one of b) within the radius, by a vantage-point tree. a, b: numbers of rows of x. If a is b, pairs come both ways round and with themselves."""
    for a, b in leaves(x, a, b, radius, leaf_pairs):
        step = max(1, BLOCK_PAIRS // len(b))
        for k in range(0, len(a), step):
            part = a[k : k + step]
            i, j = np.nonzero(distance(x[part][:, None, :], x[b][None, :, :]) <= radius)
            if len(i):
                yield part[i], b[j]


def group_pairs(x: np.ndarray, first: np.ndarray, side: np.ndarray, radius: int, small: int = 64, leaf_pairs: int = BLOCK_PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the pairs of rows within the radius, in each group of rows of x. first: where groups begin; side: rows of a group that has both sides 0 and 1 meet those of the other side only."""
    size = np.diff(np.append(first, len(x)))
    place = np.arange(len(x)) - np.repeat(first, size)
    left = np.repeat(np.where(size <= small, size, 0), size) - place  # small groups: all at once, by how far two rows stand apart
    two = np.repeat(np.maximum.reduceat(side, first) != np.minimum.reduceat(side, first), size)
    rows = np.flatnonzero(left > 1)
    for d in range(1, small):
        rows = rows[left[rows] > d]
        if not len(rows):
            break
        on = rows[~two[rows] | (side[rows] != side[rows + d])]
        on = on[distance(x[on], x[on + d]) <= radius]
        if len(on):
            yield on, on + d
    for g in np.flatnonzero(size > small):
        rows = np.arange(first[g], first[g] + size[g])
        a, b = (rows[side[rows] == 0], rows[side[rows] == 1]) if two[rows[0]] else (rows, rows)
        for i, j in search(x, a, b, radius, leaf_pairs):
            if a is b:
                on = i < j
                i, j = i[on], j[on]
            yield i, j


def tiled(members: DataFrame, shard: str, tile_points: int, weight: F.Column | None = None, tile_weight: float = 1.0) -> DataFrame:
    """members with tile and side, each shard's rows of a tile together: large shards are cut into parts, and a tile (s, t) has the rows of parts s and t, whose pairs it is for. Shards of one row go.

    weight: if given, parts are so many that their weights' sums are about tile_weight at most.
    """
    size = members.groupBy(shard).agg(F.count(F.lit(1)).alias("c"), F.sum(weight if weight is not None else F.lit(0.0)).alias("w")).where("c > 1")
    parts = F.least(F.col("c"), F.greatest(F.ceil(F.col("c") / F.lit(float(tile_points))), F.ceil(F.col("w") / F.lit(float(tile_weight))))).cast("int")
    rows = members.join(size.select(shard, parts.alias("m")), shard)
    rows = rows.withColumn("s", F.when(F.col("m") > 1, F.pmod(F.xxhash64("point"), F.col("m"))).otherwise(0).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda t: F.struct((F.least("s", t).cast("long") * F.col("m") + F.greatest("s", t)).alias("tile"), (F.col("s") > t).cast("int").alias("side")))
    rows = rows.select(*members.columns, F.explode(tile).alias("_t")).select(F.col(shard).alias("shard"), "_t.tile", "_t.side", *[c for c in members.columns if c != shard])
    return rows.repartition("shard", "tile").sortWithinPartitions("shard", "tile")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole runs of equal first two columns (shard and tile)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and not _same(held[-1], b):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        cut = int(starts(b)[-1])
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def starts(b: pa.RecordBatch) -> np.ndarray:
    """Where runs of equal shard and tile begin."""
    shard, tile = b.column(0).to_numpy(), b.column(1).to_numpy()
    return np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (tile[1:] != tile[:-1])]))


def _same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    """Whether a's last row and b's first are of one shard and tile."""
    return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in (0, 1))


def shard_links(members: DataFrame, width: int, used: int, radius: int, tile_points: int = TILE_POINTS, *, leaf_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(a, b): spanning forests of the pairs of points that share a shard and are within the radius. members: distinct shard long, point binary of ``width`` numbers, the first ``used`` of which are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            x = numbers(b.column(3), width)
            trees = Forest(len(x))
            for i, j in group_pairs(x[:, :used], starts(b), b.column(2).to_numpy(), radius, leaf_pairs=leaf_pairs):
                trees.join(i, j)
            yield trees.links(x)

    return tiled(members.select("shard", "point"), "shard", tile_points).mapInArrow(run, "a binary, b binary")


def choices(n: int, bits: int, radius: int, chance_points: int = CHANCE_POINTS) -> list[np.ndarray]:
    """For each choice of bands its bits' numbers: of radius + k bands of about equal size each k; the least k at which chance puts few points into a shard."""
    for k in itertools.count(1):
        bands = np.array_split(np.arange(bits), radius + k)
        out = [np.concatenate(c) for c in itertools.combinations(bands, k)]
        more = len(out) * (radius + k + 1) // (k + 1)
        if n / 2.0 ** min(map(len, out)) <= chance_points or more > MOST_CHOICES or radius + k == bits:
            return out


def naming_bits(n: int, chosen: list[np.ndarray], shard_points: int = SHARD_POINTS) -> list[np.ndarray]:
    """Of each choice's bits those that name its shards: so many that about shard_points of n points share one by chance, or all."""
    enough = max(0, math.ceil(math.log2(max(1, n / shard_points))))
    return [some[:enough] for some in chosen]


def links(points: DataFrame, radius: int, bits: int = 64, chance_points: int = CHANCE_POINTS, tile_points: int = TILE_POINTS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(a, b): spanning forests of the pairs of points within the radius. points: distinct fp."""
    width = bits // 64
    n = points.count()
    chosen = naming_bits(n, choices(n, bits, radius, chance_points), shard_points)
    if not len(chosen[0]):
        chosen = chosen[:1]  # all points are one shard
    masks = np.zeros((len(chosen), width), np.uint64)
    for c, some in enumerate(chosen):
        np.bitwise_or.at(masks[c], some // 64, np.uint64(1) << (some % 64).astype(np.uint64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = numbers(b.column(0), width)
            for c, mask in enumerate(masks):
                shard = np.full(len(x), c, np.uint64)
                for w in range(width):
                    shard = mix(shard ^ (x[:, w] & mask[w]))
                yield pa.record_batch([pa.array(shard.view(np.int64)), b.column(0)], names=["shard", "point"])

    return shard_links(points.select("fp").mapInArrow(deal, "shard long, point binary"), width, width, radius, tile_points, leaf_pairs=LEAF_PAIRS)


def near_groups(docs: DataFrame, words: int = 4, bits: int = 64, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: the least id that links reach."""
    rows = stored(fingerprints(docs, words, bits, id_col, text_col))
    points = stored(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    edges = stored(links(points, radius, bits))
    roots = components(edges)
    rooted = stored(points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    dropped(points, edges)
    first = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = stored(rooted.join(first, "root").select("fp", "component_id"))
    dropped(rooted, first)
    return rows.join(named, "fp").select(id_col, "fp", "component_id")
