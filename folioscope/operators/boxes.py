"""Greedy merging of overlapping boxes as joins: no page is ever in one row.

Greedy merging takes the largest box that is left and all boxes left that overlap it enough.
So a box is absorbed if and only if it overlaps an earlier box that is not absorbed itself:
the seeds are the first maximal independent set in the order of area. It is found in rounds,
all pages at once: a box none of whose earlier neighbours is undecided is a seed, what it
overlaps is absorbed, and both leave (Blelloch, Fineman, Shun 2012: few rounds for most orders).

Neighbours come from a grid: boxes meet in the cells that they cover, and a pair counts in the
cell that holds the upper left corner of its intersection. Equal boxes are one box with a count.

Where boxes lie thick, their pairs would grow with the square of how thick. So boxes are taken in
parts by the order, each thin enough: a part's seeds are found among itself, and all later boxes
that they overlap leave. A later box is asked for in the cell of its centre alone; it is the few
seeds that go to all cells where a box that they absorb can have its centre.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MERGE_AT = 0.6
#: Cells are so many times as wide and high as the mean box.
MEANS = 2.0
#: Boxes of a part in a cell, about; and boxes that are looked at to tell where a part ends.
THICK, LOOKED_AT = 32, 20_000


def _order(prefix: str = "") -> Column:
    """What boxes are taken by: the largest first, then by ordinal, then by corners."""
    return F.struct((-F.col(f"{prefix}area")).alias("a"), *[F.col(prefix + c).alias(c) for c in ("o", "x0", "y0", "x1", "y1")])


def _size(boxes: DataFrame) -> tuple[float, float, float, float]:
    """A cell's width and height, and those of the widest and the highest box."""
    across, down = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    w, h, widest, highest = boxes.agg(F.avg(across), F.avg(down), F.max(across), F.max(down)).first()
    return MEANS * w if w else 1.0, MEANS * h if h else 1.0, widest or 0.0, highest or 0.0


def neighbours(boxes: DataFrame, keys: list[str], at_least: float, size: tuple[float, float] | None = None) -> DataFrame:
    """(hi, lo): ids of each two boxes of a page whose intersection over union is at_least or more, the one with the larger area (or smaller ordinal) first.

    boxes: keys, id, o, x0, y0, x1, y1, area. No positive at_least is too small, but touching boxes never count.
    """
    w, h = size or _size(boxes)[:2]
    cells = lambda lo, hi, size: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    placed = boxes.withColumn("cx", F.explode(cells("x0", "x1", w))).withColumn("cy", F.explode(cells("y0", "y1", h)))
    a, b = (placed.select(*keys, "cx", "cy", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "o", "x0", "y0", "x1", "y1", "area")]) for s in "ab")
    earlier = _order("a_") < _order("b_")
    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    across, down = F.least("a_x1", "b_x1") - left, F.least("a_y1", "b_y1") - top
    here = (F.floor(left / w) == F.col("cx")) & (F.floor(top / h) == F.col("cy"))
    iou = across * down / (F.col("a_area") + F.col("b_area") - across * down)
    pairs = a.join(b, [*keys, "cx", "cy"]).where((across > 0) & (down > 0) & (F.col("b_area") >= F.col("a_area") * (at_least * (1 - 1e-9))) & here & earlier)
    return pairs.where(iou >= at_least).select(F.col("a_id").alias("hi"), F.col("b_id").alias("lo"))


def absorbed(edges: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(lo): the ids that an unabsorbed earlier neighbour absorbs. kept: writes a frame to shared storage and reads it again."""
    gone = edges.select("lo").limit(0)
    left = edges
    while True:
        los = left.select(F.col("lo").alias("hi")).distinct()
        seeds = left.select("hi").distinct().join(los, "hi", "left_anti")
        now = kept(left.join(seeds, "hi", "left_semi").select("lo").distinct())
        if now.isEmpty():
            return gone
        gone = gone.unionByName(now)
        # pairs of a seed are done with, too: all that it overlaps is absorbed
        left = left.join(now, "lo", "left_anti").join(now.withColumnRenamed("lo", "hi"), "hi", "left_anti")
        left = kept(left)


def _first_part(left: DataFrame, keys: list[str], w: float, h: float) -> Column | None:
    """Which boxes are early enough for the next part; None if all that are left are thin enough."""
    placed = left.groupBy(*keys, *_home(w, h)).agg(F.count(F.lit(1)).alias("c"))
    n, squares = placed.agg(F.sum("c"), F.sum(F.col("c").cast("double") * F.col("c"))).first()
    if not n or squares / n <= THICK:
        return None
    some = sorted(left.sample(min(1.0, LOOKED_AT / n), seed=7).select(-F.col("area"), "o", "x0", "y0", "x1", "y1").collect())
    if not some:
        return None
    last = some[min(len(some) - 1, int(len(some) * THICK * n / squares))]
    return _order() <= F.struct(*[F.lit(v).alias(c) for v, c in zip(last, ("a", "o", "x0", "y0", "x1", "y1"), strict=True)])


def _home(w: float, h: float) -> list[Column]:
    """The cell of a box's centre."""
    return [F.floor((F.col("x0") + F.col("x1")) / (2 * w)).alias("cx"), F.floor((F.col("y0") + F.col("y1")) / (2 * h)).alias("cy")]


def _taken(seeds: DataFrame, later: DataFrame, keys: list[str], at_least: float, size: tuple[float, float, float, float]) -> DataFrame:
    """(id, seed_id): later boxes that overlap a seed enough, and the first one of these."""
    w, h, widest, highest = size
    # of two boxes with this much in common neither is over 1 / at_least times as wide, so the later one's centre is within reach
    beyond = max(0.0, (0.5 - at_least) / at_least) + 1e-6

    def cells(lo: str, hi: str, cell: float, most: float) -> Column:
        reach = F.least((F.col(hi) - F.col(lo)) * beyond, F.lit(most / 2 + 1e-9))
        return F.sequence(F.floor((F.col(lo) - reach) / cell), F.floor((F.col(hi) + reach) / cell))

    spread = seeds.withColumn("cx", F.explode(cells("x0", "x1", w, widest))).withColumn("cy", F.explode(cells("y0", "y1", h, highest)))
    a = spread.select(*keys, "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in ("id", "o", "x0", "y0", "x1", "y1", "area")])
    b = later.select(*keys, *_home(w, h), *[F.col(c).alias(f"b_{c}") for c in ("id", "x0", "y0", "x1", "y1", "area")])
    across, down = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"), F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    met = a.join(b, [*keys, "cx", "cy"]).where((across > 0) & (down > 0) & (across * down / (F.col("a_area") + F.col("b_area") - across * down) >= at_least))
    return met.groupBy(F.col("b_id").alias("id")).agg(F.min_by("a_id", _order("a_")).alias("seed_id"))


def _owners(one: DataFrame, keys: list[str], kept: Callable[[DataFrame], DataFrame], at_least: float) -> DataFrame:
    """(id, seed_id): the seed of each absorbed box."""
    size, left, found = _size(one), one, []
    while True:
        early = _first_part(left, keys, *size[:2])
        part = left if early is None else left.where(early)
        edges = kept(neighbours(part, keys, at_least, size[:2]))
        gone = kept(absorbed(edges, kept))
        order = part.select(F.col("id").alias("hi"), _order().alias("_order"))
        found.append(edges.join(gone.withColumnRenamed("lo", "hi"), "hi", "left_anti").join(order, "hi").groupBy(F.col("lo").alias("id")).agg(F.min_by("hi", "_order").alias("seed_id")))
        if early is None:
            return reduce(DataFrame.unionByName, found)
        seeds, later = part.join(gone.withColumnRenamed("lo", "id"), "id", "left_anti"), left.where(~early)
        taken = kept(_taken(seeds, later, keys, at_least, size))
        found.append(taken)
        left = kept(later.join(taken, "id", "left_anti"))


def merge_overlapping(boxes: DataFrame, keys: list[str], kept: Callable[[DataFrame], DataFrame], box_col: str = "bbox", order_col: str = "ordinal", at_least: float = MERGE_AT) -> DataFrame:
    """keys, seed, n_boxes, x0, y0, x1, y1: the seed's ordinal, the size and the union of each group of a page's boxes.

    The largest box that is left (ties: by ordinal) takes every box left that overlaps it by
    at_least or more; unions are not compared again. Boxes that are null are left out.
    """
    box = F.col(box_col)
    flat = boxes.where(box.isNotNull()).select(*keys, F.col(order_col).cast("long").alias("o"), *[box[c].alias(c) for c in ("x0", "y0", "x1", "y1")])
    alike = flat.groupBy(*keys, "x0", "y0", "x1", "y1").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n"))
    one = kept(alike.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).withColumn("id", F.monotonically_increasing_id()))
    owned = one.join(_owners(one, keys, kept, at_least), "id", "left").withColumn("seed_id", F.coalesce("seed_id", "id"))
    is_seed = F.col("id") == F.col("seed_id")
    groups = owned.groupBy(*keys, "seed_id").agg(F.max(F.when(is_seed, F.col("o"))).alias("seed"), F.sum("n").cast("int").alias("n_boxes"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return groups.drop("seed_id")
