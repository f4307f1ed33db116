"""Boxes on pages: struct(x0, y0, x1, y1) in 0..1, origin at the top left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9
MERGE_AT = 0.6
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
POINTS = ("_x0", "_y0", "_x1", "_y1", "_w", "_h")


def clamp(x: Column) -> Column:
    """x within 0..1; what is off the page goes to its edge, what is as good as on the edge too."""
    return F.when(x < EPSILON, 0.0).when(x > 1.0 - EPSILON, 1.0).otherwise(x)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def _turned(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, rotation: Column, edges: Callable[..., Column], kind: str) -> Column:
    """edges, of a type kind, of a rectangle on the displayed page: left, top, right and bottom in points from its upper left corner, and the page's width and height."""
    left, right = F.least(x0, x1), F.greatest(x0, x1)
    top, bottom = height - F.greatest(y0, y1), height - F.least(y0, y1)
    turn = F.pmod(rotation, F.lit(360))
    # a branch for each turn, so that a row evaluates its own four edges only
    turned = (
        F.when(turn == 0, edges(left, top, right, bottom, width, height)).when(turn == 90, edges(height - bottom, left, height - top, right, height, width))
        .when(turn == 180, edges(width - right, height - bottom, width - left, height - top, width, height)).otherwise(edges(top, width - right, bottom, width - left, height, width))
    )
    problem = F.when(~((width > 0) & (height > 0)), F.lit("a page's size must be positive")).when(~turn.isin(0, 90, 180, 270), F.lit("a rotation must be a multiple of 90"))
    return F.when(problem.isNull(), turned).otherwise(F.raise_error(problem).cast(kind))


def _scaled(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """Edges in points as a box."""
    return box(clamp(x0 / w), clamp(y0 / h), clamp(x1 / w), clamp(y1 / h))


def normalised(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A rectangle in points (origin at the bottom left) as a box on the displayed page.

    rotation is in degrees, a multiple of 90, clockwise; other values and pages without a size are errors.
    Tables are better served by with_boxes.
    """
    return _turned(x0, y0, x1, y1, width, height, rotation, _scaled, BOX)


def with_boxes(rects: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, rotation: Column, into: str = "bbox") -> DataFrame:
    """rects with a column of boxes, as of normalised.

    Boxes are generated from their rows, so each is worked out once: a filter on an edge stays above,
    while with a plain column Spark would write the whole box again for each edge that the filter
    names, and methods of such a length (over 8,000 bytes) are interpreted by the JVM, not compiled.
    """
    keys = [F.col(f"`{c}`") for c in rects.columns]
    points = lambda *edges: F.struct(*[e.cast("double").alias(c) for e, c in zip(edges, POINTS, strict=True)])
    kind = f"struct<{','.join(f'{c}:double' for c in POINTS)}>"
    turned = rects.select(*keys, F.inline(F.array(_turned(x0, y0, x1, y1, width, height, rotation, points, kind))))
    return turned.select(*keys, F.explode(F.array(_scaled(*[F.col(c) for c in POINTS]))).alias(into))


def is_valid(b: Column) -> Column:
    """Whether a box has a positive size and lies on the page."""
    return (b["x0"] < b["x1"]) & (b["y0"] < b["y1"]) & (b["x0"] >= 0) & (b["y0"] >= 0) & (b["x1"] <= 1) & (b["y1"] <= 1)


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; boxes that only touch have 0."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    common = w * h
    return F.when((w > 0) & (h > 0), common / (area(a) + area(b) - common)).otherwise(0.0)


def union(b: Column) -> Column:
    """Aggregate: the least box around a group's boxes; null without any."""
    return F.when(F.count(b) > 0, F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1")))


def merge_overlapping(boxes: DataFrame, keys: list[str], box_col: str = "bbox", order_col: str = "ordinal", at_least: float = MERGE_AT) -> DataFrame:
    """keys, seed ordinal and union box of each merged group of a page's boxes.

    The largest box that is left (ties: by ordinal) takes every box left that overlaps it by
    at_least; unions are not compared again. A page is one row's array, so pages spread.
    """
    fields = ", ".join(f"`{k}` {t}" for k, t in boxes.dtypes if k in keys)
    pages = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order_col).cast("long").alias("o"), F.col(box_col).alias("b")))).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                left = sorted((((x["b"]["x0"], x["b"]["y0"], x["b"]["x1"], x["b"]["y1"]), x["o"]) for x in row[-1]), key=lambda x: -_area(x[0]))
                while left:
                    seed, ordinal = left[0]
                    group = [seed, *(b for b, _ in left[1:] if _iou(seed, b) >= at_least)]
                    left = [x for x in left[1:] if _iou(seed, x[0]) < at_least]
                    out.append((*row[:-1], ordinal, len(group), min(b[0] for b in group), min(b[1] for b in group), max(b[2] for b in group), max(b[3] for b in group)))
            yield pd.DataFrame(out, columns=[*keys, "seed", "n_boxes", "x0", "y0", "x1", "y1"])

    return pages.select(*keys, "boxes").mapInPandas(run, f"{fields}, seed long, n_boxes int, x0 double, y0 double, x1 double, y1 double")


def _area(b: tuple[float, float, float, float]) -> float:
    return (b[2] - b[0]) * (b[3] - b[1])


def _iou(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h / (_area(a) + _area(b) - w * h) if w > 0 and h > 0 else 0.0
