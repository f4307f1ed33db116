"""Streams of documents in id order, each with the next one's text.

Ids are dealt to ranges of about equal numbers of rows: range ends are quantiles of the ids
(one aggregation over the id column alone, whose sketch has a bounded size), and a row finds
its range by a binary search in a column expression. An id that holds
several ranges' worth of rows, and null ids, are spread over as many ranges by the hash of
the text. Each range is sorted on its own, and the first row of each range is sent along to
the range above it, so that the text is shuffled once and no task sees more than its ranges.
The last row's next is the first row of all.

Ids must be numbers. Order: descending id, null ids last; equal ids by the hash of their
text, descending, and then by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import pieces

#: Ranges at least and at most, and rows of a range between these limits. The range ends, numbers, go to the driver.
LEAST_RANGES, MOST_RANGES, RANGE_ROWS = 512, 16384, 50_000


def text_hash(text_col: str = "text") -> Column:
    """A number that orders the rows of one id."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def id_ranges(docs: DataFrame, id_col: str, text_col: str = "text", rows_per_range: int = RANGE_ROWS) -> Column | None:
    """The number of each row's range, ascending with the id (equal ids: with the hash of their text); null ids have ranges below 0. None for an empty table."""
    n, ids = docs.agg(F.count(F.lit(1)), F.count(id_col)).first()
    if not n:
        return None
    ranges = max(LEAST_RANGES, min(MOST_RANGES, n // rows_per_range))
    share = F.least(text_hash(text_col).cast("double") / float(1 << 64) + 0.5, F.lit(1 - 2.0**-53))  # below 1, ascending with the hash
    nulls = -(-ranges * (n - ids) // n)
    null_range = F.floor(share * nulls).cast("long") - nulls
    if not ids:
        return null_range
    step = 1.0 / ranges
    ends = docs.agg(F.percentile_approx(id_col, [k * step for k in range(1, ranges)], 4 * ranges)).first()[0]
    ends = sorted(ends)
    at, size = F.array(*[F.lit(x) for x in ends]), len(ends)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(size.bit_length()))])

    def before(upto: bool) -> Column:
        """How many range ends are below the id, or up to it."""
        fits = lambda v: v <= F.col(id_col) if upto else v < F.col(id_col)
        return F.aggregate(steps, F.lit(0), lambda acc, x: F.when((acc + x <= size) & fits(F.element_at(at, F.least(acc + x, F.lit(size)))), acc + x).otherwise(acc))

    own = before(False)
    if len(set(ends)) < size:  # some id holds more than a range
        many = before(True) - own
        own = own + F.when(many > 1, F.floor(share * (many + 1))).otherwise(0)
    return F.when(F.col(id_col).isNull(), null_range).otherwise(own.cast("long"))


def with_next(docs: DataFrame, step, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """step(ids, texts, next_texts) -> columns, over all rows in descending id order (null ids last).

    texts and next_texts are lists of str or None; step returns a pyarrow RecordBatch of the given schema.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    where = id_ranges(docs, "id")
    if where is None:
        return docs.sparkSession.createDataFrame([], schema)
    docs = docs.withColumn("range", where).withColumn("h", text_hash())
    # a row for each range that has rows, two times MOST_RANGES at most, some 40 bytes each: its first row's id and hash, and the range above it
    heads = docs.groupBy("range").agg(F.max(F.struct("id", "h")).alias("head"))
    whole = Window.orderBy("range")
    above = F.coalesce(F.lead("range").over(whole), F.first("range").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("range").alias("head_range"), above.alias("above"), F.col("head.id").alias("head_id"), F.col("head.h").alias("head_h"))
    rows = docs.join(F.broadcast(heads), (F.col("range") == F.col("head_range")) & F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")), "left")
    to = lambda r, g: F.struct(F.col(r).alias("range"), F.lit(g).alias("guest"))
    rows = rows.select("id", "h", "text", F.explode(F.filter(F.array(to("range", 0), to("above", 1)), lambda x: x["range"].isNotNull())).alias("to"))
    rows = rows.select("id", "text", "to.*", "h").repartition("range").sortWithinPartitions("range", "guest", F.desc_nulls_last("id"), F.desc("h"), F.asc_nulls_first("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for b in pieces(batches, "text", 1 << 20):
            t = pa.Table.from_batches([b])
            t = t if left is None else pa.concat_tables([left, t])
            if t.num_rows > 1:
                yield from done(t)
            left = t.slice(t.num_rows - 1)
        # what remains is a guest: each range ends in one

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        texts, guest = t.column("text").to_pylist(), t.column("guest").to_pylist()
        own = [i for i in range(len(texts) - 1) if not guest[i]]
        if own:
            yield step(t.column("id").take(own).combine_chunks(), [texts[i] for i in own], [texts[i + 1] for i in own])

    return rows.select("id", "text", "range", "guest").mapInArrow(run, schema)
