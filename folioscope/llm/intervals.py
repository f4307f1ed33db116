"""Interval overlap join by IEJoin (Khayyat et al. 2015) over salted blocks of a key.

Time is compared in slots, so intervals of one key that begin and end in the same slots are
alike: both sides are first reduced to distinct (key, first slot, last slot), the right one
with its sums. What is joined is bounded by the slots of the time range, not by rows.

A key with many distinct intervals is cut into a grid: its left ones are salted into blocks,
its right ones too, and each pair of blocks is one unit. Units are gathered into groups of
about equal size; in a group, numpy holds the right intervals in start order and in end order,
the permutation between the two, and each left interval's offsets into both. Left intervals
are taken by their ends: right ones that start in time are marked in a bitmap over the end
order, and the bitmap is scanned from the first that ends late enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import stored

SLOT = 6 * 3600 * 1_000_000
GAP = 15 * 60 * 1_000_000
#: The last slot of an interval without end.
OPEN = (1 << 63) - 1
#: Distinct intervals of a key in a block; rows of a group of blocks, about.
BLOCK, GROUP_ROWS = 4096, 32_768
#: Cells of a gap's length that sessions are first put together in.
CELLS = 64
#: By start (earlier, equal, later than the right one's), then by end (earlier, equal, later).
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")


def micros(df: DataFrame, col: str) -> Column:
    """Whole microseconds since 1970 UTC. A timestamp without a zone is taken as UTC, whatever the session's zone."""
    if df.schema[col].dataType.typeName() == "timestamp_ntz":
        since = F.col(col) - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
        return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long")
    return F.unix_micros(F.col(col))


def floored(col: str, width: int) -> Column:
    """A whole number divided by a width, down."""
    return F.expr(f"(`{col}` - pmod(`{col}`, {width}L)) div {width}L")


def sessions(events: DataFrame, key: str, ts: str, flag: Column, gap: int = GAP) -> DataFrame:
    """(key, first, last, flag): a session ends where a key's next event is over a gap later; flag: whether an event at its last instant has it.

    Events of one cell, as long as a gap, are of one session, so events are first summed up by
    cell, by each task before anything is shuffled: a key of a third of all rows sends as many
    rows as there are cells. Runs of cells are put together within blocks of CELLS cells, each
    of which also gets the last cell of the one before it; only runs that touch a block's edge
    are looked at once more, two a key and block at most. Null keys and times are left out.
    """
    there = events.select(F.col(key).alias("key"), micros(events, ts).alias("us"), F.coalesce(flag, F.lit(False)).cast("long").alias("f")).where("key IS NOT NULL AND us IS NOT NULL")
    cells = there.groupBy("key", floored("us", gap).alias("cell")).agg(F.min("us").alias("first"), F.max(F.col("us") * 2 + F.col("f")).alias("last"))  # the time, then the flag
    block, at_end = floored("cell", CELLS), F.pmod("cell", F.lit(CELLS)) == CELLS - 1
    dealt = cells.select("*", F.explode(F.when(at_end, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"))
    w = Window.partitionBy("key", "block").orderBy("cell")
    goes_on = (F.lag("cell").over(w) == F.col("cell") - 1) & (F.col("first") - F.shiftright(F.lag("last").over(w), 1) <= gap)
    own = floored("cell", CELLS) == F.col("block")
    marked = dealt.withColumn("begins", (own & ~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("run", F.sum("begins").over(w)).where(own)
    # run 0 of a block goes on from the block before
    runs = marked.groupBy("key", "block", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("cell").alias("cell"))
    at_edge = (F.col("run") == 0) | at_end
    chains = runs.withColumn("apart", F.when(~at_edge, F.col("block")))
    chains = chains.withColumn("chain", F.sum((F.col("run") > 0).cast("int")).over(Window.partitionBy("key", "apart").orderBy("block", "run")))
    whole = chains.groupBy("key", "apart", "chain").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return whole.select("key", "first", F.shiftright("last", 1).alias("last"), (F.pmod("last", F.lit(2)) == 1).alias("flag"))


def slotted(df: DataFrame, keep: list[str], slot: int = SLOT) -> DataFrame:
    """df's key, first, last and flag as key, s and e, slots both inclusive; e is OPEN where flag is true."""
    return df.select(*keep, "key", floored("first", slot).alias("s"), F.when(F.col("flag"), F.lit(OPEN)).otherwise(floored("last", slot)).alias("e"))


def overlaps(lk: np.ndarray, ls: np.ndarray, le: np.ndarray, rk: np.ndarray, rs: np.ndarray, re: np.ndarray, batch: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of left and right intervals of one block (lk, rk: small numbers) that share a slot, about batch at a time."""
    if not len(ls) or not len(rs):
        return
    values, ranks = np.unique(np.concatenate([ls, le, rs, re]), return_inverse=True)
    m, cuts = len(values), np.cumsum([len(ls), len(le), len(rs)])
    ls_, le_, rs_, re_ = np.split(ranks.astype(np.int64), cuts)
    by_start, by_end = np.argsort(rk * m + rs_, kind="stable"), np.argsort(rk * m + re_, kind="stable")
    starts, ends = (rk * m + rs_)[by_start], (rk * m + re_)[by_end]
    place = np.empty(len(rs), np.int64)
    place[by_end] = np.arange(len(rs))
    permutation = place[by_start]  # from start order to end order
    seen = np.searchsorted(starts, lk * m + le_, "right")  # right ones that start in time, those of earlier blocks included
    since, stop = np.searchsorted(ends, lk * m + ls_, "left"), np.searchsorted(ends, (lk + 1) * m, "left")
    bitmap, marked = np.zeros(len(rs), bool), 0
    order = np.argsort(seen, kind="stable")
    order = order[(since < stop)[order] & (seen > np.searchsorted(starts, lk * m, "left"))[order]]
    lefts, hits, held = [], [], 0
    for i, upto, a, b in zip(order.tolist(), seen[order].tolist(), since[order].tolist(), stop[order].tolist(), strict=True):
        if upto > marked:
            bitmap[permutation[marked:upto]] = True
            marked = upto
        found = bitmap[a:b].nonzero()[0]
        if len(found):
            lefts.append(i)
            hits.append(found + a)
            held += len(found)
            if held >= batch:
                yield np.repeat(lefts, [len(x) for x in hits]), by_end[np.concatenate(hits)]
                lefts, hits, held = [], [], 0
    if held:
        yield np.repeat(lefts, [len(x) for x in hits]), by_end[np.concatenate(hits)]


_RESULT = pa.schema([("key", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("relation", pa.string()), ("n_pairs", pa.int64()), ("overlap_slots", pa.int64()), ("sessions_crc", pa.int64())])


def _related(group: pa.Table) -> pa.Table:
    """Sums by left interval and relation of all blocks of a group."""
    col = {n: group.column(n).to_numpy() for n in ("key", "a", "b", "s", "e", "n", "crc")}
    _, unit = np.unique(np.stack([col["key"], col["a"].astype(np.int64), col["b"].astype(np.int64)]), axis=1, return_inverse=True)
    unit, left = unit.reshape(-1).astype(np.int64), group.column("is_left").to_numpy(zero_copy_only=False).astype(bool)
    li, ri = np.flatnonzero(left), np.flatnonzero(~left)
    ls, le, rs, re = col["s"][li], col["e"][li], col["s"][ri], col["e"][ri]
    rn, rcrc, out = col["n"][ri], col["crc"][ri], []
    for x, y in overlaps(unit[li], ls, le, unit[ri], rs, re):
        relation = 3 * (np.sign(ls[x] - rs[y]) + 1) + (le[x] > re[y]) + (le[x] >= re[y])
        end = np.minimum(le[x], re[y])
        shared = np.where(end == OPEN, 0, (np.where(end == OPEN, 0, end) - np.maximum(ls[x], rs[y]) + 1) * rn[y])
        key = x * 9 + relation
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sums = [np.add.reduceat(v[order], first) for v in (rn[y], shared, rcrc[y])]
        which, what = key[first] // 9, key[first] % 9
        both_open = (le[which] == OPEN) & (what % 3 == 1)
        out.append(pa.table([pa.array(col["key"][li][which]), pa.array(ls[which]), pa.array(le[which]), pa.array(np.array(RELATIONS)[what]), pa.array(sums[0]), pa.array(sums[1], mask=both_open), pa.array(sums[2])], schema=_RESULT))
    return pa.concat_tables(out) if out else _RESULT.empty_table()


def related(left: DataFrame, right: DataFrame, block: int = BLOCK, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, s, e, relation, n_pairs, overlap_slots, sessions_crc): partial sums, to be added up, of each left interval's relations to right ones.

    left: distinct (key, s, e); right: distinct (key, s, e) with n intervals and the sum crc of their checksums. Both are read several times: stored() tables.
    """
    n = left.count() + right.count()
    sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("ka"))
    sizes = sizes.join(right.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("kb")), "key", "full")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one block of its own side, against all blocks of the other."""
        cut = df.join(sizes, "key", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("ka", "kb")})
        salt = F.pmod(F.xxhash64("s", "e"), F.col(f"k{own}").cast("long")).cast("int")
        return cut.withColumn(own, salt).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"k{other}") - 1)))

    cols = ["key", "a", "b", "s", "e"]
    a = dealt(left, "a", "b").select(*cols, F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("crc"), F.lit(True).alias("is_left"))
    b = dealt(right, "b", "a").select(*cols, "n", "crc", F.lit(False).alias("is_left"))
    groups = max(1, -(-n // group_rows))
    both = a.unionByName(b).withColumn("unit", F.pmod(F.xxhash64("key", "a", "b"), F.lit(groups)))
    return both.groupBy("unit").applyInArrow(_related, "key long, s long, e long, relation string, n_pairs long, overlap_slots long, sessions_crc long")


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """(sale_id, key, first, last, flag): from sold_at to the latest of it and the lines' shipped_at; flag: the sale is open."""
    shipped = lines.select("sale_id", micros(lines, "shipped_at").alias("us")).where("sale_id IS NOT NULL").groupBy("sale_id").agg(F.max("us").alias("shipped"))
    sold = sales.select("sale_id", F.col("client_id").alias("key"), micros(sales, "sold_at").alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("flag")).where("key IS NOT NULL AND first IS NOT NULL")
    return sold.join(shipped, "sale_id", "left").select("sale_id", "key", "first", F.greatest("first", "shipped").alias("last"), "flag")


def sales_and_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame, block: int = BLOCK, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(sale_id, relation, n_pairs, overlap_slots, sessions_crc) of sales and click sessions of their client that share a slot.

    A sale_id that repeats is summed up over its rows, a null one is an id of its own; sales that meet no session have no row.
    overlap_slots is null where all pairs of the row are open on both sides.
    """
    found = sessions(clicks, "client_id", "ts", F.col("kind") == "error")
    crc = F.crc32(F.col("first").cast("string").cast("binary"))
    spans = slotted(found.withColumn("crc", crc), ["crc"]).groupBy("key", "s", "e").agg(F.count(F.lit(1)).alias("n"), F.sum("crc").alias("crc"))
    right = stored(spans)
    sold = stored(slotted(sale_intervals(sales, lines), ["sale_id"]))
    left = stored(sold.select("key", "s", "e").distinct())
    sums = sold.join(related(left, right, block, group_rows), ["key", "s", "e"])
    return sums.groupBy("sale_id", "relation").agg(*[F.sum(c).alias(c) for c in ("n_pairs", "overlap_slots", "sessions_crc")])
