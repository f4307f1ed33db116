"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

Method. A document's size is its number of words. Sources, in code point order with null
last, get target sizes by weight; a target stops at ``epochs`` times its source's size and
the excess goes to the others by weight until none is above (the closed form of that
resharing: sources ordered by capacity over weight, the first so many at their caps, the
others at one common rate). Each source is cut by a seeded hash into shards of about
``shard_words`` words. The mix's blocks of ``block_words`` words are then apportioned to the
shards, whose votes are their part of their source's target, by Sainte-Lague: the block
goes, one after another, to the highest quotient votes / (2 seats + 1). Rounding
votes / block_words gives the apportionment for nearly all blocks; the few blocks that
differ from the total are dealt out (or taken back) by highest (lowest) quotient over a
list that holds a few quotients a shard.

Within a shard documents are in a seeded order, laid end to end and cut into blocks. A
quota of q blocks takes every block q // blocks times and a seeded run of q % blocks
neighbouring blocks (around the end) once more. A document's ``taken`` is the number of
its words in blocks taken, repeats counted. Since votes stop at ``epochs`` times the shard,
quotas do too, and no document is taken more often.

Scale. Text is not shuffled unless the result keeps it: windows run over shards, whose number grows
with the input, not over sources, so that a source with a third of all rows is spread.

Defined results: null, empty and blank texts have size 0 and take 0 words; a null source
is a source of its own; repeated rows each have a place of their own, equal rows in any
order; a null id is placed by its text; an empty table gives an empty table. All columns
of the input are kept; those with the names of results are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import WORD, stored

MADE = ("size", "source_size", "target", "taken")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source."""
    everything = Window.partitionBy()
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1))
    w = w.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("all", F.sum("source_size").over(everything) * share)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the rate that is left for a source and those after it, if all before it are at their caps
    w = w.withColumn("rate", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    free = F.col("rate") * F.col("weight") < F.col("cap")
    w = w.withColumn("common", F.max(F.when(free, F.struct(-F.row_number().over(order), F.col("rate")))).over(everything)["rate"])
    return w.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))).alias("target"))


def quotas(votes: DataFrame, block_words: int, epochs: int = 2) -> DataFrame:
    """votes (a row for each shard: key columns, shard_size, blocks, vote) with quota: its number of blocks."""
    even = F.floor(F.col("vote") / block_words + 0.5)  # what Sainte-Lague gives at the divisor block_words
    v = votes.withColumn("even", even.cast("long"))
    total, seats = v.agg(F.sum("vote"), F.sum("even")).first()
    if not total:
        return v.withColumn("quota", F.lit(0).cast("long")).drop("even")
    missing = round(total / block_words) - seats
    if missing == 0:
        return v.withColumnRenamed("even", "quota")
    few = F.ceil(F.lit(float(abs(missing))) * F.col("vote") / F.lit(float(total))).cast("long") + 1
    keys = [c for c in votes.columns if c not in ("shard_size", "blocks", "vote")]
    step = F.explode(F.sequence(F.lit(1).cast("long"), few)).alias("step")
    if missing > 0:
        quotient = F.col("vote") / (2 * (F.col("even") + F.col("step") - 1) + 1)
        more = v.select(*keys, "vote", "even", step).withColumn("quotient", quotient).orderBy(F.desc("quotient"), *[F.asc_nulls_last(k) for k in keys], "step")
    else:
        quotient = F.col("vote") / (2 * (F.col("even") - F.col("step")) + 1)
        more = v.select(*keys, "vote", "even", step).where("step <= even").withColumn("quotient", quotient).orderBy("quotient", *[F.desc_nulls_first(k) for k in keys], F.desc("step"))
    change = more.limit(abs(missing)).groupBy(*keys).agg(F.count(F.lit(1)).alias("change"))
    change = change.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "change")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    sign = 1 if missing > 0 else -1
    return v.join(change, same, "left").select(*votes.columns, (F.col("even") + sign * F.coalesce("change", F.lit(0))).alias("quota"))


def _overlap(a: Column, b: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, hi) - F.greatest(a, lo))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: int = 2, block_words: int = 32, shard_words: int = 1 << 18, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """docs with size, source_size, target and taken."""
    docs = docs.drop(*MADE)
    # rows of one id differ by text or source; those that differ by neither take as much in either order
    word = lambda c: F.coalesce(c, F.lit(""))
    order = F.md5(F.concat_ws(":", F.lit(seed), word(F.col(id_col).cast("string")), F.md5(word(F.col(text_col))), word(F.col(source_col)))).alias("_order")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    kept = docs.columns if keep_text else [c for c in docs.columns if c != text_col]
    slim = stored(docs.select(*[c for c in kept if c != text_col], size, order))  # the text stays behind
    sized = docs.select(*kept, size, order) if keep_text else slim
    sizes = slim.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    aim = targets(sizes, weights, share, epochs).withColumn("shards", F.ceil(F.col("source_size") / F.lit(float(shard_words))).cast("long"))
    aim = aim.withColumn("shards", F.greatest("shards", F.lit(1)))
    aim = stored(aim.withColumnRenamed("source", "_source"))


    def sharded(rows: DataFrame) -> DataFrame:
        # a row for each source, of which there are few, or many small ones: the join's size check decides on a broadcast
        rows = rows.join(aim, F.col(source_col).eqNullSafe(F.col("_source"))).drop("_source")
        return rows.withColumn("_shard", F.pmod(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.col("shards"))).drop("shards")

    shard = [source_col, "_shard"]
    votes = sharded(slim).groupBy(*shard).agg(F.sum("size").alias("shard_size"), F.max("target").alias("target"), F.max("source_size").alias("source_size"))
    votes = votes.select(*shard, "shard_size", F.ceil(F.col("shard_size") / F.lit(float(block_words))).cast("long").alias("blocks"), F.when(F.col("source_size") > 0, F.col("target") * F.col("shard_size") / F.col("source_size")).otherwise(0.0).alias("vote"))
    quota = stored(quotas(stored(votes), block_words, epochs)).withColumnRenamed(source_col, "_source").withColumnRenamed("_shard", "_s")
    rows = sharded(sized).join(quota.select("_source", "_s", "shard_size", "blocks", "quota"), F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_s"))).drop("_source", "_s")
    start = F.sum("size").over(Window.partitionBy(*shard).orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rows = rows.withColumn("_a", start)
    b = F.col("_a") + F.col("size")
    rounds = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0)
    run = F.col("quota") - F.col("_rounds") * F.col("blocks")
    first = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(source_col), F.lit("")), F.col("_shard").cast("string"))), 1, 8), 16, 10).cast("long"), F.greatest("blocks", F.lit(1)))
    rows = rows.withColumn("_rounds", rounds.cast("long")).withColumn("_run", run).withColumn("_first", first)
    lo, hi, end = F.col("_first") * block_words, (F.col("_first") + F.col("_run")) * block_words, F.col("blocks") * block_words
    once_more = _overlap(F.col("_a"), b, lo, F.least(hi, end)) + _overlap(F.col("_a"), b, F.lit(0), hi - end)
    taken = F.least((F.col("_rounds") * F.col("size") + once_more).cast("long"), F.col("size") * epochs)
    return rows.withColumn("taken", taken).select(*kept, *MADE)


def sample(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as its taken words make it whole (rounded), with the columns of docs."""
    mixed = mix(docs, **how)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
