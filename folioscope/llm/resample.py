"""Importance resampling towards a target corpus, scored without exploding a document.

A document's features are its runs of words; a feature's bucket is a crc32 of its bytes. The
target's and the corpus's counts of each bucket give a gain; a document's weight is the mean
gain of its features. Counting is the only thing that shuffles: one total a bucket from each
task. Scoring is one projection: higher-order functions make the array of buckets and add up
``element_at`` of the gains, which are a literal array of a fixed number of entries. A noise
of Gumbel's distribution, made of the document's id, turns the highest scores into a sample
without replacement (Efraimidis, Spirakis 2006; Kool et al. 2019).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import stored

#: Words: runs of ASCII letters and digits, in lower case, and of whatever is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """The words of a text; a null text has none. Only A to Z are lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def bucketed(df: DataFrame, keep: list[str], text: str = "text", runs: int = 1, buckets: int = 10_000) -> DataFrame:
    """df's columns of keep, _n_words, and _buckets: the bucket of each run of one to so many words, in order of length and place."""
    words = df.select(*keep, terms(F.col(text)).alias("_words"))
    bucket = lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int")
    run = lambda n: lambda i: bucket(F.concat_ws(" ", *[F.get("_words", i + k) for k in range(n)]))
    arrays = [F.transform("_words", bucket)]
    for n in range(2, runs + 1):
        at = F.when(F.size("_words") >= n, F.sequence(F.lit(0), F.size("_words") - n)).otherwise(F.array().cast("array<int>"))
        arrays.append(F.transform(at, run(n)))
    return words.select(*keep, F.size("_words").alias("_n_words"), (F.concat(*arrays) if runs > 1 else arrays[0]).alias("_buckets"))


def totals(df: DataFrame, buckets: int = 10_000) -> list[int]:
    """How many features lie in each bucket; to the driver goes a number for each bucket, whatever the size of df."""
    out = [0] * buckets
    # with explode, Spark would add a filter on the array's size, and make the array twice for it
    for bucket, n in df.select(F.explode_outer("_buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("b IS NOT NULL").collect():
        out[bucket] = n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of a bucket's share of the target and of the corpus, each count one more than it is."""
    k, s, t = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(corpus, target, strict=True)]


def noise(seed: int, id_col: str) -> Column:
    """Thousandths of a Gumbel variable made of the seed and the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(docs: DataFrame, table: list[int], seed: int = 2024, id_col: str = "doc_id", text: str = "text", runs: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each row; weight is the floored mean of gains, 0 without features."""
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded into one literal by the optimizer
    rows = bucketed(docs, [id_col], text, runs, len(table)).select(
        F.col(id_col), F.col("_n_words").cast("long").alias("n_words"), F.size("_buckets").cast("long").alias("n_features"),
        F.aggregate("_buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(literal, b + 1)).alias("_gain"),
    )
    weighed = rows.select(id_col, "n_words", "n_features", F.when(F.col("n_features") > 0, F.floor(F.col("_gain") / F.col("n_features"))).otherwise(F.lit(0).cast("long")).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise(seed, id_col))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, least_words: int = 20, runs: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document: rank is 1, 2, 3 for those drawn, null for others.

    Of the documents with least_words words or more, the floor of percent per cent with the
    highest scores are drawn; ties go to the smaller id (null last), then to fewer features.
    Null and empty texts have weight 0 and are not drawn. Rows of one id are rows of their own.

    Ranks need no sort of all rows in one place: a table of how many rows have each score gives
    the number above it, and rows are numbered within their score. Scores are whole thousandths
    of logarithms of counts, some tens of thousands of values at any size.
    """
    corpus = totals(bucketed(docs, [], text, runs, buckets), buckets)
    wanted = totals(bucketed(target, [], text, runs, buckets), buckets)
    rows = stored(scored(docs, gains(corpus, wanted), seed, id_col, text, runs))
    fit = F.col("n_words") >= least_words
    counts = rows.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    cut = counts.select("score", above.alias("_above"), F.sum("_n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    cut = cut.select("score", "_above", F.expr(f"(_all * {percent}) div 100").alias("_drawn")).where("_above < _drawn").withColumn("_fit", F.lit(True))
    placed = rows.withColumn("_fit", fit).join(cut, ["score", "_fit"], "left")
    within = Window.partitionBy("score", "_fit").orderBy(F.asc_nulls_last(id_col), "n_features", "weight")
    place = F.when(F.col("_above").isNotNull(), F.col("_above") + F.row_number().over(within))
    return placed.withColumn("_place", place).select(id_col, "n_features", "weight", "score", F.when(F.col("_place") <= F.col("_drawn"), F.col("_place")).alias("rank"))
