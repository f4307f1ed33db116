"""The corpus pipeline: language, near-duplicates, decontamination, mixing, token files.

Each stage takes all documents that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again before the next. All but the last return the columns of
documents. Texts stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, jaccard, langid, mixing, tokenfile
from folioscope.llm.queries import tokenizer_path
from folioscope.llm.shared import shared_folder, stored, table

#: Documents whose language is less sure than this, hardly more than a guess, are rejected, like those without a letter.
LEAST_SURE = 0.3
#: Near-duplicates: the exact similarity of the sets of five-word shingles.
DEDUP = {"words": 5, "similarity": 0.8}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their text shows; undetermined ones go."""
    named = langid.annotate(docs, langid.train(docs))
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the least id (rows without an id come last); equal rows are one group."""
    return jaccard.one_of_each(docs, **DEDUP)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    checked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return checked.where(~F.col("contaminated")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and each document's place in them."""
    folder = shared_folder(spark)
    tokenfile.write(docs, folder, tokenizer_path())
    return tokenfile.read(spark, folder)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mixed), ("tokens", tokens)]

#: Hashed fingerprints, alignments and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
