"""Quality rules as a short-circuit cascade: what rejects most for its cost comes first.

A rule is a Column that is true where a text fails. Each rule's cost (seconds a row) and
selectivity (share of rows it rejects) are measured on a bounded sample; rules are ordered by
rejection per cost, the greedy order that is best for independent filters (Hellerstein,
Stonebraker 1993). The cascade is one nested CASE: Spark evaluates a later rule only for rows
that all earlier ones let pass. The order changes the time, never which rows are kept.

All work is DataFrame functions: no Python runs on executors, and nothing shuffles.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import WORD

#: Rows that costs and selectivities are measured on, at most.
SAMPLE_ROWS = 2000
#: Words of a window that counts as repeated when a text has it twice.
WINDOW = 5
NO_SYMBOLS = "[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[], Column]


@dataclass(frozen=True)
class Estimate:
    """cost: seconds a row; selectivity: share of rows rejected."""

    rule: Rule
    cost: float
    selectivity: float

    @property
    def gain(self) -> float:
        """Rejection per cost."""
        return self.selectivity / self.cost


#: Rules over measured() columns and the text. A text without a word fails none of them; base rules see to it.
RULES: tuple[Rule, ...] = (
    Rule("many_symbols", lambda: F.col("n_symbols") > 0.1 * F.col("n_words")),
    Rule("odd_word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("many_dup_lines", lambda: (F.col("n_dup_lines") > 0.3 * F.col("n_lines")) & (F.col("n_dup_lines") > 2)),
    Rule("shouting", lambda: F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")) > 0.5 * F.col("word_chars")),
    Rule("few_letters", lambda: F.length(F.regexp_replace("text", r"[\p{L}\p{M}\x20\x09-\x0D]+", "")) > 0.5 * F.col("word_chars")),
    Rule("many_exclamations", lambda: F.length(F.regexp_replace("text", r"[^!?]+", "")) > 0.3 * F.col("n_words")),
)


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines); null texts count as empty.

    Windows are told apart by 64-bit hashes of their words, within one text. Texts without a
    repeated window are done after one look for distinct hashes; only others sort theirs.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("*", F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("_words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    # those that reach over the end are cut off
    window = F.slice(F.transform("_words", lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, WINDOW)])), F.lit(1), F.size("_words") - (WINDOW - 1))
    solid = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), " \t\n\x0b\x0c\r", F.col("text"))
    rows = rows.select(
        "_id", "text", F.size("_words").cast("long").alias("n_words"), F.length(solid).cast("long").alias("word_chars"), F.length(F.regexp_replace("text", NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.size("_lines").cast("long").alias("n_lines"), F.when(F.size("_words") >= WINDOW, window).alias("_windows"),
    )
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.select("*", F.when(twice, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted")).drop("_windows")
    same = lambda x, i: F.coalesce(x["h"] == F.get("_sorted", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_sorted", i + 1)["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_sorted", same), lambda x: x["i"]))
    # a window adds the words that the one before it doesn't cover
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n")), lambda a: a["n"])
    return rows.select(F.col("_id").alias(id_col), "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text", most_chars: int = 20_000, fraction: float = 0.2) -> DataFrame:
    """At most so many texts, none of over most_chars: a random share of as many partitions as it takes, one after another.

    They pass through the driver, which is what stops the reading early; a limit within a plan would read every partition.
    """
    taken = docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")).where(F.length(text) <= most_chars).sample(fraction, seed=11).take(rows)
    return docs.sparkSession.createDataFrame(taken, "doc_id int, text string")


def estimate(sample: DataFrame, rules: Sequence[Rule] = RULES) -> list[Estimate]:
    """Cost and selectivity of each rule, alone, on a sample of measured() rows, which is kept in memory meanwhile."""
    held = sample.cache()
    try:

        def seconds(c: Column) -> tuple[float, int]:
            began = time.perf_counter()
            n = held.agg(F.count_if(c).alias("n")).first()[0]
            return time.perf_counter() - began, n

        n = held.count()
        seconds(F.lit(True))
        idle = min(seconds(F.length("text") < 0)[0] for _ in range(2))
        out = []
        for rule in rules:
            seconds(rule.fails())  # the first run compiles
            took, failed = min(seconds(rule.fails()) for _ in range(2))
            out.append(Estimate(rule, max(took - idle, 1e-4) / max(n, 1), failed / max(n, 1)))
        return out
    finally:
        held.unpersist()


def ordered(estimates: Sequence[Estimate]) -> list[Rule]:
    """Rules by rejection per cost, cheaper ones first among those that reject nothing in the sample."""
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.gain, e.cost, e.rule.name))]


def passes(rules: Sequence[Rule]) -> Column:
    """True where no rule fails; a rule is evaluated only where those before it passed."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.fails(), F.lit(False)).otherwise(out)
    return out


def rejected_by(rules: Sequence[Rule]) -> Column:
    """The name of the first rule of this order that fails; null where none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.fails(), F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row.

    A null or empty text has no words and fails the base rules. Equal rows get equal results; an empty table gives none.
    """
    order = ordered(estimate(measured(sampled(docs, sample_rows, text)), rules))
    rows = measured(docs, id_col, text)
    return rows.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.when(base_failed(), F.lit(False)).otherwise(passes(order)).alias("kept"))
