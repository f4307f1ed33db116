"""Numbers in table cells of filings: accounting negatives, footnotes, percents, ratios."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from folioscope.functions.text import strip

# Cells that hold no number, currency signs, raised digits.
NO_NUMBER = ["", "-", "--", "—", "–", "‒", "―", "n/a", "na", "n.a.", "nm", "n.m.", "nil", "none", "*"]
CURRENCY = "$€£¥₹"
RAISED = "¹²³⁰-⁹"
RESULT = "struct<value:decimal(38,12),is_percent:boolean,is_negative:boolean,had_footnote:boolean>"


@pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Unicode's compatibility form (NFKC), which Spark has no function for; ASCII passes as it is."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.transform(F.array(value), use)[0]


def parse_number(raw: Column, ascii_only: bool = False) -> Column:
    """struct(value, is_percent, is_negative, had_footnote), or null if a cell holds no number.

    ascii_only: cells are known to be ASCII, and the expression stays in the JVM.
    """
    if ascii_only:
        return _let(strip(raw), lambda bare: _of(bare, bare, F.lit(False)))
    plain = F.regexp_replace(strip(raw), rf"[{RAISED} ]+$", "")
    # the raised digits come off first: folding would turn them into digits of the number
    return _let(F.struct(compatible(plain).alias("text"), (plain != strip(raw)).alias("raised")), lambda c: _of(strip(F.translate(c["text"], "\u00a0\u2212", " -")), c["text"], c["raised"]))


def _of(text: Column, there: Column, raised: Column) -> Column:
    # trailing [1] or (2) are footnotes as long as a digit is left before them; a lone (12) is a value
    bare = F.regexp_replace(text, r"(?s)^(.*?[0-9].*?)(?:\s*[(\[{]\s*[0-9]{1,2}\s*[)\]}]\s*)+$", "$1")
    return F.when(there.isNotNull() & ~F.lower(text).isin(NO_NUMBER), _let(F.struct(strip(bare).alias("t"), (raised | (bare != text)).alias("noted")), lambda c: _signed(c["t"], c["noted"])))


def _signed(text: Column, noted: Column) -> Column:
    percent = text.endswith("%")
    unit = F.when(percent, F.regexp_replace(text, "%$", "")).otherwise(F.regexp_replace(text, "(?i)bps?$", ""))
    amount = F.regexp_replace(strip(unit), rf"^[{CURRENCY} ]+", "")
    return F.when(~F.lower(text).isin(NO_NUMBER), _let(F.struct(amount.alias("t"), percent.alias("p")), lambda c: _unwrapped(c["t"], c["p"], noted)))


def _unwrapped(text: Column, percent: Column, noted: Column) -> Column:
    # each pair of brackets around the whole turns the sign; unpaired ones leave a bracket, which is no number
    left = F.length(F.regexp_replace(F.regexp_extract(text, r"^((?:\(\s*)*)", 1), r"\s", ""))
    right = F.length(F.regexp_replace(F.regexp_extract(text, r"((?:\s*\))*)$", 1), r"\s", ""))
    inner = F.when(left == right, F.regexp_replace(text, r"^(?:\(\s*)+|(?:\s*\))+$", "")).otherwise(text)
    return _let(F.struct(strip(inner).alias("t"), (left % 2 == 1).alias("n")), lambda c: _number(c["t"], c["n"], percent, noted))


def _number(text: Column, negative: Column, percent: Column, noted: Column) -> Column:
    negative = negative != text.startswith("-")
    digits = F.regexp_replace(strip(F.regexp_replace(text, "^[-+]", "")), rf"^[{CURRENCY} ]+|[{CURRENCY} ]+$", "")
    digits = F.regexp_replace(F.regexp_replace(digits, "[, ]", ""), "(?i)x$", "")
    return _let(F.when(digits.rlike(r"^([0-9]*\.?[0-9]+|[0-9]+\.)$"), digits).try_cast("decimal(38,12)"), lambda v: F.when(v.isNotNull(), F.struct(F.when(negative, -v).otherwise(v).cast("decimal(38,12)").alias("value"), percent.alias("is_percent"), negative.alias("is_negative"), noted.alias("had_footnote"))))
