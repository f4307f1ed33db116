"""Language identification by word-first backoff.

Method. A model holds, for each language, log frequencies of its most frequent words and
of character n-grams of 5 down to 1 letters (words are wrapped in ``<`` and ``>``). A text
is its runs of letters in lower case. A known word adds its log frequency in each
language. An unseen word is read from left to right: at each place the longest known
n-gram that starts there is scored and the place moves behind it, so the word falls back
to shorter n-grams only where longer ones are unknown. The sums over the text give the
language (ties: the first by name) and, through a softmax of the mean advantage over
``CONFIDENT_WORDS`` words at most, the score.

Training learns from a bounded sample of labelled rows, ``train_docs`` a language, chosen
by a hash of the id, and keeps ``words`` words and ``grams`` n-grams a language; counting
is distributed and only those tables reach the driver. Prediction is one narrow pass;
each Python worker keeps the scores of words it has met, from task to task, up to ``CACHE_WORDS``.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows with
a null id or language are not learnt from, and are predicted; repeated rows get equal
results; without any training row every text is ``und``; other columns are not looked at.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.shared import pieces

#: Runs of letters (and of the few digit-like letters that Python counts as word characters).
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 5
CACHE_WORDS = 150_000
CONFIDENT_WORDS = 40
#: What a unit that a language has never shown counts as.
UNSEEN_COUNT = 0.1


def grams(word: str) -> Iterator[str]:
    """All n-grams of a wrapped word."""
    w = f"<{word}>"
    for n in range(1, LONGEST + 1):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


class _Rows(dict):
    """The row of a model's table for each word met; that of an unseen word is added."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> int:
        m = self.model
        at = m.units.get(" " + word)
        if at is None:
            if m.used == len(m.table):
                m.table = np.concatenate([m.table, np.zeros((max(1024, m.used // 2), m.table.shape[1]))])
            m.table[m.used] = m.backoff(word)
            at, m.used = m.used, m.used + 1
        self[word] = at
        return at


class Model:
    """languages; units: words (prefixed by a space) and n-grams, in the order of the rows of table, their log frequencies by language."""

    def __init__(self, languages: list[str], units: list[str], table: np.ndarray):
        self.languages, self.units, self.table, self.used, self.known = languages, dict(zip(units, range(len(units)), strict=True)), table, len(units), len(units)
        self.memo = _Rows(self)

    @classmethod
    def of_counts(cls, rows: list[tuple[str, str, int]]) -> Model:
        """rows: (language, unit, count); a word's unit begins with a space."""
        languages = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(languages)}
        units = {u: i for i, u in enumerate(dict.fromkeys(r[1] for r in rows))}
        table = np.full((len(units), len(languages)), UNSEEN_COUNT)
        for lang, unit, n in rows:
            table[units[unit], at[lang]] += n
        level = np.array([0 if u[0] == " " else len(u) for u in units], np.int64)
        size = np.zeros((LONGEST + 1, len(languages)))
        np.add.at(size, level, table)
        return cls(languages, list(units), np.log(table / size[level]))

    def backoff(self, word: str) -> np.ndarray:
        """An unseen word's log score in each language."""
        w, i, out = f"<{word}>", 0, np.zeros(len(self.languages))
        while i < len(w):
            for n in range(min(LONGEST, len(w) - i), 0, -1):
                at = self.units.get(w[i : i + n])
                if at is not None:
                    out = out + self.table[at]
                    i += n - 1
                    break
            i += 1
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(languages, scores); ('und', 0) without letters."""
        if len(self.memo) > CACHE_WORDS:
            self.memo.clear()
            self.used = self.known
        rows, count, row = [], [], self.memo.__getitem__
        for t in texts:
            words = LETTERS.findall((t or "").lower()) if self.languages else []
            if not any(c.isalpha() for w in words for c in w):
                words = []
            rows.extend(map(row, words))
            count.append(len(words))
        names, scores, count = ["und"] * len(texts), np.zeros(len(texts)), np.array(count, np.int64)
        some = np.flatnonzero(count)
        if len(some):
            total = np.add.reduceat(self.table[rows], (np.cumsum(count) - count)[some], axis=0)
            best = total.argmax(1)
            edge = (total - total[np.arange(len(some)), best][:, None]) * np.minimum(1.0, CONFIDENT_WORDS / count[some])[:, None]
            scores[some] = 1 / np.exp(edge).sum(1)
            for k, b in zip(some.tolist(), best.tolist(), strict=True):
                names[k] = self.languages[b]
        return names, scores


def train(docs: DataFrame, train_docs: int = 1500, words: int = 20_000, grams_kept: int = 30_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the docs' languages, from a sample of train_docs rows a language at most, on average."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return Model([], [], np.zeros((0, 0)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, train_docs / n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in pieces(batches, "text"):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(LETTERS.findall((text or "").lower()))
            if sum(map(len, seen.values())) > 30_000:
                yield flush(seen)
                seen = {}
        if seen:
            yield flush(seen)

    def flush(seen: dict[str, Counter]) -> pa.RecordBatch:
        out: dict[tuple[str, str], int] = {}
        for lang, c in seen.items():
            for w, n in c.items():
                out[lang, " " + w] = n
                for g in grams(w):
                    out[lang, g] = out.get((lang, g), 0) + n
        return pa.record_batch([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["lang", "unit", "n"])

    counts = sample.mapInArrow(count, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    kind = F.col("unit").startswith(" ")
    kept = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", kind).orderBy(F.desc("n"), "unit"))).where(F.col("r") <= F.when(kind, words).otherwise(grams_kept))
    return Model.of_counts(sorted(tuple(r) for r in kept.select("lang", "unit", "n").collect()))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id with lang_pred and score."""
    return annotate(docs.select(id_col, text_col), model, text_col).select(id_col, "lang_pred", "score")


#: A worker's model, by a name that goes with its broadcast: the next task finds the words that are known.
_MODELS: dict[str, Model] = {}


def annotate(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with all their columns, and lang_pred and score behind them (a clashing column is replaced)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.languages, list(model.units), model.table[: model.known]))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, *parts = shared.value
        if name not in _MODELS:
            _MODELS.clear()  # one at a time
            _MODELS[name] = Model(*parts)
        m = _MODELS[name]
        for b in pieces(batches, text_col, 1 << 20):
            languages, scores = m.predict(b.column(at).to_pylist())
            yield pa.record_batch([*b.columns, pa.array(languages, pa.string()), pa.array(scores)], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
