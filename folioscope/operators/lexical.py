"""Lexical retrieval: analysis, postings, web-style queries, cover density and BM25.

The analyser is its own: words in lower case, English stop words dropped, Porter's
published stemming algorithm (1980) applied to the distinct words only.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

WORD = r"(?U)[\p{L}\p{N}]+"
# English function words.
STOP = frozenset("a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own s same she should so some such t than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split())
K1, B = 1.2, 0.75
#: What one cover adds at most, as the weight of plain text.
COVER_WEIGHT = 0.1
#: Words that are held as numbers at once: whole documents, one at least.
RUN_WORDS = 1 << 18


def stem(word: str) -> str:
    """Porter's algorithm for an English word in lower case."""
    if len(word) < 3 or not word.isascii():
        return word
    vowel = lambda w, i: w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))
    shape = lambda w: "".join("v" if vowel(w, i) else "c" for i in range(len(w)))
    measure = lambda w: len(re.findall("v+c+", shape(w)))
    has_vowel = lambda w: "v" in shape(w)
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1)
    cvc = lambda w: len(w) > 2 and shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
        for end, new in rules:
            if w.endswith(end):
                return w[: -len(end)] + new if measure(w[: -len(end)]) > least else w
        return w

    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # Porter's endings of steps 2, 3 and 4.
    w = swap(w, [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")], 0)
    w = swap(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    if w.endswith("ion"):
        w = w[:-3] if w[:-3].endswith(("s", "t")) and measure(w[:-3]) > 1 else w
    else:
        w = swap(w, [(e, "") for e in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")], 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if measure(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def words(text: Column) -> Column:
    """A text's words in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def terms(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", stemmed: bool = True) -> DataFrame:
    """(id, position, term): a row for each word that is no stop word; positions count all words, from 1."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(words(F.col(text_col))).alias("position", "word"))
    rows = rows.where(~F.col("word").isin(*sorted(STOP))).withColumn("position", F.col("position") + 1)
    if not stemmed:
        return rows.select("id", "position", F.col("word").alias("term"))
    # each distinct word is stemmed once, and found again by an equality join
    known = rows.select("word").distinct().withColumn("term", stems("word"))
    return rows.join(known, "word").select("id", "position", "term")


def coded(found: pa.Array, stemmed: bool, stems: dict[str, str]) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms of words, and each word's place among them, -1 for stop words. stems: what is known, added to."""
    numbered = found.dictionary_encode()
    known, stop = numbered.dictionary, pc.is_in(numbered.dictionary, value_set=pa.array(sorted(STOP))).to_numpy(zero_copy_only=False)
    term = np.arange(len(known))
    if stemmed:
        if len(stems) > 1 << 18:
            stems.clear()
        each = known.to_pylist()
        for w, out in zip(each, stop, strict=True):
            if not out and w not in stems:
                stems[w] = stem(w)
        again = pa.array([stems.get(w, w) for w in each], pa.string()).dictionary_encode()
        known, term = again.dictionary, again.indices.to_numpy()
    return known, np.where(stop, -1, term)[numbered.indices.to_numpy()]


def placed(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", stemmed: bool = True, payload: Sequence[str] = ()) -> DataFrame:
    """(term, id, *payload, positions): the postings of documents that are a row each, made where they lie, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems_: dict[str, str] = {}
        for b in batches:
            n = pc.list_value_length(b.column("w")).to_numpy(zero_copy_only=False)
            ends, at = n.cumsum(), 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_WORDS, "right")))
                some, m = b.slice(at, to - at), n[at:to]
                known, code = coded(pc.list_flatten(some.column("w")), stemmed, stems_)
                doc = np.repeat(np.arange(len(m)), m)
                position = np.arange(1, len(code) + 1) - np.repeat(np.r_[0, m.cumsum()[:-1]], m)
                key = (code * len(m) + doc)[code >= 0]
                # by term, then document: a term's postings of a run lie together
                by = np.argsort(key, kind="stable")
                key, position = key[by], position[code >= 0][by]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
                of_term, of_doc = np.divmod(key[first], len(m))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)].astype(np.int32)), pa.array(position.astype(np.int32)))
                out = pa.table([known.take(pa.array(of_term)), *(c.take(pa.array(of_doc)) for c in some.drop_columns(["w"]).columns), lists], names=["term", "id", *payload, "positions"])
                yield from out.to_batches(max_chunksize=1 << 16)
                at = to

    shape = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", docs.schema[id_col].dataType), *(docs.schema[c] for c in payload), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(id_col).alias("id"), *payload, words(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).mapInArrow(run, shape)


def postings(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", stemmed: bool = True, only: DataFrame | None = None) -> DataFrame:
    """(term, id, positions): the index, sorted positions of each term in each document; of the terms in only, if given, for a batch of queries that has no stored index."""
    rows = terms(docs, id_col, text_col, stemmed)
    rows = rows if only is None else rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "id").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def parse(query: str, stemmed: bool | None = True) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of (wanted, terms of a phrase); words are joined by and, or parts alternatives, - excludes, quotes make phrases. stemmed None: words are terms already, and stay as they are."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for sign, phrase, bare in re.findall(r'(-?)"([^"]*)"?|(\S+)', query or ""):
        if bare.lower() == "or":
            out.append([])
            continue
        wanted = not (sign or bare.startswith("-"))
        found = phrase.split() if stemmed is None else [w for w in re.findall(r"[^\W_]+", (phrase or bare).lower()) if w not in STOP]
        if found:
            out[-1].append((wanted, [stem(w) if stemmed else w for w in found]))
    return [g for g in out if any(wanted for wanted, _ in g)]


def matches(groups: list[list[tuple[bool, list[str]]]], where: dict[str, list[int]]) -> list[list[str]]:
    """The wanted terms of each alternative that a document meets. where: its positions of each term."""

    def holds(phrase: list[str]) -> bool:
        if any(t not in where for t in phrase):
            return False
        return len(phrase) == 1 or any(all(p + i in where[t] for i, t in enumerate(phrase)) for p in where[phrase[0]])

    return [[t for wanted, phrase in g if wanted for t in phrase] for g in groups if all(holds(phrase) == wanted for wanted, phrase in g)]


def cover_density(wanted: list[str], where: dict[str, list[int]]) -> float:
    """Sum over the shortest stretches that hold all wanted terms: more for tighter ones (Clarke, Cormack, Tudhope, 2000)."""
    wanted = sorted(set(wanted))
    places = sorted((p, t) for t in wanted for p in where[t])
    last: dict[str, int] = {}
    covers: list[tuple[int, int]] = []
    for p, t in places:
        last[t] = p
        if len(last) == len(wanted):
            begin = min(last.values())
            if not covers or covers[-1][0] < begin:
                covers.append((begin, p))
    return sum(COVER_WEIGHT * len(wanted) / (q - p + 1) for p, q in covers)


def match(queries: DataFrame, index: DataFrame, stemmed: bool | None = True) -> DataFrame:
    """(query_id, id) of documents that meet each web-style query.

    An alternative needs a wanted term; one of excluded terms alone meets nothing. Words are
    decided by counting the terms that a document has of an alternative; only candidates of an
    alternative with a phrase of several words are looked at by their positions.
    """

    @pandas_udf("array<struct<part:int,term:string,wanted:boolean,n:int,phrases:boolean>>")
    def plan(text: pd.Series) -> pd.Series:
        def of(query: str) -> list[tuple]:
            rows = []
            for i, group in enumerate(parse(query, stemmed)):
                wanted = {t for keep, phrase in group if keep for t in phrase}
                barred = {phrase[0] for keep, phrase in group if not keep and len(phrase) == 1}
                long = any(len(phrase) > 1 for _, phrase in group)
                rows += [(i, t, True, len(wanted), long) for t in sorted(wanted)] + [(i, t, False, len(wanted), long) for t in sorted(barred)]
            return rows

        return text.map(of)

    asked = queries.select("query_id", F.col("text").alias("query"))
    rows = asked.select("query_id", F.explode(plan("query")).alias("p")).select("query_id", "p.*").join(index.select("term", "id"), "term")
    found = rows.groupBy("query_id", "part", "n", "phrases", "id").agg(F.count_if("wanted").alias("w"), F.count_if(~F.col("wanted")).alias("x"))
    met = found.where((F.col("w") == F.col("n")) & (F.col("x") == 0))
    sure = met.where(~F.col("phrases")).select("query_id", "id")
    maybe = met.where("phrases").select("query_id", "id").distinct()
    return sure.unionByName(_ranked(asked, maybe, index, stemmed).select("query_id", "id")).distinct()


def _ranked(asked: DataFrame, found: DataFrame, index: DataFrame, stemmed: bool | None) -> DataFrame:
    """(query_id, id, score) of those found that meet their query, by cover density. asked: query_id, query; found: distinct query_id, id."""

    @pandas_udf("array<string>")
    def all_terms(text: pd.Series) -> pd.Series:
        return text.map(lambda q: sorted({t for g in parse(q, stemmed) for _, phrase in g for t in phrase}))

    @pandas_udf("double")
    def rank(text: pd.Series, found: pd.Series) -> pd.Series:
        out, known = [], functools.cache(lambda q: parse(q, stemmed))
        for q, rows in zip(text, found, strict=True):
            where = {r["term"]: list(r["positions"]) for r in rows}
            out.append(max((cover_density(m, where) for m in matches(known(q), where)), default=None))
        return pd.Series(out, dtype="float64")

    wanted = asked.select("query_id", F.explode(all_terms("query")).alias("term"))
    index = index.select("term", "id", "positions").join(wanted.select("term").distinct(), "term", "left_semi")  # no other postings move
    held = found.join(wanted, "query_id").join(index, ["term", "id"])
    held = held.groupBy("query_id", "id").agg(F.sort_array(F.collect_list(F.struct("term", "positions"))).alias("found"))
    scored = held.join(asked, "query_id").select("query_id", "id", rank("query", "found").alias("score"))
    return scored.where(F.col("score").isNotNull() & ~F.isnan("score"))


def search(queries: DataFrame, index: DataFrame, k: int | None = 50, stemmed: bool = True) -> DataFrame:
    """(query_id, id, score, position) of documents that meet each web-style query, by cover density, then id.

    A query's score is that of its best alternative, so each distinct alternative of the batch
    is ranked once, and only its k best go on: what is not among them has k better ones in every
    query of that alternative. One word alone is ranked by how often it stands, without Python.
    """

    @pandas_udf("array<struct<alternative:string,term:string>>")
    def alternatives(text: pd.Series) -> pd.Series:
        def of(query: str) -> list[tuple]:
            rows = {}
            for group in parse(query, stemmed):
                alone = group[0][1][0] if len(group) == 1 and len(group[0][1]) == 1 else None
                # terms are joined by a space and never stemmed again
                rows[" ".join(("" if wanted else "-") + '"' + " ".join(phrase) + '"' for wanted, phrase in group)] = alone
            return list(rows.items())

        return text.map(of)

    parts = queries.select("query_id", F.explode(alternatives("text")).alias("a")).select("query_id", "a.*")
    distinct = parts.select("alternative", "term").distinct()
    rows = index.join(distinct.where("term IS NOT NULL"), "term").select("alternative", "id", (F.size("positions") * F.lit(COVER_WEIGHT)).alias("score"))
    long = distinct.where("term IS NULL").select(F.col("alternative").alias("query_id"), F.col("alternative").alias("text"))
    if not long.isEmpty():  # the words of a batch of single words are read once, not once more for phrases that are not there
        # alternatives hold terms, and are not analysed again
        scored = _ranked(long.withColumnRenamed("text", "query"), match(long, index, None), index, None)
        rows = rows.unionByName(scored.select(F.col("query_id").alias("alternative"), "id", "score"))
    if k is not None:
        best = Window.partitionBy("alternative").orderBy(F.desc("score"), "id")
        rows = rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")
    scores = parts.join(rows, "alternative").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = scores.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked if k is None else ranked.where(F.col("position") <= k)


def counts(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", stemmed: bool = True, only: DataFrame | None = None) -> DataFrame:
    """(term, id, tf): how often each document has each term; of the terms in only, if given."""
    rows = terms(docs, id_col, text_col, stemmed)
    rows = rows if only is None else rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "id").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def lengths(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, n_terms): how many words that are no stop words each document has."""
    return docs.select(F.col(id_col).alias("id"), F.size(F.filter(words(F.coalesce(F.col(text_col), F.lit(""))), lambda w: ~w.isin(*sorted(STOP)))).cast("long").alias("n_terms"))


def bm25(queries: DataFrame, index: DataFrame, sizes: DataFrame, k: int = 50, stemmed: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, position) by Okapi BM25 over any of a query's terms.

    index: postings, or counts of all a query's terms; sizes: (id, n_terms) of all documents.
    """
    stats = sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("avg_terms"))
    wanted = terms(queries, "query_id", "text", stemmed).select(F.col("id").alias("query_id"), "term").distinct()
    tf = index.select("term", "id", (F.size("positions") if "positions" in index.columns else F.col("tf")).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = wanted.join(df, "term").join(tf, "term").join(sizes, "id").join(F.broadcast(stats))  # one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("avg_terms")))
    scored = rows.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))
    ranked = scored.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("position") <= k)
