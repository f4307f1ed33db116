"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Method. Texts are their lower-case runs of letters and digits. Seeds of a test item are the
triples of its words that stand together, or with one word left out between them; those of
a document are made alike. So a changed, a dropped or an added word in every three still
leaves seeds on both sides, and a passage without any is none that the threshold would call
a copy, but by chance. All seeds count, however many documents hold them: of an edited copy
only a few are left, and in a widely copied item these are the frequent ones. Each place of a
seed in a document proposes a passage around the place where the item would start;
overlapping proposals are one passage. A passage that holds too few of the item's words, in
whatever order, to reach the threshold goes; any other is aligned with the item by
Smith-Waterman (match 2, mismatch -1, gap -1), which finds exact, edited and paraphrased
copies alike; a score is a share of what an exact copy gets. A document is contaminated if an item's score reaches
``threshold`` and its alignment is worth ``least_words`` (8) equal words, or all words of a
shorter item: so an item of under 16 words needs a larger share than the threshold, one of 10 words
0.8, since a few common words in a row are no copy. An item of one or two words, which stands in any text, is held against whole
documents: one that has just these words is contaminated.

Scale. The pass is narrow and aligns within the row: no text is shuffled and there are
no pair tables. Seeds and items go to the executors in parts of at most ``part_words``
words, the proven bound of each broadcast; more items mean more passes. Alignments grow
with the places where seeds of items stand by chance.

Defined results: null and empty documents, and those without a passage to align, are clean
with score 0; items without
text are not searched; items whose id is null or no number are searched, and named null; ties
between items go to the least item id, null last; rows repeat as they are; an empty item table leaves all documents clean. All
columns are kept; those named like results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.shared import pieces, stored
from folioscope.llm.wordhash import Words, hash_spans, mix

SEED = 3
LEAST_WORDS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
RUNS = re.compile(r"[^\W_]+")
RESULTS = [T.StructField("contaminated", T.BooleanType()), T.StructField("item_id", T.LongType()), T.StructField("item_score", T.DoubleType()), T.StructField("word_from", T.IntegerType()), T.StructField("word_to", T.IntegerType())]


#: Offsets of a seed's second and third word.
PATTERNS = ((1, 2), (2, 3), (1, 3))


def read_words(texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, each word's hash, and the text number of each word."""
    w = Words([" ".join(RUNS.findall((t or "").lower())) for t in texts], lower=False)
    return w, hash_spans(w.buf, w.start, w.end - w.start), np.repeat(np.arange(len(w.count)), w.count)


def seeds(word: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the first word, hash of the triple) of each seed, pattern by pattern."""
    one, two = mix(word), mix(word ^ np.uint64(SEED))
    for second, third in PATTERNS:
        n = len(word) - third
        if n > 0:
            at = np.flatnonzero(of[:n] == of[third:])
            yield at, mix(one[at] ^ mix(two[at + second] ^ mix(word[at + third])))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman's best score of each item with its passage, and the passage's word at which it ends."""
    best, at = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    order = np.lexsort(([len(p) for p in passages], [len(i) for i in items])) if items else []
    lo = 0
    while lo < len(order):
        hi, cells = lo, 0
        while hi < len(order) and (hi == lo or cells < 1 << 18):
            cells += len(passages[order[hi]]) + 1
            hi += 1
        some = order[lo:hi]
        lo = hi
        m, w = max(len(items[i]) for i in some), max(len(passages[i]) for i in some)
        a, b = np.zeros((len(some), m), np.uint64), np.zeros((len(some), w), np.uint64)
        real_a, real_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
        for k, i in enumerate(some):
            a[k, : len(items[i])], b[k, : len(passages[i])] = items[i], passages[i]
            real_a[k, : len(items[i])], real_b[k, : len(passages[i])] = True, True
        h, place = np.zeros((len(some), w + 1), np.int32), np.arange(w + 1, dtype=np.int32) * -GAP
        top, end = np.zeros(len(some), np.int32), np.zeros(len(some), np.int64)
        for r in range(m):
            same = (b == a[:, r : r + 1]) & real_b & real_a[:, r : r + 1]
            x = np.zeros_like(h)
            x[:, 1:] = np.maximum(h[:, :-1] + np.where(same, MATCH, MISMATCH), 0)
            x = np.maximum(x, h + GAP)
            h = np.maximum.accumulate(x + place, axis=1) - place  # gaps along the passage
            col = h.argmax(1)
            now = h[np.arange(len(some)), col]
            more = now > top
            top[more], end[more] = now[more], col[more]
        best[some], at[some] = top, end
    return best, at


class Items:
    """Items of one part: words, seeds sorted by hash, where each seed stands in which item, and the items too short for seeds."""

    def __init__(self, ids: list[int], words: list[np.ndarray], seed: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.argsort(seed, kind="stable")
        self.ids, self.words = ids, words
        self.size = np.array([len(x) for x in words], np.int64)
        self.seed, self.first = np.unique(seed[order], return_index=True)
        self.last = np.append(self.first[1:], len(seed))
        self.item, self.place = item[order], place[order]
        self.bits = max(16, int(len(seed)).bit_length() + 4)  # a table that tells most other hashes at once
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.seed >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.vocabulary = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
        self.numbers = [np.searchsorted(self.vocabulary, x) for x in words]
        self.flat, self.begin = np.concatenate([*self.numbers, np.zeros(0, np.int64)]).astype(np.int64), np.cumsum(self.size) - self.size
        self.whole: dict[bytes, int] = {}
        for i, x in enumerate(words):
            if len(x) < SEED:
                self.whole.setdefault(x.tobytes(), i)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in hashes, number of the seed) of those that are seeds."""
        if not len(self.seed) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.seed, hashes[some]), len(self.seed) - 1)
        hit = self.seed[at] == hashes[some]
        return some[hit], at[hit]


def able(items: Items, word: np.ndarray, w: Words, todo: list[tuple[int, int, int, int]], threshold: float) -> list[tuple[int, int, int, int]]:
    """The passages that hold so many of their item's words that the score can reach the threshold."""
    if not todo:
        return todo
    number = np.minimum(np.searchsorted(items.vocabulary, word), len(items.vocabulary) - 1)
    number[items.vocabulary[number] != word] = len(items.vocabulary)
    there, out = np.zeros(len(items.vocabulary) + 1, bool), []
    for x in todo:
        t, i, lo, hi = x
        here = number[w.first[t] + lo : w.first[t] + hi]
        there[here] = True
        there[-1] = False
        if np.count_nonzero(there[items.numbers[i]]) >= threshold * len(items.numbers[i]) - 1e-9:
            out.append(x)
        there[here] = False
    return out


def _parts(items: DataFrame, id_col: str, text_col: str, part_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of bounded size, streamed to the driver one part at a time."""
    part, size = [], 0
    for r in items.select(F.col(id_col).try_cast("long").alias(id_col), text_col).distinct().orderBy(id_col, text_col).toLocalIterator():
        n = len(RUNS.findall((r[1] or "").lower()))
        if n:
            if part and size + n > part_words:
                yield part
                part, size = [], 0
            part.append((r[0], r[1]))
            size += n
    if part:
        yield part


def _of_part(part: list[tuple[int, str]]) -> Items:
    w, word, of = read_words([t for _, t in part])
    at, hashes = (np.concatenate(x) for x in zip(*seeds(word, of), strict=True)) if len(word) > SEED - 1 else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Items([i for i, _ in part], [word[f : f + n] for f, n in zip(w.first, w.count, strict=True)], hashes, of[at], at - w.first[of[at]])


def _entries(items: Items, seed: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(hits, number of the hit among them, entry): where the seeds of some hits stand in items, about most entries at a time."""
    n = items.last[seed] - items.first[seed]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(seed):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        k = n[lo:hi]
        yield slice(lo, hi), np.repeat(np.arange(len(k)), k), np.repeat(items.first[seed[lo:hi]] - np.cumsum(k) + k, k) + np.arange(k.sum())
        lo = hi


def hopeful(items: Items, word: np.ndarray, of: np.ndarray, w: Words, text: np.ndarray, seed: np.ndarray, threshold: float) -> np.ndarray:
    """Keys (text times items plus item, sorted) of the texts and items that share a seed where the whole text holds so many of the item's words that its score can reach the threshold.

    A phrase of many items proposes each of them wherever it stands; most go here, before a place is looked at.
    """
    m = len(items.ids)
    pairs = np.unique(text * len(items.seed) + seed)
    text, seed = pairs // len(items.seed), pairs % len(items.seed)
    keys = [np.unique(text[some][k] * m + items.item[entry]) for some, k, entry in _entries(items, seed)]
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    number = np.minimum(np.searchsorted(items.vocabulary, word), len(items.vocabulary) - 1)
    number[items.vocabulary[number] != word] = len(items.vocabulary)
    there, kept = np.zeros(len(items.vocabulary) + 1, bool), []
    for t in np.unique(keys // m):
        here = number[w.first[t] : w.first[t] + w.count[t]]
        there[here] = True
        there[-1] = False
        mine = keys[np.searchsorted(keys, t * m) : np.searchsorted(keys, (t + 1) * m)]
        for part in np.split(mine, np.arange(4096, len(mine), 4096)):
            i = part - t * m
            size = items.size[i]
            at = np.cumsum(size) - size
            flat = items.flat[np.repeat(items.begin[i] - at, size) + np.arange(size.sum())]
            kept.append(part[np.add.reduceat(there[flat], at) >= threshold * size - 1e-9])
        there[here] = False
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def passages(items: Items, word: np.ndarray, of: np.ndarray, w: Words, threshold: float) -> list[tuple[int, int, int, int]]:
    """(text, item, from, to): stretches of a text's words that seeds propose for an item."""
    found = [(at[hit], seed) for at, hashes in seeds(word, of) for hit, seed in [items.find(hashes)]]
    hit, seed = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(hit):
        return []
    keys, m = hopeful(items, word, of, w, of[hit].astype(np.int64), seed, threshold), len(items.ids)
    if not len(keys):
        return []
    some = []
    for part, k, entry in _entries(items, seed):
        row = hit[part][k]
        key = of[row].astype(np.int64) * m + items.item[entry]
        on = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
        some.append((items.item[entry[on]], of[row[on]], row[on] - w.first[of[row[on]]] - items.place[entry[on]]))
    item, text, begin = (np.concatenate(x) for x in zip(*some, strict=True))  # begin: where the item would start
    order = np.lexsort((begin, item, text))
    item, text, begin = item[order], text[order], begin[order]
    size = items.size[item]
    # proposals of one item in one text that are near each other are one passage, up to a bounded length
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[1:] // 2)
    run = np.flatnonzero(new)
    block = (begin - np.repeat(begin[run], np.diff(np.append(run, len(order))))) // (2 * size + 1)
    new[1:] |= block[1:] != block[:-1]
    run = np.flatnonzero(new)
    last = np.append(run[1:], len(order)) - 1
    half = size[run] // 2 + 1
    lo, hi = np.maximum(0, begin[run] - half), np.minimum(w.count[text[run]], begin[last] + 3 * half)
    return list(zip(text[run].tolist(), item[run].tolist(), lo.tolist(), hi.tolist(), strict=True))


def _before(a: int | None, b: int | None) -> bool:
    """Whether an id comes before another; none comes last."""
    return a is not None and (b is None or a < b)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.5, least_words: int = LEAST_WORDS, part_words: int = 2_000_000, id_col: str = "item_id", item_text: str = "text", text_col: str = "text") -> DataFrame:
    """docs with contaminated, the best item_id, item_score and the words (word_from to before word_to) of the passage."""
    names = [f.name for f in RESULTS]
    plain = docs.drop(*names)
    out = plain.withColumns({"contaminated": F.lit(False), "item_id": F.lit(None).cast("long"), "item_score": F.lit(0.0), "word_from": F.lit(None).cast("int"), "word_to": F.lit(None).cast("int")})
    context = docs.sparkSession.sparkContext
    columns = plain.columns
    at, width = columns.index(text_col), len(columns)
    schema = T.StructType([*plain.schema.fields, *RESULTS])
    last_part = None  # of many parts two are held at once, at most
    for part in _parts(items, id_col, item_text, part_words):
        shared = context.broadcast(_of_part(part))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in pieces(batches, text_col, 1 << 20):
                w, word, of = read_words(b.column(at).to_pylist())
                todo = able(items, word, w, passages(items, word, of, w, threshold), threshold)
                if items.whole:
                    short = [(t, word[w.first[t] : w.first[t] + w.count[t]].tobytes()) for t in np.flatnonzero((w.count > 0) & (w.count < SEED)).tolist()]
                    todo += [(t, items.whole[x], 0, len(x) // 8) for t, x in short if x in items.whole]
                score, end = align([items.words[i] for _, i, _, _ in todo], [word[w.first[t] + lo : w.first[t] + hi] for t, _, lo, hi in todo])
                flag, item, value, begin, stop = (b.column(width + k).to_pylist() for k in range(5))
                for (t, i, lo, _), s, e in zip(todo, score.tolist(), end.tolist(), strict=True):
                    m = len(items.words[i])
                    share = s / (MATCH * m)
                    if share > value[t] or share == value[t] > 0 and _before(items.ids[i], item[t]):
                        value[t], item[t], begin[t], stop[t] = share, items.ids[i], max(lo, lo + e - m), lo + e
                    flag[t] = flag[t] or share >= threshold and s >= MATCH * min(m, least_words)
                yield pa.record_batch([*b.columns[:width], pa.array(flag, pa.bool_()), pa.array(item, pa.int64()), pa.array(value, pa.float64()), pa.array(begin, pa.int32()), pa.array(stop, pa.int32())], names=[*columns, *names])

        out = out.mapInArrow(search, schema)
        if last_part is not None:
            out = stored(out)
            last_part.destroy()
        last_part = shared
    return out
