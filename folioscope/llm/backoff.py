"""Language-model scores by Stupid Backoff, computed relationally.

Method (Brants et al., 2007), with n-grams of up to three words. The score of a word after
two others is count(three) / count(first two) if the three occur ``least_count`` times or
more in the corpus; else ``alpha`` times that after one: count(pair) / count(first word), if
the pair occurs as often; else ``alpha`` times the word's share of all words. A text's first
words have fewer words before them and begin at that order. A text's score is the mean
logarithm over its words.

Relations. Each word of a text is exploded with the word before and the word behind it (or
a mark). These rows are dealt by the middle word, so that a shard counts all n-grams that
begin or end with it: three words, both pairs, the word; and joins the counts to its rows.
A frequent middle word would load a shard: its rows are dealt by it and the word behind,
and those of a frequent pair by all three words. The counts of frequent words, pairs and
triples are known before: a row whose counts are all known is scored where it stands, and
isn't dealt, however many texts repeat it.
Two counts may then be another shard's: that of a pair whose second word is frequent, and
that of a rare word that is backed off to. Rows that need one go on, by the n-gram's hash,
to the shard of its table, where they are joined. Sums by document meet at the end.

Scale. The rows would be six times the input; they travel as compressed columns of sorted
numbers, a shard of a batch each. Shards have about ``shard_words`` words. With more than
``FAN`` of them rows are dealt in two steps, of about the square root of their number each,
so that columns stay long and the number of records in proportion to the input; what a
shard sends back to a document is one sum. The hundred thousand most frequent words of a
bounded sample have small codes; their exact counts over the whole corpus, and those of at most
``KNOWN`` frequent pairs and as many triples of them, tables of fixed size, are broadcast. Which
these are changes no result. Other words are known by 63
bits of their XXH64 hash: among a billion different words any two share one with a chance of
one in eighteen. Counts cover all documents.

A document is named by its task, batch and place, so docs must give the same rows in the same
order when a lost partition is computed again, as a scan of files does; store other plans
first.

Defined results: words are runs of non-space in ASCII lower case; a text without words has
n_words 0 and a null score; repeated rows are counted each and get equal scores, but for
rounding; a null id is kept as such; an empty table gives an empty table; other columns are
not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.shared import pieces, shuffles_freed, stored
from folioscope.llm.wordhash import Words, hash_spans, mix

ALPHA = 0.4
#: Codes below HOT are frequent words; then the marks before and behind a text; other words have bit 63 set.
HOT = 1 << 17
START, END = HOT, HOT + 1
U = np.uint64
RARE = U(1 << 63)
#: Frequent pairs and triples at most; how often a sample of so many texts must hold one.
KNOWN, SEEN, GRAM_DOCS = 1 << 16, 8, 2000
NONE = U(2**64 - 1)
#: Words of a shard, about; shards to which rows are dealt at once.
SHARD_WORDS, FAN = 500_000, 1024
#: Bits of a document's number that tell its place in the batch.
PLACE = 20
#: Kinds of records, with their columns.
ROWS, PAIRS, WORDS, ASK_PAIR, ASK_WORD, SUMS, HOME = range(7)
COLUMNS = {ROWS: 4, PAIRS: 3, WORDS: 2, ASK_PAIR: 3, ASK_WORD: 2, SUMS: 2}
RECORD = "kind int, shard long, blob binary"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as compressed byte planes: the first, which is ascending, of its steps, others of their distance from the least."""
    n, base, planes, widths = len(columns[0]), [], [], []
    for k, c in enumerate(columns):
        c = c.astype(U)
        base.append(int(c.min()) if n else 0)
        c = c - U(base[-1])
        if k == 0:
            c[1:] = c[1:] - c[:-1]
        widths.append(max(1, (int(c.max()).bit_length() + 7) // 8) if n else 1)
        planes.append(c.astype("<u8").view(np.uint8).reshape(n, 8).T[: widths[-1]])
    raw = np.ascontiguousarray(np.concatenate(planes)).tobytes()
    return np.array([n, len(raw), *widths, *base], "<u8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n, size, *rest = np.frombuffer(blob, "<u8", 2 + 2 * columns).tolist()
    raw = np.frombuffer(pa.decompress(blob[16 * (1 + columns) :], size, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for w, base in zip(rest[:columns], rest[columns:], strict=True):
        c = np.zeros((n, 8), np.uint8)
        c[:, :w] = raw[at : at + w * n].reshape(w, n).T
        c = c.reshape(-1).view("<u8").astype(U)
        out.append((c if out else np.cumsum(c, dtype=U)) + U(base))
        at += w * n
    return out


def columns_of(blobs: list[bytes], kind: int) -> list[np.ndarray]:
    """The columns of several records of one kind, one record after another."""
    parts = [unpack(b, COLUMNS[kind]) for b in blobs]
    return [np.concatenate([np.zeros(0, U), *(p[i] for p in parts)]) for i in range(COLUMNS[kind])]


def rows_of(n: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes before and behind each word, or marks. n: each text's words."""
    some = np.flatnonzero(n)
    last = np.cumsum(n)[some] - 1
    before, after = np.roll(codes, 1), np.roll(codes, -1)
    before[last - n[some] + 1], after[last] = START, END
    return before, after


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for each pair of frequent words; NONE for others."""
    return np.where((first < U(HOT)) & (second < U(HOT)), first * U(HOT) + second, NONE)


def triple_keys(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """A number for each triple of frequent words; NONE for others."""
    return np.where((first < U(HOT)) & (second < U(HOT)) & (third < U(HOT)), (first * U(HOT) + second) * U(HOT) + third, NONE)


class Known:
    """Sorted keys of n-grams, and where a row has one of them."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.maybe = np.zeros(1 << 20, bool)  # tells most others at once
        self.maybe[self._bits(self.keys)] = True

    @staticmethod
    def _bits(keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(44)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each row's key; -1 for other keys."""
        out = np.full(len(keys), -1)
        if len(self.keys):
            some = np.flatnonzero(self.maybe[self._bits(keys)])
            at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            hit = self.keys[at] == keys[some]
            out[some[hit]] = at[hit]
        return out


class Deal:
    """Which shard a record's rows go to, in one step or two. pairs: a broadcast Known, whose rows are dealt by all three words."""

    def __init__(self, shards: int, fan: int = FAN, pairs=None):
        self.shards, self.pairs = shards, pairs
        self.each = 1 if shards <= fan else math.ceil(math.sqrt(shards))  # final shards of a first step's

    def place(self, kind: int, columns: list[np.ndarray]) -> np.ndarray:
        """The final shard of each row: by a pair's words, a word, or the document's batch."""
        if kind == SUMS:
            h = mix(columns[0] >> U(PLACE))
        elif kind in (WORDS, ASK_WORD):
            h = mix(columns[0])
        else:
            h = np.where(columns[0] < RARE, mix(mix(columns[0]) ^ columns[1]), mix(columns[0]))
            if kind == ROWS and self.pairs is not None:
                on = np.flatnonzero(self.pairs.value.find(pair_keys(columns[0], columns[1])) >= 0)
                h[on] = mix(h[on] ^ columns[2][on])
        return (h % U(self.shards)).astype(np.int64)

    def records(self, kind: int, *columns: np.ndarray, last: bool = False) -> list[tuple[int, int, bytes]]:
        """Rows as records of the first step, or of the last one."""
        if not len(columns[0]):
            return []
        to = self.place(kind, list(columns)) // (1 if last else self.each)
        order = np.lexsort((*columns[1::-1], to))
        columns, to = [c[order] for c in columns], to[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        return [(kind, int(to[lo]), pack(*(c[lo:hi] for c in columns))) for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(to)], strict=True)]

    def settle(self, records: DataFrame, most_rows: int = 1 << 21) -> DataFrame:
        """Records of the first step as those of the last."""
        if self.each == 1:
            return records
        rows = records.repartition("shard", "kind").sortWithinPartitions("shard", "kind")

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at, size = [], None, 0
            for b in batches:
                for kind, shard, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if kind == HOME:  # stands in its last shard from the beginning
                        yield record_batch([(kind, shard, blob)])
                        continue
                    n = int(np.frombuffer(blob, "<u8", 1)[0])
                    if held and ((kind, shard) != at or size + n > most_rows):
                        yield record_batch(self.records(at[0], *columns_of(held, at[0]), last=True))
                        held, size = [], 0
                    held.append(blob)
                    at, size = (kind, shard), size + n
            if held:
                yield record_batch(self.records(at[0], *columns_of(held, at[0]), last=True))

        return rows.mapInArrow(again, RECORD)


def record_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["kind", "shard", "blob"])


def word_codes(texts: list[str | None], hot: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(each text's number of words, all words' codes). hot: the frequent words' sorted codes as rare ones, and their own."""
    w = Words(texts)
    h = hash_spans(w.buf, w.start, w.end - w.start) | RARE
    if hot is None or not len(hot[0]):
        return w.count, h
    at = np.minimum(np.searchsorted(hot[0], h), len(hot[0]) - 1)
    return w.count, np.where(hot[0][at] == h, hot[1][at], h)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, of sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spread(first: np.ndarray, n: int) -> np.ndarray:
    """For each row the size of its run."""
    size = np.diff(np.append(first, n))
    return np.repeat(size, size)


def frequent(texts: DataFrame, n_docs: int, sample_docs: int = 10_000) -> np.ndarray:
    """Codes, as rare ones, of the most frequent words of a sample, the most frequent first; which words these are changes no result."""
    draw = F.pmod(F.xxhash64(F.lit("frequent"), "text"), F.lit(1 << 20)) < F.lit(max(1, (1 << 20) * sample_docs // max(1, n_docs)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in pieces(batches, "text"):
            codes, n = np.unique(word_codes(b.column(0).to_pylist(), None)[1], return_counts=True)
            seen.update(dict(zip(codes.view(np.int64).tolist(), n.tolist(), strict=True)))
        yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["code", "n"])

    top = texts.where(draw).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(HOT).collect()
    return np.array([r[0] for r in top], np.int64).view(U)


def frequent_grams(texts: DataFrame, n_docs: int, hot: tuple[np.ndarray, np.ndarray], triples: bool, sample_docs: int = GRAM_DOCS, seen: int = SEEN, most: int = KNOWN) -> list[np.ndarray]:
    """Keys of the pairs and triples that a sample holds ``seen`` times or more, the most frequent ones; which these are changes no result."""
    draw = F.pmod(F.xxhash64(F.lit("frequent"), "text"), F.lit(1 << 20)) < F.lit(max(1, (1 << 20) * sample_docs // max(1, n_docs)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            n, codes = word_codes(b.column(0).to_pylist(), hot)
            before, after = rows_of(n, codes)
            for size, keys in ((2, pair_keys(codes, after)), (3, triple_keys(before, codes, after) if triples else np.zeros(0, U))):
                keys, times = np.unique(keys[keys != NONE], return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(keys), size, np.int32)), pa.array(keys.view(np.int64)), pa.array(times)], names=["size", "key", "n"])

    counts = texts.where(draw).mapInArrow(count, "size int, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)
    return [np.array([r[0] for r in counts.where(F.col("size") == size).orderBy(F.desc("n"), "key").limit(most).select("key").collect()], np.int64).view(U) for size in (2, 3)]


def score(docs: DataFrame, order: int = 3, least_count: int = 2, alpha: float = ALPHA, shard_words: int = SHARD_WORDS, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, score) of each row. order: 2 or 3 words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = rows.select("text")
    n_docs = texts.count()
    names = frequent(texts, n_docs)
    rank = np.argsort(names)
    hot = names[rank], rank.astype(U)
    pairs, triples = map(Known, frequent_grams(texts, n_docs, hot, order > 2))
    context = docs.sparkSession.sparkContext
    tables = context.broadcast((hot, pairs, triples))
    n_pairs, n_triples = len(pairs.keys), len(triples.keys)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, pairs, triples = tables.value
        n, total = np.zeros(HOT + n_pairs + n_triples, np.int64), 0  # words, then pairs, then triples
        for b in pieces(batches, "text", 1 << 20):
            sizes, codes = word_codes(b.column(0).to_pylist(), hot)
            n[:HOT] += np.bincount(codes[codes < U(HOT)].astype(np.int64), minlength=HOT)
            before, after = rows_of(sizes, codes)
            for known, start, keys in ((pairs, HOT, pair_keys(codes, after)), (triples, HOT + n_pairs, triple_keys(before, codes, after))):
                at = known.find(keys)
                n[start : start + len(known.keys)] += np.bincount(at[at >= 0], minlength=len(known.keys))
            total += len(codes)
        on = np.flatnonzero(n)
        yield pa.record_batch([pa.array(np.append(on, -1)), pa.array(np.append(n[on], total))], names=["code", "n"])

    counts = {r[0]: r[1] for r in texts.mapInArrow(tally, "code long, n long").groupBy("code").agg(F.sum("n")).collect()}
    total = counts.pop(-1, 0)
    known = np.zeros(HOT + n_pairs + n_triples, np.int64)
    known[list(counts)] = list(counts.values())
    enough = known >= least_count  # rarer ones are counted with the others, if a caller asks for so many
    known_pairs, known_triples = Known(pairs.keys[enough[HOT : HOT + n_pairs]]), Known(triples.keys[enough[HOT + n_pairs :]])
    logs = np.log(np.maximum(known, 1))
    deal = Deal(max(8, math.ceil(total / shard_words)), fan, context.broadcast(known_pairs))
    log_total, log_alpha = math.log(max(1, total)), math.log(alpha)
    shared = context.broadcast((hot, logs[:HOT], logs[HOT : HOT + n_pairs][enough[HOT : HOT + n_pairs]], known_triples, logs[HOT + n_pairs :][enough[HOT + n_pairs :]]))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, log_hot, log_pairs, triples, log_triples = shared.value
        pairs = deal.pairs.value
        task = TaskContext.get().partitionId()
        for number, b in enumerate(pieces(batches, "text", 6 << 20)):
            n, codes = word_codes(b.column(1).to_pylist(), hot)
            home = ((task << PLACE) + number) << PLACE
            doc = np.repeat(np.arange(len(n)), n).astype(U) + U(home)
            some = np.flatnonzero(n)
            first = np.cumsum(n)[some] - n[some]
            before, after = rows_of(n, codes)
            marks = np.full(len(some), START, U)
            # rows whose counts are known are scored here: triples after a known pair, and pairs that nothing, or nothing that counts, stands before
            pair = pairs.find(pair_keys(codes, after))
            triple = np.where(pair >= 0, triples.find(triple_keys(before, codes, after)), -1) if order > 2 else np.full(len(codes), -1)
            pair_before = np.full(len(codes), -1)
            on = np.flatnonzero(triple >= 0)
            pair_before[on] = pairs.find(pair_keys(before[on], codes[on]))
            term, done = np.zeros(len(codes)), pair_before >= 0
            term[done] = log_triples[triple[done]] - log_pairs[pair_before[done]]
            two = (pair >= 0) & ((before == U(START)) | (order == 2))
            term[two] = log_pairs[pair[two]] - log_hot[codes[two].astype(np.int64)]
            done |= two
            sums = np.bincount(np.repeat(np.arange(len(n)), n)[done], weights=term[done], minlength=len(n))
            left = ~done
            # middle, behind, before, document; and a row for each text's first word
            columns = [np.concatenate(x) for x in ((codes[left], marks), (after[left], codes[first]), (before[left], marks), (doc[left], doc[first]))]
            ids = pa.record_batch([b.column(0), pa.array(n), pa.array(sums)], names=["id", "n", "sum"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as out:
                out.write_batch(ids)
            at = int(deal.place(SUMS, [np.array([home], U)])[0])
            yield record_batch([*deal.records(ROWS, *columns), (HOME, at, np.array([home], "<u8").tobytes() + sink.getvalue().to_pybytes())])

    def count_rows(key, group: pd.DataFrame) -> pd.DataFrame:
        _, log_hot, log_pairs, _, _ = shared.value
        pairs = deal.pairs.value
        homes = group[group["kind"] == HOME]  # these only pass through, to the shard that their documents' sums go to
        columns = columns_of(list(group.loc[group["kind"] == ROWS, "blob"]), ROWS)
        sort = np.lexsort((columns[2], columns[1], columns[0]))
        mid, after, before, doc = (c[sort] for c in columns)
        del columns, sort
        n, rare = len(mid), mid >= RARE
        one, two, three = _runs(mid), _runs(mid, after), _runs(mid, after, before)
        count_one, count_two, count_three = _spread(one, n), _spread(two, n), _spread(three, n)
        scored, opening = after != U(END), mid == U(START)
        in_table = pairs.find(pair_keys(mid, after))
        log_two = np.log(count_two)
        log_two[in_table >= 0] = log_pairs[in_table[in_table >= 0]]
        count_two = np.where(in_table >= 0, least_count, count_two)  # occurs as often at least; how often is known
        most = np.where(opening, 1, np.where(before == U(START), 2, order))
        tri = scored & (most == 3) & (count_three >= least_count)
        bi = scored & (most >= 2) & ~tri & (count_two >= least_count)
        uni = scored & ~tri & ~bi
        term = np.zeros(n)
        term[tri] = np.log(count_three[tri])
        both = tri & rare  # here the pair before is counted, too
        if both.any():
            sort = np.flatnonzero(rare)
            sort = sort[np.lexsort((before[sort], mid[sort]))]
            pair = np.zeros(n, np.int64)
            pair[sort] = _spread(_runs(mid[sort], before[sort]), len(sort))
            term[both] -= np.log(pair[both])
        log_mid = np.log(count_one)
        log_mid[mid < U(HOT)] = log_hot[mid[mid < U(HOT)].astype(np.int64)]
        term[bi] = (most[bi] - 2) * log_alpha + log_two[bi] - log_mid[bi]
        term[uni] = (most[uni] - 1) * log_alpha - log_total
        easy = uni & (after < U(HOT))
        term[easy] += log_hot[after[easy].astype(np.int64)]
        ask = np.flatnonzero(tri & ~rare)
        known = pairs.find(pair_keys(before[ask], mid[ask]))
        term[ask[known >= 0]] -= log_pairs[known[known >= 0]]
        ask = ask[known < 0]
        docs_here, at = np.unique(doc, return_inverse=True)
        out = deal.records(SUMS, docs_here, np.bincount(at, weights=term, minlength=len(docs_here)).astype("<f4").view("<u4"))
        out += deal.records(ASK_PAIR, before[ask], mid[ask], doc[ask])
        ask = uni & (after >= RARE)
        out += deal.records(ASK_WORD, after[ask], doc[ask])
        table = two[(after[two] < U(HOT)) & (mid[two] != U(START)) & (count_two[two] >= least_count) & (in_table[two] < 0)]
        if order > 2:
            out += deal.records(PAIRS, mid[table], after[table], count_two[table])
        table = one[rare[one]]
        out += deal.records(WORDS, mid[table], count_one[table])
        return pd.concat([homes, pd.DataFrame(out, columns=["kind", "shard", "blob"])])

    def join_counts(key, group: pd.DataFrame) -> pd.DataFrame:
        of = lambda kind: columns_of(list(group.loc[group["kind"] == kind, "blob"]), kind)
        first, second, count = of(PAIRS)
        a, b, doc = of(ASK_PAIR)
        docs_here, terms = [doc], []
        names = np.unique(first)  # a pair is its first word's number and its second word's code
        pair = np.searchsorted(names, first).astype(U) * U(2 * HOT) + second
        sort = np.argsort(pair)
        terms.append(-np.log(count[sort][np.searchsorted(pair[sort], np.searchsorted(names, a).astype(U) * U(2 * HOT) + b)].astype(np.float64)) if len(a) else np.zeros(0))
        word, count = of(WORDS)
        w, doc = of(ASK_WORD)
        sort = np.argsort(word)
        docs_here.append(doc)
        terms.append(np.log(count[sort][np.searchsorted(word[sort], w)].astype(np.float64)) if len(w) else np.zeros(0))
        docs_here, at = np.unique(np.concatenate(docs_here), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate(terms), minlength=len(docs_here))
        return pd.DataFrame(deal.records(SUMS, docs_here, sums.astype("<f4").view("<u4")), columns=["kind", "shard", "blob"])

    def total_up(batches: pd.DataFrame) -> pd.DataFrame:
        doc, sums = columns_of(sorted(batches.loc[batches["kind"] == SUMS, "blob"]), SUMS)  # one order, so that reruns add alike
        sums = sums.astype("<u4").view("<f4").astype(np.float64)
        out = []
        for blob in batches.loc[batches["kind"] == HOME, "blob"]:
            home = int(np.frombuffer(blob, "<u8", 1)[0])
            ids = pa.ipc.open_stream(pa.py_buffer(blob[8:])).read_all().to_pandas(integer_object_nulls=True)
            mine = (doc >> U(PLACE)) == U(home >> PLACE)
            whole = np.bincount((doc[mine] - U(home)).astype(np.int64), weights=sums[mine], minlength=len(ids)) + ids["sum"].to_numpy()
            out.append(pd.DataFrame({"id": ids["id"], "n_words": ids["n"], "score": [s / k if k else None for s, k in zip(whole.tolist(), ids["n"].tolist(), strict=True)]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n_words": [], "score": []})

    counted = stored(deal.settle(rows.mapInArrow(explode, RECORD)).groupBy("shard").applyInPandas(count_rows, RECORD))
    shuffles_freed(docs.sparkSession)  # the rows are by far the largest shuffle, and over
    asked = deal.settle(counted.where(~F.col("kind").isin(SUMS, HOME))).groupBy("shard").applyInPandas(join_counts, RECORD)
    sums = deal.settle(counted.where(F.col("kind").isin(SUMS, HOME)).unionByName(asked))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())])
    return sums.groupBy("shard").applyInPandas(total_up, schema).withColumnRenamed("id", id_col)
