"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph cells.

Method. A text's paragraphs are its sentences: its lines, cut behind words that end in
``. ! ?``, and, so that text without such ends has paragraphs that an edit elsewhere leaves
alone, behind words whose hash is a multiple of ``CUT``. Each paragraph is hashed (XXH64; a
repeated one with the number of its
occurrence), and each hash goes into three cells of a table, which hold a count, the xor
of hashes and the xor of check values. The fingerprint is the table of ``BASE`` cells.
Two versions are compared by subtracting their tables, where common paragraphs cancel,
and peeling: a cell with one hash left gives that hash, which is taken out of its other
two cells, and so on. Where a table is too small for the difference, peeling stalls and
the pair is retried with tables ``GROW`` times as large, until it comes out whole. The digests on either side give
the likeness, common cells over all cells (Jaccard); two texts without cells have 1.

Everything for a pair is in one row's stream, vectorised over the texts of a batch, and
tables end with the batch.

Defined results: null texts count as empty; equal texts have equal fingerprints; ids are
numbers; see ``neighbours`` for ties and null ids; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.neighbours import with_next
from folioscope.llm.wordhash import hash_spans, mix, words_at

BASE, GROW, CUT = 48, 2, 64
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ENDS = np.zeros(256, bool)
ENDS[list(b".!?")] = True


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of each paragraph cell; digests are distinct in a text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = b"\n".join(raw) + b"\n"
    a = np.frombuffer(buf, np.uint8)
    gap = SPACE[a]
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U)
    end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    at = words_at(buf)
    line = np.searchsorted(np.flatnonzero(a == 10), start)
    cut = hash_spans(buf, start, end - start, at=at) % U(CUT) == 0
    cut |= ENDS[a[end - 1]]
    cut[:-1] |= line[1:] != line[:-1]
    cut[-1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    digest = hash_spans(buf, start[first], end[last] - start[first], at=at)
    of = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start[first], "right")
    order = np.lexsort((digest, of))
    d, o = digest[order], of[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (o[1:] != o[:-1])])
    nth = np.arange(len(d)) - np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    with np.errstate(over="ignore"):
        d = np.where(nth > 0, mix(d + nth.astype(U) * U(0x9E3779B97F4A7C15)), d)
    return o, d


def _places(key: np.ndarray, table: np.ndarray, m: int) -> list[np.ndarray]:
    """Three cells for each digest, one in each third of its table; other cells for another m."""
    third = U(m // 3)
    g = mix(key ^ U(m))
    base, low = table * m, U(0x1FFFFF)
    return [base + j * (m // 3) + ((((g >> U(21 * j)) & low) * third) >> U(21)).astype(np.int64) for j in range(3)]


def _check(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key ^ (key >> U(29))) * U(0xBF58476D1CE4E5B9)) >> U(32)


class Tables:
    """Sketches of several sets side by side, of m cells each."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m
        self.count, self.key, self.check = np.zeros(n * m, np.int64), np.zeros(n * m, U), np.zeros(n * m, U)

    def add(self, table: np.ndarray, key: np.ndarray, sign: int | np.ndarray = 1) -> None:
        check = _check(key)
        for p in _places(key, table, self.m):
            np.add.at(self.count, p, sign)
            np.bitwise_xor.at(self.key, p, key)
            np.bitwise_xor.at(self.check, p, check)

    def strings(self, sizes: np.ndarray) -> list[str]:
        raw = np.zeros((self.n * self.m,), [("n", "<i4"), ("k", "<u8"), ("c", "<u4")])
        raw["n"], raw["k"], raw["c"] = self.count, self.key, self.check
        raw = raw.reshape(self.n, self.m)
        return [f"{s}:{base64.b64encode(r.tobytes()).decode()}" for s, r in zip(sizes, raw, strict=True)]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(table, digest, sign) of what is left, and whether each table came out whole."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, pure = np.flatnonzero(np.abs(self.count) == 1), np.zeros(self.n * self.m, bool)
        while True:
            at = at[np.abs(self.count[at]) == 1]
            at = at[self.check[at] == _check(self.key[at])]
            if not len(at):
                break
            key, table = self.key[at], at // self.m
            places = _places(key, table, self.m)
            pure[at] = True
            one = at == np.where(pure[places[0]], places[0], np.where(pure[places[1]], places[1], places[2]))  # a digest that is alone in several of its cells is taken once
            pure[at] = False
            key, table, sign = key[one], table[one], self.count[at[one]]
            found.append((table, key, sign))
            check = _check(key)
            for p in places:
                p = p[one]
                np.add.at(self.count, p, -sign)
                np.bitwise_xor.at(self.key, p, key)
                np.bitwise_xor.at(self.check, p, check)
            if len(key) * 6 > len(pure):
                at = np.flatnonzero(np.abs(self.count) == 1)
            else:
                at = np.unique(np.concatenate([p[one] for p in places]))
        bad = ((self.count != 0) | (self.key != 0)).reshape(self.n, self.m).any(1)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), ~bad
        return (*(np.concatenate(x) for x in zip(*found, strict=True)), ~bad)


def differences(pairs: int, of_a: np.ndarray, a: np.ndarray, of_b: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of sets how many digests only a has, and only b, by subtracting and peeling."""
    only_a, only_b = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    todo, m = np.arange(pairs), BASE
    while len(todo):
        most = max(1, (1 << 20) // m)
        for lo in range(0, len(todo), most):  # a bounded number of cells at once
            some = todo[lo : lo + most]
            slot = np.full(pairs, -1)
            slot[some] = np.arange(len(some))
            t = Tables(len(some), m)
            for of, key, sign in ((of_a, a, 1), (of_b, b, -1)):
                on = slot[of] >= 0
                t.add(slot[of[on]], key[on], sign)
            table, _, sign, whole = t.peel()
            only_a[some] = np.bincount(table[sign > 0], minlength=len(some))
            only_b[some] = np.bincount(table[sign < 0], minlength=len(some))
            only_a[some[~whole]] = -1
        todo, m = todo[only_a[todo] < 0], m * GROW
    return only_a, only_b


def likeness(pairs: int, of_a: np.ndarray, a: np.ndarray, of_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common digests over all digests of each pair of sets."""
    only_a, only_b = differences(pairs, of_a, a, of_b, b)
    n = np.bincount(of_a, minlength=pairs)
    both = n - only_a
    total = both + only_a + only_b
    return np.where(total > 0, both / np.maximum(total, 1), 1.0)


def edited(text: str, other: str) -> str:
    """text with its last third replaced by as many first characters of other, or by all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its edited text, and their likeness to each other and to the next row's."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def step(ids: pa.Array, texts: list[str | None], following: list[str | None]) -> pa.RecordBatch:
        texts, following = [t or "" for t in texts], [t or "" for t in following]
        new, n = [edited(t, f) for t, f in zip(texts, following, strict=True)], len(texts)
        own, changed = cells(texts), cells(new)
        if following[:-1] == texts[1:]:  # one run of rows: all next texts but the last are in it
            last = cells(following[-1:])
            on = own[0] > 0
            after = np.concatenate([own[0][on] - 1, last[0] + n - 1]), np.concatenate([own[1][on], last[1]])
        else:
            after = cells(following)
        prints = []
        for of, key in (own, changed):
            t = Tables(n, BASE)
            t.add(of, key)
            prints.append(t.strings(np.bincount(of, minlength=n)))
        hashes = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]
        return pa.record_batch([ids.cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(hashes), pa.array(prints[0]), pa.array(prints[1]), pa.array(likeness(n, *own, *changed)), pa.array(likeness(n, *own, *after))], names=names)

    return with_next(docs, step, SCHEMA, id_col, text_col)
