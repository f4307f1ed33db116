"""XXH64 over many byte spans of one buffer at once (numpy), and word spans of texts.

The hash is the published XXH64; ``hash_spans`` equals ``xxhash.xxh64_intdigest`` for each span.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
# XXH64's five primes, as published.
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Spans above this many bytes are hashed one by one.
LONG = 512


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def words_at(buf: bytes) -> np.ndarray:
    """The little-endian 64-bit number that starts at each byte of buf (zero bytes follow its end)."""
    n = len(buf) + 1
    rows = (n + 7) // 8
    padded = buf + bytes(rows * 8 + 16 - len(buf))
    out = np.empty((rows, 8), U)
    for shift in range(8):
        out[:, shift] = np.frombuffer(padded, "<u8", rows, shift)
    return out.reshape(-1)


def hash_spans(buf: bytes, start: np.ndarray, length: np.ndarray, seed: int = 42, at: np.ndarray | None = None) -> np.ndarray:
    """XXH64 of buf[start:start+length] for each span."""
    at = words_at(buf) if at is None else at
    start, length = start.astype(np.int64), length.astype(np.int64)
    seed64 = U(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), seed64 + P5, U)
        pos = start.copy()
        big = np.flatnonzero((length >= 32) & (length <= LONG))
        if len(big):
            lanes = [np.full(len(big), v, U) for v in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            stripes, p = length[big] // 32, start[big]
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                q = p[on] + 32 * k
                for i in range(4):
                    lanes[i][on] = _round(lanes[i][on], at[q + 8 * i])
            x = _rot(lanes[0], 1) + _rot(lanes[1], 7) + _rot(lanes[2], 12) + _rot(lanes[3], 18)
            for lane in lanes:
                x = (x ^ _round(np.zeros_like(lane), lane)) * P1 + P4
            h[big] = x
            pos[big] += 32 * stripes
        h += length.astype(U)
        rest = length - (pos - start)
        rest[length > LONG] = 0
        for _ in range(3):
            on = np.flatnonzero(rest >= 8)
            if not len(on):
                break
            h[on] = _rot(h[on] ^ _round(np.zeros(len(on), U), at[pos[on]]), 27) * P1 + P4
            pos[on] += 8
            rest[on] -= 8
        on = np.flatnonzero(rest >= 4)
        if len(on):
            h[on] = _rot(h[on] ^ ((at[pos[on]] & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
            pos[on] += 4
            rest[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(rest >= 1)
            if not len(on):
                break
            h[on] = _rot(h[on] ^ ((at[pos[on]] & U(0xFF)) * P5), 11) * P1
            pos[on] += 1
            rest[on] -= 1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
    for i in np.flatnonzero(length > LONG):
        h[i] = xxhash.xxh64_intdigest(buf[start[i] : start[i] + length[i]], seed)
    return h


def mix(x: np.ndarray) -> np.ndarray:
    """A second, independent-looking 64-bit number for each (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Words:
    """Words of several texts in one buffer: texts' words joined by single spaces, ASCII lower case.

    start, end: of each word in buf. first, count: of each text's words.
    """

    def __init__(self, texts: list[str | None], lower: bool = True):
        norm = []
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            norm.append(b" ".join((raw.lower() if lower else raw).split()))
        self.count = np.array([x.count(b" ") + 1 if x else 0 for x in norm], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)
        self.buf = b" ".join(x for x in norm if x)
        gaps = np.flatnonzero(np.frombuffer(self.buf, np.uint8) == 32) if self.buf else np.zeros(0, np.int64)
        self.start = np.concatenate([[0], gaps + 1]).astype(np.int64) if self.buf else np.zeros(0, np.int64)
        self.end = np.concatenate([gaps, [len(self.buf)]]).astype(np.int64) if self.buf else np.zeros(0, np.int64)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of each run of k words; a text with fewer, but some, words has its whole sequence."""
        n = np.where(self.count >= k, self.count - k + 1, (self.count > 0).astype(np.int64))
        of = np.repeat(np.arange(len(n)), n)
        first = np.repeat(self.first, n) + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
        last = first + np.minimum(k, self.count[of]) - 1
        start = self.start[first]
        return of, hash_spans(self.buf, start, self.end[last] - start)
