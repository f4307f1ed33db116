"""Token ids of a corpus as files: one concatenated id array with Elias-Fano boundaries.

Format. A token file set is a folder of Parquet files whose rows are shards of about
``SHARD_TOKENS`` ids, in ascending (id_range, part) order. A shard row holds
``ids`` (its documents' ids, end ids included, as 2-byte little-endian numbers, or 4-byte
ones where an id needs it; ``id_bytes`` says which), ``doc_ids`` (8-byte numbers), and
``ends``: the documents' end offsets in ``ids`` as an Elias-Fano sequence. Of each offset
the low bits are packed, the high bits are a unary bit vector, and a select directory holds
the place of every ``SELECT_EVERY``-th one bit; ``EliasFano.get(i)`` returns an offset
without decoding the rest, in 2 + log2(ids / documents) bits a document, about.

Parquet carries the binary payload because Spark's writers reach any shared store that the
cluster names, commit whole files, and drop what a lost executor left half written.

Encoding. Whole texts go through the tokenizers library. No token of the vocabulary file
spans white space, so a text's ids are those of its runs of non-space one after another,
and each worker keeps the ids of runs it has met, from task to task, up to ``CACHE_RUNS``;
then it forgets those met once. The text is shuffled
once, by ranges of the document id.

Defined results: ids are whole numbers; a null text is an empty one and holds just the end
id; rows with the same id are in the order of the hash of their text, then of their text;
rows with a null id come first, as id ``NO_ID``, and come back with a null id; an empty table makes no shard; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.neighbours import id_ranges, text_hash
from folioscope.llm.shared import pieces

END_ID = 2
SHARD_TOKENS = 1 << 20
SELECT_EVERY = 64
#: Runs of non-space that a worker knows at most, about 40 bytes each.
CACHE_RUNS = 800_000
NO_ID = -(1 << 63)
#: What the vocabulary writes behind a token that ends a piece.
WORD_END = "</w>"
#: Letters that stay one letter in lower case and composed form; runs of them are one piece to the tokenizer's split.
LETTER = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: Signs that the tokenizer's split always parts from such a letter before them.
SIGNS = ".,;:!?%$&#*|"


class EliasFano:
    """A non-descending sequence of whole numbers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, places: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        low_bits = max(0, int(v[-1] // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        ones = (v >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits.reshape(-1), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SELECT_EVERY].astype("<u4"))

    def get(self, i: int) -> int:
        """The i-th number: select on the high bits, and the i-th group of low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.places[i // SELECT_EVERY]), i % SELECT_EVERY
        byte, bit = place // 8, place % 8
        word = self.high[byte] >> bit
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte, bit = byte + 1, 0
            word = self.high[byte]
        while left:
            word &= word - 1
            left -= 1
        place = byte * 8 + bit + ((word & -word).bit_length() - 1)
        at = i * self.low_bits
        group = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8], "little") >> (at % 8)
        return ((place - i) << self.low_bits) | (group & ((1 << self.low_bits) - 1))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return ((ones - np.arange(self.n)) << self.low_bits) | (bits << np.arange(self.low_bits)).sum(1)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8").tobytes()
        return head + self.low + self.high + self.places.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, a, b = np.frombuffer(raw, "<u8", 4).tolist()
        return cls(n, low_bits, raw[32 : 32 + a], raw[32 + a : 32 + a + b], np.frombuffer(raw, "<u4", offset=32 + a + b))


def _tails(runs: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows its head in each run."""
    size = [pc.binary_length(x.cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64) for x in (runs, heads)]
    rest = size[0] - size[1]
    end = np.cumsum(rest)
    raw = np.frombuffer(b"".join(runs.cast(pa.binary()).to_pylist()), np.uint8) if rest.any() else np.zeros(0, np.uint8)
    at = np.repeat(np.cumsum(size[0]) - end, rest) + np.arange(end[-1] if len(end) else 0)
    return pa.StringArray.from_buffers(len(runs), pa.py_buffer(np.concatenate([[0], end]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[at])))


class Encoder:
    """Ids of texts by a tokenizer file of the tokenizers library.

    Runs of non-space are told apart and looked up by Arrow's kernels. A run of plain letters
    has the ids of the word in lower case; one with signs behind, that word's ids and the
    signs'. So the encoder knows words, in lower case, and the few runs of other kinds.
    """

    def __init__(self, path: str, cache_runs: int = CACHE_RUNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_runs = Tokenizer.from_file(path), cache_runs
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self._keep(np.zeros(0, np.int64))

    def _keep(self, some: np.ndarray) -> None:
        """Forget all runs but some, and the empty one, which is number 0."""
        ids, self.length = self._get(some) if len(some) else (np.zeros(0, self.kind), np.zeros(1, np.int64))
        self.known = self.known.take(pa.array(some)) if len(some) else pa.array([""], pa.string())
        self.start, self.flat, self.used = np.cumsum(self.length) - self.length, np.zeros(max(1 << 16, 2 * len(ids)), self.kind), len(ids)
        self.flat[: len(ids)] = ids
        self.uses = np.zeros(len(self.known), np.int32)

    def _forget(self) -> None:
        """Keep the runs that more than one batch had since the last time, half of the room at most, and not the others."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) * 2 > self.cache_runs:
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.cache_runs // 2])
        self._keep(np.union1d([0], keep))

    def _add(self, runs: pa.Array, length: np.ndarray, ids: np.ndarray) -> None:
        """Know the ids of runs, one run's after another's."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.uses = np.concatenate([self.uses, np.zeros(len(runs), np.int32)])
        self.known = pa.concat_arrays([self.known, runs])
        self.used += len(ids)

    def _get(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the numbered runs."""
        return _gather(self.flat, self.start[number], self.length[number]), self.length[number]

    def _add_words(self, words: pa.Array) -> None:
        """Learn words of plain letters. Each is one piece to the tokenizer, whose last token is a word end."""
        for lo in range(0, len(words), 20_000):
            some = words.slice(lo, 20_000)
            ids = np.array(self.tokenizer.encode(" ".join(some.to_pylist()), add_special_tokens=False).ids, self.kind)
            self._add(some, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1), ids)

    def _add_others(self, runs: pa.Array) -> None:
        """Learn any runs, one by one."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(runs.to_pylist(), add_special_tokens=False)]
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        self._add(runs, length, np.fromiter(itertools.chain.from_iterable(lists), self.kind, int(length.sum())))

    def _numbers(self, runs: pa.Array) -> np.ndarray:
        """The numbers of distinct runs, which are learnt if new."""
        number = pc.fill_null(pc.index_in(runs, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = number < 0
        plain = np.zeros(len(runs), bool)
        plain[new] = pc.match_substring_regex(runs.filter(pa.array(new)), f"^[{LETTER}]+$").to_numpy(zero_copy_only=False)
        for some, add in ((plain, self._add_words), (new & ~plain, self._add_others)):
            number[some] = len(self.known) + np.arange(some.sum())
            add(runs.filter(pa.array(some)))
        self.uses[number] += 1
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all texts' ids one after another, each text's number of ids). A null text has none."""
        if len(self.known) > self.cache_runs:
            self._forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        cut = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        runs = words.dictionary
        head = pc.utf8_rtrim(runs, SIGNS)
        plain = pc.match_substring_regex(head, f"^[{LETTER}]+$")
        head = pc.if_else(plain, head, runs)
        tails = _tails(runs, head).dictionary_encode()
        heads = pc.if_else(plain, pc.utf8_lower(head), head).dictionary_encode()
        first = self._numbers(heads.dictionary)[heads.indices.to_numpy()]
        second = self._numbers(tails.dictionary)[tails.indices.to_numpy()]
        ids, length = self._get(np.stack([first, second], 1).reshape(-1))
        length = length.reshape(-1, 2).sum(1)
        of = words.indices.to_numpy()
        after = np.concatenate([[0], np.cumsum(length[of])])
        return _gather(ids, (np.cumsum(length) - length)[of], length[of]), np.diff(after[cut - cut[0]])


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of flat, one after another."""
    after = np.cumsum(length)
    return flat[np.repeat(start - after + length, length) + np.arange(after[-1] if len(after) else 0)]


#: A worker's encoder: the next task of the same worker finds the runs that are known.
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_runs: int = CACHE_RUNS) -> Encoder:
    if (path, cache_runs) not in _ENCODERS:
        _ENCODERS.clear()  # one at a time
        _ENCODERS[path, cache_runs] = Encoder(path, cache_runs)
    return _ENCODERS[path, cache_runs]


SHARDS = "id_range long, part int, n_docs long, n_tokens long, id_bytes int, ids binary, doc_ids binary, ends binary"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs' ids to folder, which must be new. tokenizer: path of a tokenizers file, readable on each executor."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    where = id_ranges(docs, "id")
    if where is None:
        docs.sparkSession.createDataFrame([], SHARDS).write.parquet(folder)
        return
    rows = docs.withColumn("id_range", where).repartition("id_range").sortWithinPartitions("id_range", F.asc_nulls_first("id"), text_hash(), F.asc_nulls_first("text"))
    names = [x.split()[0] for x in SHARDS.split(", ")]

    def shard(at: int, part: int, ids: list[int], sizes: list[int], blobs: list[np.ndarray]) -> pa.RecordBatch:
        all_ids = np.concatenate(blobs)
        size = 2 if all_ids.max() < 1 << 16 else 4
        row = (at, part, len(ids), len(all_ids), size, all_ids.astype(f"<u{size}").tobytes(), np.array(ids, "<i8").tobytes(), EliasFano.of(np.cumsum(sizes)).to_bytes())
        return pa.record_batch([pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        at, part, ids, sizes, blobs, held = None, 0, [], [], [], 0
        for b in pieces(batches, "text", 4 << 20):
            codes, length = enc.encode(b.column(1))
            ends = np.cumsum(length)
            codes, length = np.insert(codes, ends, end_id), length + 1
            begin = np.concatenate([[0], np.cumsum(length)]).tolist()
            first = 0
            for k, (i, n, r) in enumerate(zip(b.column(0).to_pylist(), length.tolist(), b.column(2).to_pylist(), strict=True)):
                if ids and (r != at or held >= shard_tokens):
                    blobs.append(codes[begin[first] : begin[k]])
                    first = k
                    yield shard(at, part, ids, sizes, blobs)
                    part, ids, sizes, blobs, held = part + 1 if r == at else 0, [], [], [], 0
                at = r
                ids.append(NO_ID if i is None else i)
                sizes.append(n)
                held += n
            blobs.append(codes[begin[first] :].copy())
        if ids:
            yield shard(at, part, ids, sizes, blobs)

    rows.mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of each document, from the files alone."""
    shards = spark.read.schema(SHARDS).parquet(folder)
    per_range = shards.groupBy("id_range").agg(F.sum("n_tokens").alias("n"))
    # a row for each range of ids (their number is a parameter of id_ranges): the one window over all is over those
    bases = per_range.select("id_range", (F.sum("n").over(Window.orderBy("id_range")) - F.col("n")).alias("base"))
    parts = shards.select("id_range", "part", "n_tokens").join(bases, "id_range").select("id_range", "part", (F.col("base") + F.sum("n_tokens").over(Window.partitionBy("id_range").orderBy("part")) - F.col("n_tokens")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").astype("<u4")
                ends = EliasFano.from_bytes(r["ends"]).all()
                begin = np.concatenate([[0], ends[:-1]])
                doc = np.frombuffer(r["doc_ids"], "<i8")
                crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(begin.tolist(), ends.tolist(), strict=True)]
                same = [pa.array([r["id_range"]] * len(doc), pa.int64()), pa.array([r["part"]] * len(doc), pa.int32())]
                yield pa.record_batch([*same, pa.array(doc, mask=doc == NO_ID), pa.array(begin), pa.array(ends - begin), pa.array(crc, pa.int64())], names=["id_range", "part", "doc_id", "begin", "n_tokens", "ids_crc32"])

    rows = shards.select("id_range", "part", "id_bytes", "ids", "doc_ids", "ends").mapInArrow(run, "id_range long, part int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    placed = rows.join(parts, ["id_range", "part"])  # ids stay where they were read; a row of numbers for each document moves
    return placed.select("doc_id", (F.col("start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", F.concat_ws("/", F.col("id_range").cast("string"), F.col("part").cast("string")).alias("shard"))


def document_ids(spark: SparkSession, folder: str, id_range: int, part: int, number: int) -> list[int]:
    """The ids of one document of a shard, by select on its Elias-Fano boundaries."""
    r = spark.read.schema(SHARDS).parquet(folder).where((F.col("id_range") == id_range) & (F.col("part") == part)).first()
    ends = EliasFano.from_bytes(r["ends"])
    lo = ends.get(number - 1) if number else 0
    return np.frombuffer(r["ids"], f"<u{r['id_bytes']}")[lo : ends.get(number)].tolist()
