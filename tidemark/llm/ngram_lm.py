"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark over all learnable rows.  A task counts what it reads
and emits sorted arrays by hash range, so a word or pair in a third of all
texts is one entry a task.  Each range becomes a file of sorted arrays in the
shared folder:

* ``words-*``: sorted hashes of words with their counts.  The place of a word
  in these files is its number.
* ``pairs-*``: sorted keys of pairs (number of the word before, number of the
  word) with their counts; ranges by a hash of the key, so no frequent word
  makes one range large.
* ``stats-*``: for each word as a context its total and how many words follow
  it once, twice and more often, and for each word how many words it follows.

Workers memory-map the files they touch and look sorted keys up.  The model's
order is two: most triples of the corpus are distinct, and their table would be
half as large again as that of the pairs.

Defined results: null and empty texts have the end token alone.  A row with
null id is scored and never learned from.  Without training rows every token
has probability one.  Ids may be of any type and repeat; other columns are left
out.  A file of the model that is missing when rows are scored is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import map_blob, new_path, write_blob
from tidemark.llm.textkit import U64, Words, distinct, mix, runs, slices, utf8

END = U64(0x5EED0E0D5EED0E0D)
ROWS_PER_RANGE = 2048
SLICE = 1 << 21
#: Distinct words or pairs that a task holds before it emits them.
HOLD = 3_000_000


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, the first one ascending, as compressed byte planes."""
    first, *rest = arrays
    planes = [np.diff(first, prepend=first.dtype.type(0)), *rest]
    raw = b"".join(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in planes)
    return len(first).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes, n_arrays: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=8 * n * n_arrays), np.uint8).reshape(n_arrays, 8, n)
    arrays = [np.ascontiguousarray(raw[k].T).view("<u8")[:, 0] for k in range(n_arrays)]
    arrays[0] = np.cumsum(arrays[0], dtype=U64)
    return arrays


def merged(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct sorted keys with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return [keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[order] for v in values)]


class Counter:
    """Sums counts by key until there are many."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > HOLD:
            self.take_back(*self.take())

    def take_back(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts, self.size = [keys], [counts], len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = merged(np.concatenate(self.keys or [np.zeros(0, U64)]), np.concatenate(self.counts or [np.zeros(0, np.int64)]))
        self.clear()
        return keys, counts


def _range_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def _emit(part: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """One blob for each part; ``arrays`` are sorted by the first one."""
    order = np.argsort(part, kind="stable")
    values, first = np.unique(part[order], return_index=True)
    blobs = [pack(*(a[k] for a in arrays)) for k in np.split(order, first[1:])] if len(values) else []
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def token_hashes(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of rows i..j, each row closed by END, and the tokens of each row."""
    words = Words(data, offsets, i, j)
    return np.insert(words.hashes, np.cumsum(words.counts), END), words.counts + 1


class WordTable:
    """The words of the model by hash: number, count and statistics, from mapped files."""

    def __init__(self, folder: str, bits: int, offsets: list[int]):
        self.folder, self.bits, self.offsets = folder, bits, np.array(offsets, np.int64)
        self.maps: dict[tuple[str, int], np.ndarray] = {}

    def _map(self, name: str, part: int) -> np.ndarray:
        if (name, part) not in self.maps:
            self.maps[name, part] = map_blob(f"{self.folder}/{name}-{part:06d}")
        return self.maps[name, part]

    def lookup(self, hashes: np.ndarray, stats: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, count, statistics) of sorted distinct hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        found = np.zeros((5, len(hashes)), np.int64)
        for part, a, b in runs(_range_of(hashes, self.bits)):
            n = int(self.offsets[part + 1] - self.offsets[part])
            if not n:
                continue
            raw = self._map("words", part)
            known = raw[: 8 * n].view(U64)
            place = np.minimum(np.searchsorted(known, hashes[a:b]), n - 1)
            hit = known[place] == hashes[a:b]
            number[a:b] = np.where(hit, place + self.offsets[part], -1)
            count[a:b] = np.where(hit, raw[8 * n :].view(np.int64)[place], 0)
            if stats:
                found[:, a:b] = np.where(hit, self._map("stats", part).view(np.int64).reshape(5, n)[:, place], 0)
        return number, count, found


@dataclass(frozen=True)
class Model:
    folder: str
    bits: int  # of word ranges
    pair_bits: int
    offsets: list[int]  # number of the first word of each range
    tokens: int
    words: int
    pairs: int
    discounts: tuple[float, ...]  # of pairs seen once, twice, more often
    lower: tuple[float, ...]  # of words that follow one word, two, more
    rest: float  # mass that the lower order leaves to the uniform distribution
    pair_parts: tuple[int, ...] = ()  # the ranges of pairs that have a file

    def pair_key(self, before: np.ndarray, number: np.ndarray) -> np.ndarray:
        return before.astype(U64) * U64(self.words + 1) + number.astype(U64)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of modified Kneser-Ney, from the numbers of entries seen one to four times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


def _discount(counts: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), fold.alias("fold"))


def train(texts: DataFrame) -> Model:
    """Count the rows (text) and write the model's files."""
    spark = texts.sparkSession
    folder = new_path(spark, "ngrams")
    pair_bits = max(3, min(16, max(1, texts.count() // ROWS_PER_RANGE).bit_length()))
    bits = max(1, min(10, pair_bits - 3))
    texts = texts.select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slices(offsets, SLICE):
                held.add(token_hashes(data, offsets, i, j)[0])
            if held.size > HOLD:
                keys, counts = held.take()
                yield _emit(_range_of(keys, bits), keys, counts)
        keys, counts = held.take()
        yield _emit(_range_of(keys, bits), keys, counts)

    def write_words(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        keys, counts = merged(*(np.concatenate(x) for x in zip(*(unpack(b, 2) for b in frame["blob"]), strict=True)))
        write_blob(f"{folder}/words-{part:06d}", keys.tobytes() + counts.astype(np.int64).tobytes())
        return pd.DataFrame({"part": [part], "words": [len(keys)], "tokens": [int(counts.sum())]})

    made = texts.mapInArrow(count_words, "part int, blob binary").groupBy("part").applyInPandas(write_words, "part int, words long, tokens long").collect()  # a row for each range
    sizes = {r["part"]: r["words"] for r in made}
    offsets = [0]
    for part in range(1 << bits):
        offsets.append(offsets[-1] + sizes.get(part, 0))
    n_words, n_tokens = offsets[-1], sum(r["tokens"] for r in made)
    empty = Model(folder, bits, pair_bits, offsets, n_tokens, n_words, 0, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 0.0)
    if not n_words:
        return empty

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = Counter(), WordTable(folder, bits, offsets)
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for i, j in slices(offs, SLICE):
                hashes, counts = token_hashes(data, offs, i, j)
                words, _, back = distinct(hashes)
                numbers = table.lookup(words, False)[0][back]
                held.add(empty.pair_key(*_with_before(numbers, counts, n_words)))
            if held.size > HOLD:
                keys, counts = held.take()
                yield _emit(_range_of(mix(keys), pair_bits), keys, counts)
        keys, counts = held.take()
        yield _emit(_range_of(mix(keys), pair_bits), keys, counts)

    def write_pairs(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        keys, counts = merged(*(np.concatenate(x) for x in zip(*(unpack(b, 2) for b in frame["blob"]), strict=True)))
        counts = counts.astype(np.int64)
        large = np.flatnonzero(counts > 254)
        write_blob(f"{folder}/pairs-{part:06d}", b"".join([np.array([len(keys), len(large)], np.int64).tobytes(), keys.tobytes(), large.astype(np.int64).tobytes(), counts[large].tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes()]))
        before, word = (keys // U64(n_words + 1)).astype(np.int64), (keys % U64(n_words + 1)).astype(np.int64)
        context = merged(before, counts, *((counts == k if k < 3 else counts >= 3).astype(np.int64) for k in (1, 2, 3)))
        follows = merged(word, np.ones(len(word), np.int64))
        seen = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        rows = []
        edges = np.array(offsets)
        for kind, arrays in (("context", context), ("follows", follows)):
            own = arrays[0] < n_words  # the begin of a text is no word; its statistics stand by themselves
            if kind == "context" and not own.all():
                rows.append((-1, "begin", pack(*(a[~own] for a in arrays)), len(keys), *seen))
            arrays = [a[own] for a in arrays]
            at = np.searchsorted(arrays[0], edges)
            for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if b > a:
                    rows.append((p, kind, pack(*(x[a:b] for x in arrays)), 0, 0, 0, 0, 0))
        rows.append((-1, "total", str(part).encode(), len(keys), *seen))
        return pd.DataFrame(rows, columns=["part", "kind", "blob", "pairs", "n1", "n2", "n3", "n4"])

    def write_stats(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        if part < 0:
            totals, begins = frame[frame["kind"] == "total"], frame[frame["kind"] == "begin"]
            begin = np.sum([[int(a[0]) for a in unpack(b, 5)[1:]] for b in begins["blob"]], axis=0).astype(np.int64) if len(begins) else np.zeros(4, np.int64)
            write_blob(f"{folder}/begin", np.append(begin, 0).tobytes())
            return pd.DataFrame({"part": [part], "n": [totals[["pairs", "n1", "n2", "n3", "n4"]].sum().astype(int).tolist() + sorted(int(x) for x in totals["blob"])]})
        n = offsets[part + 1] - offsets[part]
        stats = np.zeros((5, n), np.int64)
        for kind, blob in zip(frame["kind"], frame["blob"], strict=True):
            arrays = unpack(blob, 5 if kind == "context" else 2)
            place = arrays[0].astype(np.int64) - offsets[part]
            if kind == "context":
                for k in range(4):
                    stats[k, place] += arrays[k + 1].astype(np.int64)
            else:
                stats[4, place] += arrays[1].astype(np.int64)
        write_blob(f"{folder}/stats-{part:06d}", stats.tobytes())
        return pd.DataFrame({"part": [part], "n": [[0, *(int((stats[4] == k).sum()) for k in (1, 2, 3, 4)), int((stats[4] >= 3).sum())]]})

    pairs = texts.mapInArrow(count_pairs, "part int, blob binary").groupBy("part").applyInPandas(write_pairs, "part int, kind string, blob binary, pairs long, n1 long, n2 long, n3 long, n4 long")
    done = pairs.groupBy("part").applyInPandas(write_stats, "part int, n array<long>").collect()  # a row for each range
    totals = next(r["n"] for r in done if r["part"] < 0)
    follow = np.sum([r["n"] for r in done if r["part"] >= 0], axis=0).tolist()
    totals, pair_parts = totals[:5], totals[5:]
    d, low = discounts(totals[1:]), discounts(follow[1:5])
    rest = sum(x * n for x, n in zip(low, (follow[1], follow[2], follow[5]), strict=True)) / totals[0]
    return Model(folder, bits, pair_bits, offsets, n_tokens, n_words, totals[0], d, low, rest, tuple(pair_parts))


def _with_before(numbers: np.ndarray, counts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The number before each token, ``begin`` for the first one of a row, and its own."""
    before = np.append(begin, numbers[:-1])
    before[np.cumsum(counts) - counts] = begin
    return before, numbers


class Scorer:
    """Scores rows by the mapped files of a model."""

    def __init__(self, model: Model):
        self.model, self.table = model, WordTable(model.folder, model.bits, model.offsets)
        self.begin = np.array(map_blob(f"{model.folder}/begin")).view(np.int64) if model.words else np.zeros(5, np.int64)
        self.pairs: dict[int, tuple] = {}
        self.there = frozenset(model.pair_parts)

    def _pairs(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if part not in self.pairs:
            if part not in self.there:
                self.pairs[part] = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
                return self.pairs[part]
            raw = map_blob(f"{self.model.folder}/pairs-{part:06d}")
            n, large = (int(x) for x in raw[:16].view(np.int64))
            a, b, c = 16 + 8 * n, 16 + 8 * (n + large), 16 + 8 * (n + 2 * large)
            self.pairs[part] = (raw[16:a].view(U64), raw[a:b].view(np.int64), raw[b:c].view(np.int64), raw[c:])
        return self.pairs[part]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of distinct sorted keys."""
        out, part = np.zeros(len(keys), np.int64), _range_of(mix(keys), self.model.pair_bits)
        order = np.argsort(part, kind="stable")
        for p, a, b in runs(part[order]):
            known, places, large, small = self._pairs(p)
            if not len(known):
                continue
            wanted = keys[order[a:b]]
            place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            count = np.where(known[place] == wanted, small[place], 0).astype(np.int64)
            if (count == 255).any():
                full = np.flatnonzero(count == 255)
                count[full] = large[np.searchsorted(places, place[full])]
            out[order[a:b]] = count
        return out

    def rows(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, score) of each row."""
        m = self.model
        words, _, back = distinct(hashes)
        number, count, stats = self.table.lookup(words, m.pairs > 0)
        starts = np.cumsum(counts) - counts
        known = np.add.reduceat((count > 0)[back].astype(np.int64), starts)
        base = np.add.reduceat(np.log10((count + 1) / (m.tokens + 1 * (m.words + 1)))[back], starts)
        if not m.pairs:
            return known, base, np.add.reduceat(np.full(len(back), -np.log10(m.words + 1)), starts)
        follows = stats[4]
        low = np.maximum(follows - _discount(follows, m.lower), 0) / m.pairs + m.rest / (m.words + 1)
        first = np.zeros(len(back), bool)
        first[starts] = True
        own = np.append(0, back[:-1])  # the distinct token before
        total = np.where(first, self.begin[0], stats[0][own])
        d = m.discounts
        mass = np.where(first, d[0] * self.begin[1] + d[1] * self.begin[2] + d[2] * self.begin[3], (d[0] * stats[1] + d[1] * stats[2] + d[2] * stats[3])[own])
        before = np.where(first, m.words, number[own])
        word = number[back]
        seen = np.flatnonzero((before >= 0) & (word >= 0))
        keys, _, places = distinct(m.pair_key(before[seen], word[seen]))
        pair = np.zeros(len(back), np.int64)
        pair[seen] = self.pair_counts(keys)[places]
        some = np.maximum(total, 1)
        p = np.where(total > 0, np.maximum(pair - _discount(pair, d), 0) / some + mass / some * low[back], low[back])
        return known, base, np.add.reduceat(np.log10(p), starts)


def score(texts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, fold, n_tokens, n_known, base_score, score) of the rows (doc_id, text, fold)."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "fold", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE):
                hashes, counts = token_hashes(data, offsets, i, j)
                known, base, own = scorer.rows(hashes, counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(own)], names=names)

    return texts.mapInArrow(run, f"doc_id {kind}, fold long, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Train on the rows out of the held-out fold, and score every row; with perplexity."""
    texts = _texts(docs, text, doc_id)
    model = train(texts.where("fold <> 2"))
    found = score(texts, model)
    return found.select(
        "doc_id",
        F.coalesce(F.col("fold") == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
