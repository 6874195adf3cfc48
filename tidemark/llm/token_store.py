"""Token ids in a binary file format: one wavelet matrix per shard.

Texts are encoded with a public byte-level tokenizer; the end id closes each
document.  Documents are written in ascending order of their ids, in shards
of at most ``SHARD_DOCS`` documents and ``SHARD_TOKENS`` ids.  A shard holds its ids as a wavelet matrix: plane k has bit
k of every id, highest first, in the order that the planes before it have
sorted the ids to.  Planes are compressed in blocks, beside the number of ones
before each block, so that token access, counting and occurrence lookup read
only the blocks they touch.

File: magic ``TMWM0001``, length of the header, JSON header (numbers, zeros of
each plane, block sizes and ones), document bounds, then the blocks.

Defined results: null and empty texts have the end id alone.  Document ids are
numbers, texts or dates; a null one comes before all others.  Documents with
equal ids stand side by side, the shorter first and then by their token ids;
one task streams them to as many files as they need.  A document with more
ids than a shard takes has a file alone.  Other columns are left out.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.llm.chunks import ChunkIds, cut
from tidemark.llm.storage import map_blob, materialize, new_path, write_blob
from tidemark.llm.textkit import SPACE, slices, utf8

MAGIC = b"TMWM0001"
SHARD_DOCS = 4096
SHARD_TOKENS = 1 << 23
RANGES = 256
BLOCK = 1 << 15  # bytes of a plane
END_ID = 2
_ONES = np.array([k.bit_count() for k in range(256)], np.uint8)


# ------------------------------------------------------------------ encoding


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer of a file, and the bytes that each of its ids stands for."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    lengths = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, k in tokenizer.get_vocab().items():
        lengths[k] = len(token)  # one character for each byte
    return tokenizer, lengths


def _encode_chunks(path: str, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of chunks, joined, and how many each has.

    Chunks of one word are encoded many at a time, a line each; a line end
    between two words is a token by itself.  Other chunks are encoded alone.
    """
    tokenizer, lengths = _tokenizer(path)
    encode = lambda raw: np.array(tokenizer.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids, np.int64)
    plain = [k for k, c in enumerate(chunks) if not SPACE[c[-1]] and not SPACE[c[1 if c[0] == 32 and len(c) > 1 else 0]]]
    sizes = np.array([len(chunks[k]) + 1 for k in plain], np.int64)
    parts, counts = [], np.zeros(len(chunks), np.int64)
    places = np.zeros(len(chunks), np.int64)
    used, rest = 0, set(range(len(chunks)))
    for a, b in slices(np.append(0, np.cumsum(sizes)), 1 << 17) if plain else ():
        ids = encode(b"\n".join([chunks[k] for k in plain[a:b]]) + b"\n")
        ends, bounds = np.cumsum(lengths[ids]), np.cumsum(sizes[a:b])
        at = np.searchsorted(ends, bounds)  # the place of each line end
        if not (np.array_equal(ends[at], bounds) and (lengths[ids[at]] == 1).all()):
            continue  # a line end has joined a word: these are encoded alone
        own = np.array(plain[a:b])
        places[own], counts[own] = used + np.append(0, at[:-1] + 1), np.diff(np.append(-1, at)) - 1
        parts.append(ids)
        used += len(ids)
        rest.difference_update(plain[a:b])
    for k in sorted(rest):
        parts.append(ids := encode(chunks[k]))
        places[k], counts[k] = used, len(ids)
        used += len(ids)
    ids, ends = np.concatenate(parts), np.cumsum(counts)
    return ids[np.repeat(places - (ends - counts), counts) + np.arange(int(ends[-1]))].astype(np.int32), counts


#: Classes of bytes: white space, letters, punctuation, and the lead byte of Latin letters; others are 0.
_SPACE, _LINE, _LETTER, _MARK, _APOSTROPHE, _DIGIT, _LEAD = range(1, 8)
_CLASS = np.zeros(256, np.uint8)
for _a, _b, _k in ((33, 48, _MARK), (58, 65, _MARK), (91, 97, _MARK), (123, 127, _MARK), (48, 58, _DIGIT), (65, 91, _LETTER), (97, 123, _LETTER), (9, 14, _LINE)):
    _CLASS[_a:_b] = _k
_CLASS[[32, 39, 0xC3]] = _SPACE, _APOSTROPHE, _LEAD
_BORDER = np.zeros((8, 8), bool)  # between two classes
_BORDER[[_LETTER, _MARK, _APOSTROPHE, _DIGIT], _SPACE : _LINE + 1] = True
_BORDER[_LETTER, [_MARK, _APOSTROPHE]] = True
_BORDER[_MARK, [_LETTER, _LEAD]] = True
_BORDER[_LINE, [_LETTER, _MARK, _APOSTROPHE, _LEAD]] = True
_BORDER = _BORDER.ravel()


def borders(text: np.ndarray) -> np.ndarray:
    """Places where the tokenizer's own words certainly end.

    White space after a printing character begins a word, and a single line
    end joins no word after it; letters and punctuation are never in one word, but
    for what follows an apostrophe.
    """
    if len(text) < 2:
        return np.zeros(0, np.int64)
    kind = _CLASS[text]
    second = np.flatnonzero(text[:-1] == 0xC3) + 1  # of a Latin letter, or of a times or division sign
    kind[second] = np.where((text[second] == 0x97) | (text[second] == 0xB7), 0, _LETTER)
    found = np.flatnonzero(_BORDER[kind[:-1] << 3 | kind[1:]]) + 1
    # of several white spaces in a row the tokenizer joins some
    after_line = (kind[found - 1] == _LINE) & (found > 1)
    return found[~after_line | (kind[found - 2] >= _LETTER) & (kind[found - 2] <= _DIGIT)]


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[bytes, ...]:
    """The texts that the tokenizer of a file takes out whole before it looks for words, long ones first.

    Those that match only as whole words, or take white space along, are not chunks; a file with such tokens is refused.
    """
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path).get_added_tokens_decoder().values()
    if any(t.single_word or t.lstrip or t.rstrip for t in found):
        raise ValueError(f"{path} has added tokens that depend on the text around them")
    return tuple(sorted((t.content.encode() for t in found if t.content), key=len, reverse=True))


def around_added(text: np.ndarray, at: np.ndarray, marks: np.ndarray, added: tuple[bytes, ...]) -> np.ndarray:
    """``marks`` with a border before and after each added token, and none inside; no token spans two rows."""
    if not added:
        return marks
    raw, pattern = text.tobytes(), re.compile(b"|".join(map(re.escape, added)))
    if not any(a in raw for a in added):
        return marks
    spans = [m.span() for i, j in zip(at[:-1], at[1:], strict=True) for m in pattern.finditer(raw, int(i), int(j))]
    inside = np.zeros(len(text) + 1, bool)
    for i, j in spans:
        inside[i + 1 : j] = True
    ends = np.array(spans, np.int64).ravel()
    return np.unique(np.append(marks[~inside[marks]], ends[ends < len(text)]))


class TextEncoder:
    """Encodes rows of Arrow strings; the distinct chunks between certain borders once each."""

    def __init__(self, path: str):
        self.added = added_tokens(path)
        self.chunks = ChunkIds(lambda chunks: _encode_chunks(path, chunks))

    def rows(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(i, j, ids, counts) of rows i..j, each closed by ``end_id``."""
        data, offsets = utf8(column)
        for i, j in slices(offsets):
            at = offsets[i : j + 1] - offsets[i]
            text = data[offsets[i] : offsets[j]]
            cuts, per_row = cut(text, at, around_added(text, at, borders(text), self.added))
            ids, counts = self.chunks.lookup(text, cuts)
            total = np.append(0, np.cumsum(counts))
            ends = np.cumsum(per_row)
            counts = total[ends] - total[ends - per_row]
            out = np.insert(ids, np.cumsum(counts), end_id)
            yield i, j, out, counts + 1


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One for a worker, which keeps its chunks from task to task."""
    return TextEncoder(path)


# ------------------------------------------------------------ wavelet matrix


def build(ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """The file of a shard: ``ids`` of documents that start at ``bounds`` (one more than documents)."""
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    rest, planes, zeros, sizes, ones = ids.astype(np.uint32 if levels > 16 else np.uint16), [], [], [], []
    pack = zstandard.ZstdCompressor(level=1).compress
    for k in range(levels - 1, -1, -1):
        bit = (rest & rest.dtype.type(1 << k)) != 0
        raw = np.packbits(bit, bitorder="little")
        blocks = [pack(raw[a : a + BLOCK].tobytes()) for a in range(0, len(raw), BLOCK)]
        per_block = [int(_ONES[raw[a : a + BLOCK]].sum(dtype=np.int64)) for a in range(0, len(raw), BLOCK)]
        planes += blocks
        sizes.append([len(b) for b in blocks])
        ones.append(per_block)
        zeros.append(int(len(bit) - bit.sum()))
        rest = np.concatenate([rest[~bit], rest[bit]])
    at = pack(np.ascontiguousarray(bounds, "<i8").tobytes())
    header = json.dumps({"n": len(ids), "docs": len(bounds) - 1, "levels": levels, "zeros": zeros, "sizes": sizes, "ones": ones, "bounds": len(at)}).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, at, *planes])


class TokenShard:
    """Reads one shard file: access, counting, occurrence lookup, and whole documents."""

    def __init__(self, data: np.ndarray):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(bytes(data[8:16]), "little")
        head = json.loads(bytes(data[16 : 16 + size]))
        self.n, self.levels, self.zeros = head["n"], head["levels"], head["zeros"]
        start = 16 + size
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.bounds = np.frombuffer(self.unpack(bytes(data[start : start + head["bounds"]]), max_output_size=8 * (head["docs"] + 1)), "<i8")
        self.data, start = data, start + head["bounds"]
        self.places, self.before = [], []
        for sizes, ones in zip(head["sizes"], head["ones"], strict=True):
            ends = start + np.cumsum(sizes, dtype=np.int64)
            self.places.append(np.stack([ends - sizes, ends], 1) if len(sizes) else np.zeros((0, 2), np.int64))
            start = int(ends[-1]) if len(sizes) else start
            self.before.append(np.append(0, np.cumsum(ones, dtype=np.int64)))
        self.cached: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self.cached:
            if len(self.cached) > 256:
                self.cached.clear()
            a, b = self.places[level][k]
            self.cached[level, k] = np.frombuffer(self.unpack(bytes(self.data[a:b]), max_output_size=BLOCK), np.uint8)
        return self.cached[level, k]

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // (8 * BLOCK))[i // 8 % BLOCK] >> (i & 7)) & 1

    def _rank(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        k, rest = divmod(i, 8 * BLOCK)
        ones = int(self.before[level][k])
        if rest:
            block = self._block(level, k)
            ones += int(_ONES[block[: rest // 8]].sum(dtype=np.int64))
            if rest & 7:
                ones += (int(block[rest // 8]) & ((1 << (rest & 7)) - 1)).bit_count()
        return ones

    def _select(self, level: int, bit: int, r: int) -> int:
        """The place of the r-th (from zero) one or zero of a plane."""
        before = self.before[level] if bit else np.minimum(np.arange(len(self.before[level])) * 8 * BLOCK, self.n) - self.before[level]
        k = int(np.searchsorted(before, r, "right")) - 1
        bits = np.unpackbits(self._block(level, k), bitorder="little")
        return 8 * BLOCK * k + int(np.flatnonzero(bits == bit)[r - int(before[k])])

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank(level, i), self._rank(level, j)
            i, j = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (i - a, j - b)
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """How often an id stands in places i..j."""
        a, b = self._range(token, i, self.n if j is None else j)
        return b - a

    def occurrence(self, token: int, r: int) -> int:
        """The place of the r-th (from zero) occurrence of an id."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= r < b - a:
            raise IndexError("no such occurrence")
        i = a + r
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        values = np.zeros(self.n, np.uint32 if self.levels > 16 else np.uint16)
        for level in range(self.levels - 1, -1, -1):
            raw = [self.unpack(bytes(self.data[a:b]), max_output_size=BLOCK) for a, b in self.places[level]]
            bit = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8), count=self.n, bitorder="little").view(bool)
            out = np.empty_like(values)
            out[~bit] = values[: self.zeros[level]]
            out[bit] = values[self.zeros[level] :] | values.dtype.type(1 << (self.levels - 1 - level))
            values = out
        return values


# --------------------------------------------------------------- Spark jobs


def range_borders(docs: DataFrame, doc_id: str, shard_docs: int) -> list:
    """The ids at which a new range begins; ranges hold like numbers of documents.

    There is a range for each shard, and beyond ``RANGES`` of them their number
    grows with the root of the number of shards: a range then has many files.
    """
    ids = docs.select(F.col(doc_id).alias("x"))
    shards = -(-ids.count() // shard_docs)
    ranges = min(shards, max(RANGES, 16 * math.isqrt(shards)))
    if ranges < 2:
        return []
    placed = ids.repartitionByRange(ranges, "x").withColumn("range", F.spark_partition_id())
    first = placed.groupBy("range").agg(F.min("x").alias("x")).where("x IS NOT NULL").orderBy("x").collect()  # a row for each range
    return [r["x"] for r in first[1:]]


def range_of(ids: pa.Array, borders: list) -> np.ndarray:
    """The range of each id; null ids come first."""
    out = np.zeros(len(ids), np.int64)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    values = ids.drop_null().to_numpy(zero_copy_only=False)
    out[known] = np.searchsorted(np.array(borders, values.dtype), values, "right")
    return out


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, shard_docs: int = SHARD_DOCS, text: str = "text", doc_id: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs`` to shard files in ``folder``; (range, shard, uri, n_tokens, doc_ids) for each, ``shard`` counting within its range."""
    borders = range_borders(docs, doc_id, shard_docs)
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        for batch in batches:
            own = range_of(batch.column(0), borders)
            for i, j, ids, counts in encoder.rows(batch.column(1), end_id):
                blobs = [r.astype("<u4" if ids.max() >> 16 else "<u2").tobytes() for r in np.split(ids, np.cumsum(counts)[:-1])]
                wide = pa.array([bool(ids.max() >> 16)] * (j - i))
                columns = [batch.column(0).slice(i, j - i), pa.array(own[i:j], pa.int32()), wide, pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "range", "wide", "n", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        doc_ids: list = []
        own = id_type = None
        shard = size = 0

        def flush() -> pa.RecordBatch:
            bounds = np.append(0, np.cumsum([len(x) for x in held], dtype=np.int64))
            uri = f"{folder}/shard-{own:06d}-{shard:06d}.tmwm"
            write_blob(uri, build(np.concatenate(held), bounds))
            columns = [pa.array([own], pa.int32()), pa.array([shard], pa.int32()), pa.array([uri]), pa.array([int(bounds[-1])], pa.int64()), pa.array([doc_ids], pa.list_(id_type))]
            return pa.RecordBatch.from_arrays(columns, names=["range", "shard", "uri", "n_tokens", "doc_ids"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, r, wide, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (r != own or len(held) >= shard_docs or size + n > shard_tokens):
                    yield flush()
                    held, doc_ids, size, shard = [], [], 0, shard + 1
                if r != own:
                    own, shard = r, 0
                doc_ids.append(doc)
                held.append(np.frombuffer(blob, "<u4" if wide else "<u2"))
                size += n
        if held:
            yield flush()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    encoded = rows.mapInArrow(encode, f"doc_id {kind}, range int, wide boolean, n long, ids binary")
    dealt = encoded.repartitionById(len(borders) + 1, "range").sortWithinPartitions("range", "doc_id", "n", "ids")
    return materialize(dealt.mapInArrow(write, f"range int, shard int, uri string, n_tokens long, doc_ids array<{kind}>"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shard files."""

    def before(n: str, window: WindowSpec) -> Column:
        return F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # sums of whole ranges, a narrow row for each, then of the shards within a range
    ranges = shards.groupBy("range").agg(F.sum("n_tokens").alias("n")).select("range", before("n", Window.orderBy("range")).alias("first"))
    within = shards.select("range", "uri", "doc_ids", before("n_tokens", Window.partitionBy("range").orderBy("shard")).alias("own"))
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base, doc_ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = TokenShard(map_blob(uri))
                ids, at = shard.tokens().astype("<u4"), shard.bounds
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(base + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, shards.select("range").distinct().count())
    files = within.join(ranges, "range").select("uri", (F.col("first") + F.col("own")).alias("base"), "doc_ids").repartition(tasks, "uri")
    return files.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def store_tokens(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID, shard_docs: int = SHARD_DOCS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write the ids of ``docs`` to shard files and describe each document from them."""
    return read_shards(write_shards(docs, path, folder or new_path(docs.sparkSession, "tokens"), end_id, shard_docs, text, doc_id))
