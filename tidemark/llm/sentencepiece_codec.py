"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a public model file, whose path is a parameter; nothing is
trained.  Scores are log probabilities.  A unigram file has them; a file of
merges has the rank of each piece instead, the more frequent ones first, and a
rank r becomes the log of its Zipf-Mandelbrot probability, in proportion to
1 / (r + ``ZIPF``).  Pieces that the file marks as never to be formed are
decoded, but not encoded.  A space becomes the white-space marker and one
marker goes before the text.  The best segmentation is the one with the
highest sum of scores; a character that no piece covers costs more than any
piece and falls back to its UTF-8 bytes, as does a marker character that
stands in the text itself, so decoding always gives the text back.

No piece has a marker after another character, so a text is cut before each
run of spaces and every distinct chunk is segmented once.  Chunks of similar
length are segmented together, place by place, in arrays.

Defined results: null and empty texts have no ids and decode to the empty
text; of segmentations with equal scores the one whose last piece is longest
wins.  Ids may be of any type and repeat.  Other columns are carried as they
are, but for those named like an added column, which are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.chunks import ChunkIds, cut
from tidemark.llm.storage import with_text
from tidemark.llm.textkit import slices, utf8

MARKER = "▁"
#: The shift of ranks in the law of Zipf and Mandelbrot.
ZIPF = 2.7
#: A score under this one marks a piece that is never formed.
NEVER = -1e8
#: Chunks up to this length are segmented in arrays, longer ones one by one.
TOGETHER = 48


@dataclass(frozen=True)
class Trie:
    """A double array: the child of state s by byte b is base[s] + b, if check of that is s; value is a piece or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(pieces: dict[bytes, int]) -> Trie:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for piece, number in pieces.items():
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][b]
            values[node] = number
        size = 8 * len(children) + 4096
        base, check, value = (np.full(size, v, np.int32) for v in (0, -1, -1))
        used = np.zeros(size, bool)
        used[0] = True
        place, queue, start = {0: 0}, [0], defaultdict(lambda: 1)  # where the search for so many free cells goes on
        for node in queue:
            s = place[node]
            value[s] = values[node]
            if not children[node]:
                continue
            labels = np.fromiter(children[node], int)
            at = start[len(labels)]
            while True:
                free = ~used[np.arange(at, at + 256)[:, None] + labels].any(1)
                if free.any():
                    break
                at += 256
            at += int(free.argmax())
            start[len(labels)] = at
            base[s] = at
            for b, child in children[node].items():
                used[at + b], check[at + b], place[child] = True, s, at + b
                queue.append(child)
        end = int(used.nonzero()[0].max()) + 257
        return Trie(base[:end], check[:end], value[:end])


@dataclass(frozen=True)
class Vocabulary:
    trie: Trie
    scores: np.ndarray
    byte_ids: np.ndarray
    pieces: list[bytes]  # decoded bytes of each piece; a marker is a space; control pieces are empty
    fallback: float
    longest: int


def log_scores(scores: np.ndarray) -> np.ndarray:
    """Log probabilities of pieces from the scores of their file, which has those or, for merges, ranks below zero."""
    if len(scores) < 2 or (scores != np.floor(scores)).any() or len(np.unique(scores)) < len(scores):
        return scores
    p = 1 / (ZIPF - scores)
    return np.log(p / p.sum())


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, known, scores, byte_ids = [], {}, [], np.full(256, -1, np.int32)
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        scores.append(model.get_score(k))
        if model.is_byte(k):
            byte_ids[int(piece[3:5], 16)] = k
            pieces.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            pieces.append(b"")
        else:
            pieces.append(piece.replace(MARKER, " ").encode())
            if scores[-1] > NEVER:
                known[pieces[-1]] = k
    if (byte_ids < 0).any():
        raise ValueError("byte fallback needs all 256 byte pieces")
    if any(b" " in p.lstrip(b" ") for p in known):
        raise ValueError("a piece has a marker after another character")
    scores, own = np.array(scores, np.float64), list(known.values())
    scores[own] = log_scores(scores[own])
    return Vocabulary(Trie.build(known), scores, byte_ids, pieces, float(scores[own].min()) - 10, max(map(len, known)))


def _width(lead: np.ndarray) -> np.ndarray:
    """Bytes of the character that starts with a byte."""
    return 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)


def _segment_together(v: Vocabulary, text: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    """The pieces of chunks, the rows of ``text``; a fallback to bytes is a negative number of bytes."""
    n, width = text.shape
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, width + 1), np.int32)
    size = np.zeros((n, width + 1), np.int16)
    base, check, value = v.trie.base, v.trie.check, v.trie.value
    for s in range(width):
        rows = np.flatnonzero((best[:, s] > -np.inf) & (lengths > s))
        if not len(rows):
            continue
        char = _width(text[rows, s])
        end = np.minimum(s + char, lengths[rows])
        cost = best[rows, s] + v.fallback
        better = cost > best[rows, end]
        r, e = rows[better], end[better]
        best[r, e], back[r, e], size[r, e] = cost[better], -(e - s), e - s
        state = np.zeros(len(rows), np.int32)
        for k in range(s, min(width, s + v.longest)):
            nxt = base[state] + text[rows, k]
            ok = (check[nxt] == state) & (lengths[rows] > k)
            rows, nxt, parent = rows[ok], nxt[ok], state[ok]
            if not len(rows):
                break
            state = nxt
            piece = value[state]
            has = piece >= 0
            r, p = rows[has], piece[has]
            cost = best[r, s] + v.scores[p]
            better = cost > best[r, k + 1]
            r = r[better]
            best[r, k + 1], back[r, k + 1], size[r, k + 1] = cost[better], p[better], k + 1 - s
    found: list[list[int]] = [[] for _ in range(n)]
    at, live = lengths.copy(), np.flatnonzero(lengths > 0)
    steps = []
    while len(live):
        steps.append((live, back[live, at[live]]))
        at[live] -= size[live, at[live]]
        live = live[at[live] > 0]
    for rows, pieces in reversed(steps):
        for r, p in zip(rows.tolist(), pieces.tolist(), strict=True):
            found[r].append(p)
    return found


def _segment_one(v: Vocabulary, text: bytes) -> list[int]:
    n = len(text)
    best, back, size = [-np.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    base, check, value, scores = v.trie.base, v.trie.check, v.trie.value, v.scores
    for s in range(n):
        if best[s] == -np.inf:
            continue
        e = min(n, s + 1 + (text[s] >= 0xC0) + (text[s] >= 0xE0) + (text[s] >= 0xF0))
        if best[s] + v.fallback > best[e]:
            best[e], back[e], size[e] = best[s] + v.fallback, -(e - s), e - s
        state = 0
        for k in range(s, min(n, s + v.longest)):
            nxt = int(base[state]) + text[k]
            if check[nxt] != state:
                break
            state = nxt
            p = int(value[state])
            if p >= 0 and (cost := best[s] + float(scores[p])) > best[k + 1]:
                best[k + 1], back[k + 1], size[k + 1] = cost, p, k + 1 - s
    out, at = [], n
    while at:
        out.append(back[at])
        at -= size[at]
    return out[::-1]


def encode_chunks(v: Vocabulary, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of chunks, joined, and how many each has."""
    found: list[list[int]] = [[]] * len(chunks)
    groups = defaultdict(list)
    for k, c in enumerate(chunks):
        if len(c) <= TOGETHER:
            groups[(len(c) + 3) // 4].append(k)
        else:
            found[k] = _segment_one(v, c)
    for width, members in groups.items():
        text = np.array([chunks[k].ljust(4 * width, b"\0") for k in members], f"S{4 * width}")
        grid = np.frombuffer(b"".join(chunks[k].ljust(4 * width, b"\0") for k in members), np.uint8).reshape(len(text), -1)
        for k, pieces in zip(members, _segment_together(v, grid, np.array([len(chunks[k]) for k in members])), strict=True):
            found[k] = pieces
    out, counts = [], np.zeros(len(chunks), np.int64)
    for k, (c, pieces) in enumerate(zip(chunks, found, strict=True)):
        before, at = len(out), 0
        for p in pieces:
            if p >= 0:
                out.append(p)
                at += len(v.pieces[p])
            else:
                out.extend(v.byte_ids[b] for b in c[at : at - p])
                at -= p
        counts[k] = len(out) - before
    return np.array(out, np.int32), counts


class Encoder:
    """Encodes rows of Arrow strings; keeps the chunks it has seen."""

    def __init__(self, path: str):
        self.vocabulary = load(path)
        self.chunks = ChunkIds(lambda chunks: encode_chunks(self.vocabulary, chunks), 500_000)

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(i, j, ids, counts): the ids of rows i..j, joined, and the number of ids of each."""
        data, offsets = utf8(column)
        for i, j in slices(offsets):
            at = offsets[i : j + 1]
            sizes = np.diff(at)
            grown = np.append(0, np.cumsum(sizes + (sizes > 0)))  # with the marker before each text
            text = np.full(int(grown[-1]), 32, np.uint8)
            for k in range(j - i):
                if sizes[k]:
                    text[grown[k] + 1 : grown[k + 1]] = data[at[k] : at[k + 1]]
            space = text == 32
            marks = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            cuts, per_row = cut(text, grown, marks)
            ids, counts = self.chunks.lookup(text, cuts)
            total = np.append(0, np.cumsum(counts))
            ends = np.cumsum(per_row)
            yield i, j, ids, total[ends] - total[ends - per_row]


class Decoder:
    def __init__(self, path: str):
        v = load(path)
        self.lengths = np.array([len(p) for p in v.pieces])
        self.data = np.frombuffer(b"".join(v.pieces), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> str:
        """The text of a row's ids: pieces and bytes joined, markers as spaces, without the first one."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return ""
        data = self.data[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]))].tobytes()
        return data[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids``; one of that name is replaced."""
    kept = [c for c in docs.columns if c != ids]
    schema = docs.select(kept).schema.add(ids, T.ArrayType(T.IntegerType()))
    rows, place = with_text(docs, text, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for i, j, out, counts in encoder.rows(batch.column(place)):
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(out, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(kept)]), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the column ``text`` of the decoded ids; one of that name is replaced."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(kept).schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for batch in batches:
            column = batch.column(0)
            out = [decoder.decode(x.values.to_numpy()) if x.is_valid else "" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], names=schema.names)

    return docs.select(F.col(ids).alias("__ids"), *kept).mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``decoded``, in one pass; columns of those names are replaced."""
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]
    schema = docs.select(kept).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("decoded", "string")
    rows, place = with_text(docs, text, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(path), Decoder(path)
        for batch in batches:
            for i, j, out, counts in encoder.rows(batch.column(place)):
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out, pa.int32()))
                texts = pa.array([decoder.decode(r) for r in np.split(out, ends[:-1])], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(kept)]), lists, pa.array(counts, pa.int64()), texts], names=schema.names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_fallback, ids_crc32, decoded_sha256, exact) for every row, decoded from the ids."""
    import zlib

    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_fallback", "ids_crc32", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(path), Decoder(path)
        is_byte = np.zeros(len(encoder.vocabulary.scores), bool)
        is_byte[encoder.vocabulary.byte_ids] = True
        for batch in batches:
            for i, j, ids, counts in encoder.rows(batch.column(1)):
                rows = np.split(ids, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(counts, pa.int64()),
                        pa.array([int(is_byte[r].sum()) for r in rows], pa.int64()),
                        pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()),
                        pa.array([decoder.decode(r) for r in rows], pa.string()),
                    ],
                    names=["doc_id", "text", *names[1:]],
                )

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, text string, n_tokens long, n_fallback long, ids_crc32 long, decoded string")
    return out.select("doc_id", "n_tokens", "n_fallback", "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))
