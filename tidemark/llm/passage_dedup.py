"""Suffix-array dedup of repeated passages by prefix-free parsing.

A byte is removed if a string of ``WIDTH`` bytes that covers it also starts in
a document with a smaller id.  Rolling-hash triggers cut every document into
phrases: of the grams of ``GRAM`` bytes inside each string of WIDTH bytes the
one with the least hash is its trigger, and the strings that follow each other
with the same trigger make a phrase.  Phrases overlap by WIDTH - 1 bytes, so a
string lies in one phrase whole, and equal strings have equal triggers at the
same place.  That makes order to the depth WIDTH a matter of the dictionary
alone; the parse, the phrases of each document, is only read again.

1. Triggers: tasks emit the hashes of their triggers in sorted blobs, by hash
   range; triggers met in one document only are done with.
2. Dictionary: the phrases of repeated triggers, each distinct one once a
   task with its smallest and largest document, go by the same ranges to
   where the suffixes of competing phrases are sorted by prefix doubling to
   the depth WIDTH.  Of equal suffixes the smallest document counts; it is
   stored by phrase in sorted arrays.
3. Parse: documents are parsed again and look their phrases up in those
   arrays, memory-mapped from the shared folder.

No step gathers a document's or a passage's occurrences: a passage in a third
of all documents is one phrase a task.  A trigger with over ``HOT`` phrases,
as a line that stands in many contexts has, would make its range large: the
strings of its phrases go apart, by ranges of their own hashes, and equal ones
meet there.

Defined results: null and empty texts have no bytes and nothing removed;
documents with equal ids do not remove each other's bytes; null ids come last.
Ids are whole numbers.  Other columns are left out.  A file of the folder that
is missing when the rows are read is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import map_blob, new_path, write_blob
from tidemark.llm.textkit import U64, distinct, mix, runs, slices, utf8

WIDTH = 50
GRAM = 16
PIECE = 1 << 19
ROWS_PER_RANGE = 512
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = U64((1 << 20) - 1)
#: Triggers, or bytes of phrases, that a task holds before it emits them.
HOLD_TRIGGERS, HOLD_BYTES = 1_500_000, 16_000_000
#: Phrases of a trigger from which on their strings are dealt by themselves.
HOT = 1 << 15
#: Bytes of competing phrases whose suffixes are sorted together.
SORT_BYTES = 1_000_000

_powers = np.concatenate([np.ones(1, U64), np.cumprod(np.full(PIECE + 2 * WIDTH, _BASE, U64))])
_inverses = np.concatenate([np.ones(1, U64), np.cumprod(np.full(PIECE + 2 * WIDTH, pow(_BASE, -1, 1 << 64), U64))])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(U64).max, U64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, block: int = 4096) -> np.ndarray:
    """The bytes of runs of ``data``, one after another, with indices for a block of runs at a time."""
    out, at = np.empty(int(sizes.sum()), np.uint8), 0
    for k in range(0, len(starts), block):
        n = sizes[k : k + block]
        ends = np.cumsum(n)
        size = int(ends[-1])
        out[at : at + size] = data[np.repeat(starts[k : k + block] - (ends - n), n) + np.arange(size)]
        at += size
    return out


class Phrases:
    """The phrases of rows in ``text``: place and size of each, its trigger's hash and place, its own hash, its row."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray):
        empty = np.zeros(0, np.int64)
        self.text, self.start, self.size, self.left, self.row = text, empty, empty, empty, empty
        self.trigger = self.key = np.zeros(0, U64)
        n = len(text)
        if n < WIDTH:
            return
        prefix = np.zeros(n + 1, U64)
        np.cumsum((text.astype(U64) + U64(1)) * _powers[:n], out=prefix[1:])
        grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * _inverses[: n - GRAM + 1])
        ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=U64)
        place = (_sliding_least(ranked, WIDTH - GRAM + 1) & _PLACE).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.flatnonzero(row[: n - WIDTH + 1] == row[WIDTH - 1 :])
        if not len(starts):
            return
        place, row = place[starts], row[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        self.start, self.row = starts[first], row[first]
        self.size = starts[last] + WIDTH - self.start
        self.left = place[first] - self.start
        self.trigger = mix(grams[place[first]])  # the least of many hashes are small; mixed again they fill the ranges evenly
        whole = (prefix[self.start + self.size] - prefix[self.start]) * _inverses[self.start]
        self.prefix = prefix
        self.key = mix(whole + self.size.astype(U64) * U64(0xD6E8FEB86659FD93) + self.left.astype(U64) * U64(0xA0761D6478BD642F))

    def strings(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, start, hash) of each string of phrases."""
        n = self.size[k] - WIDTH + 1
        each = np.repeat(k, n)
        start = self.start[each] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return each, start, mix((self.prefix[start + WIDTH] - self.prefix[start]) * _inverses[start] + U64(WIDTH))

    def bytes_of(self, k: np.ndarray) -> np.ndarray:
        """The bytes of phrases, one after another."""
        return gather(self.text, self.start[k], self.size[k])


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, text, bytes of each row, place in the row) of pieces; a long row gives several that overlap."""
    for i, j in slices(offsets, PIECE):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= PIECE:
            yield i, data[a:b], np.diff(offsets[i : j + 1]), 0
            continue
        for at in range(a, b, PIECE):
            text = data[at : min(b, at + PIECE + WIDTH - 1)]
            yield i, text, np.array([len(text)]), at - a


def _by_range(hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, start, end) of the hash ranges in sorted hashes."""
    return runs((hashes >> U64(64 - bits)).astype(np.int64))


def _short(hashes: np.ndarray, bits: int) -> bytes:
    """The five bytes of each hash below the bits of its range."""
    return np.ascontiguousarray(hashes << U64(bits)).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(U64)[:, 0]


def _below(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes << U64(bits)) & ~U64((1 << 24) - 1)


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


class Files:
    """The files of a folder by name and range; ``parts`` says which there are."""

    def __init__(self, folder: str, bits: int, parts: dict[str, np.ndarray]):
        self.folder, self.bits, self.parts, self.open = folder, bits, parts, {}

    def get(self, name: str, part: int) -> np.ndarray:
        """The bytes of a file, mapped; a range that was never written is empty."""
        if (name, part) not in self.open:
            there = self.parts[name]
            at = int(np.searchsorted(there, part))
            found = at < len(there) and there[at] == part
            self.open[name, part] = map_blob(f"{self.folder}/{name}-{part:06d}") if found else np.zeros(0, np.uint8)
        return self.open[name, part]

    def known(self, name: str, hashes: np.ndarray) -> np.ndarray:
        """Which of the triggers are in the files ``name``."""
        order = np.argsort(hashes)
        hit = np.zeros(len(order), bool)
        for part, a, b in _by_range(hashes[order], self.bits):
            there = self.get(name, part).view(U64)
            if len(there):
                wanted = _below(hashes[order[a:b]], self.bits)
                hit[order[a:b]] = there[np.minimum(np.searchsorted(there, wanted), len(there) - 1)] == wanted
        return hit

    @staticmethod
    def written(rows: list, name: str) -> np.ndarray:
        return np.sort(np.array([r["part"] for r in rows if r["name"] == name], np.int64))


def _find_triggers(docs: DataFrame, bits: int, folder: str, hot: int) -> dict[str, np.ndarray]:
    """Write, for each hash range, the sorted triggers that more than one document has, and those with many phrases."""
    names = ["part", "once", "many", "phrases"]

    def emit(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        triggers, rows, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort([keys, triggers])
        triggers, rows, keys = triggers[order], rows[order], keys[order]
        first = np.flatnonzero(np.append(True, triggers[1:] != triggers[:-1]))
        many = np.minimum.reduceat(rows, first) != np.maximum.reduceat(rows, first)
        phrases = np.add.reduceat(np.append(True, keys[1:] != keys[:-1]).astype(np.int64), first)
        phrases = np.minimum(phrases, 65535).astype("<u2")
        triggers = triggers[first]
        parts = [(k, triggers[a:b], many[a:b], phrases[a:b]) for k, a, b in _by_range(triggers, bits)]
        columns = [pa.array([k for k, *_ in parts], pa.int32()), *(pa.array(c, pa.binary()) for c in ([_short(t[~m], bits) for _, t, m, _ in parts], [_short(t[m], bits) for _, t, m, _ in parts], [p[m].tobytes() for *_, m, p in parts]))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, text, sizes, _ in pieces(data, offsets):
                p = Phrases(text, sizes)
                if len(p.row):
                    held.append((p.trigger, p.row + i + seen, p.key))
                    size += len(p.row)
                if size > HOLD_TRIGGERS:
                    yield emit(held)
                    held, size = [], 0
            seen += len(batch.column(0))
        if held:
            yield emit(held)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        once, at_once = np.unique(np.concatenate([_long(x) for x in frame["once"]]), return_counts=True)
        # a trigger that one task has in many documents, or that another task has as well
        many, back = np.unique(np.concatenate([_long(x) for x in frame["many"]]), return_inverse=True)
        phrases = np.bincount(back, np.concatenate([np.frombuffer(x, "<u2") for x in frame["phrases"]]), len(many))
        found = np.union1d(once[at_once > 1], many)
        total = np.zeros(len(found), np.int64)
        total[np.searchsorted(found, many)] += phrases.astype(np.int64)
        again = np.isin(once, found, assume_unique=True)
        total[np.searchsorted(found, once[again])] += at_once[again]
        part = int(frame["part"].iloc[0])
        names = []
        for name, own in (("triggers", found), ("hot", found[total > hot])):
            if len(own):
                write_blob(f"{folder}/{name}-{part:06d}", own.tobytes())
                names.append(name)
        return pd.DataFrame({"part": [part] * len(names), "name": pd.Series(names, dtype=object)})

    parts = docs.mapInArrow(run, "part int, once binary, many binary, phrases binary")
    rows = parts.groupBy("part").applyInPandas(merge, "part int, name string").collect()  # two rows a range
    return {name: Files.written(rows, name) for name in ("triggers", "hot")}


def suffix_groups(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``starts`` to the depth WIDTH, and the group of equal strings of each of its places.

    Prefix doubling: ranks of 8 bytes give those of 16 and 32, and two ranks of
    32 bytes that overlap give WIDTH.
    """
    padded = np.concatenate([text, np.zeros(64, np.uint8)])
    words = np.ndarray((len(text) + 56,), ">u8", padded.tobytes(), 0, (1,))
    _, rank = np.unique(words[: len(text)].astype(U64), return_inverse=True)
    for step in (8, 16):
        after = np.append(rank[step:], np.zeros(min(step, len(rank)), rank.dtype))[: len(rank)]
        _, rank = np.unique(rank.astype(U64) << U64(32) | after.astype(U64), return_inverse=True)
    both = rank[starts].astype(U64) << U64(32) | rank[starts + WIDTH - 32].astype(U64)
    order = np.argsort(both, kind="stable")
    return order, np.cumsum(np.append(False, both[order][1:] != both[order][:-1]))


def first_documents(sizes: np.ndarray, left: np.ndarray, least: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest document of each string of each phrase: (strings of each phrase, documents, phrase).

    ``text`` holds the phrases one after another; ``least`` is the smallest
    document of each phrase as a whole.
    """
    counts = sizes - WIDTH + 1
    begin = np.cumsum(sizes) - sizes
    phrase = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
    out = least[phrase].copy()
    at = begin + left
    grams = np.ndarray((max(0, len(text) - 7),), "<u8", np.ascontiguousarray(text), 0, (1,))
    _, _, trigger = distinct(mix(grams[at] + mix(grams[at + GRAM - 8].astype(U64))))
    often = np.bincount(trigger)
    rivals = np.flatnonzero(often[trigger] > 1)  # phrases that share a trigger
    rivals = rivals[np.argsort(trigger[rivals], kind="stable")]
    ends = np.cumsum(sizes[rivals])
    last = np.append(trigger[rivals][1:] != trigger[rivals][:-1], True) if len(rivals) else np.zeros(0, bool)
    done = 0
    while done < len(rivals):  # as many triggers at a time as SORT_BYTES hold, whole
        stop = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SORT_BYTES))
        stop = min(stop, len(rivals) - 1)
        stop += int(last[stop:].argmax()) + 1
        own = rivals[done:stop]
        join = _join_many if int(sizes[own].sum()) > 2 * SORT_BYTES else _join_rivals
        join(own, sizes, left, begin, counts, least, text, out)
        done = stop
    return counts, out, phrase


def _join_rivals(rivals: np.ndarray, sizes: np.ndarray, left: np.ndarray, begin: np.ndarray, counts: np.ndarray, least: np.ndarray, text: np.ndarray, out: np.ndarray) -> None:
    """Set in ``out`` the smallest document of the strings of ``rivals``, among each other."""
    ends = np.cumsum(sizes[rivals])
    own = gather(text, begin[rivals], sizes[rivals])
    n = counts[rivals]
    place = np.arange(int(n.sum()))
    order, group = suffix_groups(own, np.repeat(ends - sizes[rivals] - (np.cumsum(n) - n), n) + place)
    docs = np.repeat(least[rivals], n)
    best = np.minimum.reduceat(docs[order], np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    docs[order] = best[group]
    out[np.repeat((np.cumsum(counts) - counts)[rivals] - (np.cumsum(n) - n), n) + place] = docs


def _join_many(rivals: np.ndarray, sizes: np.ndarray, left: np.ndarray, begin: np.ndarray, counts: np.ndarray, least: np.ndarray, text: np.ndarray, out: np.ndarray) -> None:
    """The same for the many rivals of one frequent trigger, a place of the trigger at a time.

    Equal strings have their trigger at the same place, so each place sorts one
    string of each phrase.
    """
    base = np.cumsum(counts) - counts
    for place in range(WIDTH - GRAM + 1):
        string = left[rivals] - place  # the string that has the trigger there
        own = (string >= 0) & (string < counts[rivals])
        k, string = rivals[own], string[own]
        if not len(k):
            continue
        rows = np.ascontiguousarray(text[(begin[k] + string)[:, None] + np.arange(WIDTH)]).view(f"V{WIDTH}")[:, 0]
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        best = np.minimum.reduceat(least[k][order], first)
        out[(base[k] + string)[order]] = np.repeat(best, np.diff(np.append(first, len(k))))


def _write_dictionary(docs: DataFrame, bits: int, folder: str, triggers: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Write, for each hash range, the phrases that a larger document has as well, with their first documents; and likewise the strings of hot triggers."""
    names = ["name", "part", "blob"]

    def emit_strings(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        h, least, most = _extremes(h, doc, doc)
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [(k, pack(np.stack([h[a:b].view(np.int64), least[a:b], most[a:b]]).tobytes())) for k, a, b in _by_range(h, bits)]
        return pa.RecordBatch.from_arrays([pa.array(["strings"] * len(parts)), pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=names)

    def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        trigger, key, left, size, doc = (np.concatenate(x) for x in list(zip(*held, strict=True))[:5])
        text = np.concatenate([x[5] for x in held])
        begin = np.cumsum(size) - size
        order = np.lexsort([key, trigger >> U64(64 - bits)])
        new = np.append(True, key[order][1:] != key[order][:-1])
        first = np.flatnonzero(new)
        least, most = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
        k = order[first]
        pack = zstandard.ZstdCompressor(level=1).compress
        parts, blobs = [], []
        for part, a, b in _by_range(trigger[k], bits):
            own = k[a:b]
            raw = gather(text, begin[own], size[own])
            parts.append(part)
            blobs.append(pack(b"".join([np.int64(b - a).tobytes(), key[own].tobytes(), least[a:b].tobytes(), most[a:b].tobytes(), left[own].astype(np.uint8).tobytes(), size[own].astype(np.uint8).tobytes(), raw.tobytes()])))
        yield pa.RecordBatch.from_arrays([pa.array(["phrases"] * len(parts)), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, strings, n_strings, files = [], 0, [], 0, Files(folder, bits, triggers)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = _ids(batch.column(0))
            for i, text, sizes, _ in pieces(data, offsets):
                p = Phrases(text, sizes)
                hit = files.known("triggers", p.trigger)
                hot = hit & files.known("hot", p.trigger) if len(triggers["hot"]) else np.zeros(len(hit), bool)
                k = np.flatnonzero(hit & ~hot)
                if len(k):
                    held.append((p.trigger[k], p.key[k], p.left[k], p.size[k], ids[p.row[k] + i], p.bytes_of(k)))
                    size += int(p.size[k].sum())
                if size > HOLD_BYTES:
                    yield from emit(held)
                    held, size = [], 0
                if hot.any():
                    each, _, h = p.strings(np.flatnonzero(hot))
                    strings.append((h, ids[p.row[each] + i]))
                    n_strings += len(h)
                if n_strings > HOLD_BYTES // 16:
                    yield emit_strings(strings)
                    strings, n_strings = [], 0
        if held:
            yield from emit(held)
        if strings:
            yield emit_strings(strings)

    def merge_strings(frame: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompressobj
        rows = np.concatenate([np.frombuffer(unpack().decompress(x), np.int64).reshape(3, -1) for x in frame["blob"]], axis=1)
        h, least, most = _extremes(rows[0].view(U64), rows[1], rows[2])
        use, part = least < most, int(frame["part"].iloc[0])
        write_blob(f"{folder}/strings-{part:06d}", h[use].tobytes() + least[use].tobytes())
        return pd.DataFrame({"part": [part], "name": ["strings"]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["name"].iloc[0] == "strings":
            return merge_strings(frame)
        unpack = zstandard.ZstdDecompressor().decompressobj
        columns = [[] for _ in range(6)]
        for blob in frame["blob"]:
            raw = unpack().decompress(blob)
            n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
            for column, kind in zip(columns, (U64, np.int64, np.int64, np.uint8, np.uint8), strict=False):
                column.append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            columns[5].append(np.frombuffer(raw, np.uint8, -1, at))
        key, least, most, left, size, text = (np.concatenate(c) for c in columns)
        del columns, raw
        left, size = left.astype(np.int64), size.astype(np.int64)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        least, most = np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)
        k = order[first]
        text = gather(text, (np.cumsum(size) - size)[k], size[k])
        part = int(frame["part"].iloc[0])
        write_blob(f"{folder}/phrases-{part:06d}", _pack_phrases(key[k], most, *first_documents(size[k], left[k], least, text)))
        return pd.DataFrame({"part": [part], "name": ["phrases"]})

    parts = docs.mapInArrow(run, "name string, part int, blob binary")
    rows = parts.groupBy("name", "part").applyInPandas(merge, "part int, name string").collect()  # a row for each range
    return {name: Files.written(rows, name) for name in ("phrases", "strings")}


def _extremes(keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys with their least and most values."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    return keys[order][first], np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)


def _pack_phrases(key: np.ndarray, most: np.ndarray, counts: np.ndarray, docs: np.ndarray, phrase: np.ndarray) -> bytes:
    """Sorted keys with the runs of strings of one first document; phrases that nothing is removed from are left out."""
    begin = np.cumsum(counts) - counts
    use = np.minimum.reduceat(docs, begin) < most
    new = np.append(True, (phrase[1:] != phrase[:-1]) | (docs[1:] != docs[:-1])) & use[phrase]
    at = np.flatnonzero(new)
    runs = np.bincount(phrase[at], minlength=len(key))[use]
    place = (at - begin[phrase[at]]).astype(np.uint8)
    head = np.array([int(use.sum()), len(at)], np.int64)
    pointers = np.append(0, np.cumsum(runs)).astype(np.int64)
    return b"".join([head.tobytes(), key[use].tobytes(), pointers.tobytes(), docs[at].tobytes(), place.tobytes()])


def _unpack_phrases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, U64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    n, runs = (int(x) for x in data[:16].view(np.int64))
    a, b, c = 16 + 8 * n, 24 + 16 * n, 24 + 16 * n + 8 * runs
    return data[16:a].view(U64), data[a:b].view(np.int64), data[b:c].view(np.int64), data[c : c + runs]


def _removed(p: Phrases, own: np.ndarray, bits: int, files: Files, lookup) -> np.ndarray:
    """(row, start, end) of the bytes to remove; ``own`` has the document of each row."""
    hot = files.known("hot", p.trigger) if len(files.parts["hot"]) else np.zeros(len(p.trigger), bool)
    order = np.lexsort([p.key, p.trigger >> U64(64 - bits)])
    order = order[~hot[order]]
    found = [np.zeros((0, 3), np.int64)]
    if hot.any():
        each, start, h = p.strings(np.flatnonzero(hot))
        by = np.argsort(h)
        for part, a, b in _by_range(h[by], bits):
            keys, least = np.split(files.get("strings", part).view(np.int64), 2)
            if len(keys):
                k = by[a:b]
                where = np.minimum(np.searchsorted(keys.view(U64), h[k]), len(keys) - 1)
                k = k[(keys.view(U64)[where] == h[k]) & (least[where] < own[p.row[each[k]]])]
                found.append(np.stack([p.row[each[k]], start[k], start[k] + WIDTH], 1))
    for part, a, b in _by_range(p.trigger[order], bits):
        keys, pointers, docs, places = lookup(part)
        if not len(keys):
            continue
        k = order[a:b]
        where = np.minimum(np.searchsorted(keys, p.key[k]), len(keys) - 1)
        hit = keys[where] == p.key[k]
        k, where = k[hit], where[hit]
        if not len(k):
            continue
        runs = pointers[where + 1] - pointers[where]
        each = np.repeat(np.arange(len(k)), runs)
        run = np.repeat(pointers[where] - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
        begin = places[run].astype(np.int64)
        end = np.append(begin[1:], 0)
        last = np.append(each[1:] != each[:-1], True)
        end = np.where(last, p.size[k][each] - WIDTH + 1, end)
        take = docs[run] < own[p.row[k][each]]
        start = p.start[k][each]
        found.append(np.stack([p.row[k][each], start + begin, start + end - 1 + WIDTH], 1)[take])
    return np.concatenate(found)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", kept_text: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row; with ``kept_text`` what is left, as binary."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    bits = max(4, min(24, (max(1, rows.count() // ROWS_PER_RANGE)).bit_length()))
    folder = new_path(spark, "passages")
    parts = _find_triggers(rows, bits, folder, hot)
    none = np.zeros(0, np.int64)
    parts |= _write_dictionary(rows, bits, folder, parts) if len(parts["triggers"]) else {"phrases": none, "strings": none}
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * kept_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder, bits, parts)
        opened: dict[int, tuple] = {}

        def lookup(part: int) -> tuple:
            if part not in opened:
                opened[part] = _unpack_phrases(files.get("phrases", part))
            return opened[part]

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids, n = _ids(batch.column(0)), len(batch.column(0))
            found = [np.zeros((0, 3), np.int64)]
            for i, piece, sizes, place in pieces(data, offsets):
                spans = _removed(Phrases(piece, sizes), ids[i : i + len(sizes)], bits, files, lookup)
                spans[:, 0] += i
                spans[:, 1:] += int(offsets[i]) + place  # places in the whole batch
                found.append(spans)
            spans = np.concatenate(found)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            at = np.searchsorted(spans[:, 0], np.arange(n + 1))
            out = [[], [], [], [], []]
            for r in range(n):
                raw = data[offsets[r] : offsets[r + 1]]
                mine = spans[at[r] : at[r + 1], 1:] - int(offsets[r])
                if len(mine):
                    change = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(change, mine[:, 0], 1)
                    np.add.at(change, mine[:, 1], -1)
                    gone = np.cumsum(change[:-1]) > 0
                    left = raw[~gone].tobytes()
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                else:
                    left, n_spans = raw.tobytes(), 0
                for column, value in zip(out, (len(raw), len(raw) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left), strict=True):
                    column.append(value)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(out[4], pa.binary())] * kept_text, names=names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_text
    return rows.mapInArrow(run, schema)
