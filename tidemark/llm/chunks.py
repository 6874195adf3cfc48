"""Texts cut into chunks that a tokenizer treats apart, each distinct chunk encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tidemark.llm.textkit import U64, distinct, hash_runs


class ChunkIds:
    """Ids of chunks by the hash of their bytes, kept in a worker between batches.

    ``encode`` gives the ids of distinct chunks, as one array and a length
    each.  The store is emptied when it holds over ``limit`` chunks.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 1_500_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.starts, self.lengths = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def lookup(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks data[cuts[k]:cuts[k+1]], joined, and the number of ids of each chunk."""
        lengths = np.diff(cuts)
        if not len(lengths):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        hashes = hash_runs(data[cuts[0] : cuts[-1]], lengths)
        wanted, first, back = distinct(hashes)
        if len(self.hashes) + len(wanted) > self.limit:
            self.clear()
        at = np.searchsorted(self.hashes, wanted)
        known = np.zeros(len(wanted), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == wanted
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            ids, counts = self.encode([raw[cuts[k] : cuts[k + 1]] for k in first[new]])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), np.int32)])
            self.pool[self.used : self.used + len(ids)] = ids
            starts = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            self.hashes = np.insert(self.hashes, at[new], wanted[new])
            self.starts, self.lengths = np.insert(self.starts, at[new], starts), np.insert(self.lengths, at[new], counts)
            at = np.searchsorted(self.hashes, wanted)
        starts, counts = self.starts[at][back], self.lengths[at][back]
        ends = np.cumsum(counts)
        return self.pool[np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]))], counts


def cut(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk borders of rows: ``marks`` (places to cut before) and every row's own; and the chunks of each row.

    ``data`` holds the rows one after another from place zero.
    """
    flags = np.zeros(len(data), bool)
    flags[marks] = True
    flags[offsets[:-1][np.diff(offsets) > 0]] = True
    borders = np.flatnonzero(flags)
    cuts = np.append(borders, len(data))
    return cuts, np.diff(np.searchsorted(borders, offsets))
