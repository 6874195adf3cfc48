"""Array kernels over the UTF-8 bytes of Arrow string columns, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, element by element."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_multipliers = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def multipliers(n: int) -> np.ndarray:
    """At least ``n`` fixed odd multipliers, one for each place in a word."""
    global _multipliers
    if len(_multipliers) < n:
        _multipliers = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    return _multipliers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of rows i..j: maximal runs without ASCII white space, A-Z lower-cased.

    ``hashes`` has a 64-bit hash of each word and ``row`` its row, counted
    from i; ``counts`` has the number of words of each row.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, lower: bool = True):
        at = offsets[i : j + 1]
        n, total = j - i, int(at[-1] - at[0])
        text = np.full(total + n + 1, 32, np.uint8)  # a space before, between and after the rows
        for k in range(n):
            a, b = int(at[k]), int(at[k + 1])
            text[a - int(at[0]) + k + 1 : b - int(at[0]) + k + 1] = data[a:b]
        inside = ~SPACE[text]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.text, self.starts, self.ends = text, edge[0::2], edge[1::2]
        row_starts = at[:-1] - at[0] + np.arange(n) + 1
        self.row_starts = row_starts
        self.counts = np.diff(np.append(np.searchsorted(self.starts, row_starts), len(self.starts)))
        self.row = np.repeat(np.arange(n), self.counts)
        letters = LOWER[text[inside]] if lower else text[inside]
        self.letters, self.lengths = letters, self.ends - self.starts
        self.hashes = hash_runs(letters, self.lengths)


def hash_runs(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the runs (none empty) that make up ``data``."""
    if not len(lengths):
        return np.zeros(0, U64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    products = (data.astype(U64) + U64(1)) * multipliers(int(lengths.max()))[place]
    return mix(np.add.reduceat(products, starts) + lengths.astype(U64))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each of the runs, of ``counts`` values, that make up ``values``."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, place of the first of each, number of the value at each place), by hashing."""
    codes, found = pd.factorize(values)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    order = np.argsort(found)
    number = np.empty(len(found), np.int64)
    number[order] = np.arange(len(found))
    return found[order], first[order], number[codes]


def runs(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, start, end) of each run of equal values in ``parts``."""
    if not len(parts):
        return []
    first = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
    return list(zip(parts[first].tolist(), first.tolist(), [*first[1:].tolist(), len(parts)], strict=True))
