"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: words lower-cased, and typed
placeholders for numbers, names (capitalised words inside a sentence) and
units.  Windows of ``WINDOW`` tokens with at least ``LITERALS`` literal words
are hashed.  A Bloom filter of fixed size, made of the benchmark's windows,
lets only the few matching windows of a document leave its task; those join
the benchmark's windows by hash.  A document holds an item if enough of the
item's windows meet with consistent slots: each value in a slot of the item
stands for one value in the document throughout, so a question asked again
with other numbers or names is caught and a chance mix of values is not.

Defined results: null and empty texts hold nothing.  An item with fewer tokens
than a window is one window by itself, met anywhere in a document of a window
or more; a shorter document is compared with it whole.  An item without a window of enough literal words has all its windows; a window
without any literal word, as a row of numbers, is met by its own values only.
Rows are judged apart, also those with equal ids or none, but
``drop_contaminated`` leaves rows without an id where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize, without_ids
from tidemark.llm.textkit import U64, hash_runs, mix, slices, utf8

WINDOW = 8
LITERALS = 4
#: A document holds an item from so many matched windows on, or from half of the item's windows, whichever is less.
MATCHED = 6
FILTER_BITS = 23
BROADCAST_WINDOWS = 200_000
UNITS = "% km m cm mm mi mile miles ft feet inch inches kg g mg lb lbs oz ton tons l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh dollar dollars cent cents euro euros pound pounds usd eur gbp percent degree degrees celsius fahrenheit".split()

NUMBER, NAME, UNIT = (mix(np.array([k], U64))[0] for k in (101, 102, 103))
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_WORD[37] = True  # the percent sign is a unit
_ENDS = np.zeros(256, bool)
_ENDS[[10, 13, 33, 46, 58, 59, 63]] = True
_HASHED_UNITS = np.sort(hash_runs(np.frombuffer("".join(UNITS).encode(), np.uint8), np.array([len(u) for u in UNITS])))


class Template:
    """The template tokens of rows i..j: ``codes`` with a hash each, ``row``, ``slot`` (no literal), and their places in ``text``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int):
        at = offsets[i : j + 1]
        n, total = j - i, int(at[-1] - at[0])
        text = np.full(total + n + 1, 10, np.uint8)
        for k in range(n):
            a, b = int(at[k] - at[0]), int(at[k + 1] - at[0])
            text[a + k + 1 : b + k + 1] = data[at[k] : at[k + 1]]
        inside = _WORD[text]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        lower = text.copy()
        big = (text >= 65) & (text <= 90)
        accented = np.zeros(len(text), bool)
        accented[1:] = (text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[1:] != 0x97)
        lower[big | accented] += 32
        lengths = ends - starts
        codes = hash_runs(lower[inside], lengths)
        digit = (text >= 48) & (text <= 57)
        digits = np.add.reduceat(digit[inside].astype(np.int64), np.cumsum(lengths) - lengths) if len(lengths) else lengths
        number = digits == lengths
        unit = np.isin(codes, _HASHED_UNITS)
        stop = np.cumsum(_ENDS[text])
        opens = np.ones(len(starts), bool)
        opens[1:] = stop[starts[1:] - 1] != stop[ends[:-1] - 1]  # a sentence ends before it
        lead = text[starts] == 0xC3
        first = np.where(lead, accented[np.minimum(starts + 1, len(text) - 1)], big[starts])
        second = starts + np.where(lead, 2, 1)
        inner = (second < ends) & ~(big | accented)[np.minimum(second, len(text) - 1)]
        name = first & inner & ~opens
        # units count only after a number
        unit &= np.append(False, number[:-1]) if len(number) else unit
        codes = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, codes)))
        row = np.searchsorted(at[:-1] - at[0] + np.arange(n) + 1, starts, "right") - 1
        again = np.zeros(len(codes), bool)  # 3.5 and 1,000 are one number
        again[1:] = number[1:] & number[:-1] & (row[1:] == row[:-1]) & (starts[1:] == ends[:-1] + 1)
        keep = ~again
        last = np.append(np.flatnonzero(keep)[1:], len(codes)) - 1 if len(codes) else np.zeros(0, int)
        self.text, self.starts, self.ends = lower, starts[keep], ends[last]
        self.codes, self.row, self.slot = codes[keep], row[keep], (number | unit | name)[keep]
        self.counts = np.bincount(self.row, minlength=n)

    def windows(self, lengths: frozenset[int] | None = None, dense: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first token, tokens, hash, literal words) of each window.

        Without ``lengths`` the rows are items: a shorter row is a window, and
        a row without a window of enough literal words has all.  With them the
        rows are documents: windows of those lengths are taken too, and all
        windows if ``dense``.
        """
        at = np.arange(len(self.codes))
        end = np.repeat(np.cumsum(self.counts), self.counts)
        literal = np.append(0, np.cumsum(~self.slot))
        h, found = np.zeros(len(at), U64), []
        for size in range(1, WINDOW + 1):
            fits = at + size <= end[at]
            at, h = at[fits], h[fits]
            h = mix(h * U64(0x9E3779B97F4A7C15) + self.codes[at + size - 1])
            words = literal[at + size] - literal[at]
            if size == WINDOW:
                keep = words >= LITERALS
                if lengths is None:
                    keep |= (np.bincount(self.row[at[keep]], minlength=len(self.counts)) == 0)[self.row[at]]
                elif dense:
                    keep[:] = True
            elif lengths is None:
                keep = self.counts[self.row[at]] == size
            elif size in lengths:
                keep = (self.counts[self.row[at]] >= WINDOW) | (self.counts[self.row[at]] == size)
            else:
                continue
            found.append((at[keep], np.full(int(keep.sum()), size), h[keep], words[keep]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def slots(self, first: int, size: int) -> list[str]:
        """The values in the slots of a window."""
        return [self.text[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace") for k in range(first, first + size) if self.slot[k]]


def row_key(row_id: str, text: str) -> Column:
    """What tells rows apart that have equal ids or none."""
    return F.xxhash64(F.col(row_id).cast("string"), F.col(row_id).isNull(), F.col(text).cast("string"))


def benchmark_windows(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(h, item, item_id, place, slots, size, literals, n_windows): every window of every item; ``item`` tells items apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in slices(offsets):
                t = Template(data, offsets, i, j)
                first, sizes, h, literals = t.windows()
                row = t.row[first] if len(first) else np.zeros(0, int)
                counts = np.bincount(row, minlength=1)
                keys, ids = (batch.column(c).slice(i, j - i).take(pa.array(row)) for c in (0, 1))
                slots = [t.slots(a, m) for a, m in zip(first, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), keys, ids, pa.array(first, pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(sizes, pa.int32()), pa.array(literals, pa.int32()), pa.array(counts[row], pa.int64())], names=["h", "item", "item_id", "place", "slots", "size", "literals", "n_windows"])

    kind = items.schema[item_id].dataType.simpleString()
    rows = items.select(row_key(item_id, text).alias("item"), F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    return rows.mapInArrow(run, f"h long, item long, item_id {kind}, place long, slots array<string>, size int, literals int, n_windows long")


def window_filter(windows: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes: 2^FILTER_BITS bits however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for k in filter_bits(batch.column(0).to_numpy(zero_copy_only=False).view(U64)):
                bits[k] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    parts = windows.select("h").coalesce(8).mapInArrow(run, "bits binary").collect()  # eight at most, of a fixed size
    out = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for p in parts:
        out |= np.frombuffer(p["bits"], np.uint8)
    return out


def filter_bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> U64(64 - FILTER_BITS)).astype(np.int64), (h >> U64(4) & U64((1 << FILTER_BITS) - 1)).astype(np.int64)


def matching_windows(docs: DataFrame, bits: np.ndarray, lengths: frozenset[int], dense: bool, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, h, slots): the windows of each document that pass the filter."""

    def passes(h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for k in filter_bits(h):
            out &= (bits[k >> 3] >> (7 - (k & 7)) & 1).astype(bool)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                t = Template(data, offsets, i, j)
                first, sizes, h, _ = t.windows(lengths, dense)
                hit = np.flatnonzero(passes(h))
                if len(hit):
                    ids = batch.column(0).slice(i, j - i).take(pa.array(t.row[first[hit]]))
                    slots = [t.slots(first[k], sizes[k]) for k in hit]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(h[hit].view(np.int64)), pa.array(slots, pa.list_(pa.string()))], names=["doc_id", "h", "slots"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, h long, slots array<string>")


def held_items(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item, item_id, matched, n_windows): the items that a document holds."""
    windows = materialize(benchmark_windows(items), "benchmark")
    bits = window_filter(windows)
    kinds = windows.select("size", (F.col("literals") < LITERALS).alias("dense")).distinct().collect()  # 16 at most
    lengths = frozenset(r["size"] for r in kinds if r["size"] < WINDOW)
    dense = any(r["dense"] for r in kinds if r["size"] == WINDOW)
    hits = materialize(matching_windows(docs, bits, lengths, dense, text, doc_id), "windows")
    hits = hits.groupBy("doc_id", "h", F.array_join("slots", "\x1f").alias("values")).agg(F.first("slots").alias("slots"))
    side = windows.withColumnRenamed("slots", "asked")
    if windows.count() <= BROADCAST_WINDOWS:
        side = F.broadcast(side)
    met = hits.join(side, "h").withColumn("pairs", F.arrays_zip("asked", "slots"))
    # within one window a value asked stands for one value in the document
    met = met.where(F.size(F.array_distinct("pairs")) == F.size(F.array_distinct("asked"))).where("literals > 0 OR asked = slots").select("doc_id", "item", "item_id", "place", "n_windows", "pairs")
    counts = met.groupBy("doc_id", "item").agg(F.first("item_id").alias("item_id"), F.count_distinct("place").alias("matched"), F.first("n_windows").alias("n_windows"))
    values = met.select("doc_id", "item", F.explode("pairs").alias("p")).groupBy("doc_id", "item", F.col("p.asked").alias("asked")).agg(F.count_distinct("p.slots").alias("values"))
    slots = values.groupBy("doc_id", "item").agg(F.count("*").alias("n_slots"), F.sum((F.col("values") == 1).cast("int")).alias("consistent"))
    found = counts.join(slots, ["doc_id", "item"], "left").where("n_slots IS NULL OR 2 * consistent >= n_slots")
    return found.where(F.col("matched") >= F.least(F.lit(MATCHED), F.ceil(F.col("n_windows") / 2))).select("doc_id", "item", "item_id", "matched", "n_windows")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, n_windows) for every row of ``docs``."""
    found = held_items(docs.withColumn("__row", row_key(doc_id, text)), items, text, "__row")
    item = F.coalesce(F.col("item_id").cast("string"), F.concat(F.lit("\0"), F.col("item").cast("string")))
    by_doc = materialize(found.groupBy(F.col("doc_id").alias("__of")).agg(F.count_distinct(item).alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sum("matched").alias("n_windows")), "held")
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("__row")).join(by_doc, F.col("__row") == F.col("__of"), "left")
    none = F.lit(0).cast("long")
    return rows.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("item_ids", F.array().cast(found.select(F.array("item_id")).dtypes[0][1])).alias("item_ids"), F.coalesce("n_windows", none).alias("n_windows"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    rows = docs.withColumn("__row", row_key(doc_id, text))
    found = materialize(held_items(rows.where(F.col(doc_id).isNotNull()), items, text, "__row").select("doc_id").distinct(), "held")
    return without_ids(rows, found, "__row").drop("__row")
