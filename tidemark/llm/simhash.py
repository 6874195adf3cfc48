"""SimHash near-dedup with covering locality-sensitive hashing.

The fingerprint of a text has bit i set if bit i is set in over half of the
XXH64 hashes (seed 42) of its word shingles.  Two fingerprints within
``radius`` bits are linked.  For the links every fingerprint is masked by
2^(radius+1)-1 structured bit masks: bit position i has a vector m(i) of
radius+1 bits, and mask v keeps the positions with odd parity of m(i) & v.
Any ``radius`` positions leave some v orthogonal to their vectors, so a pair
within the radius agrees under that mask: it meets in some table, always.

Copies collapse first: tables hold distinct fingerprints.  A bucket with more
than ``BUCKET`` fingerprints is masked again over its remaining bits, by the
same construction, so that it splits without losing a pair; after the second
split a bucket of a 64-bit fingerprint has few bits left to differ in.  A
bucket yields a spanning forest of its links, never all its pairs, and star
contraction joins the forests to components.

Defined results: words are lower-cased in A-Z and split at [\\x20\\x09-\\x0D];
with fewer words than a shingle the whole sequence is the one shingle; null,
empty and blank texts have fingerprint zero and link like any other.  Rows
that share an id share its component; a row with null id gets the smallest
id it reaches, or null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.storage import map_blob, materialize, new_path, small, without_ids, write_blob
from tidemark.llm.textkit import mix, runs

SEED = 42
#: Fingerprints that one task compares within a bucket.
BUCKET = 2048
LEVELS = 3
#: A block of shingle counts is of about 2^this many bytes of text.
COUNT_BYTES = 24
#: Shingles that a task counts or looks up at once, and those of one more document.
TOGETHER = 1 << 19
#: Prefix shingles are compared in rounds, one in so many: the first joins large groups at little cost.
ROUNDS = (16, 1)
#: A block of a filter has 2^this many hashes or fewer, expected.
FILTER_TOKENS = 20
#: Sets of fewer shingles are compared whatever their wide fingerprints say.
FEW = 64


def spread_table() -> np.ndarray:
    """For each byte, its bits, lowest first, in the eight bytes of a word."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return bits.astype(np.uint8).view("<u8")[:, 0]


def majority(hashes: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """For each column of ``hashes``, the bits set in over half of its rows."""
    n, width = hashes.shape
    ones = np.zeros(64 * width, np.int64)
    for k in range(0, n, 255):  # a byte holds a sum of up to 255 bits
        block = np.ascontiguousarray(hashes[k : k + 255]).astype("<u8", copy=False)
        ones += spread[block.view(np.uint8)].sum(0).view(np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8") if n else np.zeros(width, np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 of each shingle, repeats included."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        return np.array([digest(b" ".join(found), SEED)], np.uint64)
    return np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(found[k:] for k in range(words)), strict=False)), np.uint64)


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = spread_table()
        for batch in batches:
            fps = np.array([majority(shingle_hashes(t.as_py(), words)[:, None], spread)[0] for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """2^(radius+1)-1 masks over ``positions``: any ``radius`` of them are all outside some mask."""
    n = 1 << (radius + 1)
    vectors = {p: 1 + k % (n - 1) for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vectors[p] & v).bit_count() & 1) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_rows(radius: int, levels: int = LEVELS) -> list[tuple[int, int, int]]:
    """(parent, number, mask) for the masks of each level; the first level has parent 0.

    The mask of a later level holds the bits of its parent as well.
    """
    rows, parents, number = [], [(0, 0)], 1
    for _ in range(levels):
        found = []
        for parent, held in parents:
            left = [i for i in range(64) if not held >> i & 1]
            for mask in covering_masks(left, radius):
                rows.append((parent, number, _signed(held | mask)))
                found.append((number, held | mask))
                number += 1
        parents = found
        if len(rows) > 5000:
            break
    return rows


def forest(near: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, block: int = 128) -> np.ndarray:
    """For each of n rows the first row that it reaches by links.

    ``near(rows, front)`` says which of ``rows`` are linked to any of ``front``.
    """
    root, todo = np.arange(n), np.arange(n)
    while len(todo):
        start, front, todo = todo[0], todo[:1], todo[1:]
        while len(front) and len(todo):  # breadth first, in blocks
            hit = np.zeros(len(todo), bool)
            for k in range(0, len(front), block):
                rest = np.flatnonzero(~hit)
                hit[rest] = near(todo[rest], front[k : k + block])
            front, todo = todo[hit], todo[~hit]
            root[front] = start
    return root


def within(fps: np.ndarray, radius: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Links of fingerprints that differ in at most ``radius`` bits."""
    return lambda rows, front: (np.bitwise_count(fps[rows][:, None] ^ fps[front][None, :]) <= radius).any(1)


def similar(wide: np.ndarray, sizes: np.ndarray, least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Links of shingle sets whose Jaccard similarity, estimated from wide fingerprints, is ``least`` or more."""
    bits = wide.shape[1] * 64

    def near(rows: np.ndarray, front: np.ndarray) -> np.ndarray:
        differ = sum(np.bitwise_count(wide[rows, k][:, None] ^ wide[front, k][None, :]).astype(np.int32) for k in range(wide.shape[1]))
        a, b = sizes[rows][:, None].astype(float), sizes[front][None, :].astype(float)
        shared = np.minimum(np.cos(np.pi * differ / bits) * np.sqrt(a * b), np.minimum(a, b))
        return (shared >= least * (a + b - shared)).any(1)

    return near


def _buckets(rows: DataFrame, masks: list[tuple[int, int, int]], first: bool) -> DataFrame:
    """The rows of one level dealt to the buckets of the next."""
    kept = [c for c in rows.columns if c != "mask"]
    if first:
        each = F.array(*(F.struct(F.lit(n).alias("number"), F.lit(b).alias("bits")) for parent, n, b in masks if parent == 0))
        keyed = rows.select(*kept, F.explode(each).alias("m")).select(*kept, "m.*")
    else:  # a mask has a fixed number of masks below it
        below = rows.sparkSession.createDataFrame(masks, "parent int, number int, bits long")
        keyed = rows.join(F.broadcast(below), rows["mask"] == below["parent"])
    return keyed.select(*kept, F.col("number").alias("mask"), F.col("fp").bitwiseAND(F.col("bits").cast("long")).alias("key"))


def links(rows: DataFrame, radius: int = 3, bucket: int = BUCKET, similarity: float | None = None) -> DataFrame:
    """(a, b): links that join the ``rep`` of all rows (print, fp, rep) that reach each other.

    Rows meet if their fingerprints with the same ``print`` number are within
    ``radius`` bits, and are linked by that, or with ``similarity`` by their
    columns ``wide`` and ``size``.  Every ``rep`` has a row with print 0.
    """
    all_masks = mask_rows(radius)
    parents = {p for p, _, _ in all_masks}
    held = ["fp", "rep"] if similarity is None else ["rep", "wide", "size"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for members in frame["members"]:
                members = sorted(members, key=lambda m: m["rep"])
                reps = np.array([m["rep"] for m in members], np.int64)
                if similarity is None:
                    near = within(np.array([m["fp"] for m in members], np.int64).view(np.uint64), radius)
                else:
                    wide = np.array([np.frombuffer(m["wide"], np.uint64) for m in members])
                    near = similar(wide, np.array([m["size"] for m in members]), similarity)
                root = forest(near, len(reps))
                own = root != np.arange(len(reps))
                yield pd.DataFrame({"a": reps[own], "b": reps[root[own]]})

    # wide fingerprints join only those rows that meet others
    sketches = None if similarity is None else rows.where("print = 0").select("rep", "wide", "size")
    level, found = rows.select("print", "fp", "rep", F.lit(0).alias("mask")), []
    while True:
        keyed = _buckets(level, all_masks, not found)
        sizes = materialize(keyed.groupBy("print", "mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        large = sizes.where(F.col("n") > bucket).select("mask").distinct().collect()  # masks, a fixed number
        last = not parents & {r["mask"] for r in large}
        met = materialize(keyed.join(small(sizes), ["print", "mask", "key"]), "buckets")
        own = met if last else met.where(F.col("n") <= bucket)
        own = own if sketches is None else own.join(sketches, "rep")
        members = F.collect_list(F.struct(*held)).alias("members")
        found.append(own.groupBy("print", "mask", "key").agg(members).select("members").mapInPandas(run, "a long, b long"))
        if last:
            break
        level = met.where(F.col("n") > bucket).select("print", "fp", "rep", "mask")
    out = found[0]
    for df in found[1:]:
        out = out.unionAll(df)
    return out.distinct()


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, text: str = "text", doc_id: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    prints = materialize(fingerprints(docs, words, text, doc_id), "simhash")
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash")
    joined = components(links(fps.where("rep IS NOT NULL").withColumn("print", F.lit(0)), radius, bucket))
    classes = fps.join(joined, fps["rep"] == joined["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def prefix_size(size: int, similarity: float) -> int:
    """Of so many elements in one order two sets of that similarity always share one."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers under 2^32, their low bytes first, then the others; the zeros among those pack well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


@dataclass(frozen=True)
class Counts:
    """The number of documents that hold each cell of shingle hashes, those of equal ``bits`` highest bits, in files by block that workers map."""

    folder: str
    bits: int  # the lowest 32 of them number a cell within its block
    there: frozenset[int]

    def of(self, shingles: np.ndarray, maps: dict[int, np.ndarray]) -> np.ndarray:
        """The count of each of the hashes, 1 for what no file has; ``maps`` keeps the files."""
        cells = shingles >> np.uint64(64 - self.bits)
        order = np.argsort(cells)
        cells, out = cells[order], np.ones(len(cells), np.uint32)
        for block, i, j in runs(cells >> np.uint64(32)):
            if block not in self.there:
                continue
            if block not in maps:
                maps[block] = map_blob(f"{self.folder}/block-{block:08d}").view("<u4")
            held, often = np.split(maps[block], 2)
            if len(held):
                own = cells[i:j].astype("<u4")
                at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                out[order[i:j]] = np.where(held[at] == own, often[at], 1)
        return out


def shingle_counts(docs: DataFrame, words: int, text: str = "text") -> Counts:
    """How many of all documents hold each shingle, counted by cells of its hash.

    There are 2^32 cells to a block and blocks in proportion to the text, so
    next to no shingles share a cell.  A task adds up what it holds of a cell
    before the shuffle, which has the gaps between cells.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = 32 + max(6, (size >> COUNT_BYTES).bit_length())
    folder = new_path(spark, "counts")

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        cells, n = np.unique(np.concatenate(held), return_counts=True)
        parts, own = runs(cells >> np.uint64(32)), cells.astype(np.uint32)
        gaps = [_planes(np.diff(own[i:j], prepend=np.uint32(0))) for _, i, j in parts]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int64()), pa.array(gaps, pa.binary()), pa.array([_planes(n[i:j]) for _, i, j in parts], pa.binary())], names=["block", "gaps", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for t in batch.column(0):
                held.append(np.unique(shingle_hashes(t.as_py(), words) >> np.uint64(64 - bits)))
                n += len(held[-1])
                if n >= TOGETHER:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["block"].iloc[0])
        cells = np.concatenate([np.cumsum(_from_planes(g), dtype=np.uint32) for g in frame["gaps"]])
        n = np.concatenate([_from_planes(g) for g in frame["n"]])
        order = np.argsort(cells)
        cells, n = cells[order], n[order]
        first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        cells, n = cells[first], np.add.reduceat(n, first)
        several = n > 1
        write_blob(f"{folder}/block-{block:08d}", np.concatenate([cells[several], n[several]]).astype("<u4").tobytes())
        return pd.DataFrame({"block": [block]})

    filled = rows.mapInArrow(count, "block long, gaps binary, n binary").groupBy("block").applyInPandas(fill, "block long")
    return Counts(folder, bits, frozenset(r["block"] for r in filled.collect()))  # a number for each file


def sketches(docs: DataFrame, words: int, prints: int, similarity: float, wide_words: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, fps, wide, size, prefix) of each row.

    ``key`` names the set of shingles; there are ``prints`` fingerprints of the
    set of words and a wide one of the set of shingles; ``prefix`` has the
    shingles that come first, those of few documents before those of many.
    """
    seeds = mix(np.arange(1, max(prints, wide_words) + 1, dtype=np.uint64))
    counts = shingle_counts(docs, words, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread, maps = spread_table(), {}
        long = pa.list_(pa.int64())
        for batch in batches:
            for i, j, sets in together(batch.column(1)):
                keys, fps, wides, prefixes = [], [], [], []
                sizes = np.array([len(x) for x in sets])
                often = np.split(counts.of(np.concatenate(sets), maps), np.cumsum(sizes)[:-1])
                for t, shingles, n in zip(batch.column(1).slice(i, j - i), sets, often, strict=True):
                    single = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in set((t.as_py() or "").encode().lower().split())), np.uint64)
                    keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    fps.append(majority(mix(single[:, None] + seeds[:prints]), spread).view(np.int64))
                    wides.append(majority(mix(shingles[:, None] + seeds[:wide_words]), spread).tobytes())
                    first = np.argsort(n, kind="stable")[: prefix_size(len(shingles), similarity)]
                    prefixes.append(shingles[first].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(keys, pa.binary()), pa.array(fps, long), pa.array(wides, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prefixes, long)], names=["doc_id", "key", "fps", "wide", "size", "prefix"])

    def together(texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        sets, i, n = [], 0, 0
        for j, t in enumerate(texts, 1):
            sets.append(np.unique(shingle_hashes(t.as_py(), words)))
            n += len(sets[-1])
            if n >= TOGETHER or j == len(texts):
                yield i, j, sets
                sets, i, n = [], j, 0

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, key binary, fps array<long>, wide binary, size int, prefix array<long>")


def shingle_sets(docs: DataFrame, reps: DataFrame, words: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(rep, shingles): the sorted hashes of the shingles of the documents ``reps`` (rep), 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    rows = docs.select(F.col(doc_id).alias("rep"), F.col(text).cast("string").alias("text")).join(small(reps), "rep")
    return rows.mapInArrow(run, "rep long, shingles binary").where(F.length("shingles") > 0).distinct()


def alike(sets: list[bytes], least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Links of sets of shingle hashes whose Jaccard similarity is ``least`` or more."""
    sizes = np.array([len(s) // 8 for s in sets])
    ends = np.cumsum(sizes)
    values, codes = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)

    def near(rows: np.ndarray, front: np.ndarray) -> np.ndarray:
        hit, mark = np.zeros(len(rows), bool), np.zeros(len(values), bool)
        for f in front:
            own = codes[ends[f] - sizes[f] : ends[f]]
            mark[own] = True
            shared = np.add.reduceat(mark[codes].astype(np.int64), ends - sizes)[rows]
            mark[own] = False
            hit |= shared >= least * (sizes[rows] + sizes[f] - shared)
        return hit

    return near


def perhaps(wide: np.ndarray, sizes: np.ndarray, least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Links that the wide fingerprints cannot rule out: their estimate, whose noise is under 0.03, is not 0.2 below ``least``, or a set is small."""
    near = similar(wide, sizes, least - 0.2)

    def loose(rows: np.ndarray, front: np.ndarray) -> np.ndarray:
        a, b = sizes[rows][:, None], sizes[front][None, :]
        few = (np.minimum(a, b) < FEW) & (np.minimum(a, b) >= least * np.maximum(a, b))
        return few.any(1) | near(rows, front)

    return loose


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the links (a, b) whose shingle sets have the similarity ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(alike([x.as_py(), y.as_py()], least)(np.array([0]), np.array([1]))[0]) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def prefix_links(tokens: DataFrame, nodes: DataFrame, joined: DataFrame, docs: DataFrame, words: int, least: float, every: int, text: str, doc_id: str) -> DataFrame:
    """(a, b): links across the components ``joined`` (node, component) of nodes that share one of the ``tokens`` (rep, token).

    One token in ``every`` counts.  Groups with the same members are compared once.
    """

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs, reps = set(), set()
            for members in frame["members"]:
                members = sorted(members, key=lambda m: m["rep"])
                own = np.array([m["component"] for m in members], np.int64)
                near = perhaps(np.array([np.frombuffer(m["wide"], np.uint64) for m in members]), np.array([m["size"] for m in members]), least)
                for f, hit in across(own, near):
                    pairs.update((min(own[f], c), max(own[f], c)) for c in np.unique(own[hit]))
                    reps.update((members[k]["rep"], own[k]) for k in (f, *hit))
            rows = [(0, a, b) for a, b in pairs] + [(1, r, c) for r, c in reps]
            yield pd.DataFrame(rows, columns=["kind", "a", "b"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for members in frame["members"]:
                members = sorted(members, key=lambda m: m["rep"])
                own = np.array([m["component"] for m in members], np.int64)
                for f, hit in across(own, alike([m["shingles"] for m in members], least)):
                    _, first = np.unique(own[hit], return_index=True)
                    found += [(members[f]["rep"], members[k]["rep"]) for k in hit[first]]
            yield pd.DataFrame(found, columns=["a", "b"])

    labels = small(joined.withColumnRenamed("node", "rep"))
    met = tokens.where(F.pmod("token", F.lit(every)) == 0).join(labels, "rep", "left").select("token", "rep", F.coalesce("component", "rep").alias("component"))
    met = materialize(met, "tokens")
    kinds = met.select("token", "component").distinct().groupBy("token").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("component", F.lit(k))).alias(f"h{k}") for k in (1, 2)))
    kinds = materialize(kinds.where("n > 1").select("token", F.concat_ws(":", "n", "h1", "h2").alias("of")), "tokens")
    # tokens of the same components make one group of all who hold one of them
    placed = materialize(met.join(small(kinds), "token").select("of", "rep", "component").distinct(), "groups")
    guessed = placed.join(nodes.where("size > 0").select("rep", "wide", "size"), "rep").groupBy("of").agg(F.collect_list(F.struct("rep", "component", "wide", "size")).alias("members"))
    likely = materialize(guessed.select("members").mapInPandas(split, "kind int, a long, b long").distinct(), "likely")
    # components that may be linked make one group, so that the set of a row goes to one place
    wholes = components(likely.where("kind = 0").select("a", "b")).toDF("component", "of")
    owners = materialize(likely.where("kind = 1").select(F.col("a").alias("rep"), F.col("b").alias("component")).join(small(materialize(wholes, "groups")), "component"), "groups")
    sets = shingle_sets(docs, materialize(owners.select("rep").distinct(), "reps"), words, text, doc_id)
    members = owners.join(sets, "rep").groupBy("of").agg(F.collect_list(F.struct("rep", "component", "shingles")).alias("members"))
    return members.select("members").mapInPandas(run, "a long, b long").distinct()


def across(own: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, linked rows of other components) for the rows outside the largest component of ``own``."""
    names, counts = np.unique(own, return_counts=True)
    everyone = np.arange(len(own))
    for f in np.flatnonzero(own != names[counts.argmax()]):
        hit = np.flatnonzero(near(everyone, np.array([f])) & (own != own[f]))
        if len(hit):
            yield int(f), hit


def shared_tokens(nodes: DataFrame) -> DataFrame:
    """(rep, token): the prefix shingles of ``nodes`` that several of them hold, and a few others.

    Only the hashes are counted by a shuffle.  Those counted more than once
    make Bloom filters, one for each block of hashes, in files that workers map
    as they need them, and what passes them leaves its task.  The number of
    blocks follows the number of hashes.
    """
    spark = nodes.sparkSession
    counts = nodes.select(F.explode("prefix").alias("token")).groupBy("token").count()
    again = materialize(counts.where("count > 1").select("token"), "tokens")
    n = again.count()
    blocks = 1 << (n >> FILTER_TOKENS).bit_length()
    bits = max(16, min(FILTER_TOKENS + 4, (16 * n).bit_length()))
    folder = new_path(spark, "filters")

    def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(h)
        return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        block, held = int(frame["block"].iloc[0]), np.zeros(1 << bits, bool)
        for k in places(frame["token"].to_numpy().view(np.uint64)):
            held[k] = True
        write_blob(f"{folder}/block-{block:08d}", np.packbits(held, bitorder="little").tobytes())
        return pd.DataFrame({"block": [block]})

    filled = again.withColumn("block", F.pmod("token", F.lit(blocks))).groupBy("block").applyInPandas(fill, "block long")
    there = frozenset(r["block"] for r in filled.collect())  # a number for each file

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(1)
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            order = np.argsort(tokens & (blocks - 1), kind="stable")
            tokens, owner = tokens[order], owner[order]
            hit = np.zeros(len(tokens), bool)
            for block, i, j in runs(tokens & (blocks - 1)):
                if block not in there:
                    continue
                if block not in maps:
                    maps[block] = map_blob(f"{folder}/block-{block:08d}")
                hit[i:j] = True
                for k in places(tokens[i:j].view(np.uint64)):
                    hit[i:j] &= (maps[block][k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[hit])), pa.array(tokens[hit])], names=["rep", "token"])

    return nodes.select("rep", "prefix").mapInArrow(keep, "rep long, token long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, prints: int = 4, radius: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, component_id): documents joined by chains of similar sets of word shingles.

    A fingerprint of shingles moves by many bits for a few edits, as each edit
    changes ``words`` shingles; so candidates come from ``prints`` independent
    fingerprints of the set of words, each with its covering tables, and the
    wide fingerprint of the shingles chooses among them.  They join most
    copies, but reach not all: pairs that are still apart and share a shingle
    of their prefixes, as all of that similarity do, are compared as well.
    The Jaccard similarity of the sets of shingle hashes decides every link.
    """
    rows = materialize(sketches(docs, words, prints, similarity, text=text, doc_id=doc_id), "sketches")
    # of rows with one set of shingles one is compared; the others, few, are told from narrow rows
    reps = materialize(rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "reps")
    several = small(materialize(reps.where("n > 1").select(F.col("key").alias("of"), F.col("rep").alias("least")), "reps"))
    nodes = rows.where("doc_id IS NOT NULL").join(several, F.col("key") == F.col("of"), "left").where("least IS NULL OR doc_id = least").withColumnRenamed("doc_id", "rep").drop("of", "least")
    placed = nodes.select(F.posexplode("fps").alias("print", "fp"), "rep", "wide", "size")
    guess = components(links(placed, radius, similarity=similarity)).where("node <> component").toDF("a", "b")
    guess = materialize(guess, "components")
    sets = materialize(shingle_sets(docs, materialize(guess.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "reps"), words, text, doc_id), "sets")
    found = materialize(confirmed(guess, sets, similarity), "links")
    joined = materialize(components(found), "components")
    tokens = materialize(shared_tokens(nodes), "tokens")
    for every in ROUNDS:
        found = found.unionAll(materialize(prefix_links(tokens, nodes, joined, docs, words, similarity, every, text, doc_id), "links"))
        joined = materialize(components(found), "components")
    classes = reps.join(small(joined), reps["rep"] == joined["node"], "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    return rows.select("doc_id", "key").join(classes, "key", "left").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id."""
    found = near_duplicates(docs, text=text, doc_id=doc_id, **options)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return without_ids(docs, materialize(gone, "gone"), doc_id)
