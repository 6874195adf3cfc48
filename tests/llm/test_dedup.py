import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_helpers import empty, make
from tidemark.llm import exact_dedup as E
from tidemark.llm import passage_dedup as P
from tidemark.llm import simhash as S
from tidemark.llm.components import components

WHITE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(WHITE), []).append((i, t or ""))
    out = {}
    for norm, own in groups.items():
        keep = min(own, key=lambda d: (-len(d[1]), d[0]))[0]
        for i, _ in own:
            out[i] = (keep, len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("filter_words", "part_words"), [(None, E.PART_WORDS), (1, 1), (64, 16)])
def test_exact_against_brute_force(corpus, filter_words, part_words):
    rows, docs = corpus
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in E.exact_dedup(docs, words=filter_words, part_words=part_words).collect()}
    assert got == brute_exact(rows)


def test_exact_uses_no_python(corpus):
    plan = E.resolve(*E.digests(corpus[1]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_exact_edges(spark):
    assert E.exact_dedup(empty(spark)).count() == 0
    docs = make(spark, [(1, "a b", None), (1, "ab", None), (1, "ab", None), (None, "ab", None), (None, "zz", None)]).withColumn("kept", F.lit("x"))
    out = E.exact_dedup(docs).collect()
    assert len(out) == 5 and sum(r["kept"] for r in out) == 2
    assert {r["keep_id"] for r in out if r["group_size"] == 4} == {1}
    kept = E.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == ["a b", "zz"]


def test_exact_filter_passes_single_rows(spark, words):
    """Few rows without a copy are false positives, and none of the copies passes."""
    docs = make(spark, [(k, f"{words[k % 2000]} {min(k, 3900)}", None) for k in range(4000)])
    rows, size = E.digests(docs)
    assert size == E.filter_words(4000) and E.filter_words(10**9) > E.PART_WORDS
    for part_words in (E.PART_WORDS, size // 4):
        maybe = {r["doc_id"] for r in E.tested(rows, size, part_words).where("maybe").collect()}
        assert maybe >= {r["doc_id"] for r in E.exact_dedup(docs).where("group_size > 1").collect()} and len(maybe) < 500


def test_exact_ids_of_text(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x "), (None, "x "), ("c", "y")], "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in E.exact_dedup(docs).collect()} == {("b", "a", False), ("a", "a", True), (None, "a", False), ("c", "c", True)}


def test_drop_exact_copies(corpus):
    rows, docs = corpus
    kept = E.drop_exact_copies(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in brute_exact(rows).items() if v[2])
    assert E.drop_exact_copies(docs.limit(0)).count() == 0


def brute_fingerprint(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """{id: smallest id reachable} of {id: fingerprint}."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(corpus):
    rows, docs = corpus
    prints = {i: brute_fingerprint(t) for i, t, _ in rows}
    expected = brute_components(prints, 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_components(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}


@pytest.mark.parametrize("bucket", [2048, 3])
def test_links_of_crowded_fingerprints(spark, bucket):
    """Near copies round a few centres: small buckets must split and lose no link."""
    r = random.Random(3)
    prints = {}
    for k in range(60):
        x = [0xDEADBEEF12345678, 0][k % 2]
        for _ in range(r.randint(0, 9)):
            x ^= 1 << r.randrange(64)
        prints[k] = x
    distinct = {}
    for k, x in prints.items():
        distinct.setdefault(x, k)
    rows = [(0, S._signed(x), k) for x, k in distinct.items()]
    found = components(S.links(spark.createDataFrame(rows, "print int, fp long, rep long"), 3, bucket)).collect()
    got = {r["node"]: r["component"] for r in found}
    expected = brute_components({k: x for x, k in distinct.items()}, 3)
    assert {k: got.get(k, k) for k in expected} == expected


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering_masks_lose_no_pair(radius):
    r = random.Random(radius)
    masks = S.covering_masks(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        flips = sum(1 << b for b in r.sample(range(64), radius))
        assert any(not m & flips for m in masks)


def test_simhash_edges(spark):
    assert S.simhash_components(empty(spark)).count() == 0
    docs = make(spark, [(5, None, None), (3, "", None), (3, "", None), (None, " ", None), (9, "one two three four", None)])
    out = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in S.simhash_components(docs).collect())
    assert [x[1:] for x in out if x[0] != "9"] == [("0" * 16, 3)] * 4


def test_near_duplicates_by_similarity(spark, words):
    r = random.Random(11)
    base = [r.choice(words) for _ in range(300)]
    close, far = list(base), list(base)
    for k in (40, 200):
        close[k] = "zzz"
    for k in range(0, 300, 6):
        far[k] = "yyy"
    docs = make(spark, [(1, " ".join(base), None), (2, " ".join(close), None), (3, " ".join(far), None), (4, " ".join(r.choice(words) for _ in range(300)), None), (5, None, None), (6, "", None)])
    got = {x["doc_id"]: x["component_id"] for x in S.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [1, 3, 4, 5]
    assert S.drop_near_copies(empty(spark)).count() == 0


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100}


def brute_passages(rows, width=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in texts:
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def passages(docs):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in P.remove_repeats(docs).collect())


def test_passages_against_brute_force(corpus):
    rows, docs = corpus
    assert passages(docs) == brute_passages(rows)


def test_passages_of_long_and_repetitive_texts(spark, words, monkeypatch):
    monkeypatch.setattr(P, "SORT_BYTES", 500)
    r = random.Random(2)
    long = " ".join(r.choice(words) for _ in range(3000))
    rows = [(1, "ab" * 400, None), (2, "x" + "ab" * 300 + "y", None), (3, long, None), (4, "q" * 20 + long[5000:5100] + "r" * 60, None), (5, long[4990:5200], None), (5, "ab" * 400, None), (0, "a" * 49, None), (6, "a" * 50, None), (7, "a" * 51, None)]
    assert passages(make(spark, rows)) == brute_passages(rows)


def test_a_text_longer_than_a_piece(spark, words, monkeypatch):
    r = random.Random(4)
    a = " ".join(r.choice(words) for _ in range(4000))
    rows = [(1, a, None), (2, "new start " + a, None)]
    monkeypatch.setattr(P, "PIECE", 4096)
    data = [P.Phrases(t, s) for _, t, s, _ in P.pieces(np.frombuffer(a.encode(), np.uint8), np.array([0, len(a.encode())]))]
    assert len(data) > 3 and sum(len(p.row) for p in data) > 0
    got = passages(make(spark, rows))
    assert got == brute_passages(rows)


@pytest.mark.parametrize("hot", [0, 1, 3])
def test_passages_of_hot_triggers(spark, words, hot):
    """A line that stands in many contexts has its strings dealt by themselves; the result is the same."""
    r = random.Random(12)
    line = " ".join(r.choice(words) for _ in range(14))
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, f"{prose(r.randint(0, 9))} {line} {prose(r.randint(0, 9))}", "en") for k in range(60)]
    out = P.remove_repeats(make(spark, rows).repartition(5), hot=hot).collect()
    assert sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in out) == brute_passages(rows)


def test_passages_fail_without_their_files(spark, words, monkeypatch, tmp_path):
    import glob
    import os

    monkeypatch.setattr(P, "new_path", lambda spark, label: f"file://{tmp_path}/{label}")
    out = P.remove_repeats(make(spark, [(k, " ".join(words[:60]), "en") for k in range(9)]))
    assert out.agg({"n_removed": "sum"}).first()[0] > 0
    os.remove(glob.glob(f"{tmp_path}/passages/phrases-*")[0])
    with pytest.raises(Exception, match="No such file"):
        out.collect()


def test_passages_edges(spark):
    assert P.remove_repeats(empty(spark)).count() == 0
    docs = make(spark, [(None, "z" * 60, None), (1, "z" * 60, None), (2, None, None)])
    out = {r["doc_id"]: r["n_removed"] for r in P.remove_repeats(docs, kept_text=True).collect()}
    assert out == {None: 60, 1: 0, 2: 0}


def test_suffix_groups_order_strings():
    r = np.random.default_rng(1)
    text = r.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(0, 350)
    order, group = P.suffix_groups(text, starts)
    strings = [text[k : k + 50].tobytes() for k in starts[order]]
    assert strings == sorted(strings)
    assert [a == b for a, b in zip(group, group[1:], strict=False)] == [a == b for a, b in zip(strings, strings[1:], strict=False)]


@pytest.mark.parametrize("join", ["_join_rivals", "_join_many"])
def test_rivals_of_one_trigger(join):
    r = random.Random(8)
    text, sizes, left = b"", [], []
    for _ in range(60):
        before, after = r.choice(["ab" * 17, "xy" * 17, "b" * 34])[: r.randint(0, 34)], r.choice(["cd" * 20, "c" * 40])[: r.randint(34, 40)]
        before, after = before[-(84 - 50) :], after
        text += (before + "T" * P.GRAM + after).encode()
        sizes.append(len(before) + P.GRAM + len(after))
        left.append(len(before))
    sizes, left, data = np.array(sizes), np.array(left), np.frombuffer(text, np.uint8)
    least = np.array([r.randrange(1000) for _ in sizes])
    counts, begin = sizes - P.WIDTH + 1, np.cumsum(sizes) - sizes
    out = np.repeat(least, counts)
    getattr(P, join)(np.arange(len(sizes)), sizes, left, begin, counts, least, data, out)
    first, strings = {}, []
    for k, (b, n) in enumerate(zip(begin, counts, strict=True)):
        for o in range(n):
            s = (left[k] - o, text[b + o : b + o + P.WIDTH]) if join == "_join_many" else text[b + o : b + o + P.WIDTH]
            strings.append(s)
            first[s] = min(first.get(s, 10**9), least[k])
    usable = [k for k, s in enumerate(strings) if join == "_join_rivals" or 0 <= s[0] <= P.WIDTH - P.GRAM]
    assert [out[k] for k in usable] == [first[strings[k]] for k in usable]
