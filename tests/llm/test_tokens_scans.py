import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from llm_helpers import empty, make
from tidemark.llm import decontaminate as D
from tidemark.llm import secret_scan as C
from tidemark.llm import sentencepiece_codec as P
from tidemark.llm import token_store as T

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  two  spaces ", "a\n\n b\n", "it's 'quoted' don't", "x-ray,é,ü!", "tab\there", " nbsp", "日本語 text", "1.5km at 10:30", "éa àb ×c", "a×b", "end \n", "\n\nstart", "a   b", "x" * 300, "..." * 40, "A'sB", "\U0001f600\U0001f600 ok"]


def all_texts(rows):
    return [t for _, t, _ in rows] + ODD


def brute_viterbi(v, data):
    """The best score of a chunk, place by place over all pieces."""
    pieces = {p: k for k, p in enumerate(v.pieces) if p and k not in set(v.byte_ids.tolist())}
    best = [0.0] + [-np.inf] * len(data)
    for s in range(len(data)):
        if best[s] == -np.inf:
            continue
        e = min(len(data), s + 1 + (data[s] >= 0xC0) + (data[s] >= 0xE0) + (data[s] >= 0xF0))
        best[e] = max(best[e], best[s] + v.fallback)
        for e in range(s + 1, min(len(data), s + v.longest) + 1):
            if data[s:e] in pieces:
                best[e] = max(best[e], best[s] + v.scores[pieces[data[s:e]]])
    return best[-1]


def test_viterbi_against_brute_force():
    v = P.load(PIECES)
    chunks = [b" the", b" internationalisation", "  naïve".encode(), "日本".encode(), b" x\xe2\x96\x81y", b"a" * 60, b" q" + b"z" * 90]
    ids, counts = P.encode_chunks(v, chunks)
    at = 0
    byte = set(v.byte_ids.tolist())
    for c, n in zip(chunks, counts, strict=True):
        own = ids[at : at + n]
        at += n
        assert b"".join(v.pieces[k] for k in own) == c
        k, score = 0, 0.0
        while k < len(own):
            if own[k] in byte and v.pieces[own[k]][0] >= 0x80:
                lead = v.pieces[own[k]][0]
                k += 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
                score += v.fallback
            else:
                score += v.scores[own[k]] if own[k] not in byte else v.fallback
                k += 1
        assert score == pytest.approx(brute_viterbi(v, c))


def test_sentencepiece_round_trip(spark, corpus):
    docs = make(spark, [(k, t, None) for k, t in enumerate(all_texts(corpus[0]))])
    out = P.decode(P.encode(docs, PIECES), PIECES).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in out)
    assert all(r["ids"] == [] for r in out if not r["text"])
    marks = {r["doc_id"]: r for r in P.round_trip(docs, PIECES).collect()}
    assert all(m["exact"] for m in marks.values())
    for r in out:
        assert marks[r["doc_id"]]["n_tokens"] == len(r["ids"])
        assert marks[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    one = {r["doc_id"]: (r["ids"], r["n_tokens"], r["decoded"]) for r in P.encode_and_decode(docs, PIECES).collect()}
    assert one == {r["doc_id"]: (r["ids"], len(r["ids"]), r["decoded"]) for r in out}


def test_sentencepiece_edges(spark):
    assert P.round_trip(empty(spark), PIECES).count() == 0
    docs = make(spark, [(None, "a", None), (1, "a", None), (1, "a", None)]).withColumnRenamed("source", "ids")
    assert P.encode(docs, PIECES).columns == ["doc_id", "text", "lang", "n_chars", "ids"]
    assert P.encode(docs, PIECES).count() == 3


def brute_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    return {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in rows}


@pytest.mark.parametrize("shard_docs", [10_000, 20])
def test_token_store_against_the_library(spark, corpus, shard_docs):
    rows = [(3 * k, t) for k, t in enumerate(all_texts(corpus[0]))]
    random.Random(1).shuffle(rows)
    expected, start = {}, 0
    ids = brute_tokens(rows)
    for i in sorted(ids):
        expected[i] = (start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        start += len(ids[i])
    docs = make(spark, [(i, t, None) for i, t in rows]).repartition(3)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in T.store_tokens(docs, BYTES, shard_docs=shard_docs).collect()}
    assert got == expected


def test_token_store_edges(spark):
    assert T.store_tokens(empty(spark), BYTES).count() == 0
    out = T.store_tokens(make(spark, [(2, None, None), (None, "a", None), (2, "b", None), (1, "", None)]), BYTES).collect()
    assert sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in out)[0] == (0, 2, None)
    assert sum(r["n_tokens"] for r in out) == 6


@pytest.mark.parametrize("ranges", [1, 4])
def test_shards_end_at_documents_and_ids(spark, corpus, tmp_path, monkeypatch, ranges):
    monkeypatch.setattr(T, "RANGES", ranges)
    monkeypatch.setattr(T.math, "isqrt", lambda n: 0)  # few ranges with many files each
    rows = [(k // 7, t) for k, t in enumerate(all_texts(corpus[0]))]  # ids repeat
    docs = make(spark, [(i, t, None) for i, t in rows]).repartition(3)
    shards = T.write_shards(docs, BYTES, str(tmp_path), shard_docs=5, shard_tokens=600).collect()
    assert len({r["range"] for r in shards}) <= ranges < len(shards)
    assert all(len(r["doc_ids"]) <= 5 and (r["n_tokens"] <= 600 or len(r["doc_ids"]) == 1) for r in shards)
    first, second = ([sorted(map(tuple, T.store_tokens(d, BYTES, shard_docs=5).collect()))] for d in (docs, docs.repartition(5)))
    assert first == second  # whatever the order of the rows
    assert sum(r[2] for r in first[0]) == sum(r["n_tokens"] for r in shards)


def test_token_store_ids_of_text(spark):
    docs = spark.createDataFrame([("b", "x y", 1), (None, "z", 2), ("\u00e9", "w", 3), ("a", None, 4)] * 5, "doc_id string, text string, start long")
    out = sorted(T.store_tokens(docs, BYTES, shard_docs=3).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None] * 5 + ["a"] * 5 + ["b"] * 5 + ["\u00e9"] * 5
    assert [r["start"] for r in out] == np.cumsum([0] + [r["n_tokens"] for r in out][:-1]).tolist()


@pytest.mark.parametrize("n,largest", [(0, 1), (1, 0), (7, 3), (3000, 50_000), (700_000, 300), (2000, 70_000)])
def test_wavelet_matrix(n, largest):
    ids = np.random.default_rng(n).integers(0, largest + 1, n)
    bounds = np.array([0, n // 2, n])
    shard = T.TokenShard(np.frombuffer(T.build(ids, bounds), np.uint8))
    assert np.array_equal(shard.tokens(), ids) and np.array_equal(shard.bounds, bounds)
    r = random.Random(n)
    for _ in range(min(n, 25)):
        i = r.randrange(n)
        token = int(ids[i])
        a, b = sorted((r.randrange(n + 1), r.randrange(n + 1)))
        assert shard.access(i) == token
        assert shard.count(token, a, b) == int((ids[a:b] == token).sum())
        places = np.flatnonzero(ids == token)
        k = r.randrange(len(places))
        assert shard.occurrence(token, k) == places[k]
    assert shard.count(largest + 1_000_000) == 0
    with pytest.raises(IndexError):
        shard.occurrence(0, n)


def test_not_a_shard():
    with pytest.raises(ValueError):
        T.TokenShard(np.zeros(32, np.uint8))


KEY = "AKIA" + "ABCDEFGH12345678"
SCANS = {
    1: 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
    2: f"x {KEY} y AKIASHORT z {KEY}",
    3: "PassWord:  short and API_KEY='abcdefghijkl' apikey=abcdefghijk",
    4: "é" * 40 + " deadbeefdeadbeef DEADBEEFDEADBEEF deadbeefdeadbee",
    5: "ſecret=aaaaaaaaaaaaaaaa toKen=aaaaaaaaaaaaaaaa",
    6: "secret=tokentokentoken=abcdefghijklmnop",
    7: None,
    8: "",
    9: "user=ann pass=abc1 see https://db.example/x",
    10: "user=ann " + "word " * 200 + "pass=abc1",
    11: "pass=abc1 only",
    12: f"{KEY} beside wJalrXUtnFEMI0K7MDENGb1PxRfiCYEXAMPLEKEY",
    13: "see https://clean.example/page for more",
    14: 'ann@corp.example has token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" on 10.0.0.7:5432.',
    15: "write to ann@corp.example or 10.0.0.7",
}


def brute_base(text):
    found = []
    for kind, pattern, ok in (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ):
        found += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text or "", re.A) if ok(m)]
    return sorted(found)


def test_secrets(spark):
    docs = make(spark, [(i, t, None) for i, t in SCANS.items()]).withColumnRenamed("source", "spans")
    got = {r["doc_id"]: r for r in C.scan_secrets(docs).collect()}
    assert got.keys() == SCANS.keys()
    for i, t in SCANS.items():
        base = brute_base(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[3] == k for x in base) for k in ("assign", "access", "hex")]
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))
    linked = {i: {s.split(":")[0] for s in got[i]["spans"].split(",")} - {"assign", "access", "hex", ""} for i in SCANS}
    assert linked[9] == {"identifier", "secret", "endpoint"}
    assert linked[10] == linked[11] == linked[13] == linked[15] == set()
    assert linked[14] == {"identifier", "endpoint"}
    assert linked[12] == {"secret"}
    assert SCANS[12][int(got[12]["spans"].split(",")[1].split(":")[1]) :] == "wJalrXUtnFEMI0K7MDENGb1PxRfiCYEXAMPLEKEY"


def test_secret_edges(spark):
    assert C.scan_secrets(empty(spark)).count() == 0
    rows = [(1, "user=ann pass=abc1", None)] * 2 + [(None, "user=ann pass=abc1 " * 2000, None)]
    out = C.scan_secrets(make(spark, rows)).collect()
    assert [r["n_linked"] for r in out if r["doc_id"] == 1] == [2, 2]
    assert [r["n_linked"] for r in out if r["doc_id"] is None] == [4000]


ITEMS = [
    (1, "A train with 12 wagons leaves the station at 9 and meets Anna near the old bridge after 45 km of travel."),
    (2, "The farmer sold many apples to the market and kept the others for the long winter ahead."),
    (3, "What is left over here?"),
    (4, None),
]


def holds(spark, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {r["doc_id"]: r["item_ids"] for r in D.decontaminate(make(spark, rows), items).collect()}


def test_decontamination(spark, words):
    r = random.Random(1)
    noise = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [
        (1, f"{noise(30)}. {ITEMS[0][1]} {noise(10)}", None),
        (2, f"{noise(5)}\n" + ITEMS[0][1].replace("12", "97").replace("9 ", "3.5 ").replace("Anna", "Bernard").replace("45 km", "6 miles"), None),
        (3, ITEMS[1][1].upper() + "!!", None),
        (4, noise(200), None),
        (5, None, None),
        (6, "", None),
        (7, ITEMS[1][1] + " " + ITEMS[0][1], None),
        (8, "The farmer sold many apples to the town and left", None),
        (9, "so: What is left over here? yes", None),
    ]
    got = holds(spark, rows)
    assert got == {1: [1], 2: [1], 3: [2], 4: [], 5: [], 6: [], 7: [1, 2], 8: [], 9: []}
    assert holds(spark, [(1, "What is left over here?", None)]) == {1: [3]}


def test_slots_must_be_consistent(spark):
    items = spark.createDataFrame([(1, "we add 7 to the other 7 then to this 7 again and then 7 more for all")], "item_id long, text string")
    docs = make(spark, [(1, "we add 5 to the other 5 then to this 5 again and then 5 more for all", None), (2, "we add 5 to the other 6 then to this 8 again and then 9 more for all", None)])
    assert {r["doc_id"]: r["contaminated"] for r in D.decontaminate(docs, items).collect()} == {1: True, 2: False}


def test_decontamination_edges(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = items.limit(0)
    docs = make(spark, [(1, ITEMS[1][1], None), (1, ITEMS[1][1], None), (None, ITEMS[1][1], None)]).withColumnRenamed("source", "contaminated")
    assert D.decontaminate(empty(spark), items).count() == 0
    assert [r["contaminated"] for r in D.decontaminate(docs, none).collect()] == [False] * 3
    out = D.decontaminate(docs, items).collect()
    assert len(out) == 3 and [r["contaminated"] for r in out if r["doc_id"] == 1] == [True, True]
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [None]


def test_pieces_have_log_scores(words):
    v = P.load(PIECES)
    scores = v.scores[[k for k, p in enumerate(v.pieces) if p and k not in set(v.byte_ids.tolist()) and v.scores[k] > P.NEVER]]
    assert np.exp(scores).sum() == pytest.approx(1) and v.fallback == pytest.approx(scores.min() - 10)
    assert [v.pieces[k] for k in P.encode_chunks(v, [b" the house"])[0]] == [b" the", b" house"]
    assert P.log_scores(np.array([-1.5, -2.25])).tolist() == [-1.5, -2.25]  # a unigram file's own
    chunks = [f" {w}".encode() for w in words[:12]]
    ids, counts = P.encode_chunks(v, chunks)
    total = np.add.reduceat(v.scores[ids], np.cumsum(counts) - counts)
    assert total == pytest.approx([brute_viterbi(v, c) for c in chunks])


OLD_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
OLD_ENDPOINT = re.compile(r"""\b(?:[a-z][a-z0-9+]*://[^\s"'<>]+|(?:host|server|endpoint|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,})""", re.I | re.A)


def test_addresses_and_endpoints_against_plain_patterns():
    r = random.Random(3)
    parts = ["a", "b9", "+", "_", ".", "@", "://", " ", "-", "host=", "url: ", "x.yz", "é", "'", "1"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert C.addresses(text) == [m.span() for m in OLD_EMAIL.finditer(text)], text
        assert C.endpoints(text) == [m.span() for m in OLD_ENDPOINT.finditer(text)], text


def test_long_texts_are_scanned_in_linear_time():
    import time

    for part in ("a", "a+", "a.", "key=", "user=", "a@", "://", "host:", "x@y.", "AKIA", "0f", "password = hunter2hunter2 user=bob "):
        text = part * (1_000_000 // len(part))
        began = time.time()
        C.weak_spans(text, C.base_spans(text))
        assert time.time() - began < 8, part


def test_linked_parts_against_brute_force(spark):
    """Each weak part is reported exactly when its complement is within reach."""
    r = random.Random(5)
    parts = ["user=bob7", "pin: 1234", "https://h.example/x", "AKIA" + "B" * 16, "secret=abcdefghijkl", "mail me@x.org", "plain words here"]
    rows = [(k, " ".join(r.choice(parts) + " " * r.choice((1, 120, 300)) for _ in range(r.randint(1, 9)))) for k in range(150)]
    got = {x["doc_id"]: x["spans"] for x in C.scan_secrets(make(spark, [(k, t, None) for k, t in rows])).collect()}
    for k, text in rows:
        base = C.base_spans(text)
        spans = base + C.weak_spans(text, base)
        near = lambda a, kinds: any(s[1] in kinds and s[0] < a[2] + C.REACH and s[2] > a[0] - C.REACH for s in spans)
        kept = [s for s in spans if s[1] < 3 or (s[1] == 4 and near(s, (1, 3))) or (s[1] == 3 and near(s, (0, 4))) or (s[1] == 5 and near(s, (0, 4)) and near(s, (1, 3)))]
        assert got[k] == ",".join(f"{C.KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(kept)), text
