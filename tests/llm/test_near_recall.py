import random
from collections import Counter

from llm_helpers import make
from tidemark.llm import simhash as S


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def edited(r, text, edits):
    """``text`` with scattered words replaced by words found nowhere else."""
    w = text.split()
    for k in r.sample(range(len(w)), edits):
        w[k] = f"new{r.getrandbits(40)}"
    return " ".join(w)


def test_pairs_of_every_band_join_and_others_do_not(spark, words):
    """Pairs of scattered edits from 0.70 up: those of 0.8 or more join, the others do not."""
    r = random.Random(31)
    rows, truth = [], {}
    for n in (60, 150, 400, 1500):
        for _ in range(60):
            text = " ".join(r.choice(words) for _ in range(n))
            k = 2 * len(truth)
            copy = edited(r, text, max(1, round(n * r.uniform(0.001, 0.035))))
            rows += [(k, text, "en"), (k + 1, copy, "en")]
            truth[k] = similarity(text, copy)
    got = {x["doc_id"]: x["component_id"] for x in S.near_duplicates(make(spark, rows).repartition(3)).collect()}
    bands = {low: [k for k, s in truth.items() if low <= s < high] for low, high in ((0.5, 0.8), (0.8, 0.82), (0.82, 0.85), (0.85, 0.9), (0.9, 1))}
    assert all(len(b) > 8 for b in bands.values())
    joined = {low: sum(got[k + 1] == k for k in b) / len(b) for low, b in bands.items()}
    print("joined by band", {low: (len(bands[low]), round(x, 3)) for low, x in joined.items()})
    assert joined == {0.5: 0, 0.8: 1, 0.82: 1, 0.85: 1, 0.9: 1}


def test_common_shingles_come_last(spark, words):
    """A passage that all documents share leads to no prefix of those that have enough else."""
    r = random.Random(32)
    passage = " ".join(r.choice(words) for _ in range(60))
    docs = make(spark, [(k, passage + " " + " ".join(r.choice(words) for _ in range(60)), "en") for k in range(50)])
    found = S.sketches(docs, 5, 4, 0.8).collect()
    seen = [t for x in found for t in x["prefix"]]
    assert len(set(seen)) == len(seen) and all(len(x["prefix"]) == S.prefix_size(x["size"], 0.8) for x in found)


def test_prefix_groups_without_a_likely_pair(spark, words):
    """A batch of groups that the wide fingerprints all rule out has no rows, and that is no error."""
    r = random.Random(33)
    passage = " ".join(r.choice(words) for _ in range(8))
    docs = make(spark, [(k, passage + " " + " ".join(r.choice(words) for _ in range(400)), "en") for k in range(3)])
    sketches = S.sketches(docs, 5, 4, 0.0).withColumnRenamed("doc_id", "rep")
    joined = spark.createDataFrame([], "node long, component long")
    assert S.prefix_links(S.shared_tokens(sketches), sketches, joined, docs, 5, 0.8, 1, "text", "doc_id").count() == 0


def test_shingles_of_few_documents_count_too(spark, words):
    """A passage of three documents leads to no prefix of those that have enough else."""
    r = random.Random(34)
    passage = " ".join(r.choice(words) for _ in range(60))
    docs = make(spark, [(k, passage + " " + " ".join(r.choice(words) for _ in range(60)), "en") for k in range(3)])
    seen = [t for x in S.sketches(docs, 5, 4, 0.8).collect() for t in x["prefix"]]
    assert len(set(seen)) == len(seen) > 60


def test_counts_come_from_all_documents(spark, words, odd_texts):
    """Over 10,000 documents: the first shingles of each are those of the fewest documents of all."""
    r = random.Random(35)
    lines = [" ".join(r.choice(words) for _ in range(8)) for _ in range(60)]
    texts = [f"{lines[int(60 * r.random() ** 3)]} {r.choice(lines)} number {k // 2}" for k in range(11_000)] + odd_texts
    own = [set(S.shingle_hashes(t, 5).tolist()) for t in texts]
    often = Counter(h for s in own for h in s)
    for x in S.sketches(make(spark, [(k, t, "en") for k, t in enumerate(texts)]).repartition(3), 5, 4, 0.8).collect():
        s = sorted(own[x["doc_id"]], key=lambda h: (often[h], h))
        assert [h % 2**64 for h in x["prefix"]] == s[: S.prefix_size(len(s), 0.8)]
