import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_helpers import empty, make
from tidemark.llm import html_wrappers as H
from tidemark.llm import language_id as L
from tidemark.llm import ngram_lm as N

END = b"\0end"


def tokens(text):
    return (text or "").encode().lower().split() + [END]


def brute_scores(rows):
    train = [tokens(t) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip([None, *t[:-1]], t, strict=True))
    context, follows = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (u, w), k in pairs.items():
        context[u][0] += k
        context[u][min(k, 3)] += 1
        follows[w] += 1
    d = N.discounts([sum(x == k for x in pairs.values()) for k in (1, 2, 3, 4)])
    low = N.discounts([sum(x == k for x in follows.values()) for k in (1, 2, 3, 4)])
    cut = lambda k, d: max(k - (d[min(k, 3) - 1] if k else 0), 0)
    rest = sum(low[min(k, 3) - 1] for k in follows.values()) / len(pairs)
    out = {}
    for i, t, *_ in rows:
        own = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)
        score = 0.0
        for u, w in zip([None, *own[:-1]], own, strict=True):
            p = cut(follows[w], low) / len(pairs) + rest / (v + 1)
            if u in context:
                a = context[u]
                p = cut(pairs[u, w], d) / a[0] + (d[0] * a[1] + d[1] * a[2] + d[2] * a[3]) / a[0] * p
            score += math.log10(p)
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(c[w] > 0 for w in own), n, base, score)
    return out


def test_scores_against_brute_force(corpus):
    rows, docs = corpus
    expected = brute_scores(rows)
    got = {r["doc_id"]: r for r in N.score_texts(docs).collect()}
    assert got.keys() == expected.keys()
    for i, (held, n, known, total, base, score) in expected.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_frequent_pairs_keep_their_counts(spark):
    rows = [(k, "go home " * 400, None) for k in range(6)]
    expected = brute_scores(rows)
    for r in N.score_texts(make(spark, rows)).collect():
        assert r["score"] == pytest.approx(expected[r["doc_id"]][5], rel=1e-9)


def test_probabilities_sum_to_one(spark, corpus):
    """Over all known words and the unknown one, after any context."""
    rows, docs = corpus
    model = N.train(N._texts(docs, "text", "doc_id").where("fold <> 2"))
    scorer = N.Scorer(model)
    hashes = np.concatenate([scorer._pairs and [] or np.array(N.map_blob(f"{model.folder}/words-{p:06d}"))[: 8 * (model.offsets[p + 1] - model.offsets[p])].view(np.uint64) for p in range(1 << model.bits) if model.offsets[p + 1] > model.offsets[p]])
    assert len(hashes) == model.words
    candidates = np.append(hashes, np.uint64(12345))
    for before in (hashes[0], hashes[7], N.END):
        total = 0.0
        for w in candidates:
            _, _, both = scorer.rows(np.array([before, w], np.uint64), np.array([2]))
            _, _, one = scorer.rows(np.array([before], np.uint64), np.array([1]))
            total += 10 ** (both[0] - one[0])
        assert total == pytest.approx(1, rel=1e-6)


def test_scoring_edges(spark):
    assert N.score_texts(empty(spark)).count() == 0
    out = {r["doc_id"]: r for r in N.score_texts(make(spark, [(None, "a b", None)])).collect()}
    assert out[None]["held_out"] is False and out[None]["train_tokens"] == 0 and out[None]["n_tokens"] == 3 and out[None]["score"] == 0


LETTERS = {"aa": "the and of ing tion wh", "bb": "der die und sch ung ein", "cc": "que los ado cion ez ar"}


def speech(r, lang, n):
    parts = LETTERS[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    r = random.Random(3)
    rows = [(k, speech(r, lang := r.choice(list(LETTERS)), r.randint(3, 60)), lang) for k in range(400)]
    return rows, make(spark, rows)


def test_held_out_accuracy_and_probabilities(spoken):
    rows, docs = spoken
    truth = {i: lang for i, _, lang in rows}
    got = L.identify(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 400 and 60 < len(held) < 140
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_prediction_ignores_labels_and_reads_whole_texts(spark, spoken):
    rows, docs = spoken
    model = L.fit(L.labelled_rows(docs))
    r = random.Random(9)
    tail = speech(r, "aa", 40) + " " + speech(r, "bb", 4000)
    texts = make(spark, [(1, tail, "aa"), (2, tail, None), (3, None, "aa"), (4, "", "aa"), (5, "123 !? ²³", "aa"), (6, "é" * 3 * L.PIECE, None)])
    out = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in L.predict(texts, model, kept=("doc_id",)).collect()}
    assert out[1] == out[2] and out[1][0] == "bb"
    assert out[3] == out[4] == out[5] == ("und", 0.0)
    assert out[6][0] in LETTERS


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "Ein ganz Langer text mit ümlauten " * 20
    whole = np.sort(np.concatenate(list(L.features(text))))
    monkeypatch.setattr(L, "PIECE", 7)
    assert np.array_equal(whole, np.sort(np.concatenate(list(L.features(text)))))


def test_language_edges(spark, spoken):
    assert L.identify(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in L.identify(make(spark, [(1, "some text", None)])).collect()} == {"und"}
    docs = make(spark, [*spoken[0], (None, "the and of", "aa"), (900, None, "aa"), (901, "  ", "bb")]).withColumnsRenamed({"source": "score"})
    kept = L.drop_undetermined(docs)
    assert "lang_pred" not in kept.columns and kept.count() == 401


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul>{menu}</ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>{main}
<div id="comments"><p>First!</p></div><form><label>Mail</label></form><aside>More</aside><footer>&copy; me</footer></body></html>"""


def page(k, main):
    return PAGE.format(menu="".join(f"<li><a href='/{n}'>m{n}</a></li>" for n in range(k % 5 + 1)), main=main)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_main_text_of_an_article(spark):
    rows, expected = [], {}
    for k in range(12):
        blocks = [f"Head {k} &amp; more", *(f"Par {k}\n {n} <b>bold</b>  x" for n in range(k % 4))]
        main = f"<article><h1>{blocks[0]}</h1>" + "".join(f"<p>{b}" + "</p>" * (k % 2) for b in blocks[1:]) + "<div class='notice'>note</div></article>"
        rows.append((k, f"http://a.example/{k}", page(k, main)))
        expected[k] = "\n\n".join([f"Head {k} & more", *(f"Par {k} {n} bold x" for n in range(k % 4))])
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(pages(spark, rows)).collect()}
    assert got == {k: (t, len(t)) for k, t in expected.items()}


def test_main_text_without_an_article(spark):
    rows = [(k, "http://b.example/x", page(k, f"<div class='w'><div><p>Long text number {k} goes on for a while, {'word ' * (k + 9)}</p><p>Second.</p></div></div>")) for k in range(6)]
    for r in H.extract(pages(spark, rows)).collect():
        assert r["text"] == f"Long text number {r['page_id']} goes on for a while, {'word ' * (r['page_id'] + 9)}".strip() + "\n\nSecond."


def test_html_edges(spark):
    assert H.extract(pages(spark, [])).count() == 0
    rows = [(1, None, None), (2, "no url", ""), (3, "http://c/", "plain &lt;text&gt;"), (3, "http://c/", "plain &lt;text&gt;"), (None, "http://d/", "<p>a<p>b<br>c</div></x>"), (4, "http://e/", "<article>" + "y " * 100_000 + "</article>"), (5, "http://f/", "<" * 50 + "a < b")]
    out = sorted(H.extract(pages(spark, rows).withColumn("host", __import__("pyspark").sql.functions.lit(1))).collect(), key=lambda r: str(r["page_id"]))
    assert [r["text"] for r in out if r["page_id"] in (1, 2)] == ["", ""]
    assert [r["text"] for r in out if r["page_id"] == 3] == ["plain <text>"] * 2
    assert [r["text"] for r in out if r["page_id"] is None] == ["a\n\nb c"]
    assert [r["n_chars"] for r in out if r["page_id"] == 4] == [199_999]


def tree(html):
    return H.expression(H.Page(html))


def test_wrappers_fold_and_align():
    assert str(tree("<ul><li>a<li>b</ul>")) == "((ul (li #)+))"
    assert str(tree("<dl>" + "<dt>a<dd>b" * 3 + "</dl>")) == "((dl ((dt #) (dd #))+))"
    one, two = tree("<body><h1>a</h1><p>b</p>"), tree("<body><h1>a</h1><div>c</div><p>b</p><p>d</p>")
    assert str(H.merge(one, two)) == "((body (h1 #) (div #)? (p #)+))"
    assert str(H.merge(tree("<p>a"), tree("<p>a"))) == str(tree("<p>a"))
    assert str(H.merge(tree("<dl><dt>a<dd>b</dl>"), tree("<dl>" + "<dt>a<dd>b" * 3 + "</dl>"))) == "((dl ((dt #) (dd #))+))"
    many = H.merge(tree("<div>" + "<h2>b</h2><p>a</p>" * 2 + "<ul><li>c</ul><p>d"), tree("<div>" + "<p>a</p><h2>b</h2>" * 9 + "<pre>x</pre>"))
    assert len(many.kids[0].kids) < 12
    assert [k.text == -1 for k in H.merge(tree("<p>a</p><h1>x"), tree("<p>a</p><h1>y")).kids] == [False, True]


def accepts(node, labels, k=0):
    """Places after ``labels`` from k on that the expression of an element with its children takes, by trying everything."""

    def one(x, at):
        if x.label == "()":
            return {e for e in sequence(x.kids, at)}
        if at < len(labels) and labels[at] == ("open", x.label):
            return {e + 1 for e in sequence(x.kids, at + 1) if e < len(labels) and labels[e] == ("close", x.label)}
        return set()

    def sequence(kids, at):
        loose = [x for x in kids if x.loose]
        ends = {at}
        for x in [None, *kids]:
            if x is not None and not x.loose:
                step = closure(lambda e, x=x: one(x, e), ends) if x.repeated else {f for e in ends for f in one(x, e)}
                ends = step | ends if x.optional else step
            ends = ends | closure(lambda e: {f for y in loose for f in one(y, e)}, ends)
        return ends

    def closure(step, starts):
        seen, todo = set(), list(starts)
        while todo:
            for f in step(todo.pop()):
                if f not in seen:
                    seen.add(f)
                    todo.append(f)
        return seen

    return sequence(node.kids, k)


def labels_of(html):
    p = H.Page(html)
    kids = {}
    for k, parent in enumerate(p.parents):
        kids.setdefault(parent, []).append(k)

    def walk(k):
        return [("open", p.labels[k]), *(t for c in kids.get(k, []) for t in walk(c)), ("close", p.labels[k])]

    return [t for c in kids.get(0, []) for t in walk(c)]


def test_a_wrapper_accepts_every_page_it_was_made_of():
    """Brute force over small hosts: each page's stream is a word of the merged expression."""
    r = random.Random(4)
    part = lambda d: r.choice(("<p>a</p>", "<h2>b</h2>", "<ul><li>c</li><li>d</li></ul>", "<nav>n</nav>")) if d > 1 or r.random() < 0.6 else "<div>" + "".join(part(d + 1) for _ in range(r.randint(0, 4))) + "</div>"
    for _ in range(150):
        host = ["<body>" + "".join(part(0) for _ in range(r.randint(1, 5))) + "</body>" for _ in range(r.randint(2, 6))]
        root = tree(host[0])
        for html in host[1:]:
            H.merge(root, tree(html))
        for html in host:
            labels = labels_of(html)
            assert len(labels) in accepts(root, labels), (str(root), html)


BARE = "<html><body><div>{top}</div><div><p>{words}</p><p>{more}</p></div><div>Terms apply. Ask the editors before any reuse of these pages, of their pictures or of parts of them, in print or on line, now or later on.</div></body></html>"


def bare_pages():
    return [(k, "http://h.example/", BARE.format(top=f"Shop {'news' * (k % 2)}", words=f"{k} words of page {k * k}, told at length", more=f"and {k + 3} more")) for k in range(6)]


def test_the_wrapper_decides(spark, monkeypatch):
    """Without names that tell, the text that all pages of a host share is longer than theirs, and only the wrapper knows."""
    df = pages(spark, bare_pages())
    expected = {k: f"{k} words of page {k * k}, told at length\n\nand {k + 3} more" for k in range(6)}
    assert {r["page_id"]: r["text"] for r in H.extract(df).collect()} == expected
    assert all(H.page_text(html, None) != expected[k] for k, _, html in bare_pages())
    monkeypatch.setattr(H, "merged", lambda trees: '["", 0, 1, 0, 0, 0, []]')
    assert not any(H.page_text(html, H.merged([])) == expected[k] for k, _, html in bare_pages())


def test_large_hosts_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN", 3)
    df = pages(spark, [(k, "http://h.example/", BARE.format(top="<b>x</b>" * (k % 3), words=f"w{k} " * 9, more="<i>y</i>" * (k % 5) + f"{k}")) for k in range(40)]).repartition(8)
    assert all(r["text"].startswith(f"w{r['page_id']} ") and "Terms" not in r["text"] for r in H.extract(df).collect())


def test_a_host_of_copies_keeps_its_text(spark):
    html = BARE.format(top="x", words="one text", more="and more of it " * 20)
    assert {r["text"] for r in H.extract(pages(spark, [(k, "http://h/", html) for k in range(5)])).collect()} == {H.page_text(html, None)}


def test_odd_pages_take_linear_time():
    import time

    for html in ("<a " * 350_000, "<b>x" * 100_000, "<div>" * 100_000 + "x", "<div><p>" * 50_000, '<a "> "' * 100_000, "<p class='x\">" * 50_000, "<!" * 300_000, "<" * 500_000):
        began = time.time()
        H.page_text(html, None)
        assert time.time() - began < 5, html[:8]


def test_irregular_streams_get_a_loose_group(spark):
    r = random.Random(1)
    blocks = lambda n: "".join(r.choice(("<p>a</p>", "<h2>b</h2>", "<ul><li>c</li></ul>", "<div><p>d</p></div>")) for _ in range(n))
    rows = [(k, "http://g/", page(k, f"<article>{blocks(n)}</article>")) for k, n in enumerate((2000, 1500, 30, 30, 30, 30, 30, 30))]
    rows.append((99, "http://g/", "<div>" * 3000 + "deep" + "</div>" * 3000))
    out = {x["page_id"]: x for x in H.extract(pages(spark, rows)).collect()}
    assert len(out) == 9 and all(x["text"].count("\n\n") >= 29 for k, x in out.items() if k != 99)


def test_hosts_share_wrappers(spark):
    rows = [(k, f"http://{'ab'[k % 2]}.example/{k}", page(k, f"<article><p>t{k}</p></article>")) for k in range(10)]
    df = pages(spark, rows)
    found = H.wrappers(df.select(H.host(df["url"]).alias("host"), "html")).collect()
    assert {r["host"] for r in found} == {"a.example", "b.example"}
    assert all("(article (p #))" in str(H.Node.load(json.loads(r["wrapper"]))) for r in found)
