import random

import corpus_pipeline
from llm_helpers import make
from tidemark.llm import queries as Q


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def brute(rows, items):
    """What is left of (id, text) by plain rules."""
    rows = [(i, t) for i, t in rows if t is not None and any(c.isalpha() for c in t)]
    best = {}
    for i, t in rows:
        key = "".join(t.split())
        if key not in best or (-len(t), i) < (-len(best[key][1]), best[key][0]):
            best[key] = (i, t)
    rows = sorted(best.values())
    left = []
    for i, t in rows:
        if not any(len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(t) | shingles(u)) for j, u in rows if j < i):
            left.append((i, t))
    return sorted(i for i, t in left if not any(x in t for x in items))


def documents(words):
    r = random.Random(21)
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [prose(20) for _ in range(3)]
    rows = [(k, prose(120), r.choice(["aa", "bb"])) for k in range(60)]
    rows += [(100 + k, rows[k][1].replace(" ", "\n", 3), "aa") for k in range(8)]  # exact copies
    rows += [(200 + k, rows[10 + k][1].rpartition(" ")[0] + " edited", "aa") for k in range(8)]  # near copies
    rows += [(300 + k, f"{prose(30)} {items[k]} {prose(30)}", "bb") for k in range(3)]
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "123 456", "aa"), (403, rows[0][1], None)]
    return rows, items


def test_pipeline_against_brute_force(spark, words, tmp_path):
    rows, items = documents(words)
    make(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == brute([(i, t) for i, t, _ in rows], items)
    assert all(r["decoded"] == r["text"] and r["n_tokens"] == len(r["ids"]) for r in out)


def test_stages_keep_the_columns(spark, words, tmp_path):
    rows, items = documents(words)
    docs = make(spark, rows[:12])
    spark.createDataFrame([(0, items[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for own in (docs, docs.limit(0)):
            out = stage(spark, own, str(tmp_path))
            assert out.dtypes == docs.dtypes and out.count() <= own.count()


def test_every_operator_is_registered():
    names = Q.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names
    assert set(Q.oracle_sql()) <= set(names)


def test_exact_dedup_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = Q.op1_exact_dedup(spark, "/root/testdata/sf0.001")
    result = con.execute(Q.oracle_sql()["op1_exact_dedup"])
    names = [d[0] for d in result.description]
    assert sorted(map(tuple, df.select(names).collect())) == sorted(result.fetchall())
