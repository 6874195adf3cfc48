import random

from llm_helpers import make
from tidemark.llm import decontaminate as D

SHORT, NUMBERS, SUM = "What is left over here?", "3 14 15 92 65 35 89 79 32", "Add 12 and 30 and 45 and 7 and 81."


def verdicts(spark, rows, items):
    found = D.decontaminate(make(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {r["doc_id"]: (r["contaminated"], r["n_items"], r["item_ids"]) for r in found}


def test_short_and_dense_items_are_met_inside_documents(spark, words):
    r = random.Random(4)
    noise = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [
        (1, f"{noise(40)}. {SHORT} {noise(40)}", None),
        (2, f"{noise(40)}. {NUMBERS} {noise(40)}", None),
        (3, f"{noise(40)}. 5 14 16 92 66 35 88 79 33 {noise(40)}", None),
        (4, f"{noise(40)}. {SUM.replace('12', '19').replace('45', '2')} {noise(40)}", None),
        (5, noise(90), None),
        (6, f"{noise(40)}. What is left {noise(40)}", None),
    ]
    got = verdicts(spark, rows, [(1, SHORT), (2, NUMBERS), (3, SUM)])
    assert {k: v[2] for k, v in got.items()} == {1: [1], 2: [2], 3: [], 4: [3], 5: [], 6: []}


def test_rows_without_ids_are_judged(spark, words):
    r = random.Random(5)
    item = " ".join(r.choice(words) for _ in range(20))
    got = verdicts(spark, [(None, f"so {item} then", None), (8, item, None)], [(None, item)])
    assert got == {None: (True, 1, []), 8: (True, 1, [])}
