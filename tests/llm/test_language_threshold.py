import random
import zlib

import pytest

from llm_helpers import make
from tidemark.llm import language_id as L

PARTS = ["the and of ing tion wh", "der die und sch ung ein", "que los ado cion ez ar", "ja joo kka yys ttu mme"]


@pytest.fixture(scope="module")
def spoken():
    r = random.Random(6)
    rows = []
    for k in range(600):
        parts = PARTS[k % 4].split()
        rows.append((k, " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(r.randint(8, 60))), f"l{k % 4}"))
    return rows


def test_uncertain_texts_go_and_held_out_ones_stay(spark, spoken):
    r = random.Random(8)
    # of no language: labelled by lot, so the model cannot tell
    lots = [(2000 + k, " ".join("".join(r.choice("qxzvkjpb") for _ in range(6)) for _ in range(30)), f"l{r.randrange(4)}") for k in range(400)]
    docs = make(spark, [*spoken, *lots])
    scores = {x["doc_id"]: x["score"] for x in L.identify(docs).collect()}
    kept = {x["doc_id"] for x in L.drop_undetermined(docs).collect()}
    held = {k for k, _, _ in spoken if zlib.crc32(str(k).encode()) % 4 == 2}
    assert len(held) > 100 and held <= kept
    assert kept == {k for k, s in scores.items() if s >= L.LEAST} and len(scores) - len(kept) > 100


def test_without_a_model_documents_pass(spark):
    docs = make(spark, [(1, "some text", None), (2, None, None), (3, "12 !", None), (4, "é", None)])
    assert sorted(r["doc_id"] for r in L.drop_undetermined(docs).collect()) == [1, 4]
