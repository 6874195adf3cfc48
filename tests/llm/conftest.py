import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import make  # noqa: E402

@pytest.fixture(scope="session")
def words():
    """Words made from syllables, the same ones each time."""
    r = random.Random(5)
    parts = "ba ko li mu re sa to ni fe du".split()
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(3000)]


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that operators must take without harm."""
    return [None, "", " \t\n\x0b\x0c\r", "a", "é", "\U0001f600 x", "x" * 70_000, "ab " * 30_000, "line\n\nline\r\n", "▁▁ marker", "\x00nul", "same words here", "same words here"]


@pytest.fixture(scope="session")
def corpus(spark, words, odd_texts):
    """(rows, DataFrame): prose with exact and near copies, shared passages and the odd texts."""
    r = random.Random(7)
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(30)
    rows = []
    for k in range(120):
        text = prose(r.randint(3, 150))
        if k % 6 == 1:
            text = rows[r.randrange(len(rows))][1]
        elif k % 6 == 2 and rows:
            near = (rows[r.randrange(len(rows))][1] or "").split()
            if near:
                near[r.randrange(len(near))] = "changed"
            text = " ".join(near)
        elif k % 6 == 3:
            text = f"{text}\n{passage} {prose(5)}"
        rows.append((k, text, "en"))
    rows += [(1000 + k, t, None) for k, t in enumerate(odd_texts)]
    r.shuffle(rows)
    return rows, make(spark, rows).repartition(3).cache()
