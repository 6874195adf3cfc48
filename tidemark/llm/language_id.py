"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (one to three code points of the
lower-cased text), weighted by relative frequency and inverse document
frequency.  Document frequencies cover all labelled rows that may be learned
from.  The weights are trained by follow-the-regularised-leader with an
elastic-net penalty on a bounded sample, ``per_language`` expected rows of each
language, chosen by a hash of the id; a fifth of the sample sets the
temperature of the probabilities.  The model has a fixed size, so every task
carries it.  Prediction is a sum over the n-grams of the whole text.

Defined results: a null text and one without a letter is ``und`` with score
zero.  Without a labelled row every text is ``und``.  A row with null id is
never learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize, small, with_text


BITS = 16
#: Expected rows of a language that the weights are trained on.
PER_LANGUAGE = 1000
#: Score under which ``drop_undetermined`` takes a text for one of no learned language: the least of the held-out rows of sf0.1 is 0.386.
LEAST = 0.35
PIECE = 1 << 18
_PLAIN = re.compile("[A-Za-z]")
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages, times the inverse document frequency
    bias: np.ndarray
    temperature: float


def has_letter(text: str) -> bool:
    return bool(_PLAIN.search(text)) or any(map(str.isalpha, text))


def features(text: str) -> Iterator[np.ndarray]:
    """The hashed n-grams of a text, each occurrence, in pieces of bounded size."""
    text = text.lower()
    for start in range(0, len(text), PIECE):
        c = np.frombuffer(text[max(0, start - 2) : start + PIECE].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        skip = min(start, 2)  # n-grams that end in the piece before
        one = c * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] * np.uint64(31) + one[1:] + np.uint64(7) if len(c) > 1 else c[:0]
        three = two[:-1] * np.uint64(31) + one[2:] + np.uint64(77) if len(c) > 2 else c[:0]
        yield (np.concatenate([one[skip:], two[max(0, skip - 1) :], three]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int32)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and their counts."""
    counts = sum((np.bincount(f, minlength=1 << BITS) for f in features(text)), np.zeros(1 << BITS, np.int64))
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many rows have each feature, and the number of rows; one partial vector a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                seen = np.zeros(1 << BITS, bool)
                for f in features(t.as_py() or ""):
                    seen[f] = True
                total += seen
                n += 1
        at = np.flatnonzero(total)
        at, total = np.append(at, 1 << BITS), np.append(total[at], n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total, pa.int64())], names=["feature", "n"])

    sums = docs.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # at most 2^BITS + 1 rows
    df = np.zeros((1 << BITS) + 1)
    df[found["feature"].to_numpy(int)] = found["n"]
    return df[:-1], int(df[-1])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 0.1, l1: float = 1e-4, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after FTRL-proximal passes over (indices, values, class) rows."""
    d = (1 << BITS) + 1  # the last one is the bias
    z, n = np.zeros((d, n_classes)), np.zeros((d, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0, w)

    random = np.random.default_rng(7)
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, d - 1), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(d))
    return w[:-1], w[-1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least log loss, from a grid in steps of a tenth."""
    if not len(classes):
        return 1.0

    def loss(t: float) -> float:
        x = logits / t
        m = x.max(1)
        return float((m + np.log(np.exp(x - m[:, None]).sum(1)) - x[np.arange(len(x)), classes]).mean())

    return min(np.geomspace(0.05, 20, 60), key=loss)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the rows (doc_id, text, lang), none of them null."""
    sizes = materialize(labelled.groupBy("lang").count(), "languages")
    order = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    sample = labelled.join(small(sizes), "lang").where(order * F.col("count") < F.lit(float(per_language) * (1 << 30))) if not sizes.isEmpty() else None
    if sample is None:
        return None
    df, n = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1

    def count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [counted(t) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "part": batch["part"], "at": [p[0] for p in pairs], "n": [p[1] for p in pairs]})

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["part", "lang"], kind="stable")
        languages = sorted(set(rows["lang"]))
        data = []
        for lang, at, counts in zip(rows["lang"], rows["at"], rows["n"], strict=True):
            data.append((np.asarray(at, int), 10 * np.asarray(counts) / max(1, sum(counts)) * idf[np.asarray(at, int)], languages.index(lang)))
        held = (rows["part"] % 5 == 0).to_numpy() if len(rows) > 50 else np.zeros(len(rows), bool)
        w, b = ftrl([d for d, h in zip(data, held, strict=True) if not h], len(languages))
        test = [d for d, h in zip(data, held, strict=True) if h]
        t = temperature(np.array([x @ w[at] + b for at, x, _ in test]), np.array([y for *_, y in test]))
        yield pd.DataFrame({"languages": [languages], "weights": [(10 * w * idf[:, None]).astype(np.float32).tobytes()], "bias": [b.tobytes()], "temperature": [t]})

    rows = sample.select("lang", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)).alias("part"), "text").mapInPandas(count_rows, "lang string, part long, at array<int>, n array<long>")
    # the sample's counts are written by all tasks; only they, a bounded number, meet in one
    model = materialize(rows, "sample").coalesce(1).mapInPandas(train, "languages array<string>, weights binary, bias binary, temperature double").first()
    k = len(model["languages"])
    n_rows = {r["lang"]: r["count"] for r in sizes.collect()}  # a row for each language
    prior = np.log([n_rows[lang] / sum(n_rows.values()) for lang in model["languages"]])  # the sample is balanced
    bias = np.frombuffer(model["bias"]) + model["temperature"] * prior
    return Model(model["languages"], np.frombuffer(model["weights"], np.float32).reshape(-1, k), bias, model["temperature"])


def predict(docs: DataFrame, model: Model | None, text: str = "text", kept: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``kept`` of ``docs`` with lang_pred and score."""
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    rows, place = with_text(docs, text, list(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(place):
                t = t.as_py()
                if t is None or model is None or not has_letter(t):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total, n = np.zeros(len(model.languages)), 0
                for f in features(t):
                    total += model.weights[f].sum(0, dtype=np.float64)
                    n += len(f)
                p = softmax((total / n + model.bias) / model.temperature)
                langs.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null stays null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def labelled_rows(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: labelled, and not of the held-out fold."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.where((remainder(F.col("doc_id"), 4) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    model = fit(labelled_rows(docs, text, lang, doc_id), per_language)
    found = predict(docs.withColumnRenamed(doc_id, "doc_id"), model, text, ("doc_id",))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def drop_undetermined(docs: DataFrame, least: float = LEAST, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the texts that have no letter or, by the model, a score under ``least``; with no model that is not asked."""
    model = fit(labelled_rows(docs, text, lang, doc_id))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if model is None:
        return docs.where(F.col(text).cast("string").rlike(r"\p{L}")).select(kept)
    found = predict(docs, model, text, tuple(kept))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(kept)
