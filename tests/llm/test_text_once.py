import corpus_pipeline
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from llm_helpers import make
from tidemark.llm import language_id
from tidemark.llm import sentencepiece_codec as C
from tidemark.llm.storage import with_text


def sent(df):
    """The columns that go to the Python workers of the last map over Arrow batches."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    return [plan.children().head().output().apply(k).name() for k in range(plan.children().head().output().size())]


def test_a_kept_text_goes_to_the_workers_once(spark):
    """The text of a batch is held once on both sides, in all functions that return it."""
    docs = make(spark, [(1, "one text", "aa"), (2, None, "bb"), (3, "", "aa"), (4, "ends here  ", None)])
    path = public_tokenizers.path("piece_bpe_32k.model")
    for df in (C.encode_and_decode(docs, path), C.encode(docs, path), language_id.drop_undetermined(docs)):
        assert sent(df) == docs.columns
    got = {r["doc_id"]: r for r in C.encode_and_decode(docs, path).collect()}
    assert [got[k]["text"] for k in (1, 2, 3, 4)] == ["one text", None, "", "ends here  "]
    assert [got[k]["decoded"] for k in (1, 2, 3, 4)] == ["one text", "", "", "ends here  "]
    assert [r["ids"] for r in C.encode(docs, path).orderBy("doc_id").collect()] == [got[k]["ids"] for k in (1, 2, 3, 4)]


def test_a_text_of_another_type_or_name_is_still_read(spark):
    docs = make(spark, [(12, "a", "aa")])
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert with_text(docs, "doc_id", docs.columns)[0].columns == [*docs.columns, "__text"]
    row = C.encode_and_decode(docs, path, text="doc_id").first()
    assert (row["doc_id"], row["text"], row["decoded"]) == (12, "a", "12")
    row = C.encode_and_decode(docs.select("doc_id", F.col("text").alias("decoded")), path, text="decoded").first()
    assert (row["doc_id"], row["decoded"], row["n_tokens"]) == (12, "a", len(row["ids"]))


def test_stages_send_small_batches(spark, tmp_path):
    """A stage's batches of long texts stay small, whatever the session had; a smaller setting stays."""
    keys = list(corpus_pipeline.BATCH)
    before = {k: spark.conf.get(k) for k in keys}
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 2000).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.set(keys[1], "64m")
        corpus_pipeline.sentencepiece_stage(spark, docs, str(tmp_path))
        found = docs.mapInArrow(run, "n long, bytes long").collect()
        assert sum(r["n"] for r in found) == 3000 and max(r["n"] for r in found) <= 1000
        assert max(r["bytes"] for r in found) <= 21_000_000
        spark.conf.set(keys[0], "500")
        corpus_pipeline.sentencepiece_stage(spark, docs, str(tmp_path))
        assert spark.conf.get(keys[0]) == "500"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
