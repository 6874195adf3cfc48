from tidemark.plans.queries import EVENT
from tidemark.sources import read_envelopes, read_payloads, write_envelopes
from tidemark.streaming import route, upgraded_stream


def records(spark):
    return spark.createDataFrame([(("a", 1, 0.5),), (("b", 2, 1.5),)], "record struct<kind:string,user:long,value:double>")


def test_write_and_read_partitioned(spark, tmp_path):
    path = str(tmp_path / "t")
    write_envelopes(records(spark), path, EVENT)
    back = read_envelopes(spark, path, EVENT)
    assert sorted(tuple(r["record"]) for r in back.collect()) == [("a", 1, 0.5), ("b", 2, 1.5)]


def test_text_format_and_payload_columns(spark, tmp_path):
    text = str(tmp_path / "text")
    spark.createDataFrame([('{"stable_name":"shop.event","version":1,"payload":{"kind":"a","user":1,"value":2}}',), ("x",)], "value string").write.text(text)
    assert sorted(str(r["kind"]) for r in read_envelopes(spark, text, EVENT, "text").select("error.kind").collect()) == ["Decode", "None"]
    rows = spark.createDataFrame([("shop.event", 1, '{"kind":"a","user":1,"value":2}'), ("other", 1, "{}")], "n string, version long, payload string")
    rows.write.json(path := str(tmp_path / "json"))
    assert read_payloads(spark, path, EVENT, "json", name="n", only_own=True, schema="n string, version long, payload string").count() == 1


def test_stream_is_routed(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([('{"stable_name":"shop.event","version":1,"payload":{"kind":"a","user":1,"value":2}}',), ("bad",)], "envelope string").write.parquet(source)
    stream = spark.readStream.schema("envelope string").parquet(source)
    query = route(upgraded_stream(stream, EVENT), str(tmp_path / "ok"), str(tmp_path / "failed"), str(tmp_path / "check"))
    assert query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1
    assert [r["kind"] for r in spark.read.parquet(str(tmp_path / "failed")).collect()] == ["Decode"]
