import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.profiles import CHECKS, canonical_time
from tidemark.functions.strict_json import Binder, Place, decode, encode, with_parsed
from tidemark.history import Fallible, Field, History, Update
from tidemark.operators import error_summary, from_versioned, inspect_envelopes, redact, split_ok_failed, to_versioned, upgrade
from tidemark.operators.quality import fail_on_error
from tidemark.shapes import BYTES, F32, F64, I64, I128, STRING, U8, U32, U64, U128, array_of, enum, list_of, map_of, option, record, set_of, tuple_of

CRATE = History.declare(
    "depot.crate",
    Field("crate_code", STRING, removed_in=2),
    Field(
        "grams",
        STRING,
        updates=(
            Update(3, U64, using=lambda p: Fallible(p.grams.cast("string"), F.when(p.grams == 505, F.lit("505")))),
            Update(2, U32, using=lambda p: p.grams),
        ),
    ),
    Field("code", STRING, added_in=2, using=lambda p: p.crate_code),
    Field("scale_model", U32, added_in=2, value=3),
)

CASES = [
    (1, '{"crate_code":"K42","grams":42}', ("42", "K42", 3), None),
    (1, '{"grams":42,"crate_code":"K42"}', ("42", "K42", 3), None),
    (3, '{"grams":"84","code":"K84","scale_model":8}', ("84", "K84", 8), None),
    (3, '{"grams":"505","code":"x","scale_model":1}', ("505", "x", 1), None),
    (1, '{"crate_code":"K13","grams":505}', None, "Upcast"),
    (2, '{"code":"K13","grams":505,"scale_model":0}', None, "Upcast"),
    (1, '{"crate_code":"K42","grams":42,"unknown":true}', None, "Decode"),
    (1, '{"crate_code":"K42","grams":42,"grams":43}', None, "Decode"),
    (1, '{"crate_code":"K42"}', None, "Decode"),
    (1, '["K42",42]', None, "Decode"),
    (1, '{"crate_code":"K42","grams":42} trailing', None, "Decode"),
    (1, '{"crate_code":"K42","grams":42}]', None, "Decode"),
    (1, '{"crate_code":"K42","grams":42},{"b":2}', None, "Decode"),
    (1, '{"crate_code":"K42","grams":"42"}', None, "Decode"),
    (1, '{"crate_code":"K42","grams":42.0}', None, "Decode"),
    (1, '{"crate_code":"K42","grams":4294967296}', None, "Decode"),
    (1, '{"crate_code":"K42","grams":-1}', None, "Decode"),
    (1, '{"crate_code":null,"grams":1}', None, "Decode"),
    (1, "", None, "Decode"),
    (1, None, None, "Decode"),
    (99, "not JSON", None, "UnsupportedVersion"),
    (0, "{}", None, "UnsupportedVersion"),
    (None, "{}", None, "UnsupportedVersion"),
    (2, '{"grams":18446744073709551615,"code":"a","scale_model":4294967295}', ("18446744073709551615", "a", 4294967295), None),
    (2, '{"grams":18446744073709551616,"code":"a","scale_model":1}', None, "Decode"),
    (2, '{"grams":18446744073709551615.0,"code":"a","scale_model":1}', None, "Decode"),
]


@pytest.fixture(scope="module")
def upgraded(spark):
    df = spark.createDataFrame([(n, v, p) for n, (v, p, *_) in enumerate(CASES)], "n int, version long, payload string")
    return upgrade(df, CRATE).cache()


def test_crate_cases(upgraded):
    rows = {r["n"]: r for r in upgraded.collect()}
    for n, (version, payload, expected, kind) in enumerate(CASES):
        got = rows[n]
        assert (tuple(got["record"]) if got["record"] else None) == expected, payload
        assert (got["error"]["kind"] if got["error"] else None) == kind, payload
        if kind == "Upcast":
            assert (got["error"]["source_version"], got["error"]["adjacent_from"], got["error"]["adjacent_to"], got["error"]["cause"]) == (version, 2, 3, "505")


def test_routing(upgraded):
    ok, failed = split_ok_failed(upgraded, ["n"])
    assert ok.columns == ["n", "grams", "code", "scale_model"]
    assert ok.count() + failed.count() == len(CASES)
    counts = {r["kind"]: 0 for r in error_summary(upgraded).collect()}
    for r in error_summary(upgraded).collect():
        counts[r["kind"]] += r["n_rows"]
    assert counts == {k: sum(c[3] == k for c in CASES) for k in ("Upcast", "Decode", "UnsupportedVersion")}


def test_fail_mode_raises(upgraded):
    with pytest.raises(Exception, match="Decode"):
        fail_on_error(upgraded.where("n = 6")).select("record").collect()


def test_plan_has_no_shuffle(spark, upgraded):
    df = spark.createDataFrame([(1, "{}")], "version long, payload string")
    plan = upgrade(df, CRATE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_envelopes(spark):
    payload = '{"crate_code":"K42","grams":42}'
    good = [f'{{"version":1,"payload":{payload},"stable_name":"depot.crate"}}', f'{{"payload":{payload},"stable_name":"depot.crate","version":1}}']
    bad = ["{}", "null", "[]", "x", f'{{"version":1,"payload":{payload}}}', f'{{"version":1,"payload":{payload},"stable_name":"depot.crate","more":1}}']
    bad += [f'{{"version":{v},"payload":{payload},"stable_name":"depot.crate"}}' for v in ("0", "-1", "1.5", '"1"', "null", "true", "4294967296")]
    bad += [f'{{"version":1,"version":1,"payload":{payload},"stable_name":"depot.crate"}}', f'{{"version":1,"payload":{payload},"stable_name":"depot.Crate"}}']
    other = [f'{{"version":1,"payload":{payload},"stable_name":"depot.pallet"}}', f'{{"version":4,"payload":{payload},"stable_name":"depot.crate"}}']
    df = spark.createDataFrame([(n, e) for n, e in enumerate(good + bad + other)], "n int, envelope string")
    kinds = [r["kind"] for r in from_versioned(df, CRATE).orderBy("n").select("error.kind").collect()]
    assert kinds == [None] * len(good) + ["Decode"] * len(bad) + ["TypeMismatch", "UnsupportedVersion"]
    seen = inspect_envelopes(df).orderBy("n").collect()
    assert [r["valid"] for r in seen] == [True] * len(good) + [False] * len(bad) + [True, True]
    assert seen[0]["envelope"] == good[0]
    back = to_versioned(from_versioned(df.where("n = 0"), CRATE), CRATE).first()["envelope"]
    assert json.loads(back) == {"stable_name": "depot.crate", "version": 3, "payload": {"grams": "42", "code": "K42", "scale_model": 3}}


def check(spark, shape, texts):
    binder = Binder()
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    df = with_parsed(df, F.col("t"), "p")
    df = df.withColumn("v", F.try_variant_get("p", "$[0]", "variant"))
    ok, value = decode(Place(F.col("v"), F.col("t"), "$", binder), shape)
    df = binder.add_to(df).withColumns({"ok": F.coalesce(ok, F.lit(False)), "value": value})
    df = df.withColumn("back", F.when(F.col("ok"), encode(F.col("value"), shape)))
    return df.orderBy("n").select("ok", "value", "back").collect()


@pytest.mark.parametrize(
    "shape,good,bad",
    [
        (U8, ["0", "255"], ["256", "-1", "1.0", "1e0", '"1"', "null", "true", "[]"]),
        (U64, ["0", "9223372036854775808", "18446744073709551615"], ["18446744073709551616", "-1", "1.5"]),
        (U128, ["0", "340282366920938463463374607431768211455"], ["340282366920938463463374607431768211456", "-1"]),
        (I128, ["-170141183460469231731687303715884105728", "170141183460469231731687303715884105727"], ["-170141183460469231731687303715884105729", "170141183460469231731687303715884105728"]),
        (F64, ["0.5", "1", "-1e300"], ["1e9999", "NaN", '"1"', "null"]),
        (F32, ["0.5"], ["1e300"]),
        (BYTES, ["[]", "[0,255]"], ["[256]", "[-1]", '"a"', "[1.0]", "[null]"]),
        (list_of(I64), ["[]", "[1,2]"], ["[null]", "{}", '["1"]', "null"]),
        (array_of(U8, 2), ["[1,2]"], ["[1]", "[1,2,3]"]),
        (map_of(I64), ["{}", '{"a":1}'], ['{"a":null}', "[]", '{"a":1,"a":2}']),
        (set_of(STRING), ['["a","a"]'], ['"a"']),
        (tuple_of(U32, option(STRING)), ['[1,"a"]', "[1,null]"], ["[1]", '[1,"a",2]', "[null,null]"]),
        (record(a=I64, b=option(STRING)), ['{"a":1}', '{"a":1,"b":null}', '{"b":"x","a":1}'], ["{}", '{"a":1,"c":2}', "[1]", '{"a":null}']),
        (enum(Idle=None, Count=U32, Pair=tuple_of(U32, STRING), Named=record(amount=U32, note=option(STRING))), ['"Idle"', '{"Idle":null}', '{"Count":3}', '{"Pair":[1,"x"]}', '{"Named":{"amount":1}}'], ["{}", '"Unknown"', '"Count"', '{"Count":"bad"}', '{"Idle":7}', '{"Pair":[1]}', '{"Named":[1,null]}', '{"Named":{}}', '{"Idle":null,"Count":1}']),
    ],
)
def test_shapes_accept_and_reject(spark, shape, good, bad):
    rows = check(spark, shape, good + bad)
    assert [r["ok"] for r in rows] == [True] * len(good) + [False] * len(bad)
    again = check(spark, shape, [r["back"] for r in rows[: len(good)]])
    assert [r["ok"] for r in again] == [True] * len(good)
    assert [r["value"] for r in again] == [r["value"] for r in rows[: len(good)]]


PROFILES = {
    "uuid": (["00000000-0000-0000-0000-000000000000", "ffffffff-ffff-ffff-ffff-ffffffffffff"], ["FFFFFFFF-ffff-ffff-ffff-ffffffffffff", "ffffffffffffffffffffffffffffffff", " 0000000-0000-0000-0000-000000000000", "g0000000-0000-0000-0000-000000000000"]),
    "decimal96": (["123.400", "0", "-0", "-0.000", "0." + "0" * 28, "79228162514264337593543950335", "-7.9228162514264337593543950335", "0." + "0" * 27 + "1"], ["+1", "1e2", "1_000", " 1", "1 ", ".1", "1.", "--1", "1.2.3", "0." + "0" * 29, "79228162514264337593543950336", "79228162514264337593543950335.0", ""]),
    "date": (["0000-01-01", "9999-12-31", "2000-02-29"], ["2023-02-29", "1900-02-29", "2023-13-01", "2023-1-01", "10000-01-01"]),
    "local_time": (["00:00:00", "23:59:59.999999999"], ["24:00:00", "12:34:60", "12:34", "12:34:56.1234567890", "12:34:56."]),
    "local_datetime": (["2000-02-29T12:00:00"], ["2000-02-29 12:00:00", "2001-02-29T12:00:00", "2000-02-29t12:00:00"]),
    "utc_instant": (["2000-02-29T12:00:00.5Z"], ["2000-02-29T12:00:00z", "2000-02-29T12:00:00"]),
    "offset_datetime": (["2000-02-29T12:00:00+23:59", "0000-01-01T23:59:00+23:59"], ["2000-02-29T12:00:00-00:00", "2000-02-29T12:00:00+24:00", "2000-02-29T12:00:00+01:00:30", "0000-01-01T00:00:00+00:01", "9999-12-31T23:59:00-00:01"]),
}


@pytest.mark.parametrize("kind", PROFILES)
def test_profiles(spark, kind):
    good, bad = PROFILES[kind]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(good + bad)], "n int, t string").withColumn("ok", F.coalesce(CHECKS[kind](F.col("t")), F.lit(False)))
    assert [r["ok"] for r in df.orderBy("n").collect()] == [True] * len(good) + [False] * len(bad)


def test_canonical_times(spark):
    cases = {"12:34:56.100": "12:34:56.1", "12:34:56.0": "12:34:56", "2000-01-01T12:34:56.010Z": "2000-01-01T12:34:56.01Z", "2000-01-01T12:34:50+01:00": "2000-01-01T12:34:50+01:00"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("c", canonical_time(F.col("t")))
    assert {r["t"]: r["c"] for r in df.collect()} == cases


def test_callbacks_see_the_whole_row_before(spark):
    h = History.declare("swap", Field("a", I64, updates=(Update(2, I64, using=lambda p: p.b),)), Field("b", I64, updates=(Update(2, I64, using=lambda p: p.a),)))
    df = spark.createDataFrame([(1, '{"a":1,"b":2}')], "version long, payload string")
    assert tuple(upgrade(df, h).first()["record"]) == (2, 1)


def test_first_declared_failure_counts(spark):
    bad = lambda cause: lambda p: Fallible(p.a, F.lit(cause))
    h = History.declare("two", Field("a", I64), Field("b", I64, added_in=2, using=bad("first")), Field("c", I64, added_in=2, using=bad("second")), Field("d", I64, added_in=3, using=bad("third")))
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":1,"b":1,"c":1}')], "version long, payload string")
    assert [(r["error"]["cause"], r["error"]["adjacent_from"]) for r in upgrade(df, h).orderBy("version").collect()] == [("first", 1), ("third", 2)]


def test_sixty_four_versions(spark):
    h = History.declare("long", Field("field_1", U32), *(Field(f"field_{k}", U32, added_in=k, value=0) for k in range(2, 65)))
    df = spark.createDataFrame([(1, '{"field_1":19}')], "version long, payload string")
    record = upgrade(df, h).first()["record"]
    assert len(record) == 64 and record["field_1"] == 19 and sum(record) == 19


def test_clashing_columns_are_replaced_and_empty_tables_work(spark):
    df = spark.createDataFrame([], "version long, payload string, record string, error string, other int")
    out = upgrade(df, CRATE)
    assert out.count() == 0 and out.columns == ["version", "payload", "other", "source_version", "record", "error"]


def test_redaction_keeps_what_is_stored(spark):
    h = History.declare("account", Field("owner", STRING, redact=True), Field("balance", U64, redact=True), Field("contacts", list_of(record(email=STRING)), redact=True), Field("kind", STRING))
    df = spark.createDataFrame([(1, '{"owner":"Ann","balance":5,"contacts":[{"email":"a@b"}],"kind":"x"}')], "version long, payload string")
    row = redact(upgrade(df, h), h).first()
    assert (row["record"]["owner"], int(row["record"]["balance"]), row["record"]["contacts"][0]["email"], row["record"]["kind"]) == ("[REDACTED]", 0, "[REDACTED]", "x")
    assert "Ann" in row["payload"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-5, 300), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=4), st.booleans(), st.none(), st.lists(st.integers(0, 3), max_size=2)), min_size=1, max_size=20))
def test_u8_gate_against_python(spark, values):
    rows = check(spark, U8, [json.dumps(v) for v in values])
    assert [r["ok"] for r in rows] == [type(v) is int and 0 <= v <= 255 for v in values]
