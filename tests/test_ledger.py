import json
import os

import pytest

from tidemark import ledger as L
from tidemark.history import Field, History, Update
from tidemark.json_schema import document
from tidemark.shapes import I64, STRING, U32, U64, array_of, enum, option, record, set_of, tuple_of


def history(*more, name="shop.a"):
    return History.declare(name, Field("x", I64), *more)


TWO = Field("y", STRING, added_in=2, value="")
THREE = Field("z", STRING, added_in=3, value="")


def test_freeze_draft_and_successor():
    empty = L.Ledger()
    assert empty.readiness(history()) == L.DRAFT
    one = empty.frozen([history()])
    assert one.readiness(history()) == L.FROZEN
    assert one.readiness(history(TWO)) == L.DRAFT
    with pytest.raises(L.LedgerError):
        one.readiness(history(TWO, THREE))
    with pytest.raises(L.LedgerError):
        empty.readiness(history(TWO))
    with pytest.raises(L.LedgerError):
        one.require_frozen(history(TWO))
    with pytest.raises(L.LedgerError):
        one.frozen([])
    with pytest.raises(L.LedgerError):
        one.frozen([History.declare("shop.a", Field("x", U64))])


def test_reset_and_undo():
    two = L.Ledger().frozen([history()]).frozen([history(TWO)])
    open_ = two.reset("shop.a", 2)
    assert open_.readiness(history(TWO)) == L.RESET_DRAFT
    assert open_.reset("shop.a", 2, undo=True).entries == two.entries
    with pytest.raises(L.LedgerError):
        two.reset("shop.a", 1)
    with pytest.raises(L.LedgerError):
        open_.frozen([history(TWO)])
    changed = history(Field("y", I64, added_in=2, value=0))
    assert open_.frozen([changed], {("shop.a", 2)}).readiness(changed) == L.FROZEN
    with pytest.raises(L.LedgerError):
        open_.readiness(history(TWO, THREE))


def test_import():
    one = L.Ledger().frozen([history()])
    two = L.Ledger.observed([history(TWO)])
    assert one.imported(two, [history(TWO)]) is two
    with pytest.raises(L.LedgerError):
        two.imported(one, [history()])


def test_text_round_trip_and_bad_texts():
    ledger = L.Ledger.observed([history(TWO), history(name="b")])
    assert L.Ledger.parse(ledger.text()).entries == ledger.entries
    raw = json.loads(ledger.text())
    for change in (lambda r: r["b"].update({"3": r["b"]["1"]}), lambda r: r["b"].update({"01": r["b"].pop("1")}), lambda r: r.update(Bad=r.pop("b")), lambda r: r["b"]["1"].update(more=1), lambda r: r.update(b={}), lambda r: r["shop.a"]["1"].update(reset_draft=True)):
        copy = json.loads(json.dumps(raw))
        change(copy)
        with pytest.raises(L.LedgerError):
            L.Ledger.parse(json.dumps(copy))
    with pytest.raises(L.LedgerError):
        L.Ledger.parse('{"a":{},"a":{}}')


def test_files(tmp_path):
    path = str(tmp_path / "ledger.json")
    L.init(path)
    with pytest.raises(FileExistsError):
        L.init(path)
    L.change(path, lambda ledger: ledger.frozen([history()]))
    assert L.load(path).head("shop.a") == 1
    before = open(path).read()
    with pytest.raises(L.LedgerError):
        L.change(path, lambda ledger: ledger.reset("shop.a", 5))
    assert open(path).read() == before and os.path.exists(path)
    with L._locked(path), pytest.raises(L.LedgerError):
        L.change(path, lambda ledger: ledger)


def test_diff_codes(spark):
    def one(**members):
        return L.Ledger({"a": {1: L.Entry(record(**members))}}).facts_df(spark)

    def codes(old, new):
        return {(r["path"], r["code"]) for r in L.diff(one(**old), one(**new)).collect()}

    assert codes({"x": I64}, {"x": I64}) == set()
    assert codes({"x": I64}, {"y": I64}) == {('$["x"]', "field_missing"), ('$["y"]', "field_added")}
    assert codes({"x": I64}, {"x": U32}) == {('$["x"]', "shape_kind_changed")}
    assert codes({"x": array_of(I64, 2)}, {"x": array_of(I64, 3)}) == {('$["x"]', "array_length_changed")}
    assert codes({"x": set_of(I64)}, {"x": set_of(I64, "mine")}) == {('$["x"]', "membership_changed")}
    assert ('$["x"]', "tuple_length_changed") in codes({"x": tuple_of(I64)}, {"x": tuple_of(I64, I64)})
    assert codes({"x": enum(A=None, B=I64)}, {"x": enum(A=I64, C=I64)}) >= {('$["x"].variant["A"]', "variant_kind_changed"), ('$["x"].variant["B"]', "variant_missing"), ('$["x"].variant["C"]', "variant_added")}
    assert codes({"x": record(k=I64)}, {"x": record(k=STRING)}) == {('$["x"]["k"]', "shape_kind_changed")}


def test_check_and_report(spark):
    saved = L.Ledger.observed([history(TWO), history(name="gone")])
    found = L.check(spark, saved, [history()], baseline=saved)
    rows = {(r["stable_name"], r["version"], r["code"], r["released"]) for r in found.collect()}
    assert rows == {(n, v, c, r) for n, v, c in (("gone", 1, "history_missing"), ("shop.a", 2, "version_missing")) for r in (False, True)}
    report = json.loads(L.report(found))
    assert report["ok"] is False and len(report["diagnostics"]) == 4
    assert L.check(spark, saved, [history(TWO, THREE), history(name="gone")]).count() == 0
    assert saved.entries_df(spark).count() == 3


def test_canonical_json_orders_by_utf16():
    assert L.canonical_json({"\U0001f600": 1, "￿": 2, "a": 3}) == '{"a":3,"\U0001f600":1,"￿":2}'


def test_json_schema():
    schema = document(record(a=option(U32), b=I64), "t")
    assert schema["required"] == ["b"] and schema["additionalProperties"] is False and schema["properties"]["a"]["anyOf"][1] == {"type": "null"}


def test_update_type_is_part_of_the_shape():
    h = History.declare("a", Field("x", STRING, updates=(Update(2, U64, value=""),)))
    assert h.shape_at(1) == record(x=U64) and h.shape_at(2) == record(x=STRING)
