import pytest
from pyspark.sql import functions as F

from tidemark.history import Field, History, HistoryError, Update
from tidemark.shapes import I64, STRING, U32, U64, Shape, array_of, enum, list_of, option, record, set_of, tuple_of


def test_types_are_reconstructed_newest_first():
    f = Field("n", STRING, updates=(Update(5, U64, value="x"), Update(3, U32, value=1)))
    assert [f.shape_at(v) for v in (1, 2, 3, 4, 5)] == [U32, U32, U64, U64, STRING]
    h = History.declare("a.b", f, Field("late", I64, added_in=4, value=0, removed_in=6))
    assert h.head == 6
    assert [m.name for m in h.shape_at(3).members] == ["n"]
    assert [m.name for m in h.shape_at(5).members] == ["n", "late"]


@pytest.mark.parametrize(
    "make",
    [
        lambda: Field("n", I64, added_in=2),
        lambda: Field("n", I64, added_in=2, value=1, using=lambda p: p.x),
        lambda: Field("n", I64, value=1),
        lambda: Field("n", I64, updates=(Update(2, U32, value=1), Update(3, U32, value=1))),
        lambda: Field("n", I64, updates=(Update(3, U32, value=1), Update(3, U32, value=1))),
        lambda: Field("n", I64, updates=(Update(3, U32),)),
        lambda: Field("n", I64, added_in=3, value=1, updates=(Update(3, U32, value=1),)),
        lambda: Field("n", I64, removed_in=1),
        lambda: Field("n", I64, updates=(Update(4, U32, value=1),), removed_in=4),
        lambda: Field("n", I64, added_in=0),
        lambda: Field("n", I64, added_in=2**32, value=1),
        lambda: Field("N", I64),
        lambda: History.declare("Bad", Field("n", I64)),
        lambda: History.declare("a..b", Field("n", I64)),
        lambda: History.declare("a" * 256, Field("n", I64)),
        lambda: History.declare("a", Field("n", I64), Field("n", STRING)),
        lambda: option(option(I64)),
        lambda: array_of(I64, 33),
        lambda: tuple_of(),
        lambda: Shape.from_json({"kind": "string", "more": 1}),
    ],
)
def test_rules_are_enforced(make):
    with pytest.raises(ValueError):
        make()


def test_a_callback_of_a_missing_field_is_told(spark):
    h = History.declare("a", Field("x", I64), Field("y", I64, added_in=2, using=lambda p: p.nothing))
    from tidemark.history import Previous, converted

    with pytest.raises(HistoryError, match="no field nothing"):
        converted(h.fields[1].rule_at(2), Previous({"x": F.lit(1)}), I64)


def test_shapes_survive_json():
    shape = record(a=option(list_of(U64)), b=set_of(STRING), c=tuple_of(I64, STRING), d=enum(One=None, Two=I64, Three=record(x=U32)))
    assert Shape.from_json(shape.to_json()) == shape
    assert Shape.from_json(record(x=I64, y=STRING).to_json()) == record(y=STRING, x=I64)
    assert record(x=I64) != record(x=U64)
