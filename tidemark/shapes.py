"""Shapes: the closed type language of stored fields, and their Spark types.

A shape says exactly which JSON values a field may hold.  Numbers of up to 64
bits have Spark numeric types; 128-bit integers, decimals, fractions of
nanoseconds and offsets keep their exact text, since Spark's types would round
them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: kind -> (least, largest, Spark type)
INTEGERS = {
    "i8": (-(2**7), 2**7 - 1, T.ByteType()),
    "i16": (-(2**15), 2**15 - 1, T.ShortType()),
    "i32": (-(2**31), 2**31 - 1, T.IntegerType()),
    "i64": (-(2**63), 2**63 - 1, T.LongType()),
    "i128": (-(2**127), 2**127 - 1, T.StringType()),
    "u8": (0, 2**8 - 1, T.ShortType()),
    "u16": (0, 2**16 - 1, T.IntegerType()),
    "u32": (0, 2**32 - 1, T.LongType()),
    "u64": (0, 2**64 - 1, T.DecimalType(20, 0)),
    "u128": (0, 2**128 - 1, T.StringType()),
}
FLOATS = {"f32": T.FloatType(), "f64": T.DoubleType()}
#: Texts with a fixed spelling; see functions/profiles.py.
PROFILES = ("uuid", "decimal96", "date", "local_time", "local_datetime", "utc_instant", "offset_datetime")
SCALARS = (*INTEGERS, *FLOATS, "bool", "string", *PROFILES)


@dataclass(frozen=True)
class Member:
    """A field of a record.  An optional one may be left out or null; its shape is an option."""

    name: str
    shape: Shape
    optional: bool = False


@dataclass(frozen=True)
class Shape:
    kind: str
    items: tuple[Shape, ...] = ()
    members: tuple[Member, ...] = ()
    size: int | None = None
    rule: str | None = None  # what makes two members of a set the same
    variants: tuple[tuple[str, str, Shape | None], ...] = field(default=())  # (tag, unit|newtype|tuple|record, payload)

    @property
    def item(self) -> Shape:
        return self.items[0]

    def spark_type(self) -> T.DataType:
        k = self.kind
        if k in INTEGERS:
            return INTEGERS[k][2]
        if k in FLOATS:
            return FLOATS[k]
        if k == "bool":
            return T.BooleanType()
        if k == "date":
            return T.DateType()
        if k == "string" or k in PROFILES:
            return T.StringType()
        if k == "bytes":
            return T.BinaryType()
        if k == "option":
            return self.item.spark_type()
        if k in ("list", "array", "set"):
            return T.ArrayType(self.item.spark_type())
        if k == "map":
            return T.MapType(T.StringType(), self.item.spark_type())
        if k == "tuple":
            return T.StructType([T.StructField(f"_{n + 1}", s.spark_type()) for n, s in enumerate(self.items)])
        if k == "record":
            return T.StructType([T.StructField(m.name, m.shape.spark_type()) for m in self.members])
        if k == "enum":
            held = [T.StructField(tag, s.spark_type()) for tag, kind, s in self.variants if kind != "unit"]
            return T.StructType([T.StructField("tag", T.StringType()), *held])
        raise ValueError(f"unknown shape {k}")

    def facts(self, path: str = "$") -> Iterator[tuple[str, str, str]]:
        """(path, attribute, value) rows that together say everything about the shape."""
        yield path, "kind", self.kind
        if self.size is not None:
            yield path, "length", str(self.size)
        if self.rule is not None:
            yield path, "membership", self.rule
        if self.kind == "tuple":
            yield path, "tuple_length", str(len(self.items))
        for n, s in enumerate(self.items):
            yield from s.facts(f"{path}[{n}]" if self.kind == "tuple" else f"{path}.{'*' if self.kind == 'map' else 'item'}")
        for m in sorted(self.members, key=lambda m: m.name):
            yield f'{path}["{m.name}"]', "presence", "optional" if m.optional else "required"
            yield from m.shape.facts(f'{path}["{m.name}"]')
        for tag, kind, s in sorted(self.variants, key=lambda v: v[0]):
            yield f'{path}.variant["{tag}"]', "variant", kind
            if s is not None:
                yield from s.facts(f'{path}.variant["{tag}"]')

    def to_json(self) -> dict:
        out: dict = {"kind": self.kind}
        if self.items:
            out["items"] = [s.to_json() for s in self.items]
        if self.kind == "record":
            out["members"] = [{"name": m.name, "optional": m.optional, "shape": m.shape.to_json()} for m in sorted(self.members, key=lambda m: m.name)]
        if self.size is not None:
            out["size"] = self.size
        if self.rule is not None:
            out["rule"] = self.rule
        if self.variants:
            out["variants"] = [{"tag": t, "kind": k, "shape": s and s.to_json()} for t, k, s in sorted(self.variants, key=lambda v: v[0])]
        return out

    @staticmethod
    def from_json(value: dict) -> Shape:
        unknown = set(value) - {"kind", "items", "members", "size", "rule", "variants"}
        if unknown:
            raise ValueError(f"unknown keys in a shape: {sorted(unknown)}")
        return checked(
            Shape(
                value["kind"],
                tuple(map(Shape.from_json, value.get("items", ()))),
                tuple(Member(m["name"], Shape.from_json(m["shape"]), m["optional"]) for m in value.get("members", ())),
                value.get("size"),
                value.get("rule"),
                tuple((v["tag"], v["kind"], Shape.from_json(v["shape"]) if v["shape"] else None) for v in value.get("variants", ())),
            )
        )

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Shape) and self.to_json() == other.to_json()

    def __hash__(self) -> int:
        return hash(repr(self.to_json()))


def checked(shape: Shape) -> Shape:
    """``shape``, or an error that names what is wrong with it."""
    k = shape.kind
    if k in ("option", "list", "array", "set", "map") and len(shape.items) != 1:
        raise ValueError(f"{k} takes one shape")
    if k == "option" and shape.item.kind == "option":
        raise ValueError("an option of an option cannot be told apart")
    if k == "array" and not 0 <= (shape.size if shape.size is not None else -1) <= 32:
        raise ValueError("an array has 0 to 32 items")
    if k == "tuple" and not 1 <= len(shape.items) <= 16:
        raise ValueError("a tuple has 1 to 16 items")
    if k == "set" and not shape.rule:
        raise ValueError("a set says what makes members the same")
    names = [m.name for m in shape.members] or [t for t, *_ in shape.variants]
    if len(set(names)) != len(names):
        raise ValueError(f"{k} repeats a name")
    if any(m.optional and m.shape.kind != "option" for m in shape.members):
        raise ValueError("an optional field holds an option")
    if k not in SCALARS and k not in ("bytes", "option", "list", "array", "set", "map", "tuple", "record", "enum"):
        raise ValueError(f"unknown shape {k}")
    return shape


def scalar(kind: str) -> Shape:
    return checked(Shape(kind))


I8, I16, I32, I64, I128, U8, U16, U32, U64, U128 = map(scalar, INTEGERS)
F32, F64, BOOL, STRING, BYTES = map(scalar, ("f32", "f64", "bool", "string", "bytes"))
UUID, DECIMAL, DATE, LOCAL_TIME, LOCAL_DATETIME, UTC_INSTANT, OFFSET_DATETIME = map(scalar, PROFILES)


def option(item: Shape) -> Shape:
    return checked(Shape("option", (item,)))


def list_of(item: Shape) -> Shape:
    return checked(Shape("list", (item,)))


def array_of(item: Shape, size: int) -> Shape:
    return checked(Shape("array", (item,), size=size))


def map_of(item: Shape) -> Shape:
    return checked(Shape("map", (item,)))


def set_of(item: Shape, rule: str | None = None) -> Shape:
    return checked(Shape("set", (item,), rule=rule or f"tidemark:same:{item.kind}:v1"))


def tuple_of(*items: Shape) -> Shape:
    return checked(Shape("tuple", items))


def record(**members: Shape) -> Shape:
    """A record; fields that are options may be left out."""
    return checked(Shape("record", members=tuple(Member(n, s, s.kind == "option") for n, s in members.items())))


def enum(**variants: Shape | None) -> Shape:
    """An enum: None is a unit variant, a record or tuple shape its own kind, any other a newtype."""
    kind = lambda s: "unit" if s is None else s.kind if s.kind in ("record", "tuple") else "newtype"
    return checked(Shape("enum", variants=tuple((t, kind(s), s) for t, s in variants.items())))
