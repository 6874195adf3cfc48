"""Strict decoding of JSON texts to typed columns, and encoding back.

A text is parsed once to a variant, between a bracket and a value that nobody
can guess, so trailing input is noticed; duplicate keys at any depth make the
parse null.  ``decode`` then builds, for a shape, one predicate (the value is
exactly of that shape) and one typed column.  No function here raises on data.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.profiles import CANONICAL, CHECKS
from tidemark.shapes import FLOATS, INTEGERS, PROFILES, Shape


def with_parsed(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the column ``name``: [value, guard] as a variant, or null if ``text`` is not one JSON value."""
    guard = uuid.uuid4().hex
    df = df.withColumn(f"{name}_raw", F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{guard}"]'))))
    raw = F.col(f"{name}_raw")
    # with input after the value, the guard is not the second item, or not the last
    whole = (F.try_variant_get(raw, "$[1]", "string") == guard) & F.try_variant_get(raw, "$[2]", "variant").isNull()
    return df.withColumn(name, F.when(whole, raw)).drop(f"{name}_raw")


class Binder:
    """Columns to add in stages, so that what is used often is computed once.

    A stage may use the columns of those before it.
    """

    def __init__(self, prefix: str = "__b"):
        self.prefix, self.stages, self.count = prefix, [], 0

    def bind(self, column: Column, level: int) -> Column:
        while len(self.stages) <= level:
            self.stages.append({})
        name = f"{self.prefix}{self.count}"
        self.count += 1
        self.stages[level][name] = column
        return F.col(name)

    def add_to(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            if stage:
                df = df.withColumns(stage)
        return df


@dataclass(frozen=True)
class Place:
    """A value in a parsed text: its variant, and its own text if a path leads there.

    ``binder`` takes what is used more than once, from stage ``level`` on;
    within a lambda there is none.
    """

    value: Column
    text: Column | None = None
    path: str = "$"
    binder: Binder | None = None
    level: int = 0

    def bind(self, column: Column, step: int = 0) -> Column:
        return self.binder.bind(column, self.level + step) if self.binder else column

    def member(self, name: str) -> Place:
        value = self.bind(F.try_variant_get(self.value, f"$.{name}", "variant"))
        return Place(value, self.text, f"{self.path}['{name}']", self.binder, self.level + 1)

    def raw(self) -> Column | None:
        return None if self.text is None else F.get_json_object(self.text, self.path)


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def members_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def items_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _integer(place: Place, shape: Shape, kind: Column) -> tuple[Column, Column]:
    least, largest, spark_type = INTEGERS[shape.kind]
    if -(2**63) <= least and largest < 2**63:
        small = place.bind(F.try_variant_get(place.value, "$", "bigint"))
        return (kind == "BIGINT") & small.between(least, largest), small.try_cast(spark_type)
    if place.text is None:  # within a list: exact up to 38 digits
        wide = F.try_variant_get(place.value, "$", "decimal(38,0)")
        spelt = (kind == "BIGINT") | (kind.startswith("DECIMAL") & (kind.endswith(",0)")) & (F.abs(wide) > 2**63 - 1))
        digits = wide.cast("string")
    else:
        digits = place.bind(place.raw())
        spelt = ~kind.isin("STRING", "BOOLEAN", "VOID") & digits.rlike(r"\A-?\d+\z")
    if largest < 10**38:
        number = place.bind(digits.try_cast("decimal(38,0)"), 1)
        return spelt & number.between(F.lit(str(least)).cast("decimal(38,0)"), F.lit(str(largest)).cast("decimal(38,0)")), number.try_cast(spark_type)
    bare = place.bind(F.ltrim(F.ltrim(digits, F.lit("-")), F.lit("0")), 1)
    negative = place.bind(digits.startswith("-") & (bare != ""), 2)
    limit = F.when(negative, F.lit(str(-least))).otherwise(F.lit(str(largest)))
    within = F.lpad(bare, 39, "0") <= F.lpad(limit, 39, "0")
    within = within & (F.length(bare) <= 39)
    if least == 0:
        within = within & ~negative
    exact = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), F.when(bare == "", F.lit("0")).otherwise(bare))
    return spelt & within, exact


def decode(place: Place, shape: Shape) -> tuple[Column, Column]:
    """(predicate, typed value).  The predicate may be null for false; the value counts only where it is true."""
    k, value = shape.kind, place.value
    if k in INTEGERS:
        return _integer(place, shape, place.bind(kind_of(value)))
    if k in FLOATS:
        number = place.bind(F.try_variant_get(value, "$", "double"))
        kind = place.bind(kind_of(value))
        ok = (kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")) & ~F.isnan(number) & (F.abs(number) < float("inf"))
        # the nearest float of the number as it is spelt; within lists and maps by way of the nearest double
        spelt = k == "f32" and place.text is not None
        out = place.bind(place.raw(), 1).try_cast("float") if spelt else number.try_cast(shape.spark_type())
        return (ok & (F.abs(out) < float("inf")) if k == "f32" else ok), out
    if k == "bool":
        return kind_of(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")
    if k == "string" or k in PROFILES:
        text = place.bind(F.try_variant_get(value, "$", "string"))
        ok = kind_of(value) == "STRING"
        if k in CHECKS:
            ok = ok & CHECKS[k](text)
            text = CANONICAL[k](text) if k in CANONICAL else text
        return ok, text.try_cast("date") if k == "date" else text
    if k == "option":
        ok, inner = decode(place, shape.item)
        none = place.bind(value.isNull() | F.is_variant_null(value))
        return none | ok, F.when(~none, inner)
    if k == "bytes":
        numbers = place.bind(items_of(value))
        ok = numbers.isNotNull() & F.forall(numbers, lambda x: F.coalesce((kind_of(x) == "BIGINT") & F.try_variant_get(x, "$", "bigint").between(0, 255), F.lit(False)))
        digits = F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(F.try_variant_get(x, "$", "bigint")), 2, "0")), "")
        return ok, F.unhex(digits)
    if k in ("list", "array", "set"):
        items = place.bind(items_of(value))
        ok = items.isNotNull() & F.forall(items, lambda x: F.coalesce(decode(Place(x), shape.item)[0], F.lit(False)))
        if k == "array":
            ok = ok & (F.size(items) == shape.size)
        return ok, F.transform(items, lambda x: decode(Place(x), shape.item)[1])
    if k == "map":
        held = place.bind(members_of(value))
        ok = held.isNotNull() & F.forall(F.map_values(held), lambda x: F.coalesce(decode(Place(x), shape.item)[0], F.lit(False)))
        return ok, F.transform_values(held, lambda _, x: decode(Place(x), shape.item)[1])
    if k == "tuple":
        items = place.bind(items_of(value))
        own = [place.bind(F.get(items, F.lit(n)), 1) for n in range(len(shape.items))]
        parts = [decode(Place(c, None, "$", place.binder, place.level + 2), s) for c, s in zip(own, shape.items, strict=True)]
        return _all([items.isNotNull(), F.size(items) == len(parts), *(p[0] for p in parts)]), F.struct(*(p[1].alias(f"_{n + 1}") for n, p in enumerate(parts)))
    if k == "record":
        held = place.bind(F.map_keys(members_of(value)))
        parts = [(m, *decode(place.member(m.name), m.shape)) for m in shape.members]
        ok = _all([has_keys(held, *_keys_of(shape)), *(p[1] for p in parts)])
        return ok, F.struct(*(p[2].alias(p[0].name) for p in parts)) if parts else F.struct(F.lit(None).cast("void").alias("_"))
    if k == "enum":
        return _enum(place, shape)
    raise ValueError(f"unknown shape {k}")


def has_keys(keys: Column, allowed: Column, required: Column) -> Column:
    """The key set of a record: nothing unknown, and all that must be there."""
    return F.coalesce(keys.isNotNull() & (F.size(F.array_except(keys, allowed)) == 0) & (F.size(F.array_except(required, keys)) == 0), F.lit(False))


def _keys_of(shape: Shape) -> tuple[Column, Column]:
    texts = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    return texts([m.name for m in shape.members]), texts([m.name for m in shape.members if not m.optional])


def _enum(place: Place, shape: Shape) -> tuple[Column, Column]:
    """A unit is its tag or {tag: null}; any other variant is {tag: payload}."""
    units = [t for t, kind, _ in shape.variants if kind == "unit"]
    name = place.bind(F.when(kind_of(place.value) == "STRING", F.try_variant_get(place.value, "$", "string")))
    held = place.bind(members_of(place.value))
    tag = place.bind(F.coalesce(name, F.when(F.size(held) == 1, F.get(F.map_keys(held), F.lit(0)))), 1)
    payload = place.bind(F.get(F.map_values(held), F.lit(0)), 1)
    ok = F.when(name.isNotNull(), name.isin(*units) if units else F.lit(False))
    columns = [tag.alias("tag")]
    for t, kind, s in shape.variants:
        if kind == "unit":
            ok = ok.when(tag == t, F.is_variant_null(payload))
            continue
        own = Place(payload, place.text, f"{place.path}['{t}']", place.binder, place.level + 2)
        good, out = decode(own, s)
        ok = ok.when(tag == t, F.coalesce(good, F.lit(False)))
        columns.append(F.when(tag == t, out).alias(t))
    return ok.otherwise(F.lit(False)), F.struct(*columns)


def has_floats(shape: Shape) -> bool:
    inner = [*shape.items, *(m.shape for m in shape.members), *(s for *_, s in shape.variants if s is not None)]
    return shape.kind in FLOATS or any(map(has_floats, inner))


def finite(value: Column, shape: Shape) -> Column:
    """Whether a typed column holds no NaN and no infinity, which JSON cannot say."""
    k = shape.kind
    if not has_floats(shape):
        return F.lit(True)
    if k in FLOATS:
        out = ~F.isnan(value) & (F.abs(value) < float("inf"))
    elif k in ("list", "array", "set"):
        out = F.forall(value, lambda x: finite(x, shape.item))
    elif k == "map":
        out = F.forall(F.map_values(value), lambda x: finite(x, shape.item))
    elif k == "tuple":
        out = _all([finite(value[f"_{n + 1}"], s) for n, s in enumerate(shape.items)])
    elif k == "record":
        out = _all([finite(value[m.name], m.shape) for m in shape.members])
    elif k == "enum":
        out = _all([finite(value[t], s) for t, kind, s in shape.variants if kind != "unit"])
    else:
        return finite(value, shape.item)
    return value.isNull() | out


def encode(value: Column, shape: Shape) -> Column:
    """The JSON text of a typed column; null is the JSON null."""
    k = shape.kind
    quote = lambda c: F.expr("0") if c is None else F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)
    if k in INTEGERS or k == "bool":
        out = value.cast("string")
    elif k in FLOATS:
        out = quote(value)
    elif k == "date":
        out = F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    elif k == "string" or k in PROFILES:
        out = quote(value)
    elif k == "option":
        return encode(value, shape.item)
    elif k == "bytes":
        places = F.sequence(F.lit(1), F.length(value))
        numbers = F.transform(places, lambda n: F.conv(F.hex(F.substring(value, n, F.lit(1))), 16, 10))
        out = F.concat(F.lit("["), F.when(F.length(value) > 0, F.array_join(numbers, ",")).otherwise(F.lit("")), F.lit("]"))
    elif k in ("list", "array", "set"):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: encode(x, shape.item)), ","), F.lit("]"))
    elif k == "map":
        pairs = F.transform(F.map_entries(value), lambda e: F.concat(quote(e["key"]), F.lit(":"), encode(e["value"], shape.item)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif k == "tuple":
        out = F.concat(F.lit("["), F.concat_ws(",", *(encode(value[f"_{n + 1}"], s) for n, s in enumerate(shape.items))), F.lit("]"))
    elif k == "record":
        pairs = [F.concat(F.lit(f'"{m.name}":'), encode(value[m.name], m.shape)) for m in shape.members]
        out = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    elif k == "enum":
        out = F.concat(F.lit('"'), value["tag"], F.lit('"'))
        for t, kind, s in shape.variants:
            if kind != "unit":
                out = F.when(value["tag"] == t, F.concat(F.lit(f'{{"{t}":'), encode(value[t], s), F.lit("}"))).otherwise(out)
    else:
        raise ValueError(f"unknown shape {k}")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)
