"""Decode rows of mixed versions and upgrade them to the head, in one scan.

Every row is checked against the exact contract of its own version, then the
steps to the head are applied.  The plan has no shuffle, and each distinct
(field, type) is read from a payload once, however many versions have it: a
field that is only carried on or born with a constant costs no step at all,
and a step adds a projection only for the fields that it converts.

Errors are data: ``error`` is null, or says the kind (``TypeMismatch``,
``UnsupportedVersion``, ``Decode`` or ``Upcast``), the row's name and version,
the step that failed and the cause.  All decoding precedes any conversion, and
of several failing conversions in a step the first declared counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from tidemark.functions.strict_json import Binder, Place, decode, has_keys, members_of, with_parsed
from tidemark.history import History, Previous, converted
from tidemark.shapes import Shape


def upgrade(
    df: DataFrame, history: History, payload: str = "payload", version: str = "version", name: str | None = None, keep: list[str] | None = None, root: str = "$"
) -> DataFrame:
    """``df`` with ``record`` (the current struct, null on failure), ``source_version`` and ``error``.

    ``name`` is the column of stored stable names; without it they are taken
    on trust.  ``keep`` are the columns to carry, by default all.  ``root`` is
    the path of the payload in the column ``payload``.
    """
    kept = df.columns if keep is None else keep
    kept = [c for c in kept if c not in ("record", "source_version", "error")]
    stored_name = F.col(name) if name else F.lit(history.name)
    stored = whole_version(df, version)
    rows = df.select(*kept, F.col(payload).cast("string").alias("__text"), stored.alias("__version"), stored_name.cast("string").alias("__name"))
    right_name = F.coalesce(F.col("__name") == history.name, F.lit(False))
    supported = F.coalesce(F.col("__version").between(1, history.head), F.lit(False))
    rows = with_parsed(rows, F.when(right_name & supported, F.col("__text")), "__parsed")
    at = "$[0]" + root[1:]
    rows = rows.withColumn("__root", F.try_variant_get("__parsed", at, "variant"))
    rows = rows.withColumn("__keys", F.map_keys(members_of(F.col("__root"))))

    # each distinct field and type once
    typed: dict[tuple[str, Shape], int] = {}
    users: dict[int, list[int]] = {}
    for v in history.retained_versions():
        for f in history.fields_at(v):
            users.setdefault(typed.setdefault((f.name, f.shape_at(v)), len(typed)), []).append(v)
    binder = Binder()
    place = Place(F.col("__root"), F.col("__text"), root, binder)
    parts = {}
    for (field_name, shape), n in typed.items():
        good, value = decode(place.member(field_name), shape)
        parts[f"__good{n}"], parts[f"__in{n}"] = F.coalesce(good, F.lit(False)), value
    rows = binder.add_to(rows)
    rows = rows.withColumns(parts) if parts else rows

    # a field must be right in the versions that have it in this type
    good = has_keys(F.col("__keys"), *_key_sets(history, F.col("__version")))
    for n, own in users.items():
        here = F.col("__version").between(own[0], own[-1]) if len(own) == own[-1] - own[0] + 1 else F.col("__version").isin(own)
        good = good & (~here | F.col(f"__good{n}"))
    problem = F.when(~right_name, "TypeMismatch").when(~supported, "UnsupportedVersion").when(~good, "Decode")
    rows = rows.withColumn("__kind", problem)

    source = lambda v, f: F.col(f"__in{typed[f.name, f.shape_at(v)]}")
    columns = {f.name: source(1, f) for f in history.fields_at(1)}
    failures: list[tuple[int, Column]] = []  # the step and the causes of its failing rows, null for the others
    for v in range(1, history.head):
        before = F.col("__version") <= v
        made, causes, following = {}, [], {}
        for f in history.fields_at(v + 1):
            shape, rule = f.shape_at(v + 1), f.rule_at(v + 1)
            if rule is None:
                following[f.name] = columns[f.name]
                continue
            own = source(v + 1, f)
            out = converted(rule, Previous(columns), shape)
            if rule[1] is None:  # a constant takes no projection of its own
                following[f.name] = F.when(before, out.value).otherwise(own)
                continue
            made[f"__at{v + 1}_{f.name}"] = F.when(before, out.value).otherwise(own)
            following[f.name] = F.col(f"__at{v + 1}_{f.name}")
            if out.error is not None:
                causes.append(out.error)
        if causes:
            made[f"__fail{v}"] = F.when(before, F.coalesce(*causes))
            failures.append((v, F.col(f"__fail{v}")))
        rows = rows.withColumns(made) if made else rows
        columns = following

    current = F.struct(*(columns[f.name].alias(f.name) for f in history.fields_at(history.head))) if columns else F.struct(F.lit(None).cast("void").alias("_"))
    return _with_error(rows, kept, current, failures, history.name)


def whole_version(df: DataFrame, version: str) -> Column:
    """The column ``version`` as a whole number; null for any other value, and for texts."""
    kind = df.select(F.col(version)).schema[0].dataType
    number = F.col(version).try_cast("bigint")
    if isinstance(kind, IntegralType):
        return number
    return F.when(F.col(version) == number, number) if isinstance(kind, NumericType) else F.lit(None).cast("bigint")


def _with_error(rows: DataFrame, kept: list[str], current: Column, failures: list[tuple[int, Column]], name: str) -> DataFrame:
    """The result columns: of the failures of a decoded row, that of the earliest step counts."""
    kind, step = F.col("__kind"), F.lit(None).cast("bigint")
    for v, cause in reversed(failures):
        step = F.when(cause.isNotNull(), F.lit(v)).otherwise(step)
    told = F.when(kind == "TypeMismatch", F.lit(f"expected {name}")).when(kind == "Decode", F.lit("the payload breaks the contract of its version"))
    if failures:
        cause = F.coalesce(*(c for _, c in failures))
        rows = rows.withColumns({"__cause": F.when(kind.isNull(), cause).otherwise(told), "__step": F.when(kind.isNull(), step)})
        rows = rows.withColumn("__kind", F.coalesce(kind, F.when(F.col("__cause").isNotNull(), "Upcast")))
    else:
        rows = rows.withColumns({"__cause": told, "__step": F.lit(None).cast("bigint")})
    parts = {"kind": "__kind", "stable_name": "__name", "source_version": "__version", "adjacent_from": "__step", "adjacent_to": F.col("__step") + 1, "cause": "__cause"}
    found = F.struct(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in parts.items()))
    failed = F.col("__kind").isNotNull()
    # a generator of one row: filters and join keys of what follows are not pushed below it, where they would repeat the decoding
    result = F.struct(F.col("__version").alias("source_version"), F.when(~failed, current).alias("record"), F.when(failed, found).alias("error"))
    return rows.select(*kept, F.inline(F.array(result)))


def _key_sets(history: History, version: Column) -> tuple[Column, Column]:
    """The keys that a version may have, and those that it must have."""
    texts = lambda names: F.split(F.lit(",".join(names)), ",") if names else F.array().cast("array<string>")  # noqa: E731  constant, so folded
    shapes = [history.shape_at(v) for v in history.retained_versions()]
    at = (version - 1).cast("int")
    allowed = F.get(F.array(*(texts([m.name for m in s.members]) for s in shapes)), at)
    return allowed, F.get(F.array(*(texts([m.name for m in s.members if not m.optional]) for s in shapes)), at)
