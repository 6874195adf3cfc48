"""Histories: when each field of a record came, changed and went.

A field says from which version on it exists (``added_in``), where its type or
meaning changed (``updates``, newest first) and from which version on it is
gone (``removed_in``).  An addition or update says how a row of the version
before gets the new value: a constant (``value``) or a function of the row
before (``using``).  From that the history gives the exact field list of every
version from 1 to the head, and the step between each two.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.names import LARGEST_VERSION, SEGMENT
from tidemark.shapes import Member, Shape


_MISSING = object()


class HistoryError(ValueError):
    """A declaration that breaks a rule of histories."""


@dataclass(frozen=True)
class Fallible:
    """A converted value, and the cause if the conversion of a row fails (null if not)."""

    value: Column
    error: Column | None


class Previous:
    """The row of the version before, by field; what a ``using`` function gets."""

    def __init__(self, columns: Mapping[str, Column]):
        self._columns = dict(columns)

    def __getattr__(self, name: str) -> Column:
        try:
            return self._columns[name]
        except KeyError:
            raise HistoryError(f"the version before has no field {name}") from None

    __getitem__ = __getattr__


Using = Callable[[Previous], "Column | Fallible"]


@dataclass(frozen=True)
class Update:
    """From version ``at`` on the field has a new type or meaning; before, it was ``previous``."""

    at: int
    previous: Shape
    value: Any = _MISSING
    using: Using | None = None


@dataclass(frozen=True)
class Field:
    name: str
    shape: Shape
    added_in: int = 1
    value: Any = _MISSING
    using: Using | None = None
    updates: tuple[Update, ...] = ()
    removed_in: int | None = None
    required: bool = False  # an option that must be there, though it may be null
    redact: bool = False

    def __post_init__(self) -> None:
        where = f"field {self.name}"
        if not re.fullmatch(SEGMENT, self.name):
            raise HistoryError(f"{where}: a name is lower-case ASCII letters, digits and underscores")
        boundaries = [u.at for u in self.updates]
        if boundaries != sorted(set(boundaries), reverse=True):
            raise HistoryError(f"{where}: updates stand newest first, one at a version")
        for at in (*boundaries, *([self.removed_in] if self.removed_in is not None else [])):
            if not 2 <= at <= LARGEST_VERSION:
                raise HistoryError(f"{where}: version {at} is no boundary after version 1")
        if not 1 <= self.added_in <= LARGEST_VERSION:
            raise HistoryError(f"{where}: version {self.added_in} is out of range")
        if boundaries and boundaries[-1] <= self.added_in:
            raise HistoryError(f"{where}: an update comes after the addition")
        if self.removed_in is not None and self.removed_in <= max([self.added_in, *boundaries]):
            raise HistoryError(f"{where}: the removal comes last")
        given = (self.value is not _MISSING) + (self.using is not None)
        if self.added_in > 1 and given != 1:
            raise HistoryError(f"{where}: an addition takes a value or a function")
        if self.added_in == 1 and given:
            raise HistoryError(f"{where}: a field of version 1 takes neither a value nor a function")
        for u in self.updates:
            if (u.value is not _MISSING) + (u.using is not None) != 1:
                raise HistoryError(f"{where}: the update at {u.at} takes a value or a function")

    def boundaries(self) -> list[int]:
        return [b for b in (self.added_in, *(u.at for u in self.updates), self.removed_in) if b is not None and b > 1]

    def alive(self, version: int) -> bool:
        return self.added_in <= version and (self.removed_in is None or version < self.removed_in)

    def shape_at(self, version: int) -> Shape:
        """The declared shape, or what the first update after ``version`` says it was before."""
        later = [u for u in self.updates if u.at > version]
        return later[-1].previous if later else self.shape

    def rule_at(self, version: int) -> tuple[Any, Using | None] | None:
        """How the step to ``version`` sets the field; None if it carries it on."""
        if version == self.added_in:
            return self.value, self.using
        for u in self.updates:
            if u.at == version:
                return u.value, u.using
        return None


@dataclass(frozen=True)
class History:
    """A stable name with its fields.  ``head`` is the newest version."""

    name: str
    fields: tuple[Field, ...]
    head: int = field(init=False)

    def __post_init__(self) -> None:
        if len(self.name) > 255 or not re.fullmatch(rf"{SEGMENT}(\.{SEGMENT})*", self.name):
            raise HistoryError(f"{self.name!r} is no stable name")
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise HistoryError("a field is declared twice; a removed name is not used again")
        object.__setattr__(self, "head", max([1, *(b for f in self.fields for b in f.boundaries())]))

    def as_of(self, version: int) -> History:
        """The history as it stood when ``version`` was its newest one."""
        if not 1 <= version <= self.head:
            raise HistoryError(f"{self.name} has no version {version}")
        fields = []
        for f in self.fields:
            if f.added_in <= version:
                gone = f.removed_in if f.removed_in is not None and f.removed_in <= version else None
                fields.append(replace(f, shape=f.shape_at(version), updates=tuple(u for u in f.updates if u.at <= version), removed_in=gone))
        out = History(self.name, tuple(fields))
        object.__setattr__(out, "head", version)
        return out

    @staticmethod
    def declare(name: str, *fields: Field) -> History:
        return History(name, tuple(fields))

    def retained_versions(self) -> list[int]:
        return list(range(1, self.head + 1))

    def supports(self, version: int) -> bool:
        return 1 <= version <= self.head

    def fields_at(self, version: int) -> list[Field]:
        return [f for f in self.fields if f.alive(version)]

    def shape_at(self, version: int) -> Shape:
        """The record of a version."""
        members = []
        for f in self.fields_at(version):
            shape = f.shape_at(version)
            members.append(Member(f.name, shape, shape.kind == "option" and not f.required))
        return Shape("record", members=tuple(members))

    def current(self) -> Shape:
        return self.shape_at(self.head)


def converted(rule: tuple[Any, Using | None], previous: Previous, shape: Shape) -> Fallible:
    """The value that an addition or update gives, in the type of ``shape``."""
    value, using = rule
    if using is None:
        out = value if isinstance(value, Column) else F.lit(value)
    else:
        out = using(previous)
    if isinstance(out, Fallible):
        return Fallible(out.value.try_cast(shape.spark_type()), out.error.cast("string"))
    if not isinstance(out, Column):
        raise HistoryError("a function gives a Column or a Fallible")
    return Fallible(out.try_cast(shape.spark_type()), None)
