"""The ledger: a file of the frozen shape of every version of every history.

The file is small and lives on the driver; its commands (init, freeze, check,
reset, import) read it, change a copy and replace the file in one step.  What
compares ledgers works on DataFrames of (stable_name, version, path,
attribute, value) rows, which also serve to query them.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.names import SEGMENT, valid_name
from tidemark.history import History
from tidemark.shapes import PROFILES, Shape

FACTS = "stable_name string, version long, path string, attribute string, value string"
FROZEN, DRAFT, RESET_DRAFT = "Frozen", "Draft", "ResetDraft"


class LedgerError(ValueError):
    """A ledger, or a command on one, that breaks a rule."""


def canonical_json(value: object) -> str:
    """JSON without white space, keys in the order of their UTF-16 code units."""

    def sort(v: object) -> object:
        if isinstance(v, dict):
            return {k: sort(v[k]) for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
        if isinstance(v, list):
            return [sort(x) for x in v]
        if isinstance(v, float):
            raise LedgerError("a ledger holds whole numbers only")
        return v

    return json.dumps(sort(value), ensure_ascii=False, separators=(",", ":"))


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise LedgerError("a key is given twice")
    return out


@dataclass(frozen=True)
class Entry:
    shape: Shape
    reset: bool = False
    metadata: str = "{}"  # an object, as canonical JSON

    def to_json(self) -> dict:
        return {"metadata": json.loads(self.metadata), "schema": self.shape.to_json()} | ({"reset_draft": True} if self.reset else {})


class Ledger:
    def __init__(self, entries: dict[str, dict[int, Entry]] | None = None):
        self.entries = entries or {}
        for name, versions in self.entries.items():
            if len(name) > 255 or not re.fullmatch(rf"{SEGMENT}(\.{SEGMENT})*", name):
                raise LedgerError(f"{name!r} is no stable name")
            if sorted(versions) != list(range(1, len(versions) + 1)) or not versions:
                raise LedgerError(f"{name}: versions run from 1 without a gap")
            if any(e.reset for v, e in versions.items() if v < len(versions)):
                raise LedgerError(f"{name}: only the newest version can be reset")

    @staticmethod
    def parse(text: str) -> Ledger:
        try:
            raw = json.loads(text, object_pairs_hook=_unique)
            entries = {}
            for name, versions in raw.items():
                if any(not re.fullmatch("[1-9][0-9]*", v) for v in versions):
                    raise LedgerError(f"{name}: a version is a positive number in digits")
                for e in versions.values():
                    if set(e) - {"metadata", "schema", "reset_draft"} or not {"metadata", "schema"} <= set(e) or not isinstance(e["metadata"], dict) or e.get("reset_draft", True) is not True:
                        raise LedgerError(f"{name}: an entry has metadata, schema and at most reset_draft")
                entries[name] = {int(v): Entry(Shape.from_json(e["schema"]), "reset_draft" in e, canonical_json(e["metadata"])) for v, e in versions.items()}
        except (json.JSONDecodeError, AttributeError, KeyError, TypeError) as problem:
            raise LedgerError(f"not a ledger: {problem}") from problem
        return Ledger(entries)

    def text(self) -> str:
        value = {n: {str(v): e.to_json() for v, e in sorted(vs.items())} for n, vs in sorted(self.entries.items())}
        return json.dumps(json.loads(canonical_json(value)), indent=2, ensure_ascii=False) + "\n"

    @staticmethod
    def observed(histories: Iterable[History]) -> Ledger:
        """What the declarations say now."""
        found: dict[str, dict[int, Entry]] = {}
        for h in histories:
            if h.name in found:
                raise LedgerError(f"{h.name} is declared twice")
            found[h.name] = {v: Entry(h.shape_at(v)) for v in h.retained_versions()}
        return Ledger(found)

    # ------------------------------------------------------------ rules

    def head(self, name: str) -> int:
        return len(self.entries.get(name, ()))

    def readiness(self, history: History) -> str:
        """Frozen, Draft or ResetDraft; an error if the head is not the frozen one or its successor."""
        frozen, head = self.head(history.name), history.head
        if not frozen:
            if head != 1:
                raise LedgerError(f"{history.name}: a new history starts with version 1")
            return DRAFT
        if head == frozen:
            return RESET_DRAFT if self.entries[history.name][head].reset else FROZEN
        if head == frozen + 1 and not self.entries[history.name][frozen].reset:
            return DRAFT
        raise LedgerError(f"{history.name}: version {head} does not follow the frozen version {frozen}")

    def require_frozen(self, history: History) -> None:
        """For release: no draft, and every version as it was frozen."""
        if self.readiness(history) != FROZEN:
            raise LedgerError(f"{history.name}: version {history.head} is a draft")
        self.assert_same(history)

    def assert_same(self, history: History) -> None:
        """Every frozen version is still what it was."""
        for v, e in self.entries.get(history.name, {}).items():
            if not e.reset and (not history.supports(v) or history.shape_at(v) != e.shape):
                raise LedgerError(f"{history.name}: version {v} differs from its frozen shape")

    def frozen(self, histories: Iterable[History], only: set[tuple[str, int]] | None = None) -> Ledger:
        """With the drafts of ``histories`` frozen too, or those in ``only``."""
        histories, out = list(histories), {n: dict(v) for n, v in self.entries.items()}
        missing = set(self.entries) - {h.name for h in histories}
        if missing:
            raise LedgerError(f"frozen histories are not declared: {sorted(missing)}")
        done = set()
        for h in histories:
            self.assert_same(h)
            state = self.readiness(h)
            if state == FROZEN or only is not None and (h.name, h.head) not in only:
                continue
            if state == RESET_DRAFT and only is None:
                raise LedgerError(f"{h.name}: name version {h.head} to freeze it again")
            out.setdefault(h.name, {})[h.head] = Entry(h.shape_at(h.head))
            done.add((h.name, h.head))
        if only and only - done:
            raise LedgerError(f"nothing to freeze: {sorted(only - done)}")
        return Ledger(out)

    def reset(self, name: str, version: int, undo: bool = False) -> Ledger:
        """With the newest frozen version open for change; its number stays taken."""
        if not version or version != self.head(name):
            raise LedgerError(f"{name}: only the newest frozen version can be reset")
        entry = self.entries[name][version]
        if entry.reset != undo:
            raise LedgerError(f"{name}: version {version} is {'not ' if undo else 'already '}reset")
        return Ledger(self.entries | {name: self.entries[name] | {version: replace(entry, reset=not undo)}})

    def imported(self, other: Ledger, histories: Iterable[History]) -> Ledger:
        """``other``, if it keeps all that is here and is what the declarations say."""
        for name, versions in self.entries.items():
            for v, e in versions.items():
                if other.entries.get(name, {}).get(v) != e:
                    raise LedgerError(f"{name}: the import changes version {v}")
        if any(e.reset for vs in other.entries.values() for e in vs.values()):
            raise LedgerError("a reset version cannot be imported")
        if Ledger.observed(histories).entries != other.entries:
            raise LedgerError("the import is not what the declarations say")
        return other

    # ------------------------------------------------------- DataFrames

    def entries_df(self, spark: SparkSession) -> DataFrame:
        """(stable_name, version, schema, reset_draft, metadata), the schema and metadata as canonical JSON."""
        rows = [(n, v, canonical_json(e.shape.to_json()), e.reset, e.metadata) for n, vs in self.entries.items() for v, e in vs.items()]
        return spark.createDataFrame(rows, "stable_name string, version long, schema string, reset_draft boolean, metadata string")

    def facts_df(self, spark: SparkSession, resets: bool = False) -> DataFrame:
        """A row for each fact of the frozen versions, with ``resets`` of those open for change too."""
        rows = [(n, v, *fact) for n, vs in self.entries.items() for v, e in vs.items() if resets or not e.reset for fact in e.shape.facts()]
        return spark.createDataFrame(rows, FACTS)


def diff(saved: DataFrame, actual: DataFrame) -> DataFrame:
    """(stable_name, version, path, code, expected, found): where ``actual`` facts differ from ``saved`` ones.

    Only saved versions count, so newer ones are no difference; of a changed
    kind, what lies below it is left out.
    """
    names = actual.select(F.col("stable_name").alias("n")).distinct()
    versions = actual.select(F.col("stable_name").alias("n"), F.col("version").alias("v")).distinct()
    own = saved.select("stable_name", "version").distinct()
    gone = own.join(names, own["stable_name"] == names["n"], "left_anti").withColumn("code", F.lit("history_missing"))
    here = own.join(names, own["stable_name"] == names["n"], "left_semi")
    same = lambda df: (here["stable_name"] == df["n"]) & (here["version"] == df["v"])
    short = here.join(versions, same(versions), "left_anti").withColumn("code", F.lit("version_missing"))
    both = here.join(versions, same(versions), "left_semi")
    key = ["stable_name", "version", "path", "attribute"]
    a = saved.join(both, ["stable_name", "version"], "left_semi").withColumnRenamed("value", "expected")
    b = actual.join(both, ["stable_name", "version"], "left_semi").withColumnRenamed("value", "found")
    rows = a.join(b, key, "full_outer").where("NOT expected <=> found")
    kind = F.col("attribute")
    missing = F.col("found").isNull()
    code = (
        F.when(kind == "kind", F.when(F.col("expected").isin(*PROFILES) & F.col("found").isin(*PROFILES), "profile_changed").when(F.col("expected").isNotNull() & ~missing, "shape_kind_changed"))
        .when(kind == "presence", F.when(missing, "field_missing").when(F.col("expected").isNull(), "field_added").otherwise("field_presence_changed"))
        .when(kind == "variant", F.when(missing, "variant_missing").when(F.col("expected").isNull(), "variant_added").otherwise("variant_kind_changed"))
        .when(F.col("expected").isNotNull() & ~missing, F.when(kind == "length", "array_length_changed").when(kind == "membership", "membership_changed").otherwise("tuple_length_changed"))
    )
    found = rows.withColumn("code", code).where("code IS NOT NULL").select("stable_name", "version", "path", "code", "expected", "found")
    # below a field or variant that is gone, new or of another kind nothing more is said
    top = found.where(F.col("code").isin("field_missing", "field_added", "variant_missing", "variant_added", "shape_kind_changed", "profile_changed"))
    top = top.select(F.col("stable_name").alias("n"), F.col("version").alias("v"), F.col("path").alias("above"))
    below = (found["stable_name"] == top["n"]) & (found["version"] == top["v"]) & found["path"].startswith(top["above"]) & (F.length("path") > F.length("above"))
    found = found.join(top, below, "left_anti")
    none = F.lit(None).cast("string")
    whole = gone.unionByName(short).select("stable_name", "version", F.lit("$").alias("path"), "code", none.alias("expected"), none.alias("found"))
    return whole.unionByName(found).dropDuplicates()


def entry_findings(saved: DataFrame, actual: DataFrame, released: bool) -> DataFrame:
    """(stable_name, version, path, code, expected, found) of entry rows against each other.

    ``metadata_changed`` where an entry of both has other metadata; with
    ``released``, ``released_reset`` for a released version that is open for
    change on either side.
    """
    named = saved.select("stable_name", "version", F.col("metadata").alias("expected"), F.col("reset_draft").alias("was"))
    other = actual.select("stable_name", "version", F.col("metadata").alias("found"), F.col("reset_draft").alias("now"))
    rows = named.join(other, ["stable_name", "version"], "left").withColumn("path", F.lit("$"))
    columns = ["stable_name", "version", "path", "code", "expected", "found"]
    changed = rows.where("expected <> found").withColumn("code", F.lit("metadata_changed")).select(columns)
    if not released:
        return changed
    reset = rows.where("was OR coalesce(now, false)").select("stable_name", "version", "path", F.lit("released_reset").alias("code"), F.lit("false").alias("expected"), F.lit("true").alias("found"))
    return changed.unionByName(reset)


def ordered(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.orderBy("stable_name", "version", "path", "code")


def report(diagnostics: DataFrame, command: str = "check") -> str:
    """One JSON document of diagnostics, a ledger's worth of rows."""
    found = [json.loads(r["j"]) for r in ordered(diagnostics).select(F.to_json(F.struct("*")).alias("j")).collect()]
    return canonical_json({"schema_version": 1, "command": command, "ok": not found, "diagnostics": found})


def contiguity(entries: DataFrame) -> DataFrame:
    """(stable_name, n_versions, head, valid, contiguous) of entry rows (stable_name, version)."""
    place = F.row_number().over(Window.partitionBy("stable_name").orderBy("version"))
    rows = entries.select("stable_name", "version", place.alias("place"))
    grouped = rows.groupBy("stable_name").agg(F.count("*").alias("n_versions"), F.max("version").alias("head"), F.every(F.col("version") == F.col("place")).alias("contiguous"))
    return grouped.select("stable_name", "n_versions", "head", valid_name(F.col("stable_name")).alias("valid"), "contiguous")


def heads(boundaries: DataFrame) -> DataFrame:
    """(stable_name, head) of rows (stable_name, boundary): the newest boundary, at least 1."""
    return boundaries.groupBy("stable_name").agg(F.greatest(F.lit(1), F.coalesce(F.max("boundary"), F.lit(1))).cast("long").alias("head"))


def readiness(declared: DataFrame, entries: DataFrame) -> DataFrame:
    """(stable_name, head, state) of declared heads against ledger entries (stable_name, version, reset_draft)."""
    frozen = entries.groupBy("stable_name").agg(F.max("version").alias("frozen"), F.max_by("reset_draft", "version").alias("reset"))
    rows = declared.join(frozen, "stable_name", "left")
    state = (
        F.when(F.col("frozen").isNull(), F.when(F.col("head") == 1, DRAFT).otherwise("Rejected"))
        .when(F.col("head") == F.col("frozen"), F.when(F.col("reset"), RESET_DRAFT).otherwise(FROZEN))
        .when((F.col("head") == F.col("frozen") + 1) & ~F.col("reset"), DRAFT)
        .otherwise("Rejected")
    )
    return rows.select("stable_name", "head", state.alias("state"))


# ------------------------------------------------------------------- files


def load(path: str) -> Ledger:
    with open(path, encoding="utf-8") as file:
        return Ledger.parse(file.read())


def init(path: str) -> None:
    """Write an empty ledger where there is none."""
    with open(path, "x", encoding="utf-8") as file:
        file.write(Ledger().text())


@contextmanager
def _locked(path: str) -> Iterator[None]:
    if os.path.islink(path):
        raise LedgerError("a ledger is no symbolic link")
    with open(f"{path}.lock", "w") as lock:
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise LedgerError("another command holds the ledger") from None
        yield


def change(path: str, command: Callable[[Ledger], Ledger]) -> Ledger:
    """Replace the file by what ``command`` makes of it, whole or not at all."""
    with _locked(path):
        with open(path, "rb") as file:
            before = file.read()
        after = command(Ledger.parse(before.decode()))
        data = after.text().encode()
        with open(temp := f"{path}.new", "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        with open(path, "rb") as file:
            if file.read() != before:
                os.unlink(temp)
                raise LedgerError("the ledger changed meanwhile")
        os.replace(temp, path)
        with open(path, "rb") as file:
            if hashlib.sha256(file.read()).digest() != hashlib.sha256(data).digest():
                raise LedgerError("the ledger was not written whole")
        folder = os.open(os.path.dirname(os.path.abspath(path)), os.O_RDONLY)
        try:
            os.fsync(folder)
        finally:
            os.close(folder)
        return after


def check(spark: SparkSession, ledger: Ledger, histories: Iterable[History], baseline: Ledger | None = None) -> DataFrame:
    """Diagnostics of the declarations against the ledger, and of a released one if given."""
    observed = Ledger.observed(histories)
    actual, entries = observed.facts_df(spark), ledger.entries_df(spark)
    found = diff(ledger.facts_df(spark), actual).unionByName(entry_findings(entries, observed.entries_df(spark), False)).withColumn("released", F.lit(False))
    if baseline is not None:
        # a reset waives nothing that is released
        own = diff(baseline.facts_df(spark, True), actual).unionByName(entry_findings(baseline.entries_df(spark), entries, True))
        found = found.unionByName(own.withColumn("released", F.lit(True)))
    return found
