"""Ledger commands: python -m tidemark.cli COMMAND --ledger FILE --histories MODULE:NAME.

NAME is a list of histories in MODULE.  Exit 0: done, or nothing found; 2: a
check found something, or a rule was broken.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from tidemark import ledger as L


def _histories(where: str | None) -> list:
    if not where:
        raise L.LedgerError("--histories MODULE:NAME is needed")
    module, _, name = where.partition(":")
    return list(getattr(importlib.import_module(module), name))


def _only(values: list[str] | None) -> set[tuple[str, int]] | None:
    return {(n, int(v)) for n, _, v in (x.rpartition("@") for x in values)} if values else None


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in (("init", "write an empty ledger"), ("freeze", "freeze drafts"), ("check", "compare declarations with the ledger"), ("reset", "open the newest version of a history"), ("import", "take a complete ledger")):
        own = commands.add_parser(name, help=words)
        own.add_argument("--ledger", required=True)
        own.add_argument("--histories")
        if name == "freeze":
            own.add_argument("--only", action="append", metavar="NAME@VERSION")
        if name == "check":
            own.add_argument("--format", choices=("text", "json"), default="text")
            own.add_argument("--released-baseline")
            own.add_argument("--release", action="store_true", help="drafts fail")
        if name == "reset":
            own.add_argument("name")
            own.add_argument("version", type=int)
            own.add_argument("--undo", action="store_true")
        if name == "import":
            own.add_argument("--from", dest="source", required=True)
    a = parser.parse_args(arguments)
    try:
        return _run(a)
    except (L.LedgerError, OSError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 2


def _run(a: argparse.Namespace) -> int:
    if a.command == "init":
        L.init(a.ledger)
    elif a.command == "freeze":
        L.change(a.ledger, lambda old: old.frozen(_histories(a.histories), _only(a.only)))
    elif a.command == "reset":
        L.change(a.ledger, lambda old: old.reset(a.name, a.version, a.undo))
    elif a.command == "import":
        L.change(a.ledger, lambda old: old.imported(L.load(a.source), _histories(a.histories)))
    else:
        return _check(a)
    return 0


def _check(a: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    saved, histories = L.load(a.ledger), _histories(a.histories)
    if a.released_baseline and os.path.realpath(a.released_baseline) == os.path.realpath(a.ledger):
        raise L.LedgerError("the baseline is a file of its own")
    baseline = L.load(a.released_baseline) if a.released_baseline else None
    found = L.check(SparkSession.builder.getOrCreate(), saved, histories, baseline)
    required = os.environ.get("TIDEMARK_REQUIRE_FROZEN")
    if required not in (None, "1"):
        raise L.LedgerError("TIDEMARK_REQUIRE_FROZEN is 1 or unset")
    for h in histories:
        if a.release or required:
            saved.require_frozen(h)
        elif saved.readiness(h) != L.FROZEN:
            print(f"warning: {h.name}: version {h.head} is a draft", file=sys.stderr)
    if a.format == "json":
        print(L.report(found))
    else:
        for r in L.ordered(found).collect():  # a ledger's worth of rows
            print(f"{r['stable_name']} v{r['version']} {r['path']}: {r['code']}" + (f" ({r['expected']} -> {r['found']})" if r["expected"] or r["found"] else ""))
    return 2 if not found.isEmpty() else 0


if __name__ == "__main__":
    sys.exit(main())
