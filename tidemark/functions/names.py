"""Stable names and versions as column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = "[a-z][a-z0-9_]*"
LARGEST_VERSION = 2**32 - 1


def valid_name(name: Column) -> Column:
    """Dot-separated segments of lower-case ASCII, 255 bytes at most; null is not valid."""
    return F.coalesce(name.rlike(f"\\A{SEGMENT}(\\.{SEGMENT})*\\z") & (F.octet_length(name) <= 255), F.lit(False))


def bad_segment(name: Column) -> Column:
    """The number, from 1, of the first segment that is not valid; null if all are."""
    at = F.array_position(F.transform(F.split(name, "\\."), lambda s: s.rlike(f"\\A{SEGMENT}\\z")), False)
    return F.when(at > 0, at)


def valid_version(version: Column) -> Column:
    return F.coalesce(version.between(1, LARGEST_VERSION), F.lit(False))
