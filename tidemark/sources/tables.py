"""Tables of envelopes and payloads, in any format that Spark reads.

A table partitioned by ``stable_name`` and ``version`` lets Spark skip files:
``read_envelopes`` asks for the history's own name and versions only, and
``read_payloads`` does so with ``only_own``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.history import History
from tidemark.operators import from_versioned, to_versioned, upgrade


def read_envelopes(spark: SparkSession, path: str, history: History, format: str = "parquet", column: str = "envelope", **options) -> DataFrame:
    """Envelopes, one JSON text a row, decoded and upgraded; format ``text`` reads one a line."""
    rows = spark.read.format(format).options(**options).load(path)
    if format == "text":
        rows = rows.withColumnRenamed("value", column)
    if {"stable_name", "version"} <= set(rows.columns):  # as write_envelopes has them: other files are not opened
        rows = rows.where((F.col("stable_name") == history.name) & F.col("version").isin(list(history.retained_versions())))
    return from_versioned(rows, history, column)


def read_payloads(spark: SparkSession, path: str, history: History, format: str = "parquet", payload: str = "payload", version: str = "version", name: str | None = None, only_own: bool = False, **options) -> DataFrame:
    """Payloads with their version (and name) in columns of their own, decoded and upgraded.

    ``only_own`` leaves out rows of other names and versions, before anything is
    parsed; else they are TypeMismatch and UnsupportedVersion errors.
    """
    rows = spark.read.format(format).options(**options).load(path)
    if only_own and name:
        rows = rows.where((F.col(name) == history.name) & F.col(version).isin(list(history.retained_versions())))
    return upgrade(rows, history, payload, version, name)


def write_envelopes(df: DataFrame, path: str, history: History, format: str = "parquet", column: str = "envelope", mode: str = "errorifexists") -> None:
    """Write current records as envelopes of the head version, partitioned by name and version."""
    rows = to_versioned(df.where("record IS NOT NULL"), history, envelope=column).drop("record", "error", "source_version")
    rows = rows.withColumns({"stable_name": F.lit(history.name), "version": F.lit(history.head)})
    rows.write.format(format).mode(mode).partitionBy("stable_name", "version").save(path)
