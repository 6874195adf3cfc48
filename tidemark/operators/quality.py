"""Routing of rows that could not be decoded or converted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_ok_failed(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(upgraded rows with the record's fields as columns, failed rows with the error's fields)."""
    rest = columns if columns is not None else [c for c in df.columns if c not in ("record", "error")]
    ok = df.where("error IS NULL").select(*rest, "record.*")
    failed = df.where("error IS NOT NULL").select(*[c for c in rest if c != "source_version"], "error.*")
    return ok, failed


def fail_on_error(df: DataFrame) -> DataFrame:
    """``df``, raising at run time on the first row with an error."""
    return df.withColumn("record", F.when(F.col("error").isNull(), F.col("record")).otherwise(F.raise_error(F.to_json("error")).cast(df.schema["record"].dataType)))


def error_summary(df: DataFrame) -> DataFrame:
    """(kind, source_version, adjacent_from, adjacent_to, n_rows) of the failed rows."""
    return df.where("error IS NOT NULL").groupBy("error.kind", "error.source_version", "error.adjacent_from", "error.adjacent_to").agg(F.count("*").alias("n_rows"))
