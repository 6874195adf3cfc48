"""Versioned envelopes: {"stable_name", "version", "payload"} in one JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import LARGEST_VERSION, valid_name
from tidemark.functions.strict_json import encode, finite, kind_of, members_of, with_parsed
from tidemark.history import History
from tidemark.operators.upgrade import upgrade


def inspect_envelopes(df: DataFrame, envelope: str = "envelope") -> DataFrame:
    """``df`` with ``stable_name``, ``version`` and ``valid``, without converting or changing the text.

    Valid is an object of exactly the three keys, in any order, with a valid
    name and a whole number from 1 to 2^32 - 1; no other spelling of it counts.
    """
    kept = [c for c in df.columns if c not in ("stable_name", "version", "valid")]
    rows = with_parsed(df, F.col(envelope), "__envelope_json").withColumn("__root", F.try_variant_get("__envelope_json", "$[0]", "variant"))
    name = F.try_variant_get("__root", "$.stable_name", "variant")
    number = F.try_variant_get("__root", "$.version", "variant")
    version = F.when(kind_of(number) == "BIGINT", F.try_variant_get(number, "$", "bigint"))
    text = F.when(kind_of(name) == "STRING", F.try_variant_get(name, "$", "string"))
    keys = F.array_sort(F.map_keys(members_of(F.col("__root"))))
    whole = keys == F.array(*map(F.lit, ("payload", "stable_name", "version")))
    valid = whole & valid_name(text) & version.between(1, LARGEST_VERSION)
    return rows.select(*kept, text.alias("stable_name"), version.alias("version"), F.coalesce(valid, F.lit(False)).alias("valid"))


def from_versioned(df: DataFrame, history: History, envelope: str = "envelope") -> DataFrame:
    """Decode envelopes and upgrade them; a broken envelope is a Decode error."""
    seen = inspect_envelopes(df, envelope)
    kept = [c for c in df.columns if c not in ("record", "source_version", "error")]
    text = F.when(F.col("valid"), F.col(envelope))
    # a broken envelope reaches the decoder as an empty text of version 1
    rows = seen.select("*", text.alias("__envelope")).withColumns({"version": F.when(F.col("valid"), F.col("version")).otherwise(1), "stable_name": F.when(F.col("valid"), F.col("stable_name")).otherwise(history.name)})
    return upgrade(rows, history, "__envelope", "version", "stable_name", kept, "$.payload")


def to_versioned(df: DataFrame, history: History, record: str = "record", envelope: str = "envelope", cause: str | None = None) -> DataFrame:
    """``df`` with the column ``envelope``: current records under the history's own name and head version.

    A record with NaN or an infinity has no JSON: its envelope is null, and
    the column ``cause``, if one is named, says why.
    """
    good = finite(F.col(record), history.current()) if history.fields_at(history.head) else F.lit(True)
    payload = encode(F.col(record), history.current()) if history.fields_at(history.head) else F.lit("{}")
    text = F.concat(F.lit(f'{{"stable_name":"{history.name}","version":{history.head},"payload":'), payload, F.lit("}"))
    made = {envelope: F.when(F.col(record).isNotNull() & good, text)}
    if cause:
        made[cause] = F.when(F.col(record).isNotNull() & ~good, F.lit("a number is not finite"))
    return df.withColumns(made)
