"""Intermediate tables and array files in the folder that all executors share.

The folder is ``spark.checkpoint.dir``; see ``tidemark.shared``.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shared import shared_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a written table that is broadcast; larger ones are joined by a shuffle.  The driver holds it more than once.
BROADCAST_BYTES = 16 << 20
#: What the hash table of a broadcast keeps for a row beside its columns.
ROW_BYTES = 16


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The written table ``df`` of numbers, texts and bytes, marked for broadcast if it has ``most`` bytes or fewer."""
    texts = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    held = F.lit(ROW_BYTES + 8 * len(df.columns))
    for c in texts:
        held += F.coalesce(F.octet_length(c), F.lit(0))
    size = df.agg(F.sum(held.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def without_ids(docs: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` without the rows whose id is in the written table ``ids`` (doc_id); texts stay where they are if that is small."""
    gone = small(ids).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["__gone"]), "left_anti")


def with_text(docs: DataFrame, text: str, kept: list[str]) -> tuple[DataFrame, int]:
    """The columns ``kept`` and, if it is not among them as a string, the text behind them; and the place of the text.

    So a text goes to a worker once, which halves what Arrow holds of a batch on both sides.
    """
    if text in kept and docs.schema[text].dataType == T.StringType():
        return docs.select(*kept), kept.index(text)
    return docs.select(*kept, F.col(text).cast("string").alias("__text")), len(kept)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or a plain path; None for any other store."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_blob(uri: str, data) -> None:
    """Write one file whole; a repeated task replaces it by the same bytes."""
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(temp := f"{path}.{uuid.uuid4().hex}", "wb") as out:
            out.write(data)
        os.replace(temp, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0])
    with store.open_output_stream(temp := f"{path}.{uuid.uuid4().hex}") as out:
        out.write(data)
    store.move(temp, path)


def map_blob(uri: str) -> np.ndarray:
    """The bytes of a file, memory-mapped if the store is mounted, else fetched once."""
    if (path := local_path(uri)) is not None:
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), np.uint8)
