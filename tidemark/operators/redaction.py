"""Redacted copies of records, by the fields' own policy; what is stored stays as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.history import History
from tidemark.shapes import FLOATS, INTEGERS, Shape

HIDDEN = "[REDACTED]"


def redacted(value: Column, shape: Shape) -> Column:
    """Texts are hidden, numbers zero and dates the first of 1970; lists, maps and records keep their form."""
    k = shape.kind
    if k == "option":
        return redacted(value, shape.item)
    if k in INTEGERS or k in FLOATS:
        out = F.lit(0).cast(shape.spark_type())
    elif k == "bool":
        out = F.lit(False)
    elif k in ("list", "array", "set"):
        out = F.transform(value, lambda x: redacted(x, shape.item))
    elif k == "map":
        out = F.transform_values(value, lambda _, x: redacted(x, shape.item))
    elif k in ("record", "tuple"):
        parts = [(m.name, m.shape) for m in shape.members] or [(f"_{n + 1}", s) for n, s in enumerate(shape.items)]
        out = F.struct(*(redacted(value[n], s).alias(n) for n, s in parts))
    elif k == "enum":
        out = F.struct(value["tag"].alias("tag"), *(redacted(value[t], s).alias(t) for t, kind, s in shape.variants if kind != "unit"))
    elif k == "bytes":
        out = F.lit(b"")
    elif k == "date":
        out = F.lit("1970-01-01").cast("date")
    else:
        out = F.lit(HIDDEN)
    return F.when(value.isNotNull(), out)


def redact(df: DataFrame, history: History, record: str = "record") -> DataFrame:
    """``df`` with the fields of ``record`` that are marked ``redact`` hidden.

    For records of an older version pass ``history.as_of(version)``, which also
    decodes them.
    """
    parts = []
    for f in history.fields_at(history.head):
        value = F.col(record)[f.name]
        parts.append((redacted(value, f.shape) if f.redact else value).alias(f.name))
    return df.withColumn(record, F.when(F.col(record).isNotNull(), F.struct(*parts)))


def template(df: DataFrame, text: str, record: str = "record", column: str = "text") -> DataFrame:
    """``df`` with ``text``, in which {field} stands for a field of ``record``."""
    import re

    parts = [F.lit(p) if k % 2 == 0 else F.col(record)[p].cast("string") for k, p in enumerate(re.split(r"\{(\w+)\}", text))]
    return df.withColumn(column, F.concat(*parts))
