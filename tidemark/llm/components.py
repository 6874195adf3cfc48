"""Connected components of a graph in a DataFrame, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize, small

#: Links of a node from which on its rows stay where they are: such nodes are few and are broadcast.
HUB = 100_000


def _links(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _with_low(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` with ``low`` of their node ``a``, by the written table ``least`` (a, low, n).

    If that is large, only its hubs are broadcast; a hub then never is one key of a shuffle.
    """
    narrow = least.select("a", "low")
    if (side := small(narrow)) is not narrow:
        return links.join(side, "a")
    hubs = F.broadcast(least.where(F.col("n") >= HUB).select("a", "low"))
    rest = links.join(hubs, "a", "left_anti").join(least.where(F.col("n") < HUB).select("a", "low"), "a")
    return links.join(hubs, "a").unionByName(rest)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), the component its smallest node.

    Alternates a large-star step, which links the larger neighbours of each
    node to its smallest one, with a small-star step, which does so for the
    smaller ones, until each component is a star.  Each round is a few
    shuffles of the links, and its result is written, so a lost executor
    costs one round at most.
    """
    links, seen = materialize(_links(edges), label), None
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select("a", F.least("a", "low").alias("low"), "n"), label)
        large = _links(_with_low(both, least).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        large = materialize(large, label)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")), label)
        lower = _with_low(large, least).select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = materialize(_links(lower.unionAll(least.select("a", F.col("low").alias("b")))), label)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
