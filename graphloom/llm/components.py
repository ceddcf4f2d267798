"""Connected components by alternating large-star and small-star rounds.

Links are kept as (u, v) with u > v. Each round is two aggregations and two joins on the
link table, written to the shared folder. A hub is one key of an aggregation with partial
sums, and of joins whose rows are dealt by key and salt. The number of rounds is
logarithmic; it ends when every node has one link, to a node without any. Up to ``SMALL``
links need no rounds: one task holds them as two arrays of a few megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import dealt, discard, durable


#: Links that one task settles.
SMALL = 1 << 18


def _at_once(links: DataFrame) -> DataFrame:
    """(u, v): every node but the smallest of each component with that one."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p[["u", "v"]].to_numpy(np.int64) for p in parts]
        ends = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
        nodes, at = np.unique(ends, return_inverse=True)
        at = at.reshape(-1, 2)
        low = np.arange(len(nodes))
        while len(at):
            best = low.copy()
            np.minimum.at(best, low[at[:, 0]], low[at[:, 1]])
            np.minimum.at(best, low[at[:, 1]], low[at[:, 0]])
            while (best[best] < best).any():
                best = best[best]
            best = best[low]
            if (best == low).all():
                break
            low = best
        up = low < np.arange(len(nodes))
        yield pd.DataFrame({"u": nodes[up], "v": nodes[low[up]]})

    return links.select("u", "v").coalesce(1).mapInPandas(rows, "u long, v long")


def _settled(links: DataFrame) -> bool:
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(links.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
    return nodes.agg(F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("top") > 0)), 1))).first()[0] == 0


def _lowest(links: DataFrame) -> DataFrame:
    """(node, m): the smallest neighbour below each node."""
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))


def _with_lowest(links: DataFrame, low: DataFrame, end: str) -> DataFrame:
    """``links`` with ``m`` of the node at ``end``; null where none is below."""
    return dealt(links.withColumn("node", F.col(end)), low.hint("merge"), ["node"], ["u", "v"], "left").select("u", "v", "m")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link between different nodes.

    ``component`` is the smallest node reachable. Null ends and self links are
    ignored; repeated and reversed links count once; no links give no rows.
    """
    links = links.filter(F.col(a) != F.col(b))
    links = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    if links.count() <= SMALL:
        links = durable(_at_once(links), "links")
    while not _settled(links):
        # Each node's larger neighbours are linked to the smallest of its neighbours and itself.
        large = _with_lowest(links, _lowest(links), "v").select("u", F.coalesce("m", "v").alias("v"))
        # Each node's smaller neighbours, and itself, are linked to the smallest of them.
        low = _lowest(large)
        small = _with_lowest(large, low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        earlier, links = links, durable(small.union(low).distinct(), "links")
        discard(earlier)
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
