"""Approximate nearest vectors by an inverted file of cells.

A coarse quantiser (spherical k-means on a bounded sample, tasks sending partial sums) gives
every vector a cell; the inverted file holds all vectors in order of cells. A query ranks
the vectors of its nearest cells exactly: of one query the cells are a predicate of the
scan, many queries meet the rows of their cells in matrix products. How many cells have to be
probed for a recall is measured on some of the queries, not guessed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.vectors import PACK, QUERY_BLOCK, _unit
from graphloom.sources.shared import durable

#: Rows from which cells are learned, cells at most, rounds of k-means.
SAMPLE, MOST_CELLS, ROUNDS = 100_000, 4096, 8
#: Queries on which probes are measured, and what is added to the recall asked for.
MEASURED, MARGIN = 200, 0.02
#: Rows of a shard (about so many, cut by samples) and queries of a block: what a task holds when they meet. Candidates it gathers.
SHARD, QUERIES, KEPT = 16_384, 16_384, 1_000_000
#: Distances are rounded to steps of this.
STEP = 1e-6


def whole(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector that has neither nulls nor values that aren't finite."""
    x = F.col(vector).cast("array<double>")
    return rows.filter(F.col(vector).isNotNull() & F.forall(x, lambda c: F.coalesce((c < float("inf")) & (c > float("-inf")), F.lit(False))))


def learn_cells(chunks: DataFrame, cells: int, rounds: int = ROUNDS, sample: int = SAMPLE) -> np.ndarray:
    """(cells, dimensions): unit centres of the vectors of at most ``sample`` rows, the first by a hash of their id."""
    part = durable(chunks.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample), "sample")
    first = part.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(cells).toPandas()
    if first.empty:
        return np.zeros((0, 0))
    centres = _unit(first["embedding"].tolist())
    for _ in range(rounds):
        sent = centres

        def sums(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            total, n = np.zeros_like(sent), np.zeros(len(sent), np.int64)
            for p in parts:
                if len(p):
                    v = _unit(p["embedding"].tolist())
                    at = (v @ sent.T).argmax(1)
                    np.add.at(total, at, v)
                    n += np.bincount(at, minlength=len(sent))
            own = np.flatnonzero(n)
            if len(own):  # an empty list would pass for a number
                yield pd.DataFrame({"cell": own, "total": total[own].tolist()})

        made = part.mapInPandas(sums, "cell long, total array<double>")
        added = made.select("cell", F.posexplode("total").alias("at", "x")).groupBy("cell", "at").agg(F.sum("x").alias("x")).groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("total")).toPandas()
        moved = centres.copy()
        moved[added["cell"].to_numpy()] = _unit(added["total"].tolist())
        if np.abs(moved - centres).max() < 1e-6:
            break
        centres = moved
    return centres


def _nearest_cells(rows: DataFrame, vector: str, centres: np.ndarray, n: int) -> DataFrame:
    """``rows`` with ``cells``: the ``n`` nearest cells of ``vector``, nearest first."""

    def near(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            far = -(_unit(p.tolist()) @ centres.T) if len(p) and len(centres) else np.zeros((len(p), len(centres)))
            yield pd.Series(np.argsort(far, axis=1, kind="stable")[:, :n].tolist())

    return rows.withColumn("cells", F.pandas_udf(near, "array<int>")(F.col(vector).cast("array<double>")))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of norm 1, or 0."""
    length = pc.list_value_length(vectors)
    if len(length) and pc.min(length).as_py() != pc.max(length).as_py():
        raise ValueError("dimensions differ")
    v = np.asarray(pc.list_flatten(vectors).to_numpy(), float).reshape(len(length), -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _best(rows: pa.Table, asked: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query in ``asked``, vec_id, distance): its ``k`` nearest of ``rows``, sorted by cell, that lie in one of its cells.

    Products by blocks; of a block only rows that may still belong to a list are kept.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not rows.num_rows or not asked.num_rows:
        return found[0]
    v, q, ids, cell = _matrix(rows["embedding"]), _matrix(asked["q"]), rows["vec_id"].to_numpy(), rows["cell"].to_numpy()
    if v.shape[1] != q.shape[1]:
        raise ValueError("dimensions differ")
    at = np.repeat(np.arange(len(q)), pc.list_value_length(asked["cells"]).to_numpy())
    wanted = pc.list_flatten(asked["cells"]).to_numpy()
    order = np.argsort(wanted, kind="stable")
    at, wanted = at[order], wanted[order]
    least, size = np.full(len(q), -np.inf), 0  # likeness that the k-th of a list has at least

    def cut(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, i, d = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((i, d, n))
        n, i, d = n[order], i[order], d[order]
        place = np.arange(len(n)) - np.searchsorted(n, n)
        last = place == k - 1
        least[n[last]] = np.maximum(least[n[last]], 1 - d[last] - STEP)
        return n[place < k], i[place < k], d[place < k]

    for c in np.unique(cell):
        begin, end = np.searchsorted(cell, [c, c + 1])
        one, two = np.searchsorted(wanted, [c, c + 1])
        for i in range(begin, end, PACK):
            pack = slice(i, min(i + PACK, end))
            for j in range(one, two, QUERY_BLOCK):
                here = at[j : min(j + QUERY_BLOCK, two)]
                like = q[here] @ v[pack].T
                if like.shape[1] >= k and np.isneginf(least[here]).any():
                    least[here] = np.maximum(least[here], np.partition(like, -k, axis=1)[:, -k])
                # Rounded distances tie: what is less than a step below may still belong to a list.
                x, y = np.nonzero(like >= (least[here] - 2 * STEP)[:, None])
                found.append((here[x], ids[pack][y], np.round(1 - like[x, y], 6) + 0.0))  # no negative zero
                size += len(x)
                if size > KEPT:
                    found, size = [cut(found)], 0
    return cut(found)


class VectorIndex:
    """The inverted file ``rows`` (cell, shard and the columns of ``chunks``), in order of cells, and its ``centres``.

    ``chunks`` (vec_id, embedding, ...) may hold null or broken vectors, which are left
    out. With about the square root of their number in cells, a probe reads as much.
    """

    def __init__(self, chunks: DataFrame, cells: int | None = None):
        chunks = whole(chunks, "embedding")
        self.size = chunks.count()
        self.centres = learn_cells(chunks, cells or max(1, min(MOST_CELLS, round(self.size**0.5))))
        rows = _nearest_cells(chunks, "embedding", self.centres, 1).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
        rows = rows.repartitionByRange(max(1, -(-self.size // SHARD)), "cell", "vec_id").withColumn("shard", F.spark_partition_id())
        self.rows = durable(rows.sortWithinPartitions("cell", "vec_id"), "inverted")

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.9) -> int:
        """Cells to probe so that ``recall`` of the true ``k`` nearest are found, measured on at most ``MEASURED`` queries."""
        asked = whole(queries, "q").orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED)
        asked = durable(_nearest_cells(asked.select("query_id", "q"), "q", self.centres, len(self.centres)), "asked")
        found = self.search(asked, k, len(self.centres)).join(self.rows.select("vec_id", "cell"), "vec_id").join(asked.select("query_id", "cells"), "query_id")
        place = F.array_position("cells", F.col("cell")).alias("place")
        at = found.select(place).groupBy("place").count().orderBy("place").toPandas()  # a row for each cell at most
        share = at["count"].cumsum() / max(at["count"].sum(), 1)
        enough = at["place"][share >= min(recall + MARGIN, 1.0)]
        return int(enough.iloc[0]) if len(enough) else len(self.centres)

    def near(self, query: list[float], k: int, probes: int, where: Column | None = None) -> DataFrame:
        """The rows of the nearest cells of one vector that pass ``where``, with ``distance``: the ``k`` nearest of them."""
        q = np.asarray(query, float)
        cells = np.argsort(-(_unit([q]) @ self.centres.T)[0], kind="stable")[:probes] if len(self.centres) else []
        rows = self.rows.filter(F.col("cell").isin([int(c) for c in cells]))
        rows = rows.filter(where) if where is not None else rows
        length = float(np.linalg.norm(q))
        e = F.col("embedding").cast("array<double>")
        dot = F.aggregate(F.zip_with(e, F.array(*[F.lit(float(x)) for x in q]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)) * length
        return rows.withColumn("distance", F.round(F.when(norm == 0, 1.0).otherwise(1.0 - dot / norm), 6) + 0.0).orderBy("distance", "vec_id").limit(k)

    def search(self, queries: DataFrame, k: int, probes: int, where: Column | None = None) -> DataFrame:
        """(query_id, vec_id, distance): the ``k`` nearest, by cosine, in the ``probes`` nearest cells of each of ``queries`` (query_id, q).

        ``where`` is tested before the ranking. A query goes once to each shard that holds rows of its
        cells, and each row to each block of queries, where they meet by cells. Broken queries find nothing.
        """
        asked = durable(_nearest_cells(whole(queries, "q").select("query_id", "q"), "q", self.centres, probes), "asked")
        blocks = max(1, -(-asked.count() // QUERIES))
        # Which shards hold rows of a cell: a row for each cell, and one more for each shard at most.
        held = self.rows.select("cell", F.col("shard").alias("part")).distinct()
        wanted = asked.select("query_id", F.explode("cells").alias("cell")).join(F.broadcast(held), "cell").groupBy("query_id", "part").agg(F.collect_list("cell").alias("cells"))
        group = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("group")
        asked = asked.select("query_id", "q").join(wanted, "query_id").select("part", group, "query_id", "q", "cells")
        rows = (self.rows.filter(where) if where is not None else self.rows).select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "cell", "vec_id", "embedding")

        def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
            at, ids, far = _best(rows.sort_by([("cell", "ascending"), ("vec_id", "ascending")]), asked, k)
            return pa.table({"query_id": asked["query_id"].to_numpy()[at], "vec_id": ids, "distance": far})

        near = rows.groupBy("shard", "block").cogroup(asked.groupBy("part", "group")).applyInArrow(best, "query_id long, vec_id long, distance double")
        order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        return near.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).drop("at")
