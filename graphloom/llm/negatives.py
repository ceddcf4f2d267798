"""Hard negatives by a pivot table.

An extra coordinate sqrt(M^2 - |x|^2) gives every vector the largest norm M of the
table; queries get a zero there. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so a larger inner
product is a smaller distance. The table stores each row's distances to ``PIVOTS``
pivots, in order of the nearest pivot. For a query, the triangle inequality over these
distances brackets the score of each row, and over their range in a batch those of
the whole batch; only what may still enter a list is checked by an exact product.

Queries are taken in blocks of bounded size, each of which meets all rows by one scan of
the stored table. A first scan over a sixteenth of the rows gives every list a
last place to beat, so that what tasks report of all rows stays small; lists are exact.
Positives come from one such search, negatives, in a window of scores below
each positive, from a second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, table

#: Pivots, and rows of a bounded sample from which they are taken farthest first.
PIVOTS = 16
PIVOT_SAMPLE = 2000
#: Queries of a block, and rows and queries that meet at once in a task.
QUERY_BLOCK = 16_384
ROWS, QUERIES = 1024, 512
#: One of so many rows takes part in the scan that finds what lists have to beat.
SEED_SHARE = 16
#: Entries that a task holds before lists are cut.
HELD = 1 << 20
_NONE = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, x): distinct rows with a key, a label and finite components, as integers floor(256 * x)."""
    x = F.col(vector).cast("array<double>")
    ok = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda c: F.coalesce((c < float("inf")) & (c > float("-inf")), F.lit(False)))
    return rows.filter(ok).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * 256)).alias("x")).distinct()


def _matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows (x, extra) to augmented pivots, the last column of which is the extra coordinate."""
    full = np.concatenate([x, extra[:, None]], 1)
    square = (full**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, norm2: float, n: int = PIVOTS) -> np.ndarray:
    """``n`` augmented pivots at most, each the row farthest from those before it."""
    full = np.concatenate([sample, np.sqrt(np.maximum(norm2 - (sample**2).sum(1), 0))[:, None]], 1)
    full = np.unique(full, axis=0)
    chosen, near = [0], ((full - full[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(full)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((full - full[chosen[-1]]) ** 2).sum(1))
    return full[chosen]


class PivotTable:
    """Stored rows (id, label, x, d, cell) with their distances to the pivots, and the largest squared norm."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        rows = durable(rows, "vectors")
        size = F.size("x")
        square = F.aggregate("x", F.lit(0).cast("double"), lambda a, c: a + c.cast("double") * c)
        dims, norm2 = rows.agg(F.max(size), F.max(square)).first()
        self.dims, self.norm2 = dims or 0, norm2 or 0.0
        if self.norm2 >= 2.0**62:
            raise ArithmeticError("inner products of these vectors do not fit into 64 bits")
        if self.dims:  # shorter vectors end in zeros
            rows = rows.withColumn("x", F.when(size < self.dims, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(self.dims) - size))).otherwise(F.col("x")))
        sample = rows.orderBy(F.xxhash64("id", "x")).select("x").limit(PIVOT_SAMPLE).toArrow()
        self.pivots = choose_pivots(_matrix(sample["x"]), self.norm2) if len(sample) and self.dims else np.zeros((1, self.dims + 1))
        pivots, norm2 = self.pivots, self.norm2

        def measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in parts:
                x = _matrix(p["x"]) if len(p) else np.zeros((0, pivots.shape[1] - 1))
                d = _distances(x, np.sqrt(np.maximum(norm2 - (x**2).sum(1), 0)), pivots)
                lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * d.shape[1], d.ravel())
                yield pa.RecordBatch.from_arrays([p["id"], p["label"], p["x"], lists, pa.array(d.argmin(1).astype(np.int32) if len(p) else np.zeros(0, np.int32))], ["id", "label", "x", "d", "cell"])

        made = rows.mapInArrow(measured, "id long, label long, x array<long>, d array<double>, cell int")
        near = F.element_at("d", F.col("cell") + 1)
        self.rows = durable(made.repartitionByRange("cell", near, "id").sortWithinPartitions("cell", near, "id"), "pivots")
        self.spark = spark

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        square = (q**2).sum(1)[:, None] + self.norm2 - 2 * q @ self.pivots[:, :-1].T
        return np.sqrt(np.maximum(square, 0))


class Lists:
    """The best ``k`` of each list so far, by score, then id; ``score`` and ``last`` hold what a newcomer has to beat."""

    def __init__(self, floor: np.ndarray, last: np.ndarray, k: int):
        self.score, self.last, self.k = floor.copy(), last.copy(), k
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray, label: np.ndarray) -> None:
        ok = (score > self.score[slot]) | ((score == self.score[slot]) & (id_ <= self.last[slot]))
        if ok.any():
            self.held.append(np.stack([slot[ok], score[ok], id_[ok], label[ok]]))
            self.size += int(ok.sum())
            if self.size >= HELD:
                self.cut()

    def cut(self) -> np.ndarray:
        x = np.concatenate(self.held, 1) if self.held else np.zeros((4, 0), np.int64)
        x = x[:, np.lexsort((x[3], x[2], -x[1], x[0]))]
        begin = np.flatnonzero(np.diff(x[0], prepend=-1))
        place = np.arange(x.shape[1]) - np.repeat(begin, np.diff(np.append(begin, x.shape[1])))
        ends = x[:, place == self.k - 1]
        self.score[ends[0]], self.last[ends[0]] = ends[1], ends[2]
        x = x[:, place < self.k]
        self.held, self.size = [x], x.shape[1]
        return x


def _scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Exact integer inner products; floats hold them below 2**53."""
    return np.rint(q @ x.T).astype(np.int64) if exact else q.astype(np.int64) @ x.astype(np.int64).T


def _search(at: PivotTable, rows: DataFrame, queries: dict[str, np.ndarray], k: int, same: bool) -> DataFrame:
    """(slot, score, id, label): for each list, candidates of ``rows`` that hold its best ``k``.

    ``queries``: x, d, id, label; and windows ``low`` and ``high`` of scores, one column a
    list, with ``floor`` and ``last`` to beat. List w of query i has the slot i * lists + w.
    ``same`` takes rows of the query's label other than itself, else rows of other labels.
    """
    norm2 = at.norm2
    exact = norm2 < 2.0**52
    sent = at.spark.sparkContext.broadcast(queries)

    def rows_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        n, lists = q["low"].shape
        best = Lists(q["floor"].ravel(), q["last"].ravel(), k)
        q2 = (q["x"] ** 2).sum(1)
        slack = 1e-9 * (q2.max(initial=0) + norm2) + 1e-6
        for p in parts:
            for at_ in range(0, len(p), ROWS):
                b = p.slice(at_, ROWS)
                x, d, ids, labels = _matrix(b["x"]), _matrix(b["d"]), b["id"].to_numpy(), b["label"].to_numpy()
                low_d, high_d = d.min(0), d.max(0)
                least = np.maximum(q["low"], best.score.reshape(n, lists)).min(1)
                most = q["high"].max(1)
                gap = np.maximum(np.maximum(low_d - q["d"], q["d"] - high_d), 0).max(1)
                reach = (q["d"] + high_d).min(1)
                upper, lower = (q2 + norm2 - gap**2) / 2 + slack, (q2 + norm2 - reach**2) / 2 - slack
                wanted = (upper >= least) & (lower <= most) & (least <= most)
                if same:
                    wanted &= np.isin(q["label"], labels)
                active = np.flatnonzero(wanted)
                for low in range(0, len(active), QUERIES):
                    a = active[low : low + QUERIES]
                    mask = (q["label"][a, None] == labels[None, :]) & (q["id"][a, None] != ids[None, :]) if same else q["label"][a, None] != labels[None, :]
                    near, far = np.zeros((len(a), len(x))), np.full((len(a), len(x)), np.inf)
                    for v in range(d.shape[1]):
                        dq, dx = q["d"][a, v, None], d[None, :, v]
                        np.maximum(near, np.abs(dq - dx), out=near)
                        np.minimum(far, dq + dx, out=far)
                    base = (q2[a] + norm2)[:, None]
                    mask &= ((base - near**2) / 2 + slack >= least[a, None]) & ((base - far**2) / 2 - slack <= most[a, None])
                    left = mask.any(0)
                    if not left.any():
                        continue
                    score = _scores(q["x"][a], x[left], exact)
                    mask, own, own_label = mask[:, left], ids[left], labels[left]
                    for w in range(lists):
                        i, j = np.nonzero(mask & (score >= np.maximum(q["low"][a, w], best.score[a * lists + w])[:, None]) & (score <= q["high"][a, w, None]))
                        best.add(a[i] * lists + w, score[i, j], own[j], own_label[j])
        x = best.cut()
        for low in range(0, x.shape[1], 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x[:, low : low + (1 << 16)]], ["slot", "score", "id", "label"])

    return rows.mapInArrow(rows_of, "slot long, score long, id long, label long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(slot, score, id, label, rank): the first ``k`` of each slot."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id", "label")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _nearest(at: PivotTable, queries: dict[str, np.ndarray], k: int, same: bool) -> DataFrame:
    """:func:`_best` of all rows, with places to beat from a share of them."""
    lists = queries["low"].shape[1]
    seed = at.rows.filter(F.pmod(F.xxhash64("id", "x"), F.lit(SEED_SHARE)) == 0)
    last = _best(_search(at, seed, queries, k, same), k).filter(F.col("rank") == k).select("slot", "score", "id").toPandas()
    floor, tie = np.full(queries["low"].size, _NONE), np.full(queries["low"].size, _MOST)
    floor[last["slot"]], tie[last["slot"]] = last["score"], last["id"]
    beaten = queries | {"floor": floor.reshape(-1, lists), "last": tie.reshape(-1, lists)}
    return durable(_best(_search(at, at.rows, beaten, k, same), k), "nearest")


def hard_negatives(vectors: DataFrame, anchors: str, low: int = 30, high: int = 90, positives: int = 5, negatives: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, x) from :func:`whole_vectors`.

    ``anchors`` is a condition on ``id``. Scores are inner products. A positive is one of the
    first ``positives`` other rows of the anchor's label; its negatives are the first
    ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` percent
    of its own. Higher scores come first, ties by smaller id. Rows with equal columns count
    once; shorter vectors end in zeros; scores beyond 64 bits are an error. An
    empty table, or one without anchors, gives no rows.
    """
    at = PivotTable(vectors)
    chosen = at.rows.filter(anchors)
    n = chosen.count()
    blocks = max(1, -(-4 * n // (3 * QUERY_BLOCK)))  # three quarters of a block on average
    block = F.pmod(F.xxhash64("id", "label", "x"), F.lit(blocks))
    out = None
    for b in range(blocks):
        q = chosen.filter(block == b).select("id", "label", "x").orderBy("id", "label", "x").toArrow()
        if not len(q):
            continue
        x = _matrix(q["x"])
        queries = {"x": x, "d": at.query_distances(x), "id": q["id"].to_numpy(), "label": q["label"].to_numpy()}
        free = np.full((len(x), 1), _NONE), np.full((len(x), 1), _MOST)
        found = _nearest(at, queries | {"low": free[0], "high": free[1], "floor": free[0], "last": free[1]}, positives, True)
        known = found.toPandas()  # at most ``positives`` a query of the block
        at_, w, score = known["slot"].to_numpy(), known["rank"].to_numpy() - 1, known["score"].to_numpy()
        lows, highs = np.full((len(x), positives), _MOST), np.full((len(x), positives), _NONE)
        # Bounds in whole numbers, exact beyond 64 bits too.
        lows[at_, w] = [-(-low * int(s) // 100) for s in score]
        highs[at_, w] = [high * int(s) // 100 for s in score]
        none = np.full_like(lows, _NONE), np.full_like(lows, _MOST)
        hard = _nearest(at, queries | {"low": lows, "high": highs, "floor": none[0], "last": none[1]}, negatives, False)
        ids = at.spark.createDataFrame(pd.DataFrame({"anchor": np.arange(len(x)), "anchor_id": queries["id"]}))
        pairs = found.select(F.col("slot").alias("anchor"), (F.col("slot") * positives + F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, "anchor")
        part = pairs.join(hard.select("slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "slot")
        part = part.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = part if out is None else out.union(part)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return at.spark.createDataFrame([], schema) if out is None else out


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", F.col("embedding"), label.alias("label"))
    return hard_negatives(whole_vectors(rows, "vec_id", "embedding", "label"), "id % 100 = 0")


OP13_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, b.id, b.label, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
