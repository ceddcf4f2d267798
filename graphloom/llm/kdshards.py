"""Sharding by a k-d tree over document metadata, in DataFrame functions only.

A node of the tree that still needs k > 1 shards is split along the dimension that is
widest in it, measured against the whole table, at the weighted quantile of k // 2 of
its k shards (the median where k is even). Weights are bytes, so leaves come out at
the target size; a split is exact to one document.

The quantile is found by refinement: one pass sums the bytes of ``BUCKETS`` ranges of
each node's split dimension, a window over these few sums finds the range in which
the quantile falls, and the next pass divides that range. Rows that are equal in the
dimension (a hot source) are ordered by doc_id, repeated ones by their place in the
stored table, so that no tie makes a shard too large. All nodes of a level share a
pass; the driver sees one row for each node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, table, unused

SHARDS = 16
#: Ranges into which a pass divides what is still open of each node.
BUCKETS = 1024
#: Ranges from this width on are divided in floating point, which keeps their order.
_WIDE = 1 << 52
_PARTS = ("__dim", "__doc", "__rid")


def metadata(docs: DataFrame) -> dict[str, Column]:
    """Default dimensions, as longs: hashed source and lang, bytes, doc_id; those that ``docs`` has."""
    text = F.octet_length(F.col("text").cast("string")).cast("long")
    known = {c.lower() for c in docs.columns}
    named = {c: F.crc32(F.col(c).cast("string").cast("binary")) for c in ("source", "lang") if c in known}
    return named | {"bytes": F.coalesce(text, F.lit(0))} | ({"doc_id": F.col("doc_id").cast("long")} if "doc_id" in known else {})


def _of_node(values: dict[int, int], level: int) -> Column:
    """The value of a row's node at a level of the tree; null where the node has none."""
    first = 1 << level
    return F.get(F.array(*[F.lit(values.get(first + i)).cast("long") for i in range(max(values) - first + 1)]), F.col("__node") - first)


def _stepped(rows: DataFrame, level: int, splits: dict[int, tuple]) -> DataFrame:
    """``rows`` with ``__node`` one step down the tree, written: nested steps would repeat one another in the plan."""
    axis, v, d, r = (_of_node({n: x[i] for n, x in splits.items()}, level) for i in range(4))
    own = F.get("__dims", axis.cast("int"))
    right = (own > v) | ((own == v) & ((F.col("__doc") > d) | ((F.col("__doc") == d) & (F.col("__rid") > r))))
    return durable(rows.withColumn("__node", F.when(axis.isNull(), F.col("__node")).otherwise(2 * F.col("__node") + right.cast("long"))), "nodes")


def _bounds() -> list[Column]:
    return [f(c).alias(f"{c}_{n}") for c in _PARTS for f, n in ((F.min, "low"), (F.max, "high"))]


def _quantiles(rows: DataFrame, level: int, open_: dict[int, dict]) -> dict[int, tuple]:
    """node: (axis, v, d, r) for each open node of a level: keys up to (v, d, r) go left.

    ``open_`` has of each node its axis, target weight, and bounds of the three parts of
    a key; each pass narrows the bounds around the key in which the target falls.
    """
    done = {}
    while True:
        at: dict[str, dict[int, int]] = {n: {} for n in ("axis", "target", "part", "low", "high", "v", "d")}
        for node, s in list(open_.items()):
            part = next((i for i, (low, high) in enumerate(s["bounds"]) if low < high), None)
            if part is None:  # one row: it goes to the side that it leaves nearer to the target
                v, d, r = (low for low, _ in s["bounds"])
                done[node] = (s["axis"], v, d, r if 2 * s["target"] >= s["weight"] else r - 1)
                del open_[node]
            else:
                for n, value in zip(at, (s["axis"], s["target"], part, *s["bounds"][part], s["bounds"][0][0], s["bounds"][1][0]), strict=True):
                    at[n][node] = value
        if not open_:
            return done
        own = rows.withColumns({f"__{n}": _of_node(x, level) for n, x in at.items()}).filter("__axis IS NOT NULL").withColumn("__dim", F.get("__dims", F.col("__axis").cast("int")))
        key = F.when(F.col("__part") == 0, F.col("__dim")).when(F.col("__part") == 1, F.col("__doc")).otherwise(F.col("__rid"))
        inside = key.between(F.col("__low"), F.col("__high")) & ((F.col("__part") == 0) | (F.col("__dim") == F.col("__v"))) & ((F.col("__part") < 2) | (F.col("__doc") == F.col("__d")))
        half = lambda c: c.cast("double") / 2  # noqa: E731  half of a long never overflows
        width = half(F.col("__high")) - half(F.col("__low"))
        coarse = F.least(F.floor((half(key) - half(F.col("__low"))) * BUCKETS / width).cast("long"), F.lit(BUCKETS - 1).cast("long"))
        fine = F.floor((key - F.col("__low")) * BUCKETS / (F.col("__high") - F.col("__low") + 1)).cast("long")
        sums = own.filter(inside).groupBy("__node", "__target", F.when(width * 2 >= _WIDE, coarse).otherwise(fine).alias("bucket")).agg(F.sum("__size").alias("weight"), *_bounds())
        ordered = Window.partitionBy("__node").orderBy("bucket")
        crossed = sums.withColumn("upto", F.sum("weight").over(ordered)).filter("upto >= __target").withColumn("at", F.row_number().over(ordered)).filter("at = 1")
        for x in crossed.collect():
            s = open_[x["__node"]]
            s["target"] -= x["upto"] - x["weight"]
            s["weight"], s["bounds"] = x["weight"], [(x[f"{c}_low"], x[f"{c}_high"]) for c in _PARTS]


def split_nodes(rows: DataFrame, n_dims: int, shards: int | None, target_bytes: int | None) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` (__dims, __doc, __rid, __size) with the leaf of each as ``__node``, and the shards of leaves."""
    rows = rows.withColumn("__node", F.lit(1).cast("long"))
    wanted: dict[int, int] = {}
    spans: list[float] = []
    level = 0
    while True:
        ranges = [f(F.get("__dims", F.lit(i))).alias(f"{n}{i}") for i in range(n_dims) for f, n in ((F.min, "low"), (F.max, "high"))]
        whole = [f(c).alias(f"{c}_{n}") for c in _PARTS[1:] for f, n in ((F.min, "low"), (F.max, "high"))]
        stats = {x["__node"]: x for x in rows.filter(F.col("__node") >= 1 << level).groupBy("__node").agg(F.sum("__size").alias("weight"), *ranges, *whole).collect()}
        if not level:
            total = sum(x["weight"] for x in stats.values())
            wanted[1] = shards or max(1, round(total / (target_bytes or total or 1)))
            spans = [x[f"high{i}"] - x[f"low{i}"] or 1 for x in stats.values() for i in range(n_dims)]
        open_: dict[int, dict] = {}
        for node, x in stats.items():
            if (k := wanted[node]) > 1:
                wide = [(x[f"high{i}"] - x[f"low{i}"]) / spans[i] for i in range(n_dims)]
                axis = wide.index(max(wide))
                open_[node] = {"axis": axis, "target": x["weight"] * (k // 2) // k, "weight": x["weight"], "bounds": [(x[f"low{axis}"], x[f"high{axis}"]), *((x[f"{c}_low"], x[f"{c}_high"]) for c in _PARTS[1:])]}
        if not open_:
            break
        for node in open_:
            k = wanted.pop(node)
            wanted[2 * node], wanted[2 * node + 1] = k // 2, k - k // 2
        rows = _stepped(rows, level, _quantiles(rows, level, open_))
        level += 1
    first, numbered = 0, {}
    for node in sorted(wanted, key=lambda n: n << (level + 1 - n.bit_length())):
        numbered[node] = first
        first += wanted[node]  # a node that ran out of rows keeps the numbers of shards that stay empty
    return rows, numbered


def shard_documents(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, dims: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard, by doc_id); names in use get longer.

    Give the number of shards, or None and ``target_bytes`` of a leaf. ``dims`` are long
    columns of metadata (:func:`metadata` by default); a null is smaller than any value.
    A row weighs the UTF-8 bytes of its text plus one, a null text one. Equal and
    repeated rows are split like others. With fewer rows than shards some shards stay
    empty; an empty table gives no rows. All columns are kept.
    """
    dims = dims or metadata(docs)
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1
    lowest = F.lit(-(1 << 62)).cast("long")
    keys = [F.coalesce(c.cast("long"), lowest if name == "doc_id" else F.lit(-1).cast("long")) for name, c in dims.items()]
    made = dict(zip(["__size", "__dims", "__doc", "__rid"], [size, F.array(*keys), F.coalesce(F.col("doc_id").cast("long"), lowest), F.monotonically_increasing_id()], strict=True))
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    stored = durable(docs.select(*kept, *[c.alias(n) for n, c in made.items()]), "sharded")
    rows = stored.select("__dims", "__doc", "__rid", "__size")
    placed, numbered = split_nodes(rows, len(keys), shards, target_bytes)
    deepest = max(n.bit_length() for n in numbered)
    shard = F.coalesce(*[_of_node(part, level) for level in range(deepest) if (part := {n: i for n, i in numbered.items() if n.bit_length() == level + 1})])
    ordered = placed.select("__rid", "__doc", shard.cast("int").alias("__shard")).repartitionByRange("__shard", "__doc", "__rid").sortWithinPartitions("__shard", "__doc", "__rid")
    placed = durable(ordered.select("__rid", "__shard", F.monotonically_increasing_id().alias("__at")).withColumn("__run", F.shiftright("__at", 33)), "placed")
    # A shard is one run of rows in each of some following partitions.
    runs = placed.groupBy("__shard", "__run").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__shard").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("__shard", "__run", (before - F.col("__first")).alias("__shift"))
    slots = placed.join(runs, ["__shard", "__run"]).select("__rid", "__shard", (F.col("__at") + F.col("__shift")).alias("__slot"))
    names = unused(docs, "shard", "slot")
    return stored.join(slots, "__rid").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("__shard").alias(names[0]), F.col("__slot").alias(names[1]))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The shards of :func:`shard_documents` as Parquet under ``path``, one folder a shard, rows in order of their slots."""
    out = shard_documents(docs, **options)
    shard, slot = out.columns[-2:]
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op11_shards(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    docs = docs.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)})
    out = shard_documents(docs, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
