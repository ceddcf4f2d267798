"""Queries of traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import paths as P
from graphloom.operators.reads import among, inside
from graphloom.plans.registry import query

#: A supplier, a customer and a nation: small ids exist at every scale.
SUPPLIER, CUSTOMER, OTHER = 4_000_000_001, 3_000_000_001, 3_000_000_002


def _seed(g, *ids):
    return g.spark.createDataFrame([(i,) for i in ids], "id long")


_HOPS = {
    "OUTGOING": "hop AS (SELECT from_id AS src, to_id AS dst, * FROM relation WHERE {0})",
    "INCOMING": "hop AS (SELECT to_id AS src, from_id AS dst, * FROM relation WHERE {0})",
    "BOTH": "hop AS (SELECT from_id AS src, to_id AS dst, * FROM relation WHERE {0} UNION ALL SELECT to_id, from_id, * FROM relation WHERE {0})",
}


def _levels(seed: str, depth: int, direction: str = "BOTH", where: str = "true") -> str:
    """Levels by unrolled joins."""
    out = _HOPS[direction].format(where) + f", l0 AS (SELECT CAST(id AS BIGINT) AS id, 0 AS level FROM (VALUES {seed}) AS v(id)), all0 AS (SELECT * FROM l0)"
    for k in range(1, depth + 1):
        out += f", l{k} AS (SELECT DISTINCT dst AS id, {k} AS level FROM hop WHERE src IN (SELECT id FROM l{k - 1}) AND dst NOT IN (SELECT id FROM all{k - 1})), all{k} AS (SELECT * FROM all{k - 1} UNION ALL SELECT * FROM l{k})"
    return out


for _direction, _word in (("OUTGOING", "out"), ("INCOMING", "in"), ("BOTH", "both")):
    for _depth in (1, 2):
        _start = SUPPLIER if _word != "in" else 2_000_000_003
        query(f"neighbors_{_word}_d{_depth}", f"{_levels(f'({_start})', _depth, _direction)};;SELECT id, level FROM all{_depth}")(
            lambda g, d=_direction, n=_depth, s=_start: P.reach(g.relation, _seed(g, s), n, d, relation_in=g.relation_in if d != "OUTGOING" else None))


@query("neighbors_typed_d2", _levels(f"({SUPPLIER})", 2, "BOTH", "relation_type = 'in_nation'") + ";;SELECT id, level FROM all2")
def neighbors_typed_d2(g):
    return P.reach(g.relation, _seed(g, SUPPLIER), 2, relation_type="in_nation", relation_in=g.relation_in)


@query("neighbors_edges_d2", _levels(f"({SUPPLIER})", 2) + ";;SELECT DISTINCT from_id, to_id, relation_type FROM hop WHERE src IN (SELECT id FROM all1)")
def neighbors_edges_d2(g):
    return P.scanned_edges(g.relation, P.reach(g.relation, _seed(g, SUPPLIER), 2, relation_in=g.relation_in), 2, relation_in=g.relation_in)


@query("subgraph_d1", _levels(f"({SUPPLIER}), ({CUSTOMER}), (1000000001), (42)", 1) + ";;SELECT id, level FROM all1 WHERE id IN (SELECT id FROM entity)")
def subgraph_d1(g):
    return P.reach(g.relation, among(g.entity, "id", _seed(g, SUPPLIER, CUSTOMER, 1_000_000_001, 42), "id"), 1, relation_in=g.relation_in)


@query("subgraph_edges_d1", _levels(f"({SUPPLIER}), ({CUSTOMER}), (1000000001)", 1).replace("all1 AS (", "all1 AS MATERIALIZED (") + ";;SELECT * FROM relation WHERE from_id IN (SELECT id FROM all1) AND to_id IN (SELECT id FROM all1)")
def subgraph_edges_d1(g):
    """The relations inside the subgraph."""
    return inside(g.relation, subgraph_d1(g))


@query("viewer_expand", _levels(f"({SUPPLIER})", 3) + ";;SELECT id, level FROM all3")
def viewer_expand(g):
    """A viewer may ask for any depth; three hops are walked at most."""
    return P.expand(g.relation, _seed(g, SUPPLIER), 9, g.relation_in)[0]


@query("find_path_chain", "SELECT CAST(p_partkey - 1 AS INTEGER) AS step, CAST(5000000000 + p_partkey AS BIGINT) AS id FROM part WHERE p_partkey BETWEEN 1 AND 45")
def find_path_chain(g):
    """A path of 44 hops along a chain."""
    return P.find_path(g.entity_by_name, g.kept("chain", lambda: g.chain), "Part#000000001", "Part#000000045")


@query("find_path_hops", _levels(f"({CUSTOMER})", 4) + f";;SELECT id AS target, level AS hops FROM all4 WHERE id IN ({OTHER}, {SUPPLIER}, 1000000002)")
def find_path_hops(g):
    targets = _seed(g, OTHER, SUPPLIER, 1_000_000_002)
    levels = P.reach(g.relation, _seed(g, CUSTOMER), 4, relation_in=g.relation_in)
    return among(levels, "id", targets, "id").select(F.col("id").alias("target"), F.col("level").alias("hops"))


@query("find_path_nodes", _levels(f"({CUSTOMER})", 4) + f""",
p AS (SELECT level AS step, id FROM all4 WHERE id = {SUPPLIER}
      UNION ALL SELECT p.step - 1, (SELECT min(h.src) FROM hop h JOIN all4 a ON a.id = h.src AND a.level = p.step - 1 WHERE h.dst = p.id) FROM p WHERE p.step > 0);;
SELECT step, id FROM p""")
def find_path_nodes(g):
    return P.shortest_path(g.relation, _seed(g, CUSTOMER), _seed(g, SUPPLIER), g.relation_in)


def _paths(depth: int, end: int) -> str:
    return f"""
hop AS (SELECT from_id AS src, to_id AS dst FROM relation UNION ALL SELECT to_id, from_id FROM relation),
w AS (SELECT CAST({CUSTOMER} AS BIGINT) AS id, [CAST({CUSTOMER} AS BIGINT)] AS path, 0 AS hops
      UNION ALL SELECT dst, list_append(path, dst), hops + 1 FROM w JOIN hop ON src = w.id
      WHERE hops < {depth} AND w.id <> {end} AND NOT list_contains(path, dst) AND (hops < {depth - 1} OR dst = {end}));;
SELECT array_to_string(path, '>') AS path, hops FROM w WHERE id = {end}"""


for _depth, _end in ((3, 2_000_000_003), (4, OTHER)):
    query(f"all_paths_d{_depth}", _paths(_depth, _end))(
        lambda g, n=_depth, end=_end: P.all_paths(g.relation, CUSTOMER, end, n, relation_in=g.relation_in).select(F.array_join("path", ">").alias("path"), "hops"))
