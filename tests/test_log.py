"""The ordered mutation log against a fold over its requests, one by one."""

import random
from collections import Counter

import pytest

from graphloom.operators import log as L
from graphloom.operators import mutate
from graphloom.plans import changes
from graphloom.sources.derived import StoredGraph

LOG = "pos long, op string, name string, other string, kind string"
ENTITY, RELATION = "id long, name string, entity_type string", "from_id long, to_id long, relation_type string"


def fold(entities, relations, log, first_id):
    ids = {n: i for i, n, _ in entities}
    types = {i: t for i, _, t in entities}
    names = {i: n for i, n, _ in entities}
    live, said, events = set(relations), {}, []
    for pos, op, name, other, kind in sorted(log, key=lambda r: r[0] if r[0] is not None else -1):
        two = op in ("rename", "relate", "unrelate")
        if pos is None or op not in L.OPERATIONS or name is None or (two and other is None) or (op in ("create", "relate", "unrelate") and kind is None):
            said[pos] = "invalid"
            continue
        a, b = ids.get(name), ids.get(other) if two else None
        if op == "create":
            said[pos] = "empty" if not name else "known" if a is not None else "done"
            if said[pos] == "done":
                ids[name], names[first_id + pos], types[first_id + pos] = first_id + pos, name, kind
                events.append((pos, first_id + pos, "create", 0))
        elif op == "annotate":
            said[pos] = "unknown" if a is None else "done"
            events += [(pos, a, "update", 1)] if a is not None else []
        elif op == "delete":
            said[pos] = "unknown" if a is None else "done"
            if a is not None:
                live = {t for t in live if a not in t[:2]}
                del ids[name], names[a]
                events.append((pos, a, "delete", 0))
        elif op == "rename":
            said[pos] = "unknown" if a is None else "empty" if not other else "taken" if b is not None else "done"
            if said[pos] == "done":
                del ids[name]
                ids[other], names[a] = a, other
                events.append((pos, a, "update", 0))
        else:
            t = (a, b, kind)
            said[pos] = "unknown" if a is None or b is None else ("known" if t in live else "done") if op == "relate" else ("done" if t in live else "absent")
            if said[pos] == "done":
                (live.add if op == "relate" else live.discard)(t)
                events += [(pos, x, "update", 0) for x in {a, b}]
    counter = Counter(("entity", types[i]) for i in names)
    counter.update(("relation", t[2]) for t in live)
    counter.subtract(("entity", t) for _, _, t in entities)
    counter.subtract(("relation", t[2]) for t in set(relations))
    return said, {(i, n, types[i]) for i, n in names.items()}, live, sorted(events), {k: v for k, v in counter.items() if v}


def chains():
    rng = random.Random(12)
    names = [f"n{i}" for i in range(14)]
    log = []
    for pos in range(0, 1200, 2):
        op = rng.choices(["create", "delete", "rename", "annotate", "relate", "unrelate"], [5, 4, 7, 2, 6, 3])[0]
        name = "n0" if rng.random() < 0.35 else rng.choice(names)  # a third of all requests on one name
        log.append((pos, op, name, rng.choice([*names, ""]), rng.choice(["x", "y"])))
    return log


@pytest.mark.parametrize("stretch", [4096, 100])
def test_log_equals_a_fold(spark, monkeypatch, stretch):
    monkeypatch.setattr(L, "STRETCH", stretch)
    entities = [(i, f"n{i}", "t") for i in range(5)] + [(50, "still", "t"), (51, "other", "u")]
    relations = [(0, 1, "x"), (1, 0, "x"), (2, 2, "y"), (50, 51, "x"), (3, 4, "y")]
    log = [*chains(), (1301, "merge", "n1", "n2", None), (1302, None, "n1", None, None), (1303, "create", None, None, "t"), (1304, "relate", "still", None, "x"), (1305, "create", "", None, "t"), (1306, "rename", "still", "still", None), (1307, "relate", "still", "still", "x")]
    got = L.apply_log(spark.createDataFrame(entities, ENTITY), spark.createDataFrame(relations, RELATION), spark.createDataFrame(log, LOG), 1000)
    said, names, live, events, counter = fold(entities, relations, log, 1000)
    assert {r.pos: r.outcome for r in got["outcome"].collect()} == said
    assert {tuple(r) for r in got["entity"].collect()} == names and got["entity"].count() == len(names)
    assert {tuple(r) for r in got["relation"].collect()} == live and got["relation"].count() == len(live)
    assert sorted(tuple(r) for r in got["event"].collect()) == events
    assert {(r.kind, r.type): r.change for r in got["counter"].collect()} == counter
    assert set(Counter(said.values())) == {"done", "known", "unknown", "absent", "taken", "empty", "invalid"}


@pytest.mark.parametrize(("stretch", "most"), [(65_536, 12), (10, 24)])
def test_renames_that_hang_on_each_other_take_few_rounds(spark, monkeypatch, stretch, most):
    monkeypatch.setattr(L, "STRETCH", stretch)
    written, durable = [], L.durable
    monkeypatch.setattr(L, "durable", lambda df, name: written.append(name) or durable(df, name))
    entities = [(i, f"n{i}", "t") for i in range(1, 61)]
    log = [(2 * i, "rename", f"n{i + 1}", f"n{i}", None) for i in range(60)]  # each is done because the one before is
    for taken in ([], [(99, "n0", "t")]):  # or isn't, because that isn't
        written.clear()
        got = L.apply_log(spark.createDataFrame(entities + taken, ENTITY), spark.createDataFrame([], RELATION), spark.createDataFrame(log, LOG), 1000)
        said, names, *_ = fold(entities + taken, [], log, 1000)
        assert {r.pos: r.outcome for r in got["outcome"].collect()} == said and {tuple(r) for r in got["entity"].collect()} == names
        assert set(said.values()) == {"taken" if taken else "done"} and len(written) <= most


def test_counts_of_relations_that_are_there_twice_or_without_type(spark):
    entity = spark.createDataFrame([(1, "a", "t"), (2, "b", "t"), (3, "c", "t")], ENTITY)
    relation = spark.createDataFrame([(1, 2, "x"), (1, 2, "x"), (2, 3, "x"), (1, 1, None), (2, 3, None), (2, 3, "y"), (2, 1, "y")], RELATION)
    got = L.apply_log(entity, relation, spark.createDataFrame([(1, "delete", "a", None, None), (2, "relate", "b", "c", "y"), (3, "unrelate", "b", "c", "y"), (4, "relate", "c", "b", "y")], LOG), 10)
    assert {tuple(r) for r in got["relation"].collect()} == {(2, 3, "x"), (2, 3, None), (3, 2, "y")} and got["relation"].count() == 3
    assert {(r.kind, r.type): r.change for r in got["counter"].collect()} == {("entity", "t"): -1, ("relation", "x"): -1, ("relation", None): -1, ("relation", "y"): -1}
    assert {r.pos: r.outcome for r in got["outcome"].collect()} == {1: "done", 2: "known", 3: "done", 4: "done"}


def test_the_log_stores_no_tables_it_reads_once(spark):
    g = StoredGraph(spark, "/root/testdata/sf0.001")
    assert changes.mut_log_outcome(g).count() == 1000 and "relation" not in g.__dict__


def test_no_requests_and_requests_without_position(spark):
    entity, relation = spark.createDataFrame([(1, "a", "t")], ENTITY), spark.createDataFrame([(1, 1, "x")], RELATION)
    got = L.apply_log(entity, relation, spark.createDataFrame([], LOG), 10)
    assert got["outcome"].count() == got["event"].count() == got["counter"].count() == 0 and got["entity"].count() == got["relation"].count() == 1
    got = L.apply_log(entity, relation, spark.createDataFrame([(None, "delete", "a", None, None)], LOG), 10)
    assert [tuple(r) for r in got["outcome"].collect()] == [(None, "invalid")] and got["entity"].count() == 1


def test_renames_in_order(spark):
    entity = spark.createDataFrame([(1, "a", "t"), (2, "b", "t"), (3, "c", "t")], ENTITY)
    asked = [(1, "b", "d"), (2, "a", "b"), (3, "c", "b"), (4, "d", "a"), (5, "d", "e"), (6, "c", "d"), (7, "x", "y"), (8, "b", ""), (9, "b", None)]
    names = spark.createDataFrame(asked, "pos long, name string, new_name string")
    want = {1: "renamed", 2: "renamed", 3: "taken", 4: "renamed", 5: "unknown", 6: "renamed", 7: "unknown", 8: "empty", 9: "empty"}
    assert {r.pos: r.outcome for r in mutate.rename_outcome(entity, names).collect()} == want
    assert sorted(tuple(r)[:2] for r in mutate.rename_entities(entity, names).collect()) == [(1, "b"), (2, "a"), (3, "d")]


def test_of_moves_onto_one_relation_the_first_is_done(spark):
    relation = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (3, 4, "a"), (5, 6, "c")], RELATION)
    kept, refused = mutate.change_relation_type(relation, relation, "c")
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 2, "b"), (1, 2, "c"), (3, 4, "c"), (5, 6, "c")]
    assert [tuple(r) for r in refused.collect()] == [(1, 2, "b")]
    asked = spark.createDataFrame([(1, 2, "a", 9), (1, 2, "b", 3)], f"{RELATION}, pos long")
    moves, refused = mutate.retype_moves(relation, asked, "c")
    assert [tuple(r) for r in refused.collect()] == [(1, 2, "a")]
    bodies = spark.createDataFrame([(1, 2, "a", 0, "x"), (1, 2, "b", 0, "y")], f"{RELATION}, idx int, body string")
    assert sorted(tuple(r) for r in mutate.apply_moves(bodies, moves).collect()) == [(1, 2, "a", 0, "x"), (1, 2, "c", 0, "y")]
