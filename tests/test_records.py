"""Leased jobs, records, machine accounts, type suggestions and code search on small tables."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import access as W
from graphloom.operators import code as K
from graphloom.operators import jobs as J
from graphloom.operators import subscriptions as P
from graphloom.operators import taxonomy as X

JOB = "k string, state string, next_attempt long, epoch long, lease_until long, attempts long, last_error string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_lease_that_ends_now_is_due_and_not_held(spark):
    jobs = spark.createDataFrame([("a", "leased", 0, 1, 10, 1, None), ("b", "leased", 0, 1, 11, 1, None), (None, "pending", 0, 1, 0, 0, None)], JOB)
    assert rows(J.claim(jobs, ["k"], 10, 5, 10), "k", "state", "epoch", "lease_until", "attempts") == sorted([("a", "leased", 2, 15, 2), ("b", "leased", 1, 11, 1), (None, "pending", 1, 0, 0)], key=repr)
    said = spark.createDataFrame([("a", 1), ("b", 1)], "k string, epoch long")
    assert rows(J.renew(jobs, said, ["k"], 10, 5), "k", "lease_until") == sorted([("a", 10), ("b", 15), (None, 0)], key=repr)


def test_old_epoch_does_not_retry_and_dead_owners_lose_chunks(spark):
    jobs = spark.createDataFrame([(k, "leased", 0, 2, 20, n, None) for k, n in (("a", 1), ("b", 1), ("c", 8), ("d", 1))], JOB)
    said = spark.createDataFrame([("a", 1, 30, "x", True), ("b", 2, 30, "y" * 3000, True), ("c", 2, 30, "z", False), ("d", 2, 30, None, None)], "k string, epoch long, next_attempt long, error string, dead boolean")
    out = J.retry(jobs, said, ["k"], 10, J.ATTEMPTS)
    assert rows(out, "k", "state", "next_attempt") == [("a", "leased", 0), ("b", "dead", 30), ("c", "dead", 30), ("d", "pending", 30)]
    assert len(out.filter("k = 'b'").first()["last_error"]) == J.ERROR_CHARS
    assert rows(J.without_dead(out.select("k"), out, ["k"]), "k") == [("a",), ("d",)]


def test_failed_stage(spark):
    attachments = spark.createDataFrame([(1, "extracting", None), (2, "extracting", None), (3, "ready", None)], "attachment_id long, status string, error_stage string")
    jobs = spark.createDataFrame([(1, "dead"), (2, "pending")], "attachment_id long, state string")
    failures = spark.createDataFrame([(1, "render"), (2, "decode")], "attachment_id long, stage string")
    assert rows(J.failed_stage(attachments, failures, jobs), "attachment_id", "status", "error_stage") == [(1, "error", "render"), (2, "extracting", "decode"), (3, "ready", None)]
    with pytest.raises(Exception, match="no such stage"):
        J.failed_stage(attachments, failures.withColumn("stage", F.lit("other")), jobs).collect()


def test_segments_run_on_over_pages(spark):
    pages = spark.createDataFrame([(1, 1, "abcd"), (1, 2, ""), (1, 3, "é" * 3), (1, 4, None), (2, 1, "lost")], "attachment_id long, page int, text string")
    stored = spark.createDataFrame([(1, 0, 1, 0, "old"), (3, 0, 1, 0, "kept")], "attachment_id long, chunk_index long, page int, segment_index long, text string")
    out = J.replace_segments(stored, pages, spark.createDataFrame([(1, 3)], "attachment_id long, revision long"), 2)
    assert rows(out, "attachment_id", "chunk_index", "page", "segment_index", "text") == [(1, 0, 1, 0, "ab"), (1, 1, 1, 1, "cd"), (1, 2, 3, 0, "éé"), (1, 3, 3, 1, "é"), (3, 0, 1, 0, "kept")]


def test_machines(spark):
    none = spark.createDataFrame([], "principal_id string, name string, scopes array<string>, token_digest string, revoked boolean")
    new = spark.createDataFrame([("machine:1", " a ", ["code", "code"], "t"), ("machine:2", " ", ["code"], "u"), ("machine:3", "c", ["admin"], "v"), ("machine:4", "d", [], "w"), ("machine:5", None, None, "x")], "principal_id string, name string, scopes array<string>, token string")
    machines, refused = W.add_machines(none, new)
    assert rows(W.list_machines(machines), "principal_id", "name", "scopes", "revoked") == [("machine:1", "a", ["code"], False)]
    assert rows(refused, "principal_id") == [(f"machine:{i}",) for i in (2, 3, 4, 5)]
    asked = spark.createDataFrame([(1, "t"), (2, ""), (3, None), (4, "T")], "request_id int, token string")
    assert rows(W.authenticated(asked, machines), "request_id") == [(1,)]
    grants = spark.createDataFrame([("w", "machine:1", "reader"), ("w", "ann", "reader")], "workspace_id string, principal string, role string")
    gone = spark.createDataFrame([("machine:1",), ("ann",)], "principal_id string")
    owners = spark.createDataFrame([("w", "bob")], "workspace_id string, owner string")
    after, left = W.revoke_machines(machines, owners, grants, gone)
    assert rows(after, "revoked") == [(True,)] and rows(left, "principal") == [("ann",)] and rows(W.authenticated(asked, after), "request_id") == []


def test_scope_of_unknown_tool(spark):
    calls = spark.createDataFrame([(1, "p", "read"), (2, "p", "other"), (3, "q", "read"), (4, None, None)], "call_id int, principal_id string, tool string")
    principals = spark.createDataFrame([("p", ["graph-read"])], "principal_id string, scopes array<string>")
    tools = spark.createDataFrame([("read", "graph-read")], "tool string, scope string")
    assert rows(W.allowed_calls(calls, principals, tools), "call_id", "allowed", "missing") == [(1, True, None), (2, False, None), (3, False, "graph-read"), (4, False, None)]


def test_plain_observations(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("[]",), (None,)], "raw string")
    assert rows(df.select(P.observations_out(P.observations_in(F.col("raw"))).alias("x")), "x") == sorted([(["a", "b"],), ([],), (None,)], key=repr)
    with pytest.raises(Exception, match="observations must be texts"):
        spark.createDataFrame([('["a", {"body": "b"}]',)], "raw string").select(P.observations_in(F.col("raw"))).collect()


def test_examples_are_capped_before_the_type_filter(spark):
    entity = spark.createDataFrame([(i, "part one", "other") for i in range(3)] + [(9, "part two", "part")], "id long, name string, entity_type string")
    observation = spark.createDataFrame([], "entity_id long, idx int, body string")
    similar = spark.createDataFrame([("parts", "part", 0.9, 1)], "typed string, name string, score double, place int")
    assert rows(X.example_entities(similar, entity, observation), "name") == []
    assert rows(X.example_entities(similar, entity.filter("id > 0"), observation), "name") == [("part two",)]


def test_code_search_caps_candidates_before_filters(spark):
    files = spark.createDataFrame([("a.py", bytearray(b"def f():\n    pass\n")), ("b.rb", bytearray(b"def f\nend\n")), ("c.py", None)], "path string, content binary")
    found = K.symbols(K.source_files(files))
    assert rows(K.search_symbols(found, ["f"]), "qualified", "lang") == [("a.py::f", "python"), ("b.rb::f", "ruby")]
    assert rows(K.search_symbols(found, ["f"], lang="ruby"), "qualified") == [("b.rb::f",)] and rows(K.search_symbols(found, ["f"], kind="class"), "qualified") == []
    _, errors = K.upsert_embeddings(spark.createDataFrame([], "symbol string, embedding array<double>"), spark.createDataFrame([(0, None, [1.0]), (1, "a", None), (2, "a", [1.0, 2.0]), (3, "a", [None])], "pos int, symbol string, embedding array<double>"), 1)
    assert rows(errors, "pos", "error") == [(0, "name"), (1, "missing"), (2, "length"), (3, "finite")]
