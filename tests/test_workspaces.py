"""Updates of workspaces on a few records."""

import pytest

from graphloom.operators import access as W


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def t(spark):
    return {
        "w": spark.createDataFrame([("w1", "ann", "one", False), ("w2", "ann", "two", True), ("w3", "bob", "one", True)], "workspace_id string, owner string, name string, public boolean"),
        "g": spark.createDataFrame([("w1", "bob", "reader"), ("w2", "cat", "writer")], "workspace_id string, principal string, role string"),
        "d": spark.createDataFrame([("ann", "w2"), ("bob", "w1"), ("cat", "w2"), ("dan", "w2")], "principal string, workspace_id string"),
        "p": spark.createDataFrame([("ann",), ("bob",), ("cat",)], "principal string"),
    }


def test_grant(spark, t):
    asked = spark.createDataFrame([(1, "ann", "w1", "bob", "writer"), (2, "ann", "w1", "cat", "reader"), (3, "bob", "w1", "cat", "writer"), (4, "ann", "w1", "ann", "reader"), (5, "ann", "w1", "eve", "reader"), (6, "ann", "w1", "cat", "owner"), (7, None, None, None, None)], "request_id int, principal string, workspace_id string, grantee string, role string")
    after, report = W.grant(t["g"], asked, t["w"], t["p"])
    assert rows(after, "workspace_id", "principal", "role") == [("w1", "bob", "writer"), ("w1", "cat", "reader"), ("w2", "cat", "writer")]
    assert rows(report, "request_id") == [(3,), (4,), (5,), (6,), (7,)]


def test_revoke_takes_the_default_along(spark, t):
    asked = spark.createDataFrame([(1, "ann", "w1", "bob"), (2, "ann", "w2", "dan"), (3, "bob", "w2", "cat")], "request_id int, principal string, workspace_id string, grantee string")
    grants, defaults, report = W.revoke(t["g"], t["d"], asked, t["w"])
    assert rows(grants, "principal") == [("cat",)] and rows(defaults, "principal") == [("ann",), ("cat",), ("dan",)] and rows(report, "request_id") == [(3,)]


def test_visibility(spark, t):
    asked = spark.createDataFrame([(1, "ann", "w2", True), (2, "ann", "w2", False), (3, "ann", "w3", False)], "request_id int, principal string, workspace_id string, public boolean")
    after, defaults, report = W.set_visibility(t["w"], t["g"], t["d"], asked)
    assert rows(after, "workspace_id", "public") == [("w1", False), ("w2", False), ("w3", True)]
    assert rows(defaults, "principal") == [("ann",), ("bob",), ("cat",)] and rows(report, "request_id") == [(3,)]


def test_rename_and_create(spark, t):
    asked = spark.createDataFrame([(1, "ann", "w1", "two"), (2, "ann", "w2", " new "), (3, "bob", "w3", " ")], "request_id int, principal string, workspace_id string, name string")
    after, report = W.rename(t["w"], asked)
    assert rows(after, "workspace_id", "name") == [("w1", "one"), ("w2", "new"), ("w3", "one")] and rows(report, "request_id") == [(1,), (3,)]
    new = spark.createDataFrame([(1, "ann", "w4", "one", None), (2, "bob", "w5", "two", None), (3, "bob", "w6", "two", True), (4, "eve", "w7", "x", True)], "request_id int, principal string, workspace_id string, name string, public boolean")
    after, report = W.create_workspaces(t["w"], new, t["p"])
    assert rows(after, "workspace_id", "owner", "public")[3:] == [("w5", "bob", False)] and rows(report, "request_id") == [(1,), (3,), (4,)]


def test_default(spark, t):
    asked = spark.createDataFrame([(1, "bob", "w2"), (2, "dan", "w1"), (3, "cat", "w3"), (4, "cat", "w2")], "request_id int, principal string, workspace_id string")
    after, report = W.set_default(t["d"], asked, t["w"], t["g"])
    assert rows(after, "principal", "workspace_id") == [("ann", "w2"), ("bob", "w2"), ("cat", "w2"), ("dan", "w2")] and rows(report, "request_id") == [(2,)]
