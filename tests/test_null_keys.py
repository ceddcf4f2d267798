"""Rows with nulls in the keys of the log's operators stay, in a stated order."""

from graphloom.operators import changelog, mutate, vectors


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_revisions_of_events_without_time_entity_or_mark(spark):
    log = spark.createDataFrame([(1, 7, 0, "2024-01-01 00:00:00"), (2, 7, 0, None), (3, None, 0, "2024-01-01 00:00:00"), (4, None, 1, None), (5, 7, None, "2024-01-02 05:00:00"), (6, None, 0, "2024-01-01 09:00:00")], "event_id long, entity_id long, quiet int, t string").selectExpr("*", "CAST(t AS TIMESTAMP_NTZ) AS ts")
    got = changelog.event_revisions(log)
    assert rows(got, "event_id", "entity_revision") == [(1, 2), (2, 1), (3, 2), (4, 1), (5, 3), (6, 3)]
    assert set(got.columns) == {*log.columns, "entity_revision"}


def test_observations_without_place_come_first(spark):
    known = spark.createDataFrame([(1, 0, "old")], "entity_id long, idx int, body string")
    new = spark.createDataFrame([(1, 5, "b"), (1, None, "a"), (None, 1, "z"), (None, None, "y")], "entity_id long, pos long, body string")
    assert rows(mutate.add_observations(known, new), "entity_id", "idx", "body") == sorted([(1, 0, "old"), (1, 1, "a"), (1, 2, "b"), (None, 0, "y"), (None, 1, "z")], key=repr)


def test_requests_without_a_key_apply(spark):
    asked = spark.createDataFrame([(1, "p", "k", "f"), (2, "p", "k", "f"), (3, "p", "k", "g"), (4, "p", None, "f"), (5, "p", None, "f"), (6, None, "k", "f"), (7, None, "k", None), (8, None, "l", None), (9, None, "l", None)], "request_id long, principal string, key string, fingerprint string")
    assert rows(changelog.idempotency(asked), "request_id", "outcome") == [(1, "apply"), (2, "replay"), (3, "conflict"), (4, "apply"), (5, "apply"), (6, "apply"), (7, "conflict"), (8, "apply"), (9, "replay")]


def test_fan_out_of_disabled_and_open_subscriptions(spark):
    subs = [("off", None, None, None, None, 0), ("unsaid", None, None, None, None, None), ("all", None, None, None, None, 1), ("made", ["create"], [], None, None, 1), ("part", None, ["part", None], [None, "bot"], "me", 1), ("none", [None], ["part"], [], None, 1)]
    subs = spark.createDataFrame(subs, "subscription_id string, operations array<string>, types array<string>, ignored_origins array<string>, own_origin string, enabled int")
    events = spark.createDataFrame([(1, "create", "part", None), (2, "update", "part", "bot"), (3, "update", "part", "me"), (4, None, None, "x"), (5, "create", None, "x"), (6, "update", "part", "x")], "event_id long, operation string, entity_type string, origin string")
    want = [(i, "all") for i in range(1, 7)] + [(1, "made"), (5, "made"), (1, "part"), (6, "part")]
    assert rows(changelog.fan_out(events, subs), "event_id", "subscription_id") == sorted(want, key=repr)
    assert rows(changelog.fan_out(events, subs.drop("enabled")).filter("subscription_id IN ('off', 'unsaid')").groupBy("subscription_id").count(), "subscription_id", "count") == [("off", 6), ("unsaid", 6)]


def test_neighbours_without_broken_vectors(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "query_id long, q array<double>")
    assert rows(vectors.knn(chunks, asked, 5), "query_id", "vec_id") == [(7, 1), (7, 4)]
