"""Interval and trigram joins against brute force, and what their plans are."""

import random

from pyspark.sql import functions as F

from graphloom.functions.text import likeness
from graphloom.operators import joins, taxonomy


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_intervals_around_points(spark):
    rng = random.Random(5)
    spans = [(rng.randint(0, 2), lo := rng.randint(-300, 3000), lo + rng.choice([0, 1, 3, 4, 5, 63, 64, 65, 300, 5000]), f"i{i}") for i in range(300)]
    spans += [(0, -(10**12), 10**12, "all"), (1, 5, 4, "turned"), (1, None, 9, "open"), (None, 0, 9, "nowhere")]
    points = [(rng.choice([0, 0, 0, 1, 2]), i, rng.randint(-400, 8200)) for i in range(500)] + [(0, 900, None), (None, 901, 5)]
    p = spark.createDataFrame(points, "g int, k long, at long")
    i = spark.createDataFrame(spans, "g int, low long, high long, name string")
    got = sorted(tuple(r) for r in joins.smallest_around(p, i, ["g"], ["k"], "at", "low", "high", "name").collect())
    want = []
    for g, k, at in points:
        around = [(hi - lo, lo, n, hi) for s, lo, hi, n in spans if None not in (s, g, lo, hi, at) and s == g and lo <= at <= hi]
        if around:
            _, lo, n, hi = min(around)
            want.append((g, k, at, lo, hi, n))
    assert got == sorted(want) and len(want) > 500 * 0.5
    met = joins.containing(p, i, ["g"], "at", "low", "high")
    assert "NestedLoop" not in plan(met) and "Cartesian" not in plan(met)
    assert joins.containing(p, i.limit(0), ["g"], "at", "low", "high").count() == 0
    assert joins.containing(p, i.drop("g"), [], "at", "low", "high").filter("name = 'all'").count() == 501


def test_similar_names_by_trigrams(spark):
    rng = random.Random(6)
    names = ["".join(rng.choices("abcé ", k=rng.randint(0, 9))) for _ in range(90)] + ["customer", "Customer", "costumer", "customs", "aaaaaaaa", "aaa", "ab", "ba", "", None]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    a, b = df.select(F.col("x").alias("typed")), df.select(F.col("x").alias("name"))
    pairs = a.distinct().crossJoin(b.distinct()).filter(F.lower("typed") != F.lower("name"))
    want = {(r.typed, r.name, r.score) for r in pairs.withColumn("score", F.round(likeness(F.lower("typed"), F.lower("name")), 6)).filter("score > 0.35").collect()}
    got = taxonomy.alike(a, b)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 20
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
