"""The query language, positional postings and ranks, and the vector index, against plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import index
from graphloom.operators import ann, search, vectors
from graphloom.operators import fulltext as T


def starts(words, phrase, prefix=False):
    fits = lambda i: all(w == x or (prefix and j == len(phrase) - 1 and w.startswith(x)) for j, (w, x) in enumerate(zip(words[i:], phrase, strict=False)))
    return [i for i in range(len(words) - len(phrase) + 1) if fits(i)]


def near(words, phrases, apart):
    own = [starts(words, p) for p in phrases]
    return any(all(any(m - len(p) - apart <= s <= m for s in o) for p, o in zip(phrases, own, strict=True)) for o in own for m in o)


ASKED = {
    "alpha beta": lambda w: "alpha" in w and "beta" in w,
    '"alpha beta"': lambda w: starts(w, ["alpha", "beta"]),
    "ALPHA + béta": lambda w: starts(w, ["alpha", "beta"]),
    "al*": lambda w: any(x.startswith("al") for x in w),
    '"gamma al"*': lambda w: starts(w, ["gamma", "al"], True),
    "^gamma": lambda w: w[:1] == ["gamma"],
    "alpha OR beta gamma": lambda w: "alpha" in w or ("beta" in w and "gamma" in w),
    "alpha NOT beta OR delta": lambda w: ("alpha" in w and "beta" not in w) or "delta" in w,
    "alpha NOT beta gamma": lambda w: "alpha" in w and not ("beta" in w and "gamma" in w),
    "alpha AND (beta OR (gamma NOT delta))": lambda w: "alpha" in w and ("beta" in w or ("gamma" in w and "delta" not in w)),
    "NEAR(alpha beta, 1)": lambda w: near(w, [["alpha"], ["beta"]], 1),
    'NEAR("alpha beta" delta gamma, 4)': lambda w: near(w, [["alpha", "beta"], ["delta"], ["gamma"]], 4),
    "NEAR(alpha gamma)": lambda w: near(w, [["alpha"], ["gamma"]], 10),
    'alpha "..." beta': lambda w: "alpha" in w and "beta" in w,
    "near alpha": lambda w: "near" in w and "alpha" in w,
    "alpha-beta": None, "alpha AND": None, "(alpha": None, "alpha (beta)": None, '"open': None, "": None, "  ": None, "NOT alpha": None, "OR": None, "*": None, "NEAR()": None, "NEAR(alpha, x)": None, '"..."': None, "alpha AND \"...\"": None,
}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gámma", "delta", "alp", "x_y", "near"]
    bodies = [" ".join(rng.choices(words, [3, 3, 3, 1, 1, 1, 1], k=rng.randint(0, 14))) for _ in range(200)] + [None, "", "—", "delta " * 3000 + "alpha"]
    rows = [(i // 3, i % 3, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "id long, idx int, body string")
    fold = lambda b: re.findall(r"[^\W_]+", (b or "").lower().replace("á", "a"))
    return {(o, i): fold(b) for o, i, b in rows}, index(df, "id", "idx").repartitionByRange("token").sortWithinPartitions("token").persist()


def test_index_holds_places(texts):
    known, made = texts
    got = {(r.token, r.owner, r.idx): r for r in made.collect()}
    want = {(w, *key): [i for i, x in enumerate(words) if x == w] for key, words in known.items() for w in words}
    assert {k: list(r.positions) for k, r in got.items()} == want
    assert all(r.tf == len(r.positions) and r.n == len(known[r.owner, r.idx]) for r in got.values())


@pytest.mark.parametrize("query", list(ASKED))
def test_query_language(texts, query):
    known, made = texts
    test = ASKED[query]
    want = sorted(k for k, w in known.items() if test and test(w))
    assert sorted(tuple(r) for r in T.find(made, query).collect()) == want
    assert (test is None) == (not want)


def test_rank_counts_beginnings_and_phrases(texts):
    known, made = texts
    mean = sum(map(len, known.values())) / len(known)
    phrases = [(["alpha"], False), (["ga"], True), (["beta", "delta"], False)]
    tf = {k: [len(starts(w, *p)) for p in phrases] for k, w in known.items()}
    df = [sum(t[i] > 0 for t in tf.values()) for i in range(3)]
    idf = [max(math.log((len(known) - d + 0.5) / (d + 0.5)), 1e-6) for d in df]
    score = lambda k: -round(sum(w * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * len(known[k]) / mean)) for w, t in zip(idf, tf[k], strict=True)), 9)
    want = {k: score(k) for k, t in tf.items() if (t[0] and t[1]) or t[2]}
    got = {(r.owner, r.idx): r["rank"] for r in T.find_ranked(made, 'alpha ga* OR "beta delta"', (len(known), mean)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)
    both = search.match_index(made, ["alpha"], prefix="ga")
    ranks = {(r.owner, r.idx): r["rank"] for r in search.rank(made, both, (len(known), mean), ["alpha"], "ga").collect()}
    assert ranks.keys() == {k for k, t in tf.items() if t[0] and t[1]} and len(set(ranks.values())) > 5
    assert all(abs(ranks[k] + sum(w * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * len(known[k]) / mean)) for w, t in zip(idf[:2], tf[k][:2], strict=True))) < 2e-9 for k in ranks)


def test_phrase_without_texts(texts):
    known, made = texts
    got = sorted(tuple(r) for r in search.match_index(made, phrase=["alpha", "beta", "alpha"], none_of=["delta"]).collect())
    assert got == sorted(k for k, w in known.items() if starts(w, ["alpha", "beta", "alpha"]) and "delta" not in w)


def test_vector_index_recall_filters_and_broken_rows(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.9 * rng.normal(size=24)).tolist(), i % 5) for i in range(1500)]
    rows += [(9000 + i, [1.0] + [0.0] * 23, 1) for i in range(600)] + [(1, None, 1), (2, [None] * 24, 1), (3, [float("nan")] * 24, 1)]
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    made = ann.VectorIndex(chunks)
    assert made.rows.count() == 2100 and len(made.centres) == 46
    queries = chunks.filter("vec_id % 50 = 0 AND vec_id < 9000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    probes = made.probes_for(queries, 10)
    assert probes < 35
    exact, found = ({(r.query_id, r.vec_id): r.distance for r in df.collect()} for df in (vectors.knn(made.rows, queries, 10), made.search(queries, 10, probes)))
    assert len(found) == len(exact) == 300 and len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(found[k] == exact[k] for k in found.keys() & exact.keys())
    every = {(r.query_id, r.vec_id) for r in made.search(queries, 10, 46, F.col("label") == 3).collect()}
    assert every == {(r.query_id, r.vec_id) for r in vectors.knn(made.rows.filter("label = 3"), queries, 10).collect()}
    one = made.near(rows[7][1], 5, probes, F.col("label") == 2).collect()
    assert one[0].vec_id == 7 and all(r.label == 2 for r in one)
    assert ann.VectorIndex(chunks.limit(0)).search(queries, 3, 2).count() == 0


def test_vector_index_of_many_shards_with_empty_tasks(spark, monkeypatch):
    for name, value in (("SHARD", 100), ("QUERIES", 7), ("PACK", 64), ("QUERY_BLOCK", 5), ("KEPT", 50)):
        monkeypatch.setattr(ann, name, value, raising=False)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)] + [(1000 + i, [1.0] + [0.0] * 7) for i in range(300)]  # a cell that fills shards
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    durable = ann.durable
    monkeypatch.setattr(ann, "durable", lambda df, name: durable(df, name).limit(7).repartition(40) if name == "sample" else durable(df, name))
    made = ann.VectorIndex(chunks, 5)
    assert len(made.centres) == 5 and made.rows.select("shard").distinct().count() > 5
    queries = chunks.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got, want = ({tuple(r) for r in df.select("query_id", "vec_id", "distance").collect()} for df in (made.search(queries, 4, 5), vectors.knn(chunks, queries, 4)))
    assert got == want and len(got) == 4 * 45
    few = made.search(queries, 4, 1).join(made.rows.select("vec_id", "cell"), "vec_id").groupBy("query_id").agg(F.count_distinct("cell").alias("n"))
    assert few.count() == 45 and few.filter("n > 1").isEmpty()


def test_block_bounds_give_the_same_best_texts(spark, texts):
    from graphloom.operators import topk

    rng = random.Random(8)
    rows = [(i, 0, " ".join(rng.choices(["the", "of", "rare", "seldom", "common"], [90, 60, 1, 2, 30], k=rng.randint(1, 60)))) for i in range(1500)]
    rows += [(2000 + i, 0, "the the rare") for i in range(40)]  # ties
    made = index(spark.createDataFrame(rows, "id long, idx int, body string"), "id", "idx").persist()
    totals = search.index_totals(made, len(rows))
    stored = topk.blocks(made, totals).persist()
    assert stored.agg(F.sum("size")).first()[0] == made.count()
    for terms, k in ((["the", "rare"], 30), (["the"], 10), (["seldom", "rare", "of"], 25), (["absent"], 5), (["seldom"], 5000), ([], 3)):
        want = search.bm25_index(made, totals, terms).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "owner", "idx").limit(k).collect()
        best, read = topk.bm25_topk(stored, totals, terms, k)
        assert [tuple(r) for r in best.select("owner", "idx", "score").collect()] == [(r.owner, r.idx, r.score) for r in want], terms
        shares = {r.token: r.read / r["size"] for r in read.collect()}
        assert terms != ["the"] or shares["the"] < 0.25


def test_packed_blocks_give_the_same_best_texts(spark, monkeypatch):
    from graphloom.operators import topk
    from graphloom.plans import search as plans
    from graphloom.sources.derived import StoredGraph

    rng = random.Random(9)
    bodies = [" ".join(rng.choices(["The", "of", "rare", "seldom", "common"], [90, 60, 1, 2, 30], k=rng.randint(1, 60))) for _ in range(900)] + ["the the rare"] * 40 + [None, "", "- -"]
    texts = spark.createDataFrame(list(enumerate(bodies)), "id long, body string").withColumn("idx", F.lit(0)).repartition(3)
    made = index(texts, "id", "idx").persist()
    totals = search.index_totals(made, len(bodies))
    for part, slice_ in ((50, 512), (10_000, 24)):
        monkeypatch.setattr(topk, "PART", part)
        monkeypatch.setattr(topk, "SLICE", slice_)
        stored, named = topk.unpacked(topk.packed(texts, "id", "idx", len(bodies)).persist())
        assert stored.agg(F.sum("size")).first()[0] == made.count() and named.agg(F.sum("n")).first()[0] == made.agg(F.sum("tf")).first()[0]
        for terms, k in ((["the", "rare"], 30), (["seldom", "rare", "of"], 25), (["absent"], 5), (["seldom"], 5000), ([], 3)):
            want = search.bm25_index(made, totals, terms).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "owner", "idx").limit(k).collect()
            best, read = topk.bm25_topk(stored, totals, terms, k, texts=named)
            assert [tuple(r) for r in best.select("owner", "idx", "score").collect()] == [(r.owner, r.idx, r.score) for r in want], terms
            assert {r.token: r["size"] for r in read.collect()} == {r.token: r.n for r in made.filter(F.col("token").isin(terms)).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    g = StoredGraph(spark, "/root/testdata/sf0.001")
    assert plans.fts_bm25_blocks(g).count() == 20 and "word" not in g.__dict__
    assert g.block_totals == g.word_totals
