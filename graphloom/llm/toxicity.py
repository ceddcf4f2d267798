"""Severity grades by cumulative-link ordinal regression on sparse text features.

Features are words and word beginnings of four and five letters, with log(1 + count).
One weight vector is shared by all ordered thresholds: P(grade >= k) =
logistic(w x - theta_k), and the expected severity is the sum of these over k.

The labels only say toxic or not. Grades are formed from them: 0 is not toxic; toxic
documents are 1 or 2, 2 if they have more indicative words (those with a feature that is
at least ``LIFT`` times as frequent in toxic documents) than the toxic median.

The model is fitted on a bounded sample of labelled documents, the first in hash order:
``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` others. Every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable, pieces, table, unused

TOXIC_ROWS, CLEAN_ROWS = 3000, 6000
FEATURES = 4096
LEAST_DOCS = 4
#: Standard errors by which a feature's frequency must differ between toxic and clean documents.
TELLING = 4.5
LIFT = 10.0
GRADES = 3
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings; a mark keeps the kinds apart."""
    return (word, "4" + word[:4], "5" + word[:5]) if len(word) > 3 else (word,)


def counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic): labelled documents within the stated bounds, each id and each text once.

    An id counts with its smallest text and its highest label, a text with its highest label.
    """
    marks = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    part = marks.filter("toxic > 0").orderBy(*order).limit(TOXIC_ROWS).union(marks.filter("toxic <= 0").orderBy(*order).limit(CLEAN_ROWS))
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = text.join(F.broadcast(part), "doc_id")  # at most TOXIC_ROWS + CLEAN_ROWS ids
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return durable(rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "labelled")


def _frequencies(sample: DataFrame) -> pd.DataFrame:
    """The most telling features and the toxic and clean documents that have them."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pieces(parts):
            seen = [Counter(), Counter()]
            for text, toxic in zip(p["text"], p["toxic"], strict=True):
                seen[toxic > 0].update({f for w in counts(text) for f in features(w)})
            yield pd.DataFrame([(f, seen[1][f], seen[0][f]) for f in seen[0].keys() | seen[1].keys()], columns=["feature", "toxic", "clean"])

    totals = sample.groupBy().agg(F.sum((F.col("toxic") > 0).cast("double")).alias("t"), F.sum((F.col("toxic") <= 0).cast("double")).alias("c")).first()
    t, c = max(totals["t"] or 0, 1.0), max(totals["c"] or 0, 1.0)
    both = sample.mapInPandas(rows, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = (F.col("toxic") + F.col("clean")) / (t + c)
    gap = F.abs(F.col("toxic") / t - F.col("clean") / c) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / t + 1 / c))
    both = both.filter((F.col("toxic") + F.col("clean") >= LEAST_DOCS) & (gap >= TELLING)).withColumn("lift", ((F.col("toxic") + 0.5) / t) / ((F.col("clean") + 0.5) / c))
    return both.orderBy(gap.desc(), "feature").limit(FEATURES).toPandas()


def _vector(words: Counter, index: dict[str, int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for word, n in words.items():
        for f in features(word):
            i = index.get(f)
            if i is not None:
                out[i] = out.get(i, 0) + n
    return dict(sorted(out.items()))


def _examples(sample: DataFrame, index: dict[str, int], telling: set[str]) -> pd.DataFrame:
    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pieces(parts):
            out = []
            for doc, text, toxic in zip(p["doc_id"], p["text"], p["toxic"], strict=True):
                words = counts(text)
                vector = _vector(words, index)
                hits = sum(n for w, n in words.items() if any(f in telling for f in features(w)))
                out.append((doc, int(toxic > 0), float(hits), list(vector), [float(np.log1p(n)) for n in vector.values()]))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "hits", "at", "value"])

    # In one order, so that sums of floats are the same at every run.
    return sample.mapInPandas(rows, "doc_id long, toxic int, hits double, at array<int>, value array<double>").toPandas().sort_values("doc_id")


def fit_cumulative_link(at: list[np.ndarray], value: list[np.ndarray], grade: np.ndarray, n_features: int, grades: int = GRADES, rounds: int = 400, decay: float = 3e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) of the proportional-odds model, by Adam on the full sample."""
    n = len(grade)
    row = np.repeat(np.arange(n), [len(a) for a in at])
    col = np.concatenate([np.asarray(a, np.int64) for a in at]) if n else np.zeros(0, np.int64)
    val = np.concatenate([np.asarray(v, float) for v in value]) if n else np.zeros(0)
    # Thresholds are a first one and logarithms of gaps, so that their order holds.
    params = np.zeros(n_features + grades - 1)
    params[n_features] = 1.0
    first, second = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, rounds + 1):
        w, raw = params[:n_features], params[n_features:]
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        z = np.bincount(row, w[col] * val, n)
        tail = sigmoid(z[:, None] - theta)
        full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
        chance = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))], 1)
        upper, lower = slope[np.arange(n), grade] / chance, slope[np.arange(n), grade + 1] / chance
        by_z = -(upper - lower) / n
        by_theta = np.zeros(grades + 1)
        np.add.at(by_theta, grade, upper / n)
        np.add.at(by_theta, grade + 1, -lower / n)
        by_theta = by_theta[1:-1]
        by_raw = np.cumsum(by_theta[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
        grad = np.concatenate([np.bincount(col, by_z[row] * val, n_features) + decay * w, by_raw])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        params = params - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    raw = params[n_features:]
    return params[:n_features], np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    """(weight by feature, thresholds); no thresholds if one of the two labels is missing."""
    sample = _sample(docs, labels)
    telling = _frequencies(sample)
    index = {f: i for i, f in enumerate(telling["feature"])}
    rows = _examples(sample, index, set(telling.loc[telling["lift"] >= LIFT, "feature"]))
    toxic = rows["toxic"].to_numpy() > 0
    if not toxic.any() or toxic.all():
        return {}, []
    hits = rows["hits"].to_numpy()
    grade = np.where(toxic, np.where(hits > np.median(hits[toxic]), 2, 1), 0)
    weights, theta = fit_cumulative_link(rows["at"].tolist(), rows["value"].tolist(), grade, len(index))
    return {f: float(weights[i]) for f, i in index.items()}, theta.tolist()


ADDED = ("__severity", "__p_toxic", "__toxic")


def severity(docs: DataFrame, model: tuple[dict[str, float], list[float]], added: Sequence[str] = ADDED) -> DataFrame:
    """``docs`` with ``__severity`` (expected grade), ``__p_toxic`` and ``__toxic``, or the names ``added``, added.

    Columns of ``docs`` with these names are replaced.

    Whole texts. A null or wordless text, or a model without thresholds, gives 0 and
    false. Every row is kept, repeated ones too, with all its columns; an empty table
    gives none.
    """
    weights, theta = model
    index = {f: i for i, f in enumerate(weights)}
    w = np.array(list(weights.values()))

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in pieces(texts):
            out = []
            for text in part:
                words = counts(text)
                vector = _vector(words, index)
                z = sum(w[i] * np.log1p(n) for i, n in vector.items())
                tail = [1 / (1 + np.exp(-np.clip(z - t, -40, 40))) for t in theta] if words else []
                out.append((float(sum(tail)), float(tail[0]) if tail else 0.0))
            yield pd.DataFrame(out, columns=["severity", "p_toxic"])

    [made] = unused(docs, "__scored")
    scored = docs.withColumn(made, F.pandas_udf(score, "severity double, p_toxic double")(F.col("text").cast("string")))
    new = [F.col(f"{made}.severity"), F.col(f"{made}.p_toxic"), F.col(f"{made}.p_toxic") >= 0.5]
    return scored.select(*[f"`{c}`" for c in docs.columns if c not in added], *[c.alias(n) for c, n in zip(new, added, strict=True)])


def op4_severity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = severity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.round("__severity", 6).alias("severity"), F.round("__p_toxic", 6).alias("p_toxic"), F.col("__toxic").alias("rejected"))
