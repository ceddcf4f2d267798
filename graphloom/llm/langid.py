"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of character n-grams,
n = 1 to 3, that both contain, divided by the geometric mean of the numbers each
contains. Landmarks span a Nystroem approximation of its feature space, in which
one-versus-rest kernel ridge regression has a closed form. Texts are scored in batches:
presence matrix times landmark matrix gives kernel values, these times one matrix of
(Nystroem map x ridge coefficients) the scores of all languages.

Characters are lower-cased, and white space is a blank. An n-gram is coded by its code
points, 21 bits each, so different n-grams have different codes in any script.

Fitting uses at most ``SAMPLE`` labelled documents, the first of each language in hash
order in equal shares, of which ``LANDMARKS`` are landmarks; of more languages than
``SAMPLE`` the first in alphabetical order are learned. All documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, pieces, table, unused

SAMPLE = 1600
LANDMARKS = 96
RIDGE = 1e-3
ORDERS = 3
_POINT = 21
#: Entries of the table by which distinct n-grams are found; texts with too many different characters are sorted.
_TABLE = 1 << 22
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.int64)


class Grams:
    """Distinct n-grams of texts; the tables are reused, and only what was used is cleared."""

    def __init__(self):
        self.last, self.symbol = np.zeros(_TABLE, np.int32), np.zeros(0x110000, np.int32)
        self.blank = np.arange(0x110000)
        self.blank[_SPACES] = 32

    def of(self, text: str) -> np.ndarray:
        """Codes of the distinct n-grams of ``text``, for each n from 1 on; longer ones have higher codes."""
        points = self.blank[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not len(points):
            return np.zeros(0, np.int64)
        self.symbol[points] = np.arange(len(points))
        known = points[self.symbol[points] == np.arange(len(points))]
        self.symbol[known] = np.arange(len(known))
        symbols, base = self.symbol[points].astype(np.int64), len(known)
        code, out = symbols, []
        for n in range(ORDERS):
            if n:
                if len(symbols) <= n:
                    break
                code = code[:-1] * base + symbols[n:]
            if base ** (n + 1) <= _TABLE:
                place = np.arange(len(code), dtype=np.int32)
                self.last[code] = place
                distinct = code[self.last[code] == place]
            else:
                distinct = np.unique(code)
            full = np.zeros(len(distinct), np.int64)
            for k in range(n, -1, -1):
                full = (full << _POINT) | (known[distinct // base**k % base] + 1)
            out.append(full)
        return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _sample(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(doc_id, lang, text): the first documents of each language in hash order; of rows with one id the smallest."""
    ids = docs.select(F.col("doc_id").cast("long"), F.col(lang).cast("string").alias("lang")).filter("doc_id IS NOT NULL AND lang IS NOT NULL").withColumn("order", F.xxhash64("doc_id"))
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # The share of hash values that holds about twice what is wanted of each language.
    early = (F.col("order") / 2.0**64 + 0.5) * F.col("n") < 2 * SAMPLE
    near = ids.join(counts, "lang").filter(early).select("doc_id", "lang", "order").distinct()
    first = near.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id")))
    ids = durable(first.orderBy("at", "lang").limit(SAMPLE).select("doc_id", "lang"), "sample")
    texts = docs.select(F.col("doc_id").cast("long"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = texts.join(F.broadcast(ids), ["doc_id", "lang"]).filter("text IS NOT NULL")  # SAMPLE ids
    return durable(rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text"), "texts")


def _columns(vocabulary: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places in the sorted ``vocabulary`` of those of ``grams`` that it holds."""
    at = np.searchsorted(vocabulary, grams)
    at[at == len(vocabulary)] = 0
    return at[vocabulary[at] == grams]


def _kernel(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / np.sqrt(np.maximum(size_a, 1)[:, None] * np.maximum(size_b, 1)[None, :])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict | None:
    """Model from the rows of ``docs``; None if no row has an id, a text and a language."""
    sample = _sample(docs, text, lang)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for p in pieces(parts):
            yield pd.DataFrame({"doc_id": p["doc_id"], "lang": p["lang"], "grams": [np.sort(grams.of(t)) for t in p["text"]]})

    got = sample.mapInPandas(rows, "doc_id long, lang string, grams array<long>").toPandas().sort_values("doc_id")
    if not len(got):
        return None
    langs = sorted(got["lang"].unique())
    y = np.where(got["lang"].to_numpy()[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    grams = [np.asarray(g, np.int64) for g in got["grams"]]
    size = np.array([len(g) for g in grams], np.float32)
    # Landmarks in equal shares of the languages, the same at every run.
    rank = got.groupby("lang").cumcount().to_numpy()
    marks = np.lexsort((got["lang"].to_numpy(), rank))[:LANDMARKS]
    vocabulary = np.unique(np.concatenate([grams[i] for i in marks]))
    present = np.zeros((len(grams), len(vocabulary)), np.float32)
    for i, g in enumerate(grams):
        present[i, _columns(vocabulary, g)] = 1
    inner = _kernel(present[marks], size[marks], present[marks], size[marks]).astype(float)
    value, vector = np.linalg.eigh(inner)
    keep = value > 1e-6 * value[-1]
    nystroem = vector[:, keep] / np.sqrt(value[keep])
    phi = _kernel(present, size, present[marks], size[marks]).astype(float) @ nystroem
    phi = np.concatenate([phi, np.ones((len(phi), 1))], 1)
    # One-versus-rest with rows weighted so that each language counts alike.
    weight = 1 / np.array([(got["lang"] == x).sum() for x in langs])[np.searchsorted(langs, got["lang"].to_numpy())]
    gram = phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1])
    coefficient = np.linalg.solve(gram, phi.T @ (y * weight[:, None]))
    return {"langs": langs, "vocabulary": vocabulary, "landmarks": present[marks].astype(np.uint8), "sizes": size[marks], "map": (nystroem @ coefficient[:-1]).astype(np.float32), "base": coefficient[-1].astype(np.float32)}


_BATCH = 64


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        self.grams = Grams()
        self.landmarks = (model["landmarks"] / np.sqrt(np.maximum(model["sizes"], 1))[:, None]).astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        present = np.zeros((len(texts), self.landmarks.shape[1]), np.float32)
        size = np.ones(len(texts), np.float32)
        for i, t in enumerate(texts):
            g = self.grams.of(t)
            present[i, _columns(self.model["vocabulary"], g)] = 1
            size[i] = max(1, len(g))
        kernel = (present @ self.landmarks.T) / np.sqrt(size)[:, None]
        return kernel @ self.model["map"] + self.model["base"]


def predict(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` with ``__lang`` and ``__score`` (0 to 1, a softmax of the regression values) added.

    A null text or one without a letter gives ``und`` and 0, as does a missing model;
    equal texts get equal results, ties go to the first language in alphabetical order.
    Every row and column is kept; columns with the two names are replaced.
    """
    data = docs.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(data.value) if data.value else None
        for part in pieces(parts):
            texts = part.tolist()
            lang, best = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if has_letter(t)] if scorer else []
            for low in range(0, len(known), _BATCH):
                at = known[low : low + _BATCH]
                raw = 4 * scorer.scores([texts[i] for i in at]).astype(float)
                share = np.exp(raw - raw.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                for i, k, s in zip(at, raw.argmax(1), share, strict=True):
                    lang[i], best[i] = scorer.model["langs"][k], round(float(s[k]), 6)
            yield pd.DataFrame({"lang": lang, "score": best})

    [made] = unused(docs, "__found")
    scored = docs.withColumn(made, F.pandas_udf(score, "lang string, score double")(F.col(text).cast("string")))
    return scored.select(*[f"`{c}`" for c in docs.columns if c not in ("__lang", "__score")], F.col(f"{made}.lang").alias("__lang"), F.col(f"{made}.score").alias("__score"))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
