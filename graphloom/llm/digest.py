"""Improbable-feature digests and their likeness.

Every 64-byte window of a text has a Shannon entropy, quantised to ``LEVELS`` bins. Bins
are ranked by how rare they are over the windows of all documents; the rarest ranks
first. In each run of 64 neighbouring windows the leftmost rarest one scores a point, and
windows with ``POPULAR`` points are the features of the text: improbable windows that
stay the same when the text around them changes. Features go, in order, into a chain of
Bloom filters of 2,048 bits with at most 160 features each. Likeness of two digests is
the mean, over the filters of the shorter chain, of the best bit overlap with a filter of
the other, normalised between what chance explains (0) and identity (1).

Entropies come from integer sums: a window's sum of c log2 c changes by one table value
for the byte that leaves and one for the byte that enters, so all windows of a batch of
texts are one cumulative sum.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pieces, table
from graphloom.llm.shingles import mix

WINDOW = 64
LEVELS = 1000
#: Windows below this level (runs of one or two characters) are no features.
LOW = 100
POPULAR = 16
BITS, PER_FILTER, HASHES = 2048, 160, 5
CUT = 0.3
_BATCH_BYTES = 1 << 18
_U = np.uint64
_SCALE = 1 << 24
_F = np.array([0, *(round(_SCALE * c * np.log2(c)) for c in range(1, WINDOW + 1))], np.int64)
_GAIN = np.concatenate([[0], np.diff(_F)])
_TOP = int(_F[WINDOW])
_NONE = np.int64(1) << np.int64(20)
_MIX = np.random.default_rng(3).integers(1, 2**63, WINDOW // 8, dtype=np.uint64) * _U(2) + _U(1)


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level of each 64-byte window of ``data``."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for j in range(1, WINDOW):
        same = (data[j:] == data[:-j]).view(np.uint8)
        before[j:] += same
        after[:-j] += same
    change = np.empty(len(data) - WINDOW + 1, np.int64)
    change[0] = _GAIN[before[:WINDOW]].sum()
    change[1:] = _GAIN[before[WINDOW:]] - _GAIN[after[:-WINDOW]]
    return np.minimum((_TOP - np.cumsum(change)) * LEVELS // _TOP, LEVELS - 1)


def _batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for i, t in enumerate(texts):
        if i > low and size + len(t) > _BATCH_BYTES:
            yield low, i
            low, size = i, 0
        size += len(t)
    if low < len(texts):
        yield low, len(texts)


def _valid(begin: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which window starts lie, with their whole window, in one text."""
    edge = np.zeros(n + 1, np.int64)
    ok = size >= WINDOW
    np.add.at(edge, begin[ok], 1)
    np.add.at(edge, (begin + size - WINDOW + 1)[ok], -1)
    return np.cumsum(edge[:-1]) > 0


def level_counts(texts: list[bytes]) -> np.ndarray:
    total = np.zeros(LEVELS, np.int64)
    for low, high in _batches(texts):
        size = np.array([len(t) for t in texts[low:high]])
        found = levels(np.frombuffer(b"".join(texts[low:high]), np.uint8))
        if len(found):
            total += np.bincount(found[_valid(np.cumsum(size) - size, size, len(found))], minlength=LEVELS)
    return total


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, rarest first; levels too low to be features rank last."""
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    rank[:LOW] = _NONE
    return rank


def digest(texts: list[bytes], rank: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(features, filters as (k, 256) bytes) of each text; equal texts get equal digests."""
    out: list[tuple[int, np.ndarray]] = []
    for low, high in _batches(texts):
        part = texts[low:high]
        size = np.array([len(t) for t in part])
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(part), np.uint8)
        level = levels(data)
        n = len(level)
        at = np.zeros(0, np.int64)
        if n:
            valid = _valid(begin, size, n)
            key = np.full(n + WINDOW - 1, _NONE << np.int64(32))
            key[:n] = np.where(valid, rank[level], _NONE) << np.int64(32)
            key += np.arange(len(key))
            step = 1
            while step < WINDOW:
                key = np.minimum(key[:-step], key[step:])
                step *= 2
            best = key[valid & (key >> np.int64(32) < _NONE)] & np.int64(0xFFFFFFFF)
            points = np.bincount(best, minlength=n)
            # A text with fewer windows than a run of neighbours takes every winner.
            least = np.ones(n, np.int64) * POPULAR
            for b, s in zip(begin[(size >= WINDOW) & (size < 2 * WINDOW - 1)], size[(size >= WINDOW) & (size < 2 * WINDOW - 1)], strict=True):
                least[b : b + s - WINDOW + 1] = 1
            at = np.flatnonzero(points >= least)
        words = np.ascontiguousarray(data[at[:, None] + np.arange(WINDOW)]).view(np.uint64) if len(at) else np.zeros((0, 8), np.uint64)
        value = np.zeros(len(at), np.uint64)
        for k in range(WINDOW // 8):
            value = mix(value + words[:, k] * _MIX[k])
        cut = np.searchsorted(at, np.append(begin, len(data)))
        count = np.diff(cut)
        alone = np.flatnonzero((count == 0) & (size > 0))
        whole = np.array([int.from_bytes(hashlib.blake2b(part[i], digest_size=8).digest(), "little") for i in alone], np.uint64)
        owner = np.concatenate([np.repeat(np.arange(len(part)), count), alone])
        place = np.concatenate([np.arange(len(at)) - np.repeat(cut[:-1], count), np.zeros(len(alone), np.int64)])
        count[alone] = 1
        chain = -(-count // PER_FILTER)
        first = np.cumsum(chain) - chain
        bits = np.zeros((int(chain.sum()), BITS), bool)
        row = first[owner] + place // PER_FILTER
        value = np.concatenate([value, whole])
        for k in range(HASHES):
            bits[row, ((value >> _U(11 * k)) & _U(BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1)
        out += [(int(count[i]), packed[first[i] : first[i] + chain[i]]) for i in range(len(part))]
    return out


def to_text(d: tuple[int, np.ndarray]) -> str:
    """A digest as text: its number of features, a colon, its filters in base64."""
    return f"{d[0]}:{base64.b64encode(d[1].tobytes()).decode()}"


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Normalised bit overlap, 0 to 1; 1 for two empty digests, 0 if one is empty."""
    x, y = sorted((a[1], b[1]), key=len)
    if not len(x):
        return float(len(y) == 0)
    size_x, size_y = _POP[x].sum(1).astype(float), _POP[y].sum(1).astype(float)
    best = np.zeros(len(x))
    for low in range(0, len(y), 64):
        block, size = y[low : low + 64], size_y[low : low + 64]
        for i in range(len(x)):
            shared = _POP[x[i] & block].sum(1)
            most, chance = np.minimum(size_x[i], size), size_x[i] * size / BITS
            floor = chance + CUT * (most - chance)
            best[i] = max(best[i], ((shared - floor) / np.maximum(most - floor, 1e-9)).max())
    return round(float(np.clip(best, 0, 1).mean()), 6)


def corpus_rarity(docs: DataFrame) -> np.ndarray:
    """Rarity ranks from the entropy levels of all windows of all documents."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LEVELS, np.int64)
        for p in pieces(parts):
            total += level_counts([(t or "").encode("utf-8", "surrogatepass") for t in p["text"]])
        yield pd.DataFrame({"level": np.arange(LEVELS), "n": total})

    counts = np.zeros(LEVELS, np.int64)
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInPandas(rows, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r["level"]] = r["n"]
    return rarity(counts)


def _in_order(docs: DataFrame) -> DataFrame:
    """(bucket, donor, doc_id, text): rows in ranges of doc_id, each with the row that follows its last.

    A range's rows are sorted by descending doc_id; ``donor`` marks the copy of the
    first row of the range below (of the top range, for the lowest). Rows without an id
    come last, in ranges of the hash of their text.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * partitions
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    splits = [float("-inf"), *sorted({float(c) for c in cuts} | {0.5}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="__id", outputCol="__bucket", handleInvalid="keep").transform(docs.withColumn("__id", F.col("doc_id").cast("double")))
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    unnamed = -1 - F.least(F.floor((0.5 - mark / 2.0**64) * n), F.lit(n - 1))
    bucket = F.when(F.col("doc_id").isNull(), unnamed).otherwise(F.col("__bucket")).cast("int")
    ranged = ranged.select(bucket.alias("bucket"), F.lit(False).alias("donor"), "doc_id", mark.alias("mark"), "text")
    heads = sorted(ranged.groupBy("bucket").agg(F.max("doc_id").alias("head"), F.max("mark").alias("top")).collect())  # one row a range
    follow = [(heads[i]["bucket"], heads[i]["head"], heads[i]["top"], heads[(i + 1) % len(heads)]["bucket"]) for i in range(len(heads))]
    if not follow:
        return ranged.drop("mark")
    targets = spark.createDataFrame(follow, "bucket int, head long, top long, target int")
    first = F.col("doc_id").eqNullSafe(F.col("head")) & F.col("mark").eqNullSafe(F.col("top"))
    donors = ranged.join(F.broadcast(targets), "bucket").filter(first).select(F.col("target").alias("bucket"), F.lit(True).alias("donor"), "doc_id", "mark", "text")
    ordered = ranged.union(donors).repartition(partitions, "bucket").sortWithinPartitions("bucket", "donor", F.desc_nulls_last("doc_id"), F.desc("mark"), "text")
    return ordered.drop("mark")


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """Digests of each text and of its edited text, and their likeness to each other and to the next document.

    The next document is the one with the next smaller doc_id (after the smallest: the
    largest; null counts as smallest, and rows without an id follow each other by hash of
    text; rows with equal ids are ordered by text; a single row follows itself). The edited text replaces the last floor(n_chars / 2) code
    points by the first as many of the next document. A null text is empty; two empty
    digests are alike. ``rank``, as ``corpus_rarity`` gives it, keeps fingerprints the same
    from one table to another; without it the rows of ``docs`` are ranked. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rank = corpus_rarity(docs) if rank is None else rank

    def described(held: list[tuple[int, str | None, str]], last) -> tuple[list[tuple], tuple]:
        """Rows for all but the last held document; ``last`` is the digest of the first, if known."""
        raw = [t.encode("utf-8", "surrogatepass") for _, _, t in held]
        own = ([last] if last else []) + digest(raw[1 if last else 0 :], rank)
        edited = []
        for (_, _, text), (_, _, after) in zip(held, held[1:], strict=False):
            half = len(text) // 2
            edited.append((text[: len(text) - half] + after[:half]).encode("utf-8", "surrogatepass"))
        changed = digest(edited, rank)
        out = [
            (held[i][1], len(held[i][2]), hashlib.sha256(edited[i]).hexdigest(), to_text(own[i]), to_text(changed[i]), likeness(own[i], changed[i]), likeness(own[i], own[i + 1]))
            for i in range(len(edited))
        ]
        return out, own[-1]

    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, str | None, str]] = []
        last, size, closed = None, 0, None
        for p in pieces(parts):
            out = []
            for bucket, donor, doc, text in zip(p["bucket"], p["donor"], p["doc_id"], p["text"], strict=True):
                if closed == bucket:
                    continue  # further rows with the donor's id
                held.append((bucket, doc, text))
                size += len(text)
                if donor:
                    out += described(held, last)[0]
                    held, last, size, closed = [], None, 0, bucket
                elif size > _BATCH_BYTES:
                    found, last = described(held, last)
                    out += found
                    held, size = held[-1:], 0
            yield pd.DataFrame(out, columns=columns)

    # Ids travel as text: a null among numbers would turn them into floats.
    ordered = _in_order(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    found = ordered.mapInPandas(rows, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_digest(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
