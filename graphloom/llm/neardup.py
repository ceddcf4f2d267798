"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

1. A document is its set of distinct word shingles. Equal sets form a class; all
   further work is on one representative (the smallest doc_id) of each class.
2. A class has a signature of ``HASHES`` MinHash symbols of b = 16 bits. Its
   positions are split into m chunks. By the pigeonhole principle two signatures
   that differ in at most r = 2m - 1 positions differ in at most one position of some
   chunk, so the chunks are indexed with every allowed error: one key for each left-out
   position. No pair with a distance up to r is missed, and no wider one is compared.
   r is so wide that a pair at the similarity threshold exceeds it with a chance of
   about one in a million.
3. Stars first: in the buckets of whole chunks, then in those with an error, each
   member is compared with the smallest one. Then the members of buckets that are still
   apart are compared in blocks of bounded size. All give edges, never all pairs.
4. Documents joined by such edges form coarse groups, in which links are confirmed on
   full shingle sets. Stars first again: each member against the smallest. Groups that
   this leaves in several parts, if they exceed a block, are split by a prefix filter: two sets above the
   threshold share one of their rarest shingles, rare within the group. What still
   stands together is compared in blocks, unlinked members with all others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import dealt, durable, pieces, table
from graphloom.llm.components import connected_components
from graphloom.llm.shingles import SPACES, mix, shingle_sets

HASHES = 64
#: Signatures, and full sets, in a block; two blocks meet in a task.
SIGNATURE_BLOCK = 1024
BLOCK = 256
BLOCK_SHINGLES = 400_000
_U = np.uint64
_RNG = np.random.default_rng(5)
_MUL = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64)


def plan(percent: int) -> tuple[int, int]:
    """(chunks m, guaranteed and compared distance r = 2m - 1) for a threshold in percent."""
    differ = 1 - percent / 100
    m = math.ceil((HASHES * differ + 5.2 * math.sqrt(HASHES * differ * (1 - differ)) + 1) / 2)
    return m, 2 * m - 1


def chunk_masks(m: int, errors: int) -> list[tuple[int, ...]]:
    """Positions of each index key: a chunk, or with one error a chunk without one of its positions."""
    chunks = np.array_split(np.arange(HASHES), m)
    return [tuple(c) for c in chunks] if not errors else [tuple(p for p in c if p != left) for c in chunks for left in c]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), HASHES) symbols of 16 bits; an empty set gives zeros."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        end, size = at, 0
        while end < len(full) and (end == at or size + len(sets[full[end]]) <= 1 << 15):
            size += len(sets[full[end]])
            end += 1
        part = [sets[i] for i in full[at:end]]
        x, begin = np.concatenate(part), np.cumsum([0] + [len(s) for s in part[:-1]])
        for k in range(HASHES):
            out[full[at:end], k] = mix(np.minimum.reduceat(x * _MUL[k] + _ADD[k], begin)) & _U(0xFFFF)
        at = end
    return out


def fingerprint_rows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) for each row of ``docs``."""

    def prints(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in pieces(parts):
            sets = list(shingle_sets(texts.tolist(), width, SPACES))
            yield pd.DataFrame({
                "n_shingles": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "sig": [x.tobytes() for x in signatures(sets)],
            })

    made = F.pandas_udf(prints, "n_shingles long, digest binary, sig binary")(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long"), made.alias("p")).select("doc_id", "p.*")


def _symbols(sig: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sig), np.uint16).reshape(-1, HASHES)


def _index_keys(reps: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """(key, rep, part): one row for each mask; ``part`` is the component known so far."""
    rng = np.random.default_rng(7)
    weights = np.zeros((HASHES, len(masks)), np.uint64)
    for v, positions in enumerate(masks):
        weights[list(positions), v] = rng.integers(1, 2**63, len(positions), dtype=np.uint64) * _U(2) + _U(1)
    seeds = rng.integers(1, 2**63, len(masks), dtype=np.uint64)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pieces(parts):
            sig = _symbols(p["sig"]).astype(np.uint64) + _U(1)
            keys = mix(sig @ weights + seeds)
            yield pd.DataFrame({"key": keys.ravel().view(np.int64), "rep": np.repeat(p["rep"].to_numpy(), len(masks)), "part": np.repeat(p["part"].to_numpy(), len(masks))})

    return reps.select("rep", "part", "sig").mapInPandas(rows, "key long, rep long, part long")


def _in_groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows with equal ``gid`` from batches sorted by it."""
    held: list[pd.DataFrame] = []
    for p in parts:
        if not len(p):
            continue
        g = p["gid"].to_numpy()
        last = int(np.searchsorted(g, g[-1]))
        if last:
            yield pd.concat([*held, p.iloc[:last]], ignore_index=True) if held else p.iloc[:last]
            held = []
        elif held and held[0]["gid"].iloc[0] != g[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(p.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _forest(near: np.ndarray) -> np.ndarray:
    """Edges (i, j) that span the components of a symmetric boolean matrix."""
    n, edges = len(near), []
    left = np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            edges += [(at, j) for j in new]
            front += new.tolist()
    return np.array(edges, np.int64).reshape(-1, 2)


def _met(rows: DataFrame, key: str, size: Column, most: int, most_size: int | None) -> DataFrame:
    """``rows`` (key, rep, alone, ...) dealt to pairs of blocks ``gid`` of their key, of ``most`` rows or a sum of ``most_size``.

    Rows that are ``alone`` meet all others of the key; the rest, which are joined already, meet only these.
    """

    def blocks(of: Column, name: str) -> Column:
        n = F.ceil(F.count(F.when(of, 1)) / most)
        return F.coalesce(n if most_size is None else F.greatest(n, F.ceil(F.sum(F.when(of, size)) / most_size)), F.lit(0)).cast("int").alias(name)

    sizes = rows.groupBy(key).agg(blocks(F.col("alone"), "n_alone"), blocks(~F.col("alone"), "n_linked"))
    # Blocks 0.. hold rows that are alone and meet all blocks; blocks from n_alone on hold the rest and meet the former.
    rows = dealt(rows.withColumnRenamed(key, "cell_"), sizes.withColumnRenamed(key, "cell_").hint("merge"), ["cell_"], ["rep"]).withColumnRenamed("cell_", key)
    own = F.when(F.col("alone"), F.pmod(F.xxhash64("rep"), F.col("n_alone"))).otherwise(F.col("n_alone") + F.pmod(F.xxhash64("rep"), F.col("n_linked"))).cast("int")
    last = F.when(F.col("alone"), F.col("n_alone") + F.col("n_linked")).otherwise(F.col("n_alone")) - 1
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return rows.withColumn("gid", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other", "n_alone", "n_linked")


def _grouped(df: DataFrame) -> DataFrame:
    return df.repartition("gid").sortWithinPartitions("gid", "rep")


def _buckets(keys: DataFrame) -> DataFrame:
    """(key, n, low, low_part): buckets of ``keys`` with members of different parts; of those with the same members only one."""
    made = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.min(F.struct("rep", "part")).alias("low"), F.min("part").alias("p"), F.max("part").alias("q"))
    return made.filter("p < q").groupBy("n", "x", "y", "low").agg(F.min("key").alias("key")).select("key", "n", F.col("low.rep").alias("low"), F.col("low.part").alias("low_part"))


def _star_edges(reps: DataFrame, masks: list[tuple[int, ...]], distance: int) -> DataFrame:
    """(a, b): members of each bucket of ``masks`` within ``distance`` of its smallest member, which is of another part."""
    keys = _index_keys(reps, masks)
    pairs = dealt(keys, durable(_buckets(keys), "buckets").hint("merge"), ["key"], ["rep"]).filter("part <> low_part").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    hubs = reps.join(pairs.select(F.col("b").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    pairs = dealt(pairs.join(reps.select(F.col("rep").alias("a"), "sig").hint("merge"), "a"), hubs.hint("merge"), ["b"], ["a"])

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.loc[(_symbols(p["sig"]) != _symbols(p["sig_b"])).sum(1) <= distance, ["a", "b"]]

    return pairs.mapInPandas(rows, "a long, b long").distinct()


def _close_pairs(reps: DataFrame, masks: list[tuple[int, ...]], distance: int) -> DataFrame:
    """(a, b): for each bucket of the keys of ``masks``, edges by signature distance between different parts.

    Pairs of small buckets, a forest of larger ones. Members that the stars have joined
    with the smallest one needn't meet each other; any two of a bucket, of which one is
    not among these, meet in one ``gid`` at least.
    """
    keys = _index_keys(reps, masks)
    buckets = durable(_buckets(keys), "buckets")
    members = dealt(keys, buckets.hint("merge"), ["key"], ["rep"]).select("key", "rep", "part", (F.col("part") != F.col("low_part")).alias("alone"))
    members = _met(durable(members, "members"), "key", F.lit(1), SIGNATURE_BLOCK, None).join(reps.select("rep", "sig").hint("merge"), "rep")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _in_groups(parts):
            gid, rep, part, sig = p["gid"].to_numpy(), p["rep"].to_numpy(), p["part"].to_numpy(), _symbols(p["sig"])
            begin = np.flatnonzero(np.diff(gid, prepend=gid[0] - 1))
            sizes = np.diff(np.append(begin, len(gid)))
            found = []
            for s in range(2, 6):
                at = begin[sizes == s]
                for i in range(s - 1):
                    for j in range(i + 1, s):
                        ok = at[(sig[at + i] != sig[at + j]).sum(1) <= distance]
                        found.append(np.stack([ok + i, ok + j], 1))
            for at, s in zip(begin[sizes > 5], sizes[sizes > 5], strict=True):
                block = sig[at : at + s]
                far = np.zeros((s, s), np.uint8)
                for k in range(HASHES):
                    far += block[:, k, None] != block[None, :, k]
                own = part[at : at + s]
                found.append(_forest((far <= distance) | (own[:, None] == own[None, :])) + at)
            edges = np.concatenate(found)
            edges = edges[part[edges[:, 0]] != part[edges[:, 1]]]
            yield pd.DataFrame({"a": rep[edges[:, 0]], "b": rep[edges[:, 1]]})

    return _grouped(members.select("gid", "rep", "part", "sig")).mapInPandas(rows, "a long, b long").distinct()


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes, by products of presence matrices over slices of the vocabulary."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    words = np.concatenate(sets)
    order = np.argsort(words, kind="stable")
    words, owner = words[order], owner[order]
    column = np.cumsum(np.diff(words, prepend=words[:1]) != 0) if len(words) else np.zeros(0, np.int64)
    out = np.zeros((n, n), np.float64)
    slice_ = 2048
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, slice_):
        i, j = np.searchsorted(column, [low, low + slice_])
        present = np.zeros((n, slice_), np.float32)
        present[owner[i:j], column[i:j] - low] = 1
        out += present @ present.T
    return out.astype(np.int64)


def _confirmed(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of the pairs of each block whose full sets pass the threshold."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _in_groups(parts):
            rep, gid = p["rep"].to_numpy(), p["gid"].to_numpy()
            sets = [np.asarray(x, np.int64) for x in p["shingles"]]
            size = np.array([len(s) for s in sets], np.int64)
            begin = np.append(np.flatnonzero(np.diff(gid, prepend=gid[0] - 1)), len(gid))
            found = [np.zeros((0, 2), np.int64)]
            for i, j in zip(begin[:-1], begin[1:], strict=True):
                if j - i > 1:
                    both = _shared(sets[i:j])
                    union = size[i:j, None] + size[None, i:j] - both
                    found.append(_forest((100 * both >= percent * union) & (both > 0)) + i)
            edges = np.concatenate(found)
            yield pd.DataFrame({"a": rep[edges[:, 0]], "b": rep[edges[:, 1]]})

    return _grouped(members.select("gid", "rep", "shingles")).mapInPandas(rows, "a long, b long")


def _set_rows(docs: DataFrame, width: int) -> DataFrame:
    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pieces(parts):
            sets = shingle_sets(p["text"].tolist(), width, SPACES)
            yield pd.DataFrame({"rep": p["rep"], "grp": p["grp"], "shingles": [s.view(np.int64) for s in sets]})

    return docs.mapInPandas(rows, "rep long, grp long, shingles array<long>")


def _candidate_cells(sets: DataFrame, percent: int) -> DataFrame:
    """(part, cell): parts of a group that share a prefix shingle, directly or over others.

    A set of n shingles has a prefix of n - ceil(t n) + 1: those in one part only first,
    then the rarest of the group. Two sets above the threshold share one of them.
    """
    words = sets.select("grp", "rep", "part", "sid", "n", F.explode("shingles").alias("word"))
    known = words.groupBy("grp", "word").agg(F.count(F.lit(1)).alias("often"), F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("grp", "word", "often")
    ranked = dealt(words, known.hint("merge"), ["grp", "word"], ["rep"], "left").withColumn("at", F.row_number().over(Window.partitionBy("rep", "sid").orderBy(F.asc_nulls_first("often"), "word")))
    prefix = ranked.filter((F.col("at") <= F.col("n") - F.ceil(percent * F.col("n") / 100) + 1) & F.col("often").isNotNull()).select("grp", "word", "part").distinct()
    prefix = durable(prefix, "prefix")
    edges = dealt(prefix, prefix.groupBy("grp", "word").agg(F.min("part").alias("low")).hint("merge"), ["grp", "word"], ["part"])
    return connected_components(edges, "part", "low").select(F.col("node").alias("part"), F.col("component").alias("cell"))


def _links(docs: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links that span the components of each group (rep, grp) under the threshold on full sets.

    Sets are named by (rep, sid); what is compared with what is settled without the sets.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(groups, "rep").distinct()
    sets = durable(_set_rows(texts, width).withColumns({"sid": F.xxhash64("shingles"), "n": F.size("shingles")}), "sets")
    hubs = sets.filter("rep = grp").select("grp", F.col("shingles").alias("hub"), F.col("n").alias("hub_n"))
    compared = dealt(sets.filter("rep <> grp"), hubs.hint("merge"), ["grp"], ["rep"]).select("rep", "grp", (F.col("n") + F.col("hub_n")).alias("all"), F.size(F.array_intersect("shingles", "hub")).alias("both"))
    star = durable(compared.filter(f"both > 0 AND 100 * both >= {percent} * (all - both)").select(F.col("rep").alias("a"), F.col("grp").alias("b")).distinct(), "star")
    parts = groups.join(star.select(F.col("a").alias("rep"), "b").hint("merge"), "rep", "left").select("rep", "grp", F.when(F.col("rep") == F.col("grp"), F.col("grp")).otherwise(F.coalesce("b", "rep")).alias("part"))
    parts = durable(parts, "parts")
    split = parts.filter("part <> grp").select("grp").distinct()
    if split.isEmpty():
        return star
    rest = dealt(sets.select("rep", "grp", "sid", "n"), split.hint("merge"), ["grp"], ["rep"], "left_semi").join(parts.select("rep", "part").hint("merge"), "rep")
    fits = rest.groupBy("grp").agg(((F.count(F.lit(1)) <= BLOCK) & (F.sum("n") <= BLOCK_SHINGLES)).alias("fits"))
    rest = durable(dealt(rest, fits.hint("merge"), ["grp"], ["rep"]), "rest")
    # A group of one block is compared as it is; larger ones are split first.
    cells, large = rest.filter("fits").withColumn("cell", F.col("grp")), rest.filter("NOT fits")
    if not large.isEmpty():
        whole = large.join(sets.select("rep", "sid", "shingles"), ["rep", "sid"])
        cells = cells.unionByName(dealt(large, _candidate_cells(whole, percent).hint("merge"), ["part"], ["rep"]))
    cells = durable(cells.withColumn("alone", F.col("fits") | (F.col("part") != F.col("grp"))), "cells")
    placed = _met(cells, "cell", F.col("n"), BLOCK, BLOCK_SHINGLES)
    return star.union(_confirmed(placed.select("rep", "sid", "gid").join(sets.select("rep", "sid", "shingles"), ["rep", "sid"]), percent))


def near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Links documents whose sets of ``width``-word shingles pass
    100 * intersection >= percent * union; ``component_id`` is the smallest doc_id
    reachable over links. A null or blank text has an empty set and no link. Rows
    with the same doc_id are one document: what links to one of them links to all.
    A null doc_id is linked with nothing and has a null component. Other columns
    are ignored; an empty table gives no rows.
    """
    m, distance = plan(percent)
    prints = durable(fingerprint_rows(docs, width), "prints")
    classes = prints.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = durable(classes, "classes")
    rows = prints.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "n_shingles", "rep").hint("merge"), ["digest", "n_shingles"], "left")
    rows = durable(rows.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "rows")
    # A document with several texts links their classes.
    several = rows.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("c")).filter("b < c").select("doc_id", "b")
    own = rows.join(several, "doc_id").select(F.col("rep").alias("a"), "b").distinct()

    reps = classes.select("rep", F.col("rep").alias("part"), "sig")
    edges = None
    for errors in (0, 1):
        stars = durable(_star_edges(reps, chunk_masks(m, errors), distance), "stars")
        edges = stars if edges is None else edges.union(stars)
        parts = connected_components(edges, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("found"))
        reps = durable(reps.drop("part").join(parts.hint("merge"), "rep", "left").select("rep", F.coalesce("found", "rep").alias("part"), "sig"), "reps")
    coarse = connected_components(_close_pairs(reps, chunk_masks(m, 1), distance).union(edges), "a", "b")
    groups = durable(coarse.select(F.col("node").alias("rep"), F.col("component").alias("grp")), "groups")
    links = _links(docs, groups, width, percent)
    linked = connected_components(links.union(own), "a", "b").select(F.col("node").alias("rep"), "component")
    found = rows.join(linked.hint("merge"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP5_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 2 THEN [array_to_string(w, ' ')]
    WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [] END) AS shingle FROM words),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS low FROM n UNION SELECT y, low FROM reach JOIN ends ON x = node WHERE low < y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(low) AS low FROM reach GROUP BY node) r ON node = d.doc_id"""
