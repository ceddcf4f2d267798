"""K-d shards, collocations and hard negatives against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import collocations as C
from graphloom.llm import kdshards as K
from graphloom.llm import negatives as N

DOCS = "doc_id long, text string, lang string, source string, shard long, slot string, rank int, a long, score double"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) beside columns whose names clash."""
    return spark.createDataFrame([(*r, 7, "x", 1, 2, 0.5) for r in rows], DOCS)


def brute_shards(rows, shards):
    """Shard of each row (doc_id, text, lang, source) with distinct ids: sort and cut, node by node."""
    crc = lambda x: -1 if x is None else zlib.crc32(x.encode())
    size = lambda r: len((r[1] or "").encode()) + 1
    dims = lambda r: (crc(r[3]), crc(r[2]), size(r) - 1, r[0])
    spans = [max(dims(r)[i] for r in rows) - min(dims(r)[i] for r in rows) or 1 for i in range(4)]
    out = {}

    def cut(part, k, first):
        if k == 1 or not part:
            out.update((r[0], first) for r in part)
            return
        wide = [(max(dims(r)[i] for r in part) - min(dims(r)[i] for r in part)) / spans[i] for i in range(4)]
        axis = wide.index(max(wide))
        part = sorted(part, key=lambda r: (dims(r)[axis], r[0]))
        target, at, n = sum(map(size, part)) * (k // 2) // k, 0, 0
        while at + size(part[n]) < target:
            at += size(part[n])
            n += 1
        n += 2 * (target - at) >= size(part[n])
        cut(part[:n], k // 2, first)
        cut(part[n:], k - k // 2, first + k // 2)

    cut(rows, shards, 0)
    return out


def documents(n, rng):
    sources = ["hot"] * 10 + [f"s{i}" for i in range(9)] + [None]
    return [(rng.choice([i, i * 7919 - 10**12, i + 2**61]) if i % 5 else i, "é" * rng.choice([0, 1, 30, 2000]) + "x" * rng.randint(0, 300) if i % 11 else None, rng.choice(["en", "de", None]), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("shards", [16, 5])
def test_shards_by_brute_force(spark, shards):
    rows = documents(900, random.Random(shards))
    rows = list({r[0]: r for r in rows}.values())
    got = K.shard_documents(frame(spark, rows), shards).collect()
    assert {r.doc_id: r.shard_ for r in got} == brute_shards(rows, shards)
    assert len(got) == len(rows) and all(r.shard == 7 and r.slot == "x" for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard_].append((r.slot_, r.doc_id, len((r.text or "").encode()) + 1))
    for part in by.values():
        assert [s for s, _, _ in sorted(part)] == list(range(len(part))) and [d for _, d, _ in sorted(part)] == sorted(d for _, d, _ in part)
    sizes = [sum(x[2] for x in p) for p in by.values()]
    assert max(sizes) - min(sizes) <= 4 * 4301


def test_shards_of_equal_rows_few_rows_and_none(spark):
    same = [(5, "copy", "en", "hot")] * 400 + [(None, None, None, None)] * 80
    got = K.shard_documents(frame(spark, same), 16).collect()
    n = Counter(r.shard_ for r in got)
    assert len(got) == 480 and set(n) == set(range(16))
    sizes = Counter()
    for r in got:
        sizes[r.shard_] += 5 if r.text else 1
    assert max(sizes.values()) - min(sizes.values()) <= 20
    few = K.shard_documents(frame(spark, [(1, "a", "en", "s"), (2, "b", "en", "s")]), 16).collect()
    assert len({r.shard_ for r in few}) == 2 and all(r.slot_ == 0 for r in few)
    assert K.shard_documents(spark.createDataFrame([], DOCS), 16).count() == 0


def test_target_bytes_and_files(spark, tmp_path):
    docs = frame(spark, documents(300, random.Random(9)))
    total = sum(len((r.text or "").encode()) + 1 for r in docs.collect())
    out = K.shard_documents(docs, None, total // 7)
    assert {r.shard_ for r in out.select("shard_").distinct().collect()} == set(range(7))
    K.write_shards(docs, str(tmp_path / "shards"), shards=4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 300 and sorted(p.name for p in (tmp_path / "shards").iterdir() if p.is_dir()) == [f"shard_={i}" for i in range(4)]


def brute_collocations(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, _ in rows:
        text = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(zip(*[w[i:] for i in range(k)], strict=False))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cand.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if 2 <= j - i < len(p):
                    inside[p[i:j]] = max(inside[p[i:j]], a)
        left = []
        for p, a in cand.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, left_n, right_n = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), left_n, right_n))
        for i, (s, a, p, x, y) in enumerate(sorted(left)[:top]):
            out.append((lang, i + 1, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def chatter(rng):
    words = ["the", "The", "of", "a.", "b,", "ÉTÉ", "日本", "z!z", "new\tyork", "new york city", "x y", "\n", "in the end of it"]
    rows = [(i, " ".join(rng.choices(words, [9, 3, 6, 2, 2, 3, 2, 1, 4, 4, 1, 2, 3], k=rng.randint(0, 60))), rng.choice(["en", "de", None, "und"]), "s") for i in range(260)]
    return [*rows, *[(900, "same words said again and again", "en", "s")] * 35, (901, None, "en", "s"), (902, "", None, None), (903, "far " * 90_000 + "away", "de", "s"), (None, "\x0b,;", "fr", "s")]


@pytest.mark.parametrize(("least", "top", "block"), [(30, 2000, None), (8, 12, 40)])
def test_collocations_by_brute_force(spark, monkeypatch, least, top, block):
    if block:  # several perfect hashes of a length
        monkeypatch.setattr(C, "BLOCK", block)
    rows = chatter(random.Random(least))
    got = C.collocations(frame(spark, rows), least, 4, top).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute_collocations(rows, least, top)
    assert len(got) > 20


def test_no_collocations(spark):
    assert C.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert C.collocations(frame(spark, [(1, None, None, None), (2, "one two", "en", "s")])).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64 - 1, 50_000, dtype=np.uint64))
    p = C.PerfectHash(keys)
    assert sorted(p.find(keys).tolist()) == list(range(len(keys)))
    assert (p.find(keys ^ np.uint64(1 << 40)) == -1).mean() > 0.99
    assert (C.PerfectHash(keys[:0]).find(keys[:9]) == -1).all()


def brute_negatives(rows):
    rows = sorted({(i, lb, tuple(int(np.floor(256 * float(np.float32(c)))) for c in x)) for i, lb, x in rows if i is not None and lb is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)})
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=False))
    out = []
    for i, lb, x in rows:
        if i % 100:
            continue
        scored = sorted((-dot(x, y), j, m) for j, m, y in rows)
        for s, j, m in [t for t in scored if t[2] == lb and t[1] != i][:5]:
            hard = [t for t in scored if t[2] != lb and 30 * -s <= 100 * -t[0] <= 90 * -s][:10]
            out += [(i, j, r + 1, h[1], -s, -h[0]) for r, h in enumerate(hard)]
    return sorted(out)


VECTORS = "id long, label int, x array<float>, d string, cell string, score int"


def vector_rows(rng, n=700, dims=8):
    one = [rng.gauss(0, 0.4) for _ in range(dims)]
    rows = [(i, rng.randint(0, 3), one if i % 3 == 0 else [rng.gauss(0, 0.4) for _ in range(dims)]) for i in range(n)]
    rows += [(None, 1, one), (-100, 1, one), (-100, 1, one), (5000, None, one), (5001, 1, None), (5002, 1, [None] * dims), (5003, 1, [float("nan")] * dims), (5100, 2, one[:3]), (5200, 9, one), (5300, 2, [])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_negatives_by_brute_force(spark, monkeypatch, small):
    if small:  # several blocks of queries, lists cut often
        for name, value in (("QUERY_BLOCK", 4), ("HELD", 64), ("ROWS", 50), ("QUERIES", 2), ("PIVOTS", 3)):
            monkeypatch.setattr(N, name, value)
    rows = vector_rows(random.Random(4))
    df = spark.createDataFrame([(*r, "d", "c", 1) for r in rows], VECTORS)
    got = N.hard_negatives(N.whole_vectors(df, "id", "x", "label"), "id % 100 = 0").collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows)
    assert len(got) > 50


def test_no_negatives(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert N.hard_negatives(N.whole_vectors(empty, "id", "x", "label"), "id % 100 = 0").count() == 0
    one = spark.createDataFrame([(7, 1, [1.0], "", "", 1)], VECTORS)
    assert N.hard_negatives(N.whole_vectors(one, "id", "x", "label"), "id % 100 = 0").count() == 0
    with pytest.raises(ArithmeticError):
        N.hard_negatives(N.whole_vectors(spark.createDataFrame([(100, 1, [1e30], "", "", 1)], VECTORS), "id", "x", "label"), "id % 100 = 0")
