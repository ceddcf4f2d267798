"""Corpus operators against brute force, with null, empty, repeated and long rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from graphloom.llm import bpe, chat, components, decontam, digest, langid, linededup, neardup, toxicity, warc
from graphloom.llm.components import connected_components
from graphloom.llm.shingles import SPACES, word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, rep long, gid long, shingle long"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 12}", len(t or ""), i, "k", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components_of(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def near_texts():
    rng = random.Random(1)
    texts = [None, "", "  \n\t ", "One two", "one TWO", "one", prose(rng, 30_000)]
    for _ in range(12):
        base = prose(rng, rng.choice([8, 30, 120, 300])).split()
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(base) // 12])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    texts.append(texts[6] + " end")
    return texts


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 6)  # several blocks for a group
    monkeypatch.setattr(neardup, "SIGNATURE_BLOCK", 7)
    texts = near_texts()
    got = {r["doc_id"]: r for r in neardup.near_duplicates(frame(spark, texts), width, percent).collect()}
    parts, sizes = components_of(texts, width, percent)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["component_id"], got[i]["n_shingles"], got[i]["kept"]) == (parts[i], sizes[i], parts[i] == i), texts[i]


def test_near_duplicates_of_odd_rows(spark):
    assert neardup.near_duplicates(empty(spark), 3, 85).count() == 0
    rows = [(None, "a b c d"), (7, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, None), (3, 3), (3, 3), (7, 3), (9, 9)]
    # One document with several texts, one of them blank, links what is alike to any of them.
    rows = [(2, "a b c d"), (3, "a b c d"), (3, "e f g h"), (3, " "), (9, "e f g h"), (5, None), (5, "i j k l"), (4, "i j k l"), (8, "m n")]
    got = neardup.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, rep long, part int"), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(2, 2), (3, 2), (3, 2), (3, 2), (4, 4), (5, 4), (5, 4), (8, 8), (9, 2)]


def test_near_duplicates_of_pages_with_a_template(spark):
    """Pages that share most of their text, below the threshold, beside copies of some of them."""
    rng = random.Random(3)
    head = prose(rng, 200, 10**6)
    texts = [f"{head} {prose(rng, 45, 10**6)}" for _ in range(120)]
    texts += [f"{texts[i]} {prose(rng, n, 10**6)}" for i in range(0, 120, 7) for n in (3, 9, 27)]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, texts), 3, 85).collect()}
    parts, _ = components_of(texts, 3, 85)
    assert [got[i] for i in range(len(texts))] == parts and 100 < len(set(parts)) < len(texts)


@pytest.mark.parametrize("percent", [85, 80])
def test_signature_index_finds_all_within_distance(percent):
    rng = np.random.default_rng(4)
    m, r = neardup.plan(percent)
    masks = neardup.chunk_masks(m, 1)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, neardup.HASHES)
        b = a.copy()
        at = rng.choice(neardup.HASHES, r, replace=False)
        b[at] = (b[at] + 1) % (1 << 16)
        assert any((a[list(k)] == b[list(k)]).all() for k in masks)


def test_word_hashes_are_the_same_in_any_batch():
    rng = random.Random(2)
    texts = [prose(rng, 50) for _ in range(20)] + [None, "", "x" * 300_000 + " y " + prose(rng, 60_000)]
    alone = [next(word_hashes([t], SPACES)) for t in texts]
    for a, b, t in zip(alone, word_hashes(texts, SPACES), texts, strict=True):
        assert (a == b).all() and len(a) == len((t or "").split())


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)  # by rounds, and in one task
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(220)]
    up = {n: n for e in chain for n in e}
    for _ in range(len(up)):
        for x, y in chain:
            up[x] = up[y] = min(up[x], up[y])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {n: c for n, c in up.items() if any(n in e and e[0] != e[1] for e in chain)}
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(1, 1), (None, 4), (9, 8), (8, 9)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5} | {k: 5 for k in range(200, 260)} | {8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_bpe_equals_tiktoken(spark):
    rng = random.Random(5)
    bits = ["a", "th", "ing", "  ", " ", "\n", "é", "日本", "😀", "123", "!!", "'s", "\t", "\r\n", "\x1c", "A", " x"]
    texts = [None, "", " ", "a" * 3000, " " * 400 + "b"] + ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(400)]
    codec = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.digests(frame(spark, texts), public_tokenizers.path(bpe.VOCABULARY)).collect()}
    full = {r["doc_id"]: r for r in bpe.encode_documents(frame(spark, texts), public_tokenizers.path(bpe.VOCABULARY)).collect()}
    for i, t in enumerate(texts):
        ids = known.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert full[i]["token_ids"] == ids and full[i]["decoded"] == (t or "")
    assert bpe.digests(empty(spark), public_tokenizers.path(bpe.VOCABULARY)).count() == 0
    again = bpe.digests(frame(spark, [texts[9], texts[9]]), public_tokenizers.path(bpe.VOCABULARY)).select("n_tokens", "ids_sha256").collect()
    assert again[0] == again[1] and again[0]["ids_sha256"] == got[9]["ids_sha256"]


def test_long_runs_of_blanks(spark):
    texts = [" " * 5_000_000, "a" + " \n" * 1_000_000 + "b"]
    began = time.time()
    got = bpe.digests(frame(spark, texts), public_tokenizers.path(bpe.VOCABULARY)).collect()
    assert time.time() - began < 60
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.op2_langid(spark, SF).collect()}
    rows = docs.select("doc_id", "lang").collect()
    held = [(got[r["doc_id"]]["lang_pred"] == r["lang"]) for r in rows if got[r["doc_id"]]["held_out"]]
    assert len(got) == len(rows) and len(held) > 20 and sum(held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_rows(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = [None, "", "123 !?", "The of the and thing", "x", "日本語" * 40_000]
    got = {r["doc_id"]: (r["__lang"], r["__score"]) for r in langid.predict(frame(spark, texts), model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "en" and got[5][0] in model["langs"]
    assert langid.predict(empty(spark), model).count() == 0
    assert langid.fit(empty(spark)) is None
    assert langid.predict(frame(spark, ["abc"]), None).first()["__lang"] == "und"


def grams_of(text):
    t = "".join(" " if c.isspace() else c for c in text.lower())
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_presence_kernel_is_exact():
    grams, rng = langid.Grams(), random.Random(6)
    large = "".join(map(chr, range(0x4E00, 0x5E00))) + "\u4e00\u4e10😀"
    for letters in ("abcdefgh \n", large, "aé日😀 "):
        for n in (0, 1, 2, 3, 60, 5000):
            t = "".join(rng.choices(letters, k=n))
            got = grams.of(t)
            want = {sum((ord(c) + 1) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) for g in grams_of(t)}
            assert len(got) == len(want) and set(got.tolist()) == want


def test_language_scores_equal_brute_force(spark):
    """Kernel ridge regression on exact sets of n-grams, solved with plain matrices."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = sorted(map(tuple, langid._sample(docs, "text", "lang").select("doc_id", "lang", "text").collect()))
    sets, langs = [grams_of(t) for _, _, t in sample], sorted({x for _, x, _ in sample})
    seen, marks = Counter(), []
    for i, (_, x, _) in enumerate(sample):
        marks.append((seen[x], x, i))
        seen[x] += 1
    marks = [sets[i] for _, _, i in sorted(marks)[: langid.LANDMARKS]]
    kernel = lambda a, b: np.array([[len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))) for y in b] for x in a])
    value, vector = np.linalg.eigh(kernel(marks, marks))
    span = vector[:, value > 1e-6 * value[-1]] / np.sqrt(value[value > 1e-6 * value[-1]])
    phi = np.hstack([kernel(sets, marks) @ span, np.ones((len(sets), 1))])
    weight = np.diag([1 / seen[x] for _, x, _ in sample])
    y = np.array([[1.0 if x == k else -1.0 for k in langs] for _, x, _ in sample])
    beta = np.linalg.solve(phi.T @ weight @ phi + langid.RIDGE * np.eye(phi.shape[1]), phi.T @ weight @ y)
    rows = docs.select("doc_id", "text").limit(40).collect()
    raw = np.hstack([kernel([grams_of(r["text"] or "") for r in rows], marks) @ span, np.ones((len(rows), 1))]) @ beta
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    for r, z in zip(rows, raw, strict=True):
        if langid.has_letter(r["text"]):
            share = np.exp(4 * z) / np.exp(4 * z).sum()
            assert got[r["doc_id"]]["__lang"] == langs[int(z.argmax())] and abs(got[r["doc_id"]]["__score"] - share.max()) < 2e-3


def test_language_of_repeated_and_tied_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.union(docs.withColumn("text", docs.text.substr(1, 50)))
    score = lambda d: sorted((r["doc_id"], r["__lang"], r["__score"]) for r in langid.predict(docs, langid.fit(d)).collect())
    assert score(twice) == score(twice.repartition(3, "source"))
    tied = langid.fit(spark.createDataFrame([(i, "same text", x) for i, x in enumerate(["b", "a", "b", "a"])], "doc_id long, text string, lang string"))
    assert {r["__lang"] for r in langid.predict(frame(spark, ["same text", "same text"]), tied).collect()} == {"a"}


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def brute_digest(data, rank):
    """(features, filters as sets of bits) by the definition, one window at a time."""
    n = len(data) - 63
    level = [brute_level(data[i : i + 64]) for i in range(max(n, 0))]
    points = Counter()
    for i in range(max(n, 0)):
        best = min((rank[level[j]], j) for j in range(i, min(i + 64, n)))
        if best[0] < digest._NONE:
            points[best[1]] += 1
    at = sorted(j for j in points if points[j] >= (16 if n >= 64 else 1))
    values = []
    for j in at:
        v = 0
        for k in range(8):
            v = mixed((v + int.from_bytes(data[j + 8 * k : j + 8 * k + 8], "little") * int(digest._MIX[k])) % 2**64)
        values.append(v)
    if not values and data:
        values = [int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")]
    chain = [{(v >> 11 * k) % 2048 for v in values[low : low + 160] for k in range(5)} for low in range(0, len(values), 160)]
    return len(values), chain


def brute_level(window):
    left = sum(round(2**24 * c * math.log2(c)) for c in Counter(window).values())
    return min((2**24 * 64 * 6 - left) * 1000 // (2**24 * 64 * 6), 999)


def brute_likeness(a, b):
    x, y = sorted((a, b), key=len)
    if not x:
        return float(not y)
    total = 0.0
    for f in x:
        best = 0.0
        for g in y:
            most, chance = min(len(f), len(g)), len(f) * len(g) / 2048
            floor = chance + 0.3 * (most - chance)
            best = max(best, (len(f & g) - floor) / max(most - floor, 1e-9))
        total += min(best, 1.0)
    return total / len(x)


def test_digests_equal_brute_force(spark):
    import base64

    rng = random.Random(13)
    texts = ["", "short", "é" * 40, "a" * 300, prose(rng, 20), prose(rng, 60), prose(rng, 300), prose(rng, 900)]
    texts += [texts[6][:700] + "changed" + texts[6][700:], texts[6]]
    docs = frame(spark, texts)
    counts = Counter(brute_level(t.encode()[i : i + 64]) for t in texts for i in range(len(t.encode()) - 63))
    rank = [digest._NONE] * 1000
    for place, k in enumerate(sorted(range(1000), key=lambda k: (counts[k], k))):
        rank[k] = digest._NONE if k < digest.LOW else place
    assert digest.corpus_rarity(docs).tolist() == rank
    got = {r["doc_id"]: r for r in digest.fingerprints(docs).collect()}
    text_of = lambda d: f"{d[0]}:" + base64.b64encode(b"".join(np.packbits([i in f for i in range(2048)]).tobytes() for f in d[1])).decode()
    for i, t in enumerate(texts):
        after, half = texts[i - 1], len(t) // 2
        own, edited, following = (brute_digest(x.encode(), rank) for x in (t, t[: len(t) - half] + after[:half], after))
        assert got[i]["fingerprint"] == text_of(own) and got[i]["edited_fingerprint"] == text_of(edited)
        assert abs(got[i]["near_edited"] - brute_likeness(own[1], edited[1])) < 2e-6 and abs(got[i]["near_next"] - brute_likeness(own[1], following[1])) < 2e-6
    # Stored ranks keep fingerprints the same in another table.
    alone = digest.fingerprints(frame(spark, texts[6:7]), digest.corpus_rarity(docs)).first()
    assert alone["fingerprint"] == got[6]["fingerprint"]


def test_digests_of_rows_without_or_with_equal_ids(spark):
    rng = random.Random(14)
    texts = [prose(rng, 30) for _ in range(60)]
    rows = [(None, t) for t in texts[:40]] + [(5, t) for t in texts[40:50]] + [(i, t) for i, t in enumerate(texts[50:], 10)]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, bucket int, donor boolean")
    got = digest.fingerprints(docs).collect()
    mark = {r["text"]: r["m"] for r in docs.selectExpr("text", "xxhash64(text) AS m").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -mark[r[1]] if r[0] is None else 0, r[1]))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


def test_digests(spark):
    rng = random.Random(7)
    texts = [None, "", "short", "é" * 50, "a" * 500, prose(rng, 20), prose(rng, 600), prose(rng, 600), prose(rng, 30_000)]
    texts += [texts[6], texts[6][:-40] + "changed"]
    got = {r["doc_id"]: r for r in digest.fingerprints(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[6]["fingerprint"] == got[9]["fingerprint"] and got[0]["fingerprint"] == got[1]["fingerprint"]
    assert got[10]["near_next"] > 0.8 and got[7]["near_next"] < 0.1 and 0.15 < got[8]["near_edited"] < 0.9
    assert digest.fingerprints(empty(spark)).count() == 0
    one = digest.fingerprints(frame(spark, ["only"])).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"onon").hexdigest()


def test_window_levels():
    data = bytes(np.random.default_rng(1).integers(97, 110, 400).astype(np.uint8))
    want = [-sum(c / 64 * math.log2(c / 64) for c in Counter(data[i : i + 64]).values()) for i in range(len(data) - 63)]
    assert np.abs(digest.levels(np.frombuffer(data, np.uint8)) - np.array(want) * digest.LEVELS / 6).max() <= 1


def test_toxicity(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(300):
        words = prose(rng, 60).split()
        if i % 4 == 0:
            words += ["beastly"] * (1 if i % 8 else 5)
        texts.append(" ".join(words))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = frame(spark, [*texts, None, "", "123"])
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert model[1] == sorted(model[1]) and len(model[1]) == toxicity.GRADES - 1
    got = {r["doc_id"]: r for r in toxicity.severity(docs, model).collect()}
    assert len(got) == len(texts) + 3 and set(docs.columns) < set(toxicity.severity(docs, model).columns)
    assert [got[i]["__toxic"] for i in range(300)] == [i % 4 == 0 for i in range(300)]
    assert got[8]["__severity"] > got[4]["__severity"] > got[1]["__severity"]
    assert got[300]["__severity"] == got[301]["__severity"] == got[302]["__severity"] == 0
    assert toxicity.severity(empty(spark), model).count() == 0
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) == ({}, [])


def test_severity_equals_brute_force_and_repeats(spark):
    rng = random.Random(15)
    texts = [" ".join([prose(rng, 40), *["beastly"] * (i % 5)]) for i in range(200)]
    rows = [(i, texts[i % 150]) for i in range(200)] + [(i, "another text of an id") for i in range(3)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(200)] + [(7, 0), (7, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, severity double, toxic int")
    weights, theta = toxicity.fit(docs, labels)
    assert (weights, theta) == toxicity.fit(docs.repartition(5), labels.repartition(3)) and theta
    got = toxicity.severity(docs, (weights, theta)).collect()
    assert len(got) == len(rows) and got[0].__fields__[:4] == docs.columns
    for r in got:
        seen = Counter()
        for w in re.findall(r"[^\W\d_]+", r["text"].lower()):
            for f in {w, *({"4" + w[:4], "5" + w[:5]} if len(w) > 3 else ())}:
                seen[f] += 1
        z = sum(weights[f] * math.log1p(n) for f, n in seen.items() if f in weights)
        assert abs(r["__severity"] - sum(1 / (1 + math.exp(t - z)) for t in theta)) < 1e-9


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 3))
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=800)
    w, theta = toxicity.fit_cumulative_link([np.arange(3)] * 800, list(x), (z > -1).astype(int) + (z > 1.5), 3)
    assert abs(w[0] / w[1] + 2) < 0.5 and abs(w[2]) < 0.3 and theta[0] < theta[1]


def test_contained_items(spark, monkeypatch):
    rng = random.Random(9)
    items = [prose(rng, n, 5000) for n in (3, 5, 9, 40, 60, 200)] + [None, "", "..."]
    long = prose(rng, 20_000, 5000).split()
    texts = [None, "", items[0], items[1].upper() + "!", " ".join(long[:9000] + items[3].split() + long[9000:]), items[5], " ".join(items[4].split()[:50]), " ".join(items[4].split()[:30])]
    texts.append(", ".join(items[5].split()[:170]) + ".")
    items_df = spark.createDataFrame([*enumerate(items), (3, items[3]), (None, "x y")], "item_id long, text string")

    def cut(t):
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            a, b = cut(x), cut(t)
            if a and 100 * len(a & b) >= 80 * len(a):
                want.add((d, i, len(a & b), len(a)))
    docs = frame(spark, texts)
    key = ["doc_id", "item_id", "n_shared", "n_item"]
    for bits in (decontam.FILTER_BITS, 64):  # a filter that lets nearly everything through changes nothing
        monkeypatch.setattr(decontam, "FILTER_BITS", bits)
        got = decontam.contained_items(docs, items_df).select(*key).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert len(want) >= 6 and decontam.contained_items(empty(spark), items_df).count() == 0
    assert decontam.contained_items(docs, items_df.limit(0)).count() == 0


def test_spread_lines(spark):
    rng = random.Random(10)
    common, rare = "All rights reserved.", "Seen on nine sites."
    rows = []
    for i in range(60):
        lines = [prose(rng, 12, 10**6) for _ in range(4)]
        lines.insert(rng.randint(0, 4), f" {common}\r" if i % 2 else common)
        if i % 12 < 9:
            lines.append(rare)
        rows.append((i, "\n".join(lines), f"s{i % 12}"))
    rows += [(60, None, "s1"), (61, "", "s2"), (62, common, "s3"), (63, f"\n{common}\n\nlong enough to stay here as a line\n", None), (64, rows[0][1], "s0"), (0, rows[0][1], "s0")]
    copied = [prose(rng, 20, 10**6) for _ in range(4)]
    rows += [(100 + i, "\n".join([*copied, f"copy {i}"]), f"s{i}") for i in range(12)]
    notice = "A notice that is longer than all that the page says beside it. " * 3
    rows += [(200 + i, f"page {i}\n{notice}", f"n{i}") for i in range(40)] + [(300 + i, f"{notice}", f"n{i}") for i in range(3)]
    docs = spark.createDataFrame([(*r, 5, 1, 2) for r in rows], "doc_id long, text string, source string, n_chars long, pos long, h1 long")
    got = sorted(linededup.remove_spread_lines(docs).collect(), key=lambda r: r["doc_id"])
    bare = lambda t: [x.strip(" \t\r") for x in (t or "").split("\n")]

    def spread(rows):
        sites = defaultdict(set)
        for _, t, s in rows:
            for x in bare(t):
                if x and s:
                    sites[x].add(s)
        return {x for x in sites if len(sites[x]) >= linededup.SITES}

    wide, contexts = spread(rows), defaultdict(dict)
    for _, t, s in rows:
        own = [x for x in bare(t) if x]
        for a, x, b in zip([None, *own], own, [*own[1:], None], strict=False):
            if s:
                contexts[x][a, b] = min(s, contexts[x].get((a, b), s))
    boiler = {x for x in wide if len(set(contexts[x].values())) >= linededup.SITES}
    for r, (_, t, _) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        lines = t.split("\n") if t is not None else []
        hit = [x.strip(" \t\r") in boiler for x in lines]
        want = None if t is None else "\n".join(x for x, h in zip(lines, hit, strict=True) if not h)
        assert (r["text"], r["__n_removed"], r["__n_lines"]) == (want, sum(hit), len(lines)), t
        assert r["n_chars"] == (None if want is None else len(want)) and r["pos"] == 1
    assert common in boiler and rare not in wide and copied[0] in wide - boiler and notice.strip() in boiler and {r["doc_id"]: r["text"] for r in got}[207] == "page 7" and {r["doc_id"]: r["text"] for r in got}[62] == ""
    assert linededup.remove_spread_lines(docs.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 7)
    big = "<p>" + "é" * 200
    trap = f"x{warc.END}{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nabcde{warc.END}{warc.MAGIC}tail" + "y" * 100
    html = [None, "", "small", "small", big, big, trap, trap, warc.MAGIC, f"{warc.END}{warc.MAGIC}", "z" * 100_000] + [f"<p>{i}" for i in range(30)]
    rows = [(i, f"http://x/{i}\r\nX: y" if i % 3 else None, h, i, "v") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long, value string").repartition(3)
    warc.write_archives(pages, str(tmp_path / "a"))
    got = sorted(map(tuple, warc.read_archives(spark, str(tmp_path / "a")).collect()))
    first, want = {}, []
    for i, h in enumerate(html):
        data = (h or "").encode()
        keep = first.setdefault(data, i) if len(data) >= 100 else i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if keep == i else "revisit", None if keep == i else keep))
    assert got == want
    warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0
    # Version 1.0 reads alike; a length that can't be read breaks a chain, which is told or ends the file's records.
    import gzip

    data = [gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("*.gz"))]
    for name, old, new in (("c", rb"WARC/1\.1", rb"WARC/1.0"), ("d", rb"(?s)(<urn:page:3>.*?\r\nContent-Length: )", rb"\1?")):
        (tmp_path / name).mkdir()
        for i, d in enumerate(data):
            (tmp_path / name / f"{i}.warc").write_bytes(re.sub(old, new, d))
    old = sorted(r["page_id"] for r in warc.read_archives(spark, str(tmp_path / "c")).collect())
    assert old == list(range(len(html)))
    with pytest.raises(ValueError, match="breaks"):
        warc.read_archives(spark, str(tmp_path / "d"))
    rest = {r["page_id"] for r in warc.read_archives(spark, str(tmp_path / "d"), strict=False).collect()}
    assert 3 not in rest and 0 < len(rest) < len(html)


def test_archives_of_null_and_repeated_ids(spark, tmp_path):
    big = "long enough " * 20
    rows = [(None, "u", big), (5, "u", big), (5, "u", big), (None, None, None), (2**62 + 1, "u", "x"), (2**62 + 1, "u", "x")]
    warc.write_archives(spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, bytes long, first string"), str(tmp_path / "a"))
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()), key=str)
    assert got == sorted([(0, "revisit", 5), (5, "response", None), (5, "response", None), (0, "response", None), (2**62 + 1, "response", None), (2**62 + 1, "response", None)], key=str)


def test_perspectives(spark):
    rng = random.Random(11)
    rows = [(1, i, rng.choice(["ann", "bob", "system", "cy"]), prose(rng, 3)) for i in range(150)]
    rows += [(2, 0, "ann", None), (2, 0, None, "hi é😀"), (2, 1, "ann", ""), (3, 0, "system", "only"), (None, 1, "ann", "x"), (4, 5, "a", "same"), (4, 5, "a", "same")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id long, turn long, role string, text string, segment long, speaker string")
    got = chat.rotate_perspectives(df).collect()
    for r in got:
        mine = sorted(((t, role or "unknown", text or "") for c, t, role, text in rows if c == r["conv_id"]))[r["segment"] * 64 : r["segment"] * 64 + 64]
        text, spans = "", []
        for _, role, words in mine:
            text += "<|assistant|>\n" if role == r["speaker"] else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
            if role == r["speaker"]:
                spans.append(f"{len(text)}:{len(text) + len(words)}")
            text += words + "\n"
        assert (r["rendered"], r["mask"], r["n_turns"], r["n_own"]) == (text, ",".join(spans), len(mine), len(spans))
    assert Counter(r["conv_id"] for r in got) == {1: 9, 2: 2, None: 1, 4: 1}
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_large_and_null_ids(spark):
    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "one two three four"), (None, "one two three four"), (big + 2, "one two three four"), (None, None)], "doc_id long, text string")
    want = {None, big, big + 2}
    path = public_tokenizers.path(bpe.VOCABULARY)
    for out in (digest.fingerprints(docs), bpe.digests(docs, path), bpe.encode_documents(docs, path), neardup.near_duplicates(docs, 3, 85)):
        got = [r["doc_id"] for r in out.collect()]
        assert set(got) == want and len(got) == 4
    kept = [r["doc_id"] for r in neardup.near_duplicates(docs, 3, 85).filter("kept").collect()]
    assert sorted(kept, key=str) == sorted([big, None, None], key=str)


def test_large_ids_in_archives(spark, tmp_path):
    ids = [2**62 + 1, 2**63 - 1, -(2**63), 10**18]
    pages = spark.createDataFrame([(i, f"u{i}", "equal " * 3000) for i in ids], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"))
    got = {r["page_id"]: r["refers_to"] for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert set(got) == set(ids) and [got[i] for i in sorted(ids)] == [None] + [min(ids)] * 3


def test_item_split_over_rows_of_a_document(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(words[:24])), (1, " ".join(words[20:])), (2, " ".join(words)), (3, " ".join(words[:24])), (None, " ".join(words)), (None, " ".join(words)), (None, "other words")]
    items = spark.createDataFrame([(7, " ".join(words), 1, 2)], "item_id long, text string, n long, tag long")
    got = decontam.contained_items(spark.createDataFrame([(*d, 5, 6) for d in docs], "doc_id long, text string, shingle long, salt int"), items)
    assert sorted(tuple(r)[:4] for r in got.collect() if r["doc_id"]) == [(1, 7, 36, 36), (2, 7, 36, 36)]
    assert [(r["n_shared"], r["tag"] != 0) for r in got.collect() if r["doc_id"] is None] == [(36, True)]


def test_candidates_of_items_with_shared_wording(spark):
    """Wording that all items share proposes no pair, and no contained item is lost."""
    rng = random.Random(12)
    head = prose(rng, 25, 10**6)
    items = [f"{head} {prose(rng, 40, 10**6)}" for _ in range(30)]
    docs = [f"{prose(rng, 50, 10**6)} {head} {prose(rng, 50, 10**6)}" for _ in range(40)] + [f"{prose(rng, 30, 10**6)} {x}" for x in items[:5]]
    docs_df, items_df = frame(spark, docs), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    sets = decontam.item_sketches(items_df).cache()
    held = decontam._held(decontam.identified(docs_df), decontam.shingle_filter(sets), 5)
    pairs = decontam.candidates(held, sets).count()
    assert 5 <= pairs <= 10
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contained_items(docs_df, items_df).collect()) == [(40 + i, i) for i in range(5)]
