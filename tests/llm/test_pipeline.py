"""The pipeline's stages on the smallest tables, against brute force where SQL has no form."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from graphloom.llm import toxicity
from graphloom.llm.common import durable, table
from tests.llm.test_operators import components_of, prose

SF = "/root/testdata/sf0.001"


def without_spread_lines(rows):
    """Texts of (doc_id, text, source) rows without lines on ten sources of documents with a quarter of text of their own."""
    bare = lambda t: [x.strip(" \t\r") for x in (t or "").split("\n")]

    def spread(some):
        sites = defaultdict(set)
        for _, t, s in some:
            for x in bare(t):
                if x and s is not None:
                    sites[x].add(s)
        return {x for x in sites if len(sites[x]) >= 10}

    wide = spread(rows)
    gone = wide & spread([r for r in rows if sum(len(x) for x in bare(r[1]) if x in wide) < 0.75 * sum(map(len, bare(r[1])))])
    return [None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in gone) for _, t, _ in rows]


def five_words(t):
    w = [x.lower() for x in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def odd_documents(spark):
    """Nulls in any column, empty and repeated rows, an id with two texts, columns with clashing names."""
    rng = random.Random(21)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = prose(rng, 60, 10**6)
    rows = [(1, base), (2, base + " end"), (2, base + " end"), (3, None), (4, ""), (None, None), (None, ""), (None, f"{prose(rng, 20, 10**6)} {item}"), (None, prose(rng, 30, 10**6)), (5, item), (6, prose(rng, 5000, 10**6)), (7, "a b c"), (7, "d e f"), (8, base)]
    rows += [(100 + i, f"{prose(rng, 9, 10**6)}\nA notice on every site.") for i in range(12)]
    data = [(i, t, None if n % 5 == 4 else "en", None if n % 7 == 6 else f"s{n % 12}", None, n, 1, 2, "x") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, rep long, tag long, __severity long, gid string")


def test_stages_on_odd_rows(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        n = docs.count()
        for name, stage in P.STAGES:
            before = docs.collect()
            docs = durable(stage(spark, docs, SF), name)
            got = docs.collect()
            if name == "toxicity":
                assert len(got) == n
            elif name == "line_dedup":
                want = without_spread_lines([(r["doc_id"], r["text"], r["source"]) for r in before])
                assert sorted(map(str, want)) == sorted(str(r["text"]) for r in got)
            elif name == "near_dedup" and n:
                ids = [r["doc_id"] for r in got]
                assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, *range(100, 112)] and ids.count(None) == 4
                assert [r["text"] for r in got if r["doc_id"] == 7] == ["a b c"]
            elif name == "decontamination" and n:
                assert {r["doc_id"] for r in got} == {1, 3, 4, 6, 7, None, *range(100, 112)} and len([r for r in got if r["doc_id"] is None]) == 3
            elif name == "bpe":
                texts = Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in before)
                assert Counter(r["decoded_sha256"] for r in got) == texts
            if name != "bpe":
                assert not got or got[0].__fields__ == before[0].__fields__


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = [docs.collect()]
    for name, stage in P.STAGES:
        docs = durable(stage(spark, docs, SF), name)
        seen.append(docs.collect())
    raw, clean, lines, single, free, coded = seen
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    for rows in seen[1:5]:
        assert rows[0].__fields__ == raw[0].__fields__
    assert {r["doc_id"] for r in lines} == {r["doc_id"] for r in clean} <= {r["doc_id"] for r in raw}
    weights, theta = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    for r in raw:
        z = sum(weights.get(f, 0) * math.log1p(n) for f, n in Counter(f for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()) for f in toxicity.features(w)).items())
        kept = not theta or not re.search(r"[^\W\d_]", r["text"] or "") or z < theta[0]
        assert abs(z - (theta or [9])[0]) < 1e-9 or kept == (r["doc_id"] in {c["doc_id"] for c in clean})
    texts = {r["doc_id"]: r["text"] for r in lines}
    assert [texts[r["doc_id"]] for r in clean] == without_spread_lines([(r["doc_id"], r["text"], r["source"]) for r in clean])
    items = [five_words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    holds = lambda t: any(i and 100 * len(i & five_words(t)) >= 80 * len(i) for i in items)
    assert {r["doc_id"] for r in free} == {r["doc_id"] for r in single if not holds(r["text"])}
    ordered = sorted(lines, key=lambda r: r["doc_id"])
    parts, _ = components_of([r["text"] for r in ordered], 5, 80)
    assert {r["doc_id"] for r in single} == {ordered[i]["doc_id"] for i in set(parts)}
    assert {r["doc_id"] for r in free} <= {r["doc_id"] for r in single} and len(free) > 0.8 * len(single)
    back = {r["doc_id"]: r["decoded_sha256"] for r in coded}
    assert back == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in free}
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in coded)


def test_spread_lines_leave_short_pages(spark):
    rng = random.Random(3)
    line = "This long notice stands on every page of the house and holds more words than the page itself."
    pages = [(i, f"{prose(rng, 9, 10**6)}\n{line}\n\n", f"s{i}") for i in range(12)]
    text = "\n".join(prose(rng, 30, 10**6) for _ in range(5))
    copies = [(100 + i, text if i else text + " x", f"s{i}") for i in range(12)] + [(None, prose(random.Random(4), 40, 10**6), f"s{i}") for i in range(12)]
    rows = [*pages, *copies, (200, line, "s0"), (201, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in P.drop_boilerplate(spark, docs, SF).collect()), key=repr)
    assert all(len(line) > 0.5 * len(t.strip()) for _, t, _ in pages)
    want = [(i, t.replace(f"{line}\n", ""), s) for i, t, s in pages] + copies + [(200, "", "s0"), (201, None, None)]
    assert got == sorted(want, key=repr)
