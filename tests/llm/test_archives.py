import hashlib
import random

from graphloom.llm import warc


def test_archives_read_in_few_rounds(spark, tmp_path, monkeypatch):
    """Records that follow each other are one run, whatever their number; each round of jumps writes one table."""
    written = []
    real = warc.durable
    monkeypatch.setattr(warc, "durable", lambda df, name: written.append(name) or real(df, name))
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}" * 30) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    got = {r["page_id"]: r["payload_digest"] for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert got == {i: hashlib.sha256((f"<p>{i}" * 30).encode()).hexdigest() for i in range(300)}
    assert written.count("chain") == 1


def test_archives_inside_payloads(spark, tmp_path):
    """Records of an archive that is a payload, ending where its holder ends, are none of the outer archive."""
    inner = warc.END.join(f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{900 + i}>\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nabc" for i in range(5))
    html = [x for i in range(20) for x in (f"<p>{i}", f"{i}{warc.END}{inner}")]
    pages = spark.createDataFrame([(i, None, h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert got == {i: (len(h), hashlib.sha256(h.encode()).hexdigest()) for i, h in enumerate(html)}


def test_runs_of_candidates(spark):
    """Any chain gives the same true candidates by runs as step by step, also where links meet inside a run."""
    rng, rows, want = random.Random(5), [], set()
    for file in "abcdefgh":
        at = sorted(rng.sample(range(1, 400), 60)) if file != "h" else [3, 9]
        at = [0, *at] if file != "h" else at
        link = {x: (at[i + 1] if rng.random() < 0.8 else rng.choice(at[i + 1 :])) if i + 1 < len(at) else 500 for i, x in enumerate(at)}
        if file == "g":
            link[at[30]] = None
        rows += [(file, x, y) for x, y in link.items()]
        x = 0
        while x in link:
            want.add((file, x))
            x = link[x]
    placed, chain = warc.in_runs(spark.createDataFrame(rows, "file string, at long, next long").repartition(3))
    true = warc.reachable(chain).withColumnRenamed("at", "run")
    got = [tuple(r) for r in placed.join(true, ["file", "run"]).select("file", "at").collect()]
    assert len(got) == len(set(got)) and set(got) == want
