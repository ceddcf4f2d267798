"""Edge cases of the graph operators on small hand-made tables."""

import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import index, likeness, query_terms, tokens
from graphloom.operators import access, audits, changelog, code, mutate, paths, reads, search, vectors
from graphloom.sources import attachments
from graphloom.streaming import events

R = "from_id long, to_id long, relation_type string"
E = "id long, name string, entity_type string"


@pytest.fixture(scope="module")
def small(spark):
    entity = spark.createDataFrame([(1, "a", "n"), (2, "b-c", "n"), (3, "d_é", "m"), (4, "it's", "m"), (9, "alone", "m")], E)
    relation = spark.createDataFrame([(1, 2, "x"), (2, 1, "x"), (1, 2, "y"), (2, 3, "x"), (4, 4, "x"), (3, 4, "x")], R)
    observation = spark.createDataFrame([(1, 0, "likes math"), (1, 1, "city: Rome"), (2, 0, "likes science"), (2, 1, "city: Oslo"), (2, 2, "city: Bonn")], "entity_id long, idx int, body string")
    return entity, relation, observation


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


def test_degrees_count_a_self_loop_twice(small):
    got = {r["id"]: tuple(r)[1:] for r in reads.degrees(small[1]).collect()}
    assert got[4] == (1, 2, 3) and got[1] == (2, 1, 3)


def test_lookup_and_batch(spark, small):
    names = reads.names_frame(spark, ["b-c", "none", "b-c", "A"])
    assert rows(reads.exists(small[0], names)) == [(0, "b-c", True), (1, "none", False), (2, "b-c", True), (3, "A", False)]
    got = rows(reads.batch_get(small[0], small[2], names))
    assert got == [(0, "b-c", 2, "n", 3), (1, "none", None, None, None), (2, "b-c", 2, "n", 3), (3, "A", None, None, None)]


def test_page_has_only_inner_relations(small):
    assert reads.inside(small[1], reads.page(small[0], 0, 1)).count() == 0
    assert reads.inside(small[1], reads.page(small[0], 0, 2)).count() == 3
    assert reads.page(small[0], 1, 5, "m").count() == 2


def test_search_relations_filters(small):
    assert reads.search_relations(small[1], small[0], source="a", relation_type="").count() == 2
    assert reads.search_relations(small[1], small[0], source="nobody").count() == 0
    assert reads.search_relations(small[1], small[0], relation_type="z").count() == 0


def test_observation_value_takes_the_first(small):
    assert rows(reads.observation_value(small[2], "city")) == [(1, "Rome"), (2, "Oslo")]


def test_export_leaves_out_empty_attributes(spark, small):
    attribute = spark.createDataFrame([("entity", 1, "k", "v"), ("entity", 1, "a", "w")], "owner_kind string, owner_id long, key string, value string")
    got = {r["id"]: r["payload"] for r in reads.export_entities(small[0], small[2], attribute).collect()}
    assert got[1] == '{"name":"a","entityType":"n","observations":["likes math","city: Rome"],"attributes":{"a":"w","k":"v"}}'
    assert "attributes" not in got[9]


def test_reach(spark, small):
    relation = small[1]
    assert rows(paths.reach(relation, ids(spark, 1), 0)) == [(1, 0)]
    assert rows(paths.reach(relation, ids(spark, 1), 2, "OUTGOING")) == [(1, 0), (2, 1), (3, 2)]
    assert rows(paths.reach(relation, ids(spark, 3), 1, "INCOMING")) == [(2, 1), (3, 0)]
    assert rows(paths.reach(relation, ids(spark, 1), 3, relation_type="none")) == [(1, 0)]
    assert rows(paths.reach(relation.limit(0), ids(spark, 1), 3)) == [(1, 0)]
    level1 = paths.reach(relation, ids(spark, 1), 1)
    assert rows(paths.scanned_edges(relation, level1, 1, "OUTGOING")) == [(1, 2, "x"), (1, 2, "y")]


def test_paths(spark, small):
    relation = small[1]
    assert rows(paths.shortest_path(relation, ids(spark, 1), ids(spark, 4))) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert rows(paths.shortest_path(relation, ids(spark, 1), ids(spark, 1))) == [(0, 1)]
    assert rows(paths.shortest_path(relation, ids(spark, 1), ids(spark, 9))) == []
    # Parallel and reciprocal relations give the path again.
    assert [tuple(r) for r in paths.all_paths(relation, 1, 2, 3).collect()] == [([1, 2], 1)] * 3
    assert paths.all_paths(relation, 1, 4, 3).count() == 3 and paths.all_paths(relation, 1, 4, 2).count() == 0
    assert paths.all_paths(relation, 1, 1, 3).collect()[0]["path"] == [1]
    assert paths.all_paths(relation, 1, 2, 3, limit=2).count() == 2


def test_paths_without_a_bound(spark, monkeypatch):
    monkeypatch.setattr(paths, "ITEMS", 3)
    monkeypatch.setattr(reads, "ITEMS", 3)
    chain = spark.createDataFrame([(i, i + 1, "x") for i in range(18)] + [(0, 100 + i, "x") for i in range(9)], R)
    assert sorted(map(tuple, paths.shortest_path(chain, ids(spark, 0), ids(spark, 18)).collect())) == [(i, i) for i in range(19)]
    assert paths.reach(chain, ids(spark, 0)).count() == 28 and paths.reach(chain, ids(spark, 0), direction="INCOMING").count() == 1
    entity = spark.createDataFrame([(0, "a", "n"), (18, "b", "n")], E)
    assert paths.find_path(entity, chain, "a", "b").count() == 19
    with pytest.raises(ValueError, match="nobody"):
        paths.find_path(entity, chain, "a", "nobody")


def test_audits(spark, small):
    assert rows(audits.duplicate_groups(small[1], ["from_id", "to_id"])) == [(1, 2, 2)]
    assert rows(audits.dangling(spark.createDataFrame([(1, 77, "x"), (78, 2, "x"), (78, 79, "x")], R), small[0])) == [(1, 77, "to"), (78, 2, "from"), (78, 79, "from+to")]
    drift = audits.counter_drift(spark.createDataFrame([("a", 99), ("b", 2)], "k string, n long"), spark.createDataFrame([("b", 2), ("c", 1)], "k string, n long"), "k")
    assert rows(drift) == [("a", 99, 0), ("c", 0, 1)]


def test_text_functions(spark):
    df = spark.createDataFrame([("Entity_5 ÄÉ-x ß", "abcd", "abcx"), ("", "", "")], "t string, a string, b string")
    got = df.select(tokens(F.col("t")).alias("t"), F.round(likeness(F.col("a"), F.col("b")), 6).alias("s")).collect()
    assert got[0]["t"] == ["entity", "5", "ae", "x", "ß"] and got[0]["s"] == round(0.5 * 0.7 + 0.75 * 0.3, 6)
    assert got[1]["t"] == [] and got[1]["s"] == 0
    assert spark.range(1).select(tokens(F.lit("Ångström à Ñandú e\u0301t ệ ǖ")).alias("t")).first()["t"] == ["angstrom", "a", "nandu", "et", "e", "u"]
    assert query_terms("Part#7 it's ab_c") == (["part", "7", "it", "s", "ab"], "c") and query_terms(" !") == ([], None)


def test_full_text(spark, small):
    assert rows(search.match(small[2], ["likes"], owner="entity_id")) == [(1,), (2,)]
    assert search.match(small[2], owner="entity_id").count() == 0
    assert rows(search.match(small[2], phrase=["city", "rome"], owner="entity_id")) == [(1,)]
    assert rows(search.match(small[2], ["likes"], none_of=["math"], owner="entity_id")) == [(2,)]
    assert rows(search.match(small[0], ["d"], prefix="e", owner="id", body="name")) == [(3,)]
    words, names = index(small[2], "entity_id", "idx"), index(small[0].select("id", F.lit(0).alias("idx"), F.col("name").alias("body")), "id", "idx")
    got = search.search_nodes(small[0], names, words, ["likes"], offset=1, limit=1).collect()
    assert [(r["place"], r["id"]) for r in got] == [(1, 2)]
    page, more = search.search_nodes_lite(small[0], names, words, ["likes"], limit=1)
    assert [r["id"] for r in page.collect()] == [1] and more
    assert search.search_nodes(small[0], names, words, []).count() == 0
    match = lambda **k: rows(search.match_index(words, texts=small[2], owner="entity_id", **k))
    assert match(phrase=["city", "rome"]) == [(1, 1)] and match(phrase=["rome", "city"]) == [] and match() == []
    assert match(all_of=["likes"], none_of=["math"]) == [(2, 0)] and match(any_of=["rome", "oslo"]) == [(1, 1), (2, 1)] and match(all_of=["city"], prefix="bo") == [(2, 2)]
    assert rows(search.direct_search("nodes", "likes sci", small[0], names, words, None, None, 5).select("id")) == [(2,)]
    score = {r["owner"]: r["score"] for r in search.bm25(small[2].select(F.concat("entity_id", F.lit(":"), "idx").alias("id"), "body"), ["math", "likes"]).collect()}
    assert score["1:0"] > score["2:0"] > 0 and len(score) == 2


def test_vectors(spark):
    data = [(0, 1, [1.0, 0.0]), (1, 1, [0.0, 0.0]), (2, 2, [0.0, 1.0]), (3, 2, [1.0, 0.0]), (4, 3, [0.6, 0.8])]
    chunks = spark.createDataFrame(data, "vec_id long, owner_id long, embedding array<double>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    far = {r["vec_id"]: r["distance"] for r in vectors.scored(chunks, q).collect()}
    assert far == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0.4}
    assert [tuple(r) for r in vectors.near_entities(chunks, q, 2).collect()] == [(1, 0, 0.0), (2, 3, 0.0)]
    assert rows(vectors.invalid_vectors(chunks, 2)) == [(1, "norm")] and vectors.invalid_vectors(chunks, 3).count() == 5
    with pytest.raises(Exception, match="dimensions differ"):
        vectors.scored(chunks, spark.createDataFrame([([1.0],)], "q array<double>")).collect()
    near = rows(vectors.knn(chunks, spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, q array<double>"), 2))
    assert near == [(7, 0, 0.0), (7, 3, 0.0), (8, 2, 0.0), (8, 4, 0.2)]
    e = np.array(spark.range(1).select(vectors.hashed_embedding(F.lit("a b a")).alias("e")).first()["e"])
    assert abs(np.linalg.norm(e) - 1) < 1e-9


def test_mmr_prefers_what_differs(spark):
    data = [(0, [1.0, 0.0], 0.0), (1, [1.0, 0.01], 0.01), (2, [0.0, 1.0], 0.3)]
    pool = spark.createDataFrame([(5, *r) for r in data], "query_id long, vec_id long, embedding array<double>, distance double")
    assert [r["vec_id"] for r in vectors.mmr(pool, 3).orderBy("place").collect()] == [0, 2, 1]


def test_fusion(spark):
    text = spark.createDataFrame([(1, 0), (2, 1)], "owner_id long, rank long")
    vec = spark.createDataFrame([(2, 0), (3, 1)], "owner_id long, rank long")
    got = {r["owner_id"]: r["score"] for r in vectors.reciprocal_rank_fusion(text, vec).collect()}
    assert got[2] > got[1] > got[3]
    up = {r["owner_id"]: r["score"] for r in vectors.boosted(vectors.reciprocal_rank_fusion(text, vec), spark.createDataFrame([(3, 5)], "id long, n long")).collect()}
    assert abs(up[3] - got[3] - 0.05) < 1e-12 and up[1] == got[1]


def test_mutations(spark, small):
    entity, relation, observation = small
    new = spark.createDataFrame([(0, "z", "p"), (1, "z", "q"), (2, "", "q"), (3, "a", "q")], "pos long, name string, entity_type string")
    assert rows(mutate.create_entities(entity, new, 100).filter("id >= 100")) == [(100, "z", "p")]
    assert {r["name"]: r["entity_type"] for r in mutate.upsert_types(entity, new).collect()}["a"] == "q"
    add = spark.createDataFrame([(1, 0, "likes math"), (1, 1, "new"), (1, 2, "new"), (9, 0, "first")], "entity_id long, pos long, body string")
    assert rows(mutate.add_observations(observation, add).filter("entity_id IN (1, 9) AND idx <> 0"))[1:] == [(1, 2, "likes math"), (1, 3, "new"), (1, 4, "new")]
    assert rows(mutate.add_observations(observation, add, only_new=True).filter("entity_id = 1")) == [(1, 0, "likes math"), (1, 1, "city: Rome"), (1, 2, "new")]
    attribute = spark.createDataFrame([("entity", 1, "k", "one"), ("entity", 2, "k", "two"), ("entity", 2, "j", "x"), ("relation", 1, "k", "r")], "owner_kind string, owner_id long, key string, value string")
    e, r, o, a = mutate.merge_entities(entity, relation, observation, attribute, 1, 2)
    assert (2, 2, "x") in rows(r) and r.count() == 5 and e.count() == 4
    assert rows(o)[-1][2] == "city: Rome" and ("entity", 2, "k", "one") in rows(a) and ("relation", 1, "k", "r") in rows(a)
    left = mutate.delete_entities(entity, spark.createDataFrame([("a",), ("?",)], "name string"), relation=relation, observation=observation, attribute=attribute)
    e, r, o, a = (left[k] for k in ("entity", "relation", "observation", "attribute"))
    assert e.count() == 4 and r.count() == 3 and o.count() == 3 and ("relation", 1, "k", "r") in rows(a)
    kept, refused = mutate.reverse_relations(relation, spark.createDataFrame([(1, 2, "x"), (4, 4, "x"), (2, 3, "x"), (7, 7, "x")], R))
    assert rows(refused) == [(1, 2, "x"), (4, 4, "x")] and (3, 2, "x") in rows(kept) and kept.count() == 6
    kept, refused = mutate.change_relation_type(relation, spark.createDataFrame([(1, 2, "x"), (2, 3, "x")], R), "y")
    assert rows(refused) == [(1, 2, "x")] and (2, 3, "y") in rows(kept)
    asked = [(0, "a", "alone"), (1, "b-c", "new"), (2, "it's", "new"), (3, "b-c", "later"), (4, "nobody", "x"), (5, "d_é", "")]
    names = spark.createDataFrame(asked, "pos int, name string, new_name string")
    assert {r["name"] for r in mutate.rename_entities(entity, names).collect()} == {"a", "new", "d_é", "it's", "alone"}
    assert {r["pos"]: r["outcome"] for r in mutate.rename_outcome(entity, names).collect()} == {0: "taken", 1: "renamed", 2: "taken", 3: "unknown", 4: "unknown", 5: "empty"}
    with pytest.raises(ValueError, match="no entity has the id 77"):
        mutate.request_observations(observation, entity, spark.createDataFrame([(1, 0, "x"), (77, 1, "y")], "entity_id long, pos long, body string"))
    edits = spark.createDataFrame([(1, 0, 2, "a"), (1, 0, 1, "z"), (1, 9, 3, "none")], "entity_id long, idx int, pos int, new_body string")
    assert rows(mutate.edit_observations(observation, edits).filter("entity_id = 1")) == [(1, 0, "a"), (1, 1, "city: Rome")]
    assert mutate.delete_observations_at(observation, edits).count() == 4
    with pytest.raises(ValueError, match="attachments"):
        mutate.merge_entities(entity, relation, observation, attribute, 1, 2, spark.createDataFrame([(5, 1)], "attachment_id long, entity_id long"))
    bodies = spark.createDataFrame([(2, 3, "x", 0, "b"), (1, 2, "x", 0, "c")], f"{R}, idx int, body string")
    moves, _ = mutate.reverse_moves(relation, spark.createDataFrame([(1, 2, "x"), (2, 3, "x")], R))
    assert rows(mutate.apply_moves(bodies, moves)) == [(1, 2, "x", 0, "c"), (3, 2, "x", 0, "b")]
    made = mutate.create_relations(relation, entity, spark.createDataFrame([(1, 9, "x"), (1, 9, "x"), (1, 2, "x"), (1, 77, "x")], R))
    assert made.count() == 7
    assert rows(mutate.changes(entity, mutate.upsert_types(entity, new).filter("id <> 9"), "id", ["name", "entity_type"])) == [(1, "update"), (9, "delete")]
    assert rows(mutate.counter_deltas(entity, e, "entity_type")) == [("n", -1)]


def test_quiet_first_event_opens_revision_one(spark):
    data = [(1, 5, "update", 1, "2024-01-01 00:00:00"), (2, 5, "update", 0, "2024-01-01 00:00:00"), (3, 5, "update", 1, "2024-01-02 00:00:00"), (4, 5, "delete", 0, "2024-01-03 00:00:00"), (5, 6, "create", 0, "2024-01-01 00:00:00")]
    log = spark.createDataFrame(data, "event_id long, entity_id long, operation string, quiet int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = changelog.event_revisions(log)
    assert rows(got.select("event_id", "entity_revision")) == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 1)]
    assert rows(changelog.latest_jobs(got)) == [(5, 3, "delete"), (6, 1, "create")]


def test_claims_and_outcomes(spark):
    data = [(1, 1, "pending", 5, 0, 0), (2, 1, "pending", 4, 0, 3), (3, 2, "leased", 0, 10, 1), (4, 3, "leased", 0, 11, 1), (5, 3, "pending", 1, 0, 0), (6, 4, "pending", 11, 0, 0)]
    outbox = spark.createDataFrame(data, "delivery_id long, subscription_id long, state string, next_attempt long, lease_until long, epoch long")
    assert rows(changelog.due_claims(outbox, 10)) == [(1, 2, 4), (2, 3, 2)]
    s = spark.createDataFrame([(200, 0), (503, 7), (503, 8), (404, 0)], "s int, a int")
    assert [r[0] for r in s.select(changelog.delivery_outcome(F.col("s"), F.col("a"))).collect()] == ["done", "pending", "dead", "dead"]


def test_attachments(spark, tmp_path):
    pages = spark.createDataFrame([(1, ""), (2, "x" * 1600), (3, "é" * 1601)], "id long, text string")
    assert [(r["id"], r["chunk_index"], len(r["segment"])) for r in attachments.segments(pages).orderBy("id", "chunk_index").collect()] == [(2, 0, 1600), (3, 0, 1600), (3, 1, 1)]
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfone\r\ntwo")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    got = {r["path"][-5:]: (r["t"], r["sha256"]) for r in attachments.read_files(spark, str(tmp_path)).withColumn("t", attachments.file_text(F.col("content"))).collect()}
    assert got["a.txt"] == ("one\ntwo", hashlib.sha256(b"\xef\xbb\xbfone\r\ntwo").hexdigest()) and got["b.bin"][0] is None
    mime = spark.createDataFrame([("text/plain",), ("image/png",), (None,)], "m string").select(attachments.allowed_type(F.col("m"), ["text/*", "image/jpeg"]))
    assert [r[0] for r in mime.collect()] == [True, False, False]


def test_access(spark):
    w = spark.createDataFrame([("a", "me", False), ("b", "x", True), ("c", "x", False), ("d", "x", True)], "workspace_id string, owner string, public boolean")
    g = spark.createDataFrame([("d", "me", "writer"), ("d", "me", "reader"), ("a", "me", "reader")], "workspace_id string, principal string, role string")
    roles = access.access(w, g, "me")
    assert rows(roles) == [("a", "owner"), ("b", "reader"), ("d", "writer")]
    page, more = access.keyset_page(roles, "workspace_id", "a", 1)
    assert rows(page) == [("b", "reader")] and more.count() == 1


def test_code_graph(spark):
    py = "def a():\n    b()\n\nclass K:\n    def m(self):\n        a()\n        self.m()\n\ndef b():\n    'doc'\n\nb()\n"
    files = [("src/x.py", py), ("src/y.rs", "pub fn run() {\n}\nstruct S;\n"), ("src/bad.py", "def ("), ("target/z.py", "def q(): pass"), ("n.txt", "def q(): pass")]
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files], "path string, content binary")
    found = code.symbols(code.source_files(df))
    assert {(r["path"], r["name"], r["kind"]) for r in found.filter("role = 'def'").collect()} == {("src/x.py", n, k) for n, k in (("a", "function"), ("K", "class"), ("m", "function"), ("b", "function"))} | {("src/y.rs", "run", "function"), ("src/y.rs", "S", "struct")}
    calls = rows(code.edges(found).filter("relation_type = 'calls'").select("source", "target"))
    assert calls == [("src/x.py", "src/x.py::b"), ("src/x.py::a", "src/x.py::b"), ("src/x.py::m", "src/x.py::a")]
    assert [r["qualified"] for r in code.get_symbol(found, "run").collect()] == ["src/y.rs::run"]
    assert [r["first"] for r in code.outline(found, "src/x.py").collect()] == [1, 4, 5, 9]
    assert {r["path"]: r["kind"] for r in found.filter("role = 'file'").collect()} == {"src/x.py": "ok", "src/y.rs": "ok", "src/bad.py": "failed"}
    assert rows(code.run_report(found, 3)) == [(2, 3, 1, 6, 9)]


def test_code_of_braces_texts_and_repeated_names(spark):
    c = '/* int no(void) { */\nstatic int twice(int x) {\n    if (x) { return more(x); }\n    char *s = "lie( {";\n    return 0; // gone(x)\n}\nint proto(int);\n/* Adds\n * one. */\nint\nmain(void) { return twice(1); }\n'
    rb = "module M\n  class A\n    # Says hi.\n    def hi(x)\n      call(x)\n    end\n    def hi(y)\n    end\n  end\nend\n"
    ts = "export const f = (x) => {\n  return g(`t(${x}`);\n};\ninterface I { a: string }\nfunction g(s) { return s }\n"
    rs = "impl<'a> T<'a> {\n    pub async fn go(&self) -> u8 {\n        self.deep('{')\n    }\n}\n" + "x" * 3000
    files = [("a.c", c), ("b.rb", rb), ("c.ts", ts), ("d.rs", rs), ("e.py", None)]
    df = spark.createDataFrame([(p, t and bytearray(t.encode())) for p, t in files], "path string, content binary")
    found = code.symbols(code.source_files(df)).collect()
    defs = {r["qualified"]: (r["kind"], r["first"], r["last"], r["doc"]) for r in found if r["role"] == "def"}
    assert defs["a.c::twice"] == ("function", 2, 6, "int no(void) {") and "a.c::proto" not in defs and "a.c::no" not in defs
    assert defs["b.rb::hi"] == ("function", 4, 6, "Says hi.") and defs["b.rb::hi::L7"][1:3] == (7, 8) and defs["b.rb::M"][:3] == ("module", 1, 10)
    assert defs["c.ts::f"][:3] == ("function", 1, 3) and defs["c.ts::I"][0] == "interface" and defs["c.ts::g"][1:3] == (5, 5)
    assert defs["d.rs::go"][:3] == ("function", 2, 4)
    refs = {(r["name"], r["inside"]) for r in found if r["role"] == "ref"}
    assert {("more", "a.c::twice"), ("call", "b.rb::hi"), ("g", "c.ts::f"), ("deep", "d.rs::go")} <= refs
    assert not {"lie", "gone", "no", "if", "t"} & {n for n, _ in refs}


def test_ignored_files(spark):
    rules = "# a comment\n*.log.py\n/root.py\nout/\n!keep/out/\ndocs/**/x.py\n"
    paths_ = ["a.py", "x.log.py", "b/x.log.py", "root.py", "b/root.py", "out/a.py", "b/out/a.py", "keep/out/a.py", "docs/x.py", "docs/a/b/x.py", "docs/a/y.py", "sub/a.py", "sub/x.log.py", "sub/z.py"]
    files = [(".gitignore", rules), ("sub/.gitignore", "!*.log.py\nz.py\n"), *[(p, "x") for p in paths_]]
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files], "path string, content binary")
    got = {r["path"] for r in code.source_files(df).collect()}
    assert got == {"a.py", "b/root.py", "keep/out/a.py", "docs/a/y.py", "sub/a.py", "sub/x.log.py"}


def test_code_projects(spark, tmp_path):
    rows_ = spark.createDataFrame([("one", "a"), ("two", "b")], "project string, path string")
    code.write_projects(rows_, str(tmp_path / "p"))
    assert rows(code.read_project(spark, str(tmp_path / "p"), "two")) == [("b",)]
    with pytest.raises(ValueError, match="project"):
        code.read_project(spark, str(tmp_path / "p"), "../one")
    with pytest.raises(Exception, match="not a project name"):
        code.write_projects(rows_.withColumn("project", F.lit("a b")), str(tmp_path / "q"))


def test_envelopes(spark):
    got = events.envelopes(spark.createDataFrame([(1, "x"), (2, "y" * events.ENVELOPE_BYTES)], "delivery_id long, payload string"), "key").collect()
    assert len(got) == 1 and got[0]["body"] == '{"version":3,"delivery_id":1,"payload":"x"}'
    assert got[0]["signature"] == hmac.new(b"key", got[0]["body"].encode(), hashlib.sha256).hexdigest()


def test_stream_continues_from_its_state(spark, tmp_path):
    schema = "event_id long, entity_id long, quiet int, ts timestamp_ntz"
    made = lambda data: spark.createDataFrame(data, "event_id long, entity_id long, quiet int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for batch in ([(1, 5, 1, "2024-01-01 00:00:00"), (2, 5, 0, "2024-01-01 00:01:00")], [(3, 5, 0, "2024-01-02 00:00:00"), (4, 6, 0, "2024-01-02 00:00:00")]):
        made(batch).write.mode("append").parquet(str(tmp_path / "in"))
        events.number_available(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("event_id", "entity_revision")) == [(1, 1), (2, 2), (3, 3), (4, 1)]


def test_fan_out_of_many_subscriptions(spark):
    lists = [([], []), (["create"], []), ([], ["a"]), (["create", "delete"], ["a", "b"])]
    subs = [(f"s{i}", *lists[i % 4], ["x"] if i % 3 == 0 else [], "y" if i % 5 == 0 else "none") for i in range(1500)]
    events = [(1, "create", "a", "x"), (2, "update", "b", "y"), (3, "delete", "b", "z"), (4, "update", "c", "z")]
    want = sorted((e, s) for e, o, t, w in events for s, ops, types, out, own in subs if (not ops or o in ops) and (not types or t in types) and w not in out and w != own)
    change = spark.createDataFrame(events, "event_id long, operation string, entity_type string, origin string")
    got = changelog.fan_out(change, spark.createDataFrame(subs, "subscription_id string, operations array<string>, types array<string>, ignored_origins array<string>, own_origin string"))
    assert sorted(tuple(r) for r in got.collect()) == want
