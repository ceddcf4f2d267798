"""Queries of the code graph, over source files that are derived from the parts: one file a part, in twelve languages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import code as K
from graphloom.operators import vectors as V
from graphloom.plans.registry import query
from graphloom.sources.shared import shared_dir

#: (language, ending, class line, heads of two functions, their close, kind of the class, the class's close): # is the part.
#: Line 1 holds the class, lines 3 to 5 the first function, lines 7 to 10 the second and a comment above it.
_FORMS = [
    ("rust", "rs", "pub struct Box#;", "fn aid_#() -> i32 {", "pub fn run_#() -> i32 {", "}", "struct", ""),
    ("python", "py", "class Box#: pass", "def aid_#():", "def run_#():", "", "class", ""),
    ("javascript", "js", "export class Box# {}", "function aid_#() {", "export async function run_#() {", "}", "class", ""),
    ("typescript", "ts", "interface Box# { x: number }", "function aid_#(): number {", "export const run_# = () => {", "}", "interface", ""),
    ("tsx", "tsx", "export default class Box# {}", "function aid_#() {", "function run_#() {", "}", "class", ""),
    ("go", "go", "type Box# struct{}", "func aid_#() int {", "func (b Box#) run_#() int {", "}", "struct", ""),
    ("java", "java", "public class Box# {", "private static int aid_#() {", "public int run_#() {", "}", "class", "}"),
    ("c", "c", "struct Box# { int x; };", "static int aid_#(void) {", "int run_#(char *s) {", "}", "struct", ""),
    ("cpp", "cpp", "class Box# { int x; };", "int aid_#() {", "std::vector<int> Box#::run_#() {", "}", "class", ""),
    ("ruby", "rb", "class Box#; end", "def aid_#()", "def self.run_#()", "end", "class", ""),
    ("php", "php", "<?php class Box# {}", "function aid_#() {", "function run_#() {", "}", "class", ""),
    ("scala", "scala", "object Box# {", "def aid_#(): Int = {", "private def run_#(): Int = {", "}", "object", "}"),
]
_N = len(_FORMS)


def _pick(column: str, i: int):
    return F.element_at(F.array(*[F.lit(f[i]) for f in _FORMS]), (F.col(column) % _N + 1).cast("int"))


def _files(g, changed: bool = False):
    """(path, content): the file of each part; every fifth of a second state is another, every seventh gone.

    A function ``run`` calls the file's own ``aid`` and the next part's ``run``.
    """
    k = F.col("p_partkey")
    comment = F.when(k % _N == 1, "# shared by all ").when(k % _N == 9, "# shared by all ").otherwise("// shared by all ")
    call = F.concat(F.lit("    return aid_#() + run_"), (k + 1).cast("string"), F.lit("()"), F.when((k % _N == 1) | (k % _N == 9), "").otherwise(";"))
    if changed:
        call = F.when(k % 5 == 0, F.concat(F.lit("    return aid_"), (k + 2).cast("string"), F.lit("()"))).otherwise(call)
    semi = F.when((k % _N == 1) | (k % _N == 9), "").otherwise(";")
    lines = [_pick("p_partkey", 2), F.lit(""), _pick("p_partkey", 3), F.concat(F.lit("    return 1"), semi), _pick("p_partkey", 5), F.lit(""), F.concat(comment, F.lit("boxes run(x)")), _pick("p_partkey", 4), call, _pick("p_partkey", 5), _pick("p_partkey", 7)]
    text = F.replace(F.array_join(F.array(*lines), "\n"), F.lit("#"), k.cast("string"))
    # The mark stands for the part in code, and for itself in the comments of two languages.
    text = F.when((k % _N == 1) | (k % _N == 9), F.replace(text, F.concat(k.cast("string"), F.lit(" shared")), F.lit("# shared"))).otherwise(text)
    rows = g.table("part").select(k, F.concat(F.lit("src/m"), F.floor(k / 100).cast("string"), F.lit("/f"), k.cast("string"), F.lit("."), _pick("p_partkey", 1)).alias("path"), F.encode(text, "utf-8").alias("content"))
    return (rows.filter("p_partkey % 7 <> 0") if changed else rows).select("path", "content")


def _found(g):
    """The symbols of all files, parsed once in a session."""
    return g.kept("code", lambda: K.symbols(K.source_files(_files(g))))


_VALUES = ", ".join(f"({i}, '{f[0]}', '{f[1]}', '{f[6]}', {11 if f[7] else 1}, {4 if f[0] == 'python' else 5}, {9 if f[0] == 'python' else 10})" for i, f in enumerate(_FORMS))
_CODE = f"""
form AS (SELECT * FROM (VALUES {_VALUES}) AS v(i, lang, ending, kind, box_last, aid_last, run_last)),
file AS (SELECT p_partkey AS k, 'src/m' || p_partkey // 100 || '/f' || p_partkey || '.' || ending AS path, form.* FROM part JOIN form ON i = p_partkey % {_N}),
defs AS (
  SELECT k, path, lang, kind, 'Box' || k AS name, path || '::Box' || k AS qualified, 1 AS first, box_last AS last FROM file
  UNION ALL SELECT k, path, lang, 'function', 'aid_' || k, path || '::aid_' || k, 3, aid_last FROM file UNION ALL SELECT k, path, lang, 'function', 'run_' || k, path || '::run_' || k, 8, run_last FROM file),
calls AS (
  SELECT a.path || '::run_' || k AS source, path || '::aid_' || k AS target FROM file a
  UNION ALL SELECT a.path || '::run_' || a.k, b.path || '::run_' || b.k FROM file a JOIN file b ON b.k = a.k + 1)"""


@query("code_defs", _CODE + ";;SELECT path, lang, kind, qualified, first, last FROM defs")
def code_defs(g):
    return K.definitions(_found(g)).select("path", "lang", "kind", "qualified", "first", "last")


@query("code_calls", _CODE + ";;SELECT source, target FROM calls")
def code_calls(g):
    return K.edges(_found(g)).filter("relation_type = 'calls'").select("source", "target")


@query("code_outline", _CODE + ";;SELECT qualified, kind, first, last FROM defs WHERE k = 18")
def code_outline(g):
    return K.outline(_found(g), "src/m0/f18.java").drop("signature")


@query("code_get_symbol", _CODE + """;;
SELECT qualified, kind, 'shared by all boxes run(x)' AS doc, (SELECT string_agg(source, ',' ORDER BY source) FROM calls WHERE target = qualified) AS callers,
       (SELECT string_agg(target, ',' ORDER BY target) FROM calls WHERE source = qualified) AS callees FROM defs WHERE name = 'run_19'""")
def code_get_symbol(g):
    rows = K.symbol_page(_found(g), "run_19")
    return rows.select("qualified", "kind", "doc", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query("code_run_report", _CODE + ";;SELECT (SELECT count(*) FROM file) AS files_indexed, CAST(7 AS BIGINT) AS files_skipped, CAST(1 AS BIGINT) AS files_failed, (SELECT count(*) FROM defs) AS symbols, (SELECT count(*) FROM defs) + (SELECT count(*) FROM calls) AS relations")
def code_run_report(g):
    broken = g.spark.createDataFrame([("src/bad.py", bytearray(b"def (")), ("build/x.py", bytearray(b"x()")), ("notes.txt", bytearray(b"run()"))], "path string, content binary")
    return K.run_report(_found(g).union(K.symbols(K.source_files(broken))), 7)


@query("code_callers", _CODE + ";;SELECT 'caller' AS role, source AS symbol FROM calls WHERE target = 'src/m0/f19.c::run_19' UNION ALL SELECT 'callee', target FROM calls WHERE source = 'src/m0/f19.c::run_19'")
def code_callers(g):
    return K.callers_and_callees(K.edges(_found(g)), "src/m0/f19.c::run_19")


@query("code_search", _CODE + ";;SELECT qualified, kind, lang FROM defs WHERE path = 'src/m0/f19.c'")
def code_search(g):
    """Names are words of path and name: the file itself is a candidate and is left out."""
    return K.search_symbols(_found(g), ["m0", "f19"])


@query("code_search_bodies", _CODE + ";;SELECT qualified, kind, lang FROM defs WHERE lang = 'scala' AND kind = 'function' AND starts_with(name, 'run_') AND qualified IN (SELECT qualified FROM defs WHERE (starts_with(name, 'run_') AND lang <> 'python') OR (starts_with(name, 'Box') AND lang IN ('java', 'scala')) ORDER BY qualified LIMIT 100)")
def code_search_bodies(g):
    """The comment above a function is found, in the snippet of a class around it too; the filters go after the cap on candidates."""
    return K.search_symbols(_found(g), ["shared", "boxes"], kind="function", lang="scala")


@query("code_changed", _CODE + """,
c AS (SELECT k, path || '::run_' || k AS source, k % 5 = 0 AS other FROM file WHERE k % 7 <> 0);;
SELECT source, path || '::aid_' || b.k AS target FROM c JOIN file b ON b.k = c.k + 2 WHERE other AND b.k % 7 <> 0
UNION ALL SELECT source, path || '::aid_' || b.k FROM c JOIN file b ON b.k = c.k WHERE NOT other
UNION ALL SELECT source, path || '::run_' || b.k FROM c JOIN file b ON b.k = c.k + 1 WHERE NOT other AND b.k % 7 <> 0""")
def code_changed(g):
    """Calls after some files changed and some went; only changed files are parsed again."""
    known = _files(g).select("path", F.sha2("content", 256).alias("sha256"))
    return K.edges(K.reindex(_found(g), known, K.source_files(_files(g, changed=True)))).filter("relation_type = 'calls'").select("source", "target")


@query("code_project", _CODE + ";;SELECT path, qualified FROM defs WHERE k % 3 = 1")
def code_project(g):
    """One of three projects, read from a folder of its own."""
    path = f"{shared_dir(g.spark)}/projects-{uuid.uuid4().hex}"
    k = F.regexp_extract("path", "f([0-9]+)\\.", 1).cast("long")
    K.write_projects(_found(g).withColumn("project", F.concat(F.lit("team-"), (k % 3).cast("string"))), path)
    return K.definitions(K.read_project(g.spark, path, "team-1")).select("path", "qualified")


_PLACES = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % 64 AS place, 1 - 2 * (CAST('0x' || substr(md5({0}), 9, 1) AS BIGINT) % 2) AS sign"


def embedded_sql(source: str, key: str, text: str) -> str:
    """Common table expressions: the hashed embedding of each ``key`` of ``source`` as rows (key, place, x)."""
    return f"""hashed AS (SELECT {key}, w, {_PLACES.format('w')} FROM (SELECT {key}, unnest(regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source})),
summed AS (SELECT {key}, place, CAST(sum(sign) AS DOUBLE) AS x FROM hashed GROUP BY {key}, place),
embedded AS (SELECT {key}, place, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM summed WHERE x <> 0)"""


def _embedded(g):
    found = _found(g)
    return found, K.definitions(found).select(F.col("qualified").alias("symbol"), V.hashed_embedding(F.concat_ws(" ", "lang", "kind", "name", "doc")).alias("embedding"))


@query("code_semantic_search", _CODE + ", texts AS (SELECT *, lang || ' ' || kind || ' ' || name || CASE WHEN starts_with(name, 'run_') THEN ' shared by all boxes run(x)' ELSE '' END AS t FROM defs), " + embedded_sql("texts", "qualified", "t") + """,
q AS (SELECT place, x AS y FROM embedded WHERE qualified = 'src/m0/f19.c::run_19'),
d AS (SELECT qualified, round(1 - sum(CASE WHEN q.place IS NOT NULL THEN x * y ELSE 0 END), 6) + 0.0 AS distance FROM embedded LEFT JOIN q USING (place) GROUP BY qualified),
n AS (SELECT * FROM d ORDER BY distance, qualified LIMIT 100);;
SELECT qualified, kind, lang, distance FROM n JOIN defs USING (qualified) WHERE kind = 'function' ORDER BY distance, qualified LIMIT 20""")
def code_semantic_search(g):
    """Symbols near the embedding of one of them."""
    found, vectors = _embedded(g)
    asked = vectors.filter("symbol = 'src/m0/f19.c::run_19'").select(F.col("embedding").alias("q"))
    return K.near_symbols(found, vectors, asked, kind="function")


@query("code_embed", "SELECT 'Part#' || p_partkey AS symbol, CAST(CASE WHEN p_partkey % 3 = 0 THEN 9 WHEN p_partkey % 3 = 1 THEN 1 ELSE 2 END AS DOUBLE) AS x FROM part")
def code_embed(g):
    """Every third vector is replaced, the later of two; every third is refused."""
    name, k = F.concat(F.lit("Part#"), F.col("p_partkey").cast("string")), F.col("p_partkey") % 3
    p = g.table("part")
    one = lambda x: F.array(F.lit(x), F.lit(0.0))
    old = p.select(name.alias("symbol"), F.when(k == 1, one(1.0)).otherwise(one(2.0)).alias("embedding"))
    new = p.filter(k == 0).select(F.lit(1).alias("pos"), name.alias("symbol"), one(9.0).alias("embedding")).union(p.filter(k == 0).select(F.lit(0), name, one(8.0)))
    new = new.union(p.filter(k == 1).select(F.lit(2), name, F.array(F.lit(1.0)))).union(p.filter(k == 2).select(F.lit(3), F.lit(""), one(5.0))).union(p.filter(k == 2).select(F.lit(4), name, F.array(F.lit(float("nan")), F.lit(0.0))))
    rows, _ = K.upsert_embeddings(old, new, 2)
    return rows.select("symbol", F.element_at("embedding", 1).alias("x"))
