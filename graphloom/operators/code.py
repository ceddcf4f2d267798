"""Code graph: definitions and references of source files, and the edges between them.

A file is one row and is parsed inside its task: Python with the standard library, other
languages by patterns of definitions and calls, whose extent is found by matching braces or
indentation. Each reference is given its enclosing definition there, so no join pairs the
references and definitions of a file.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import index
from graphloom.operators.limits import clamp
from graphloom.operators.search import search_nodes
from graphloom.operators.vectors import scored, top_k

SKIPPED = ("target", "node_modules", ".git", "dist", "build")
# Languages and the endings of their files.
ENDINGS = {
    "rust": "rs", "python": "py pyi", "javascript": "js jsx mjs cjs", "typescript": "ts mts cts", "tsx": "tsx", "go": "go", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp hh hxx",
    "ruby": "rb", "php": "php phtml php3 php4 php5", "scala": "scala sc",
}
LANGUAGES = {ending: lang for lang, endings in ENDINGS.items() for ending in endings.split()}
SIGNATURE, DOC, SNIPPET = 512, 512, 2000

_OPEN = r"(?:public\s+|private\s+|protected\s+|internal\s+|static\s+|final\s+|abstract\s+|sealed\s+|override\s+|implicit\s+|case\s+|inline\s+|virtual\s+|async\s+|export\s+|default\s+|declare\s+|unsafe\s+|extern\s+)*"
_TYPES = r"(?:[\w:<>,*&\[\]\s]+?[\s*&])"
_SCRIPT = [("function", rf"{_OPEN}function\s*\*?\s*(\w+)"), ("class", rf"{_OPEN}class\s+(\w+)"), ("interface", rf"{_OPEN}interface\s+(\w+)"), ("enum", rf"{_OPEN}enum\s+(\w+)"), ("function", rf"{_OPEN}(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")]
#: Patterns of definitions at the beginning of a line: (kind, pattern with the name as group 1).
PATTERNS = {
    "rust": [("function", r"(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+(\w+)"), ("struct", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)")],
    "go": [("function", r"func\s+(?:\([^)]*\)\s*)?(\w+)"), ("struct", r"type\s+(\w+)\s+struct"), ("interface", r"type\s+(\w+)\s+interface")],
    "javascript": _SCRIPT, "typescript": _SCRIPT, "tsx": _SCRIPT,
    "java": [("class", rf"{_OPEN}(?:class|record)\s+(\w+)"), ("interface", rf"{_OPEN}interface\s+(\w+)"), ("enum", rf"{_OPEN}enum\s+(\w+)"), ("function", rf"{_OPEN}{_TYPES}(\w+)\s*\([^;]*\{{")],
    "c": [("struct", r"(?:typedef\s+)?struct\s+(\w+)\s*\{"), ("enum", r"(?:typedef\s+)?enum\s+(\w+)\s*\{"), ("function", rf"{_TYPES}(\w+)\s*\([^;]*\{{")],
    "cpp": [("class", r"class\s+(\w+)[^;]*\{"), ("struct", r"struct\s+(\w+)[^;]*\{"), ("enum", r"enum\s+(?:class\s+)?(\w+)"), ("function", rf"(?:template\s*<[^>]*>\s*)?{_TYPES}(?:\w+::)*(\w+)\s*\([^;]*\{{")],
    "ruby": [("function", r"def\s+(?:self\.)?(\w+)"), ("class", r"class\s+(\w+)"), ("module", r"module\s+(\w+)")],
    "php": [("function", rf"(?:<\?php\s+)?{_OPEN}function\s+&?(\w+)"), ("class", rf"(?:<\?php\s+)?{_OPEN}(?:class|trait)\s+(\w+)"), ("interface", r"(?:<\?php\s+)?interface\s+(\w+)")],
    "scala": [("function", rf"{_OPEN}def\s+(\w+)"), ("class", rf"{_OPEN}class\s+(\w+)"), ("object", rf"{_OPEN}object\s+(\w+)"), ("trait", rf"{_OPEN}trait\s+(\w+)")],
}
_COMPILED = {lang: [(kind, re.compile(r"\s*" + p)) for kind, p in pairs] for lang, pairs in PATTERNS.items()}
_CALL = re.compile(r"(?<![\w$])([A-Za-z_]\w*)\s*\(")
#: Words before a parenthesis that call nothing.
NO_CALLS = frozenset("if for while switch catch return sizeof match when until unless elsif and or not in is new await yield throw function func fn def class synchronized with super this print".split())
_HASH = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*|//[^\n]*|/\*.*?\*/', re.S)
_TEXTS = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/', re.S)
_CHARS = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\'|//[^\n]*|/\*.*?\*/', re.S)
_ASIDE = {"ruby": re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*'), "php": _HASH, "javascript": _TEXTS, "typescript": _TEXTS, "tsx": _TEXTS}


def language(path: Column) -> Column:
    """Language by file ending; null for unknown ones."""
    ending = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    names = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(names, ending)


def ignore_rules(files: DataFrame) -> DataFrame:
    """(base, pos, pattern, unless): the rules of the .gitignore files among ``files`` (path, content), as patterns of paths below their folder.

    Blank lines and comments are none; ``!`` takes back, a closing ``/`` names folders, a
    ``/`` elsewhere binds to the folder, ``*`` stays in a part and ``**`` spans parts.
    """

    def translated(rule: str) -> str:
        anchored = "/" in rule.rstrip("/")
        body = re.escape(rule.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        return f"^{'' if anchored else '(?:.*/)?'}{body}{'/' if rule.endswith('/') else '(?:/|$)'}"

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for path, text in zip(p["path"], p["text"], strict=True):
                lines = [x.rstrip() for x in (text or "").splitlines()]
                kept = [x for x in lines if x.strip("!/") and not x.startswith("#")]
                out += [(path.rpartition("/")[0], i, translated(x.lstrip("!")), x.startswith("!")) for i, x in enumerate(kept)]
            yield pd.DataFrame(out, columns=["base", "pos", "pattern", "unless"])

    rules = files.filter((F.col("path") == ".gitignore") | F.col("path").endswith("/.gitignore")).select("path", F.col("content").cast("string").alias("text"))
    return rules.mapInPandas(rows, "base string, pos int, pattern string, unless boolean")


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (path, ...) that the last matching rule of the deepest folder doesn't leave out."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = files.select("path", F.explode(above).alias("base"))
    below = F.when(F.col("base") == "", F.col("path")).otherwise(F.expr("substring(path, length(base) + 2)"))
    hits = asked.join(rules, "base").filter(F.rlike(below, F.col("pattern")))
    last = hits.groupBy("path").agg(F.max_by("unless", F.struct(F.length("base"), "pos")).alias("unless"))
    return files.join(last.filter("NOT unless"), "path", "left_anti").select(files.columns)


def source_files(files: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """Files (path, content) of a known language, not too long, outside build folders and not ignored."""
    skipped = F.exists(F.split("path", "/"), lambda p: p.isin(*SKIPPED))
    known = files.withColumn("lang", language(F.col("path"))).filter(F.col("lang").isNotNull() & ~skipped & (F.octet_length("content") <= most_bytes))
    return not_ignored(known, ignore_rules(files))


def _python(text: str) -> Iterator[tuple]:
    tree = ast.parse(text)
    lines = text.split("\n")
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            yield ("def", kind, node.name, node.lineno, node.end_lineno, lines[node.lineno - 1].strip(), (ast.get_docstring(node) or ""))
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                yield ("ref", "call", name, node.lineno, node.lineno, "", "")


def _last_line(lines: list[str], at: int, lang: str) -> int:
    """Place of the line that closes the definition at line ``at``."""
    if lang == "ruby":
        margin = len(lines[at]) - len(lines[at].lstrip())
        if re.search(r";\s*end\b", lines[at]):
            return at
        return next((i for i in range(at + 1, len(lines)) if re.match(rf"\s{{{margin}}}end\b", lines[i])), at)
    depth = 0
    for i in range(at, len(lines)):
        for c in lines[i]:
            if c == ";" and not depth:
                return i
            depth += (c == "{") - (c == "}")
            if c == "}" and not depth:
                return i
        if not depth and i > at:
            return at  # no body follows
    return len(lines) - 1


def _doc_above(lines: list[str], at: int) -> str:
    found: list[str] = []
    while at and (m := re.match(r"\s*(?://+!?|#+|/\*+|\*+/?)\s?(.*?)(?:\*/)?\s*$", lines[at - 1])):
        found.append(m[1])
        at -= 1
    return "\n".join(reversed(found)).strip()


def _patterned(text: str, lang: str) -> Iterator[tuple]:
    raw = text.split("\n")
    # Texts and comments hold no definitions: blanks and line ends stay in their place.
    lines = _ASIDE.get(lang, _CHARS).sub(lambda m: "\n" * m[0].count("\n") or " ", text).split("\n")
    for at, line in enumerate(lines):
        named = None
        for kind, pattern in _COMPILED[lang]:
            if (m := pattern.match(line)) and m[1] not in NO_CALLS:
                named = m
                yield ("def", kind, m[1], at + 1, _last_line(lines, at, lang) + 1, raw[at].strip(), _doc_above(raw, at))
                break
        for m in _CALL.finditer(line):
            if m[1] not in NO_CALLS and not (named and m.start(1) == named.start(1)):
                yield ("ref", "call", m[1], at + 1, at + 1, "", "")


def _located(path: str, lang: str, text: str) -> Iterator[tuple]:
    """Rows of one file: definitions under their qualified name, references with the smallest definition around them."""
    lines = text.split("\n")
    found = list(_python(text) if lang == "python" else _patterned(text, lang))
    spans, seen = [], set()
    for role, kind, name, first, last, signature, doc in sorted((x for x in found if x[0] == "def"), key=lambda x: (x[3], x[1], x[2])):
        qualified = f"{path}::{name}::L{first}" if name in seen else f"{path}::{name}"
        seen.add(name)
        spans.append((first, last, qualified))
        snippet = "\n".join(lines[first - 1 : last])
        yield (path, lang, role, kind, name, qualified, None, first, last, signature[:SIGNATURE], doc[:DOC], snippet if len(snippet) <= SNIPPET else snippet[:SNIPPET] + "…")
    # Definitions are nested: those open at a line are a stack in order of their first lines.
    stack: list[tuple[int, int, str]] = []
    at = 0
    for role, kind, name, first, last, *_ in sorted((x for x in found if x[0] == "ref"), key=lambda x: x[3]):
        while at < len(spans) and spans[at][0] <= first:
            stack.append(spans[at])
            at += 1
        stack = [x for x in stack if x[1] >= first]
        inside = min(stack, key=lambda x: (x[1] - x[0], x[2]))[2] if stack else path
        yield (path, lang, role, kind, name, None, inside, first, last, "", "", "")


def symbols(files: DataFrame) -> DataFrame:
    """(path, lang, role, kind, name, qualified, inside, first, last, signature, doc, snippet) of each definition (def) and reference (ref).

    Each file has a row of role ``file`` too, of kind ``ok``, or ``failed`` if it doesn't
    parse, isn't UTF-8 or has no content. A definition is named path::name, and ::L<line>
    if it repeats a name of its file; ``inside`` is the smallest definition around a
    reference, else its path. A snippet that is cut ends in an ellipsis.
    """
    columns = ["path", "lang", "role", "kind", "name", "qualified", "inside", "first", "last", "signature", "doc", "snippet"]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for path, lang, data in zip(p["path"], p["lang"], p["content"], strict=True):
                try:
                    found, kind = list(_located(path, lang, bytes(data).decode("utf-8"))), "ok"
                except (SyntaxError, ValueError, RecursionError, TypeError):
                    found, kind = [], "failed"
                out += [(path, lang, "file", kind, path, None, None, None, None, "", "", ""), *found]
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({"first": "Int32", "last": "Int32"})

    texts = files.select("path", "lang", F.col("content").cast("binary").alias("content"))
    return texts.mapInPandas(rows, "path string, lang string, role string, kind string, name string, qualified string, inside string, first int, last int, signature string, doc string, snippet string")


def definitions(found: DataFrame) -> DataFrame:
    return found.filter("role = 'def'")


def edges(found: DataFrame) -> DataFrame:
    """(source, target, relation_type): files define symbols; callers call symbols whose bare name is defined once.

    The caller is the smallest definition around the reference, else its file; calls to oneself are left out.
    """
    defs = definitions(found)
    owns = defs.select(F.col("path").alias("source"), F.col("qualified").alias("target"), F.lit("defines").alias("relation_type"))
    single = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("qualified").alias("target")).filter("n = 1").select("name", "target")
    refs = found.filter("role = 'ref'").select("name", F.col("inside").alias("source")).distinct()
    calls = refs.join(single, "name").select("source", "target", F.lit("calls").alias("relation_type"))
    return owns.union(calls.filter("source <> target")).distinct()


def run_report(found: DataFrame, skipped: int) -> DataFrame:
    """(files_indexed, files_skipped, files_failed, symbols, relations) of an index run over ``found``; ``skipped`` files had not changed."""
    n = lambda test: F.count(F.when(test, 1))
    role, kind = F.col("role"), F.col("kind")
    counts = found.agg(n((role == "file") & (kind == "ok")).alias("files_indexed"), n((role == "file") & (kind == "failed")).alias("files_failed"), n(role == "def").alias("symbols"))
    rows = counts.crossJoin(edges(found).agg(F.count(F.lit(1)).alias("relations")))  # one row each
    return rows.select("files_indexed", F.lit(skipped).cast("long").alias("files_skipped"), "files_failed", "symbols", "relations")


def outline(found: DataFrame, path: str) -> DataFrame:
    return definitions(found).filter(F.col("path") == path).select("qualified", "kind", "first", "last", "signature").orderBy("first", "qualified")


def get_symbol(found: DataFrame, name: str, most: int = 10) -> DataFrame:
    """The symbol of this qualified name, else those that end in ``::name``."""
    defs = definitions(found)
    rows = defs.filter((F.col("qualified") == name) | F.col("qualified").endswith(f"::{name}")).withColumn("exact", F.col("qualified") == name)
    best = rows.agg(F.max("exact").alias("any"))
    return rows.crossJoin(best).filter(F.col("exact") | ~F.col("any")).drop("exact", "any").orderBy("qualified").limit(most)  # best is one row


def symbol_page(found: DataFrame, name: str, most: int = 10) -> DataFrame:
    """``get_symbol`` with ``callers`` and ``callees``, each sorted."""
    calls = edges(found).filter("relation_type = 'calls'")
    rows = get_symbol(found, name, most)
    callers = calls.groupBy(F.col("target").alias("qualified")).agg(F.array_sort(F.collect_set("source")).alias("callers"))
    callees = calls.groupBy(F.col("source").alias("qualified")).agg(F.array_sort(F.collect_set("target")).alias("callees"))
    none = F.array().cast("array<string>")
    return rows.join(callers, "qualified", "left").join(callees, "qualified", "left").withColumns({"callers": F.coalesce("callers", none), "callees": F.coalesce("callees", none)})


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, sha256) that are new or whose hash differs from ``known``."""
    return files.join(known.select("path", "sha256"), ["path", "sha256"], "left_anti")


def reindex(found: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """``found`` after a run over ``files`` (path, content, lang): rows of changed and vanished files go, those of changed and new ones come.

    ``known`` (path, sha256) are the hashes of the files that ``found`` is from; others are not parsed again.
    """
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    changed = changed_files(hashed, known)
    gone = known.select("path").join(hashed.select("path"), "path", "left_anti").union(changed.select("path"))
    return found.join(gone, "path", "left_anti").select(found.columns).union(symbols(changed).select(found.columns))


PROJECT = r"^[A-Za-z0-9_-]{1,64}$"


def write_projects(found: DataFrame, path: str) -> None:
    """Write ``found`` (project, ...) under ``path``, each project in a folder of its own; a name that isn't 1 to 64 letters, digits, ``_`` or ``-`` is an error."""
    named = F.when(F.rlike("project", F.lit(PROJECT)), F.col("project")).otherwise(F.raise_error(F.lit("not a project name")).cast("string"))
    found.withColumn("project", named).write.partitionBy("project").parquet(path)


def read_project(spark: SparkSession, path: str, project: str) -> DataFrame:
    """The rows of one project; no other project's files are read."""
    if not re.match(PROJECT, project):
        raise ValueError("not a project name")
    return spark.read.parquet(path).filter(F.col("project") == project).drop("project")


def callers_and_callees(relation: DataFrame, symbol: str, most: int = 500) -> DataFrame:
    """(role, symbol): up to ``most`` callers and callees each of a symbol, over edges (source, target, relation_type)."""
    calls = relation.filter(F.col("relation_type").isin("calls", "references"))
    callers = calls.filter(F.col("target") == symbol).select(F.lit("caller").alias("role"), F.col("source").alias("symbol")).distinct().orderBy("symbol").limit(most)
    callees = calls.filter(F.col("source") == symbol).select(F.lit("callee").alias("role"), F.col("target").alias("symbol")).distinct().orderBy("symbol").limit(most)
    return callers.union(callees)


# Results by default and at most, candidates for each result and at most (words, vectors), embeddings in a request.
RESULTS, RESULTS_MOST, FETCH, WORD_MOST, VECTOR_MOST, EMBEDDINGS = 20, 500, 5, 1000, 100, 1000


def graph_tables(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, observation) of files and symbols: names and ids are paths and qualified names; bodies are signature, doc and snippet."""
    defs = definitions(found)
    files = found.filter("role = 'file' AND kind = 'ok'").select(F.col("path").alias("id"), F.col("path").alias("name"), F.lit("code:file").alias("entity_type"))
    entity = files.union(defs.select("qualified", "qualified", F.concat(F.lit("code:"), "kind")))
    observation = defs.select(F.col("qualified").alias("entity_id"), F.posexplode(F.array("signature", "doc", "snippet")).alias("idx", "body")).filter("body <> ''")
    return entity, observation


def _of_kind(rows: DataFrame, kind: str | None, lang: str | None) -> DataFrame:
    rows = rows.filter(F.col("kind") == kind) if kind else rows
    return rows.filter(F.col("lang") == lang) if lang else rows


def search_symbols(found: DataFrame, terms: Sequence[str], kind: str | None = None, lang: str | None = None, limit: int | None = None) -> DataFrame:
    """(qualified, kind, lang): symbols whose name, then whose bodies, hold all terms.

    Files and the filters of kind and language go after the candidates are capped, so a
    filtered list may be short.
    """
    n = clamp(limit, RESULTS, RESULTS_MOST)
    entity, observation = graph_tables(found)
    names = index(entity.select("id", F.lit(0).alias("idx"), F.col("name").alias("body")), "id", "idx")
    hits = search_nodes(entity, names, index(observation, "entity_id", "idx"), terms, limit=min(FETCH * n, WORD_MOST)).select(F.col("id").alias("qualified"), "place")
    rows = _of_kind(definitions(found).join(hits, "qualified"), kind, lang)
    return rows.orderBy("place").limit(n).select("qualified", "kind", "lang")


def upsert_embeddings(vectors: DataFrame, new: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """(vectors, errors): ``vectors`` (symbol, embedding) with ``new`` (pos, symbol, embedding) in, and new rows (pos, error) that are refused.

    The later position of a symbol wins. Refused: no symbol, no vector, another length, a value that isn't finite.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fault = F.when(F.coalesce("symbol", F.lit("")) == "", "name").when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != dimensions, "length").when(~finite, "finite")
    checked = new.withColumn("error", fault)
    last = checked.filter("error IS NULL").groupBy("symbol").agg(F.max_by("embedding", "pos").alias("embedding"))
    kept = vectors.select("symbol", "embedding").join(last, "symbol", "left_anti")
    return kept.union(last), checked.filter("error IS NOT NULL").select("pos", "error")


def near_symbols(found: DataFrame, vectors: DataFrame, query: DataFrame, kind: str | None = None, lang: str | None = None, limit: int | None = None) -> DataFrame:
    """(qualified, kind, lang, distance): symbols nearest to the one-row frame ``query`` (q) by cosine; filters go after the cap on candidates."""
    n = clamp(limit, RESULTS, RESULTS_MOST)
    hits = top_k(scored(vectors, query), min(FETCH * n, VECTOR_MOST), "symbol").select(F.col("symbol").alias("qualified"), "distance")
    rows = _of_kind(definitions(found).join(hits, "qualified"), kind, lang)
    return rows.orderBy("distance", "qualified").limit(n).select("qualified", "kind", "lang", "distance")
