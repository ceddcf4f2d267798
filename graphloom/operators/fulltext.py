"""The query language of full-text search over positional postings.

A query is compiled into one expression over rows (owner, idx): the postings of all its
words are read by a predicate on the sorted index, gathered for each text, and phrases,
NEAR groups, AND, OR, NOT and brackets become array expressions on positions. One
shuffle of these postings answers a query of any shape; no text is read.

    alpha beta          both                      "alpha beta"      in a row, as alpha + beta
    alpha OR beta       one of them               alph*  "a b"*     a beginning of a word
    alpha NOT beta      the first only            ^alpha            at the beginning of the text
    NEAR(a "b c", 5)    with at most five words between the first and the last (10 if not said)

NOT binds tighter than AND, AND than OR; words side by side bind tightest of all and don't
stand beside brackets. A query that doesn't follow this finds nothing.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import MARKED, PLAIN
from graphloom.operators.search import B, K1, _merged, _relations, earlier, index_totals

NEAR_WORDS = 10
_LEXEME = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([\w\u0080-\U0010ffff]+)|([()*+^,]))')


def words_of(text: str) -> list[str]:
    """Folded words of a query's term, as ``functions.text.tokens`` cuts texts."""
    plain = "".join(c for c in text.lower().translate(str.maketrans(MARKED, PLAIN)) if not unicodedata.category(c).startswith("M"))
    return re.findall(r"[^\W_]+", plain)


class _Parser:
    """Recursive descent; nodes are tuples, phrases numbered in ``phrases`` as (words, prefix, first)."""

    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        self.phrases: list[tuple[list[str], bool, bool]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _LEXEME.match(text, at)
            if not m:
                raise ValueError("no such symbol")
            quoted, bare, symbol = m.groups()
            self.items.append(("term", quoted.replace('""', '"')) if quoted is not None else (bare, bare) if bare in ("AND", "OR", "NOT") else ("term", bare) if bare else (symbol, symbol))
            if bare == "NEAR" and text[m.end() :].lstrip().startswith("("):
                self.items[-1] = ("NEAR", bare)
            at = m.end()

    def next(self, *kinds: str) -> str | None:
        if self.items and self.items[0][0] in kinds:
            return self.items.pop(0)[1]
        return None

    def need(self, kind: str) -> str:
        got = self.next(kind)
        if got is None:
            raise ValueError(f"{kind} expected")
        return got

    def whole(self):
        node = self.binary("OR")
        if self.items:
            raise ValueError("more than a query")
        return node

    def binary(self, kind: str):
        below = {"OR": lambda: self.binary("AND"), "AND": lambda: self.binary("NOT"), "NOT": self.run}[kind]
        node = below()
        while self.next(kind):
            node = (kind, node, below())
        return node

    def run(self):
        if self.next("("):
            node = self.binary("OR")
            self.need(")")
            if self.items and self.items[0][0] in ("term", "NEAR", "^", "("):
                raise ValueError("brackets need an operator")
            return node
        parts = [self.unit()]
        while self.items and self.items[0][0] in ("term", "NEAR", "^"):
            parts.append(self.unit())
        if self.items and self.items[0][0] == "(":
            raise ValueError("brackets need an operator")
        # A term without words is passed over beside others, and alone finds nothing.
        full = [p for p in parts if p != ("none",)]
        return reduce(lambda a, b: ("AND", a, b), full) if full else ("none",)

    def unit(self):
        if self.next("NEAR"):
            self.need("(")
            group, apart = [], NEAR_WORDS
            while self.items and self.items[0][0] in ("term", "^"):
                group.append(self.phrase())
            if self.next(","):
                apart = int(self.need("term"))
            self.need(")")
            if not group:
                raise ValueError("nothing is near")
            group = [p for p in group if p != ("none",)]
            return ("NEAR", apart, group) if len(group) > 1 else group[0] if group else ("none",)
        return self.phrase()

    def phrase(self):
        first = self.next("^") is not None
        words = words_of(self.need("term"))
        while self.next("+"):
            words += words_of(self.need("term"))
        prefix = self.next("*") is not None
        if not words:
            return ("none",)
        self.phrases.append((words, prefix, first))
        return ("phrase", len(self.phrases) - 1)


def parse(text: str) -> tuple[tuple, list[tuple[list[str], bool, bool]]] | None:
    """(tree, phrases), or None of a query that is no query."""
    try:
        p = _Parser(text or "")
        return p.whole(), p.phrases
    except (ValueError, RecursionError):
        return None


def _starts(phrase: tuple[list[str], bool, bool], terms: dict[tuple[str, bool], str]) -> Column:
    """Sorted positions at which a phrase begins."""
    words, prefix, first = phrase
    names = [terms[w, prefix and i == len(words) - 1] for i, w in enumerate(words)]
    shifted = [F.col(names[0]), *[earlier(n, i) for i, n in enumerate(names) if i]]
    starts = F.array_sort(reduce(F.array_intersect, shifted))
    return F.filter(starts, lambda x: x == 0) if first else starts


def _holds(node: tuple, lengths: list[int]) -> Column:
    kind = node[0]
    if kind == "none":
        return F.lit(False)
    if kind == "phrase":
        return F.size(f"__s{node[1]}") > 0
    if kind == "NEAR":
        own = [n[1] for n in node[2]]
        # The last phrase starts at m; every other ends at most the allowed number of words before.
        ends = F.array_distinct(F.flatten(F.array(*[F.col(f"__s{i}") for i in own])))
        close = lambda i, m: F.exists(f"__s{i}", lambda s: (s <= m) & (s >= m - lengths[i] - node[1]))
        return F.exists(ends, lambda m: reduce(lambda a, b: a & b, [close(i, m) for i in own]))
    a, b = _holds(node[1], lengths), _holds(node[2], lengths)
    return a & b if kind == "AND" else a | b if kind == "OR" else a & ~b


def _gathered(index: DataFrame, phrases: list[tuple[list[str], bool, bool]]) -> DataFrame:
    """(owner, idx, n, __s0, ...): texts with a word of the query, and the starts of each phrase in them."""
    terms: dict[tuple[str, bool], str] = {}
    for words, prefix, _ in phrases:
        for i, w in enumerate(words):
            terms.setdefault((w, prefix and i == len(words) - 1), f"__t{len(terms)}")
    is_ = lambda w, prefix: F.col("token").startswith(w) if prefix else F.col("token") == w
    whole = [w for w, prefix in terms if not prefix]
    tests = ([F.col("token").isin(whole)] if whole else []) + [is_(w, True) for w, prefix in terms if prefix]
    hits = index.filter(reduce(lambda a, b: a | b, tests))
    gathered = hits.groupBy("owner", "idx", "n").agg(*[F.flatten(F.collect_list(F.when(is_(*t), F.col("positions")))).alias(name) for t, name in terms.items()])
    return gathered.select("owner", "idx", "n", *[_starts(p, terms).alias(f"__s{i}") for i, p in enumerate(phrases)])


def find(index: DataFrame, query: str) -> DataFrame:
    """(owner, idx): texts that ``query`` finds in a positional index; none if it is malformed or blank."""
    parsed = parse(query)
    if parsed is None or not parsed[1]:
        return index.filter(F.lit(False)).select("owner", "idx")
    tree, phrases = parsed
    return _gathered(index, phrases).filter(_holds(tree, [len(p[0]) for p in phrases])).select("owner", "idx")


def find_ranked(index: DataFrame, query: str, totals: tuple[int, float]) -> DataFrame:
    """(owner, idx, rank): as :func:`find`, with the rank of a stored full-text table, best (lowest) first.

    Minus BM25 over the phrases of the query, beginnings of words included, each with
    idf = ln((N - df + 0.5) / (df + 0.5)), 1e-6 at least, df the texts that hold it; to nine digits.
    """
    parsed = parse(query)
    if parsed is None or not parsed[1]:
        return index.filter(F.lit(False)).select("owner", "idx", F.lit(0.0).alias("rank"))
    tree, phrases = parsed
    docs, mean = totals
    rows = _gathered(index, phrases)
    found = rows.agg(*[F.count(F.when(F.size(f"__s{i}") > 0, 1)).alias(f"__d{i}") for i in range(len(phrases))])
    rows = rows.filter(_holds(tree, [len(p[0]) for p in phrases])).crossJoin(F.broadcast(found))  # one row of counts
    score = F.lit(0.0)
    for i in range(len(phrases)):
        df, tf = F.col(f"__d{i}"), F.size(f"__s{i}")
        idf = F.greatest(F.log((docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / mean))
    return rows.select("owner", "idx", (-F.round(score, 9)).alias("rank"))


def query_nodes(entity: DataFrame, name_index: DataFrame, body_index: DataFrame, query: str, entity_type: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """(place, id, name, entity_type): as ``search.search_nodes``, by the query language."""
    return _merged(entity, find_ranked(name_index, query, index_totals(name_index, entity.count())), find(body_index, query), entity_type, offset, limit)


def query_relations(relation_observation: DataFrame, index: DataFrame, query: str, limit: int = 20, relation: DataFrame | None = None) -> DataFrame:
    """(place, from_id, to_id, relation_type): as ``search.search_relation_texts``, by the query language."""
    return _relations(find_ranked(index, query, index_totals(index, relation_observation.count())), limit, relation)
