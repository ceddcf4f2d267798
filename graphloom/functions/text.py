"""Tokens of full-text search and string likeness, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def _plain_letters() -> dict[str, str]:
    """Letters that canonically decompose into a plain one and marks, and the plain one."""
    out = {}
    for c in map(chr, range(0x80, 0x3000)):
        first, *marks = unicodedata.normalize("NFD", c)
        if marks and first.isalnum() and all(unicodedata.category(m).startswith("M") for m in marks):
            out[c] = first
    return out


_LETTERS = _plain_letters()
MARKED, PLAIN = "".join(_LETTERS), "".join(_LETTERS.values())


def folded(text: Column) -> Column:
    """Lower case without marks: marked letters become plain ones, combining marks go."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), r"\p{M}+", "")


def tokens(text: Column) -> Column:
    """Words of letters and digits, in order; underscores and hyphens split."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def index(texts: DataFrame, owner: str, at: str, body: str = "body") -> DataFrame:
    """(token, owner, idx, tf, n, positions): each distinct word of each text, its places from 0, their count, and the text's number of words.

    Words are counted inside their row: sorted with their places, and cut where they change.
    """
    rows = texts.select(F.col(owner).alias("owner"), F.col(at).alias("idx"), tokens(F.col(body)).alias("t"))
    rows = rows.select("owner", "idx", F.size("t").alias("n"), F.array_sort(F.transform("t", lambda x, i: F.struct(x.alias("token"), i.alias("at")))).alias("t")).filter("n > 0")
    begins = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get("t", i)["token"] != F.get("t", i - 1)["token"]))
    rows = rows.select("owner", "idx", "n", "t", begins.alias("b"))
    words = F.transform("b", lambda x, i: F.struct(F.get("t", x)["token"].alias("token"), F.transform(F.slice("t", x + 1, F.coalesce(F.get("b", i + 1), F.col("n")) - x), lambda y: y["at"]).alias("positions")))
    return rows.select("owner", "idx", "n", F.explode(words).alias("w")).select("w.token", "owner", "idx", F.size("w.positions").cast("long").alias("tf"), "n", "w.positions")


def query_terms(text: str) -> tuple[list[str], str | None]:
    """(terms, prefix) of a typed query: all terms are needed, the last may be a beginning."""
    words = "".join(c if c.isalnum() or c == "_" else " " for c in text).split()
    words = [w.translate(str.maketrans(MARKED, PLAIN)) for part in words for w in part.lower().replace("_", " ").split()]
    return (words[:-1], words[-1]) if words else ([], None)


def trigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def likeness(a: Column, b: Column) -> Column:
    """0.7 x trigram overlap (left occurrences) + 0.3 x (1 - edit distance / longer length)."""
    ta, tb = trigrams(a), trigrams(b)
    total, longer = F.size(ta) + F.size(tb), F.greatest(F.length(a), F.length(b))
    shared = F.size(F.filter(ta, lambda x: F.array_contains(tb, x)))
    overlap = F.when(total == 0, F.lit(0.0)).otherwise(F.lit(2.0) * shared / total) * 0.7
    edits = F.when(longer == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer) * 0.3
    return overlap + edits
