"""Secret scan in SQL functions only: patterns, and sliding-window entropy.

Positions come from splitting a text at a pattern: the lengths of the parts between
and of the matches themselves, summed up, are the spans. A text is only split where
a cheap test says that the pattern occurs.

Entropy: candidates are maximal runs of token characters. A fold over the characters
of a candidate keeps their counts in a window of ``WINDOW`` characters and the sum of
c log2 c, which the character that enters and the one that leaves change by a table
lookup. A candidate is reported if some window's entropy reaches the threshold of the
narrowest character class that holds it, unless the allow list suppresses it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import table

# Fixed patterns of the base kinds. Group 2 of an assignment has six characters at least.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{WINDOW},}}={{0,2}}"
#: Character classes, narrowest first, and bits a character that a window must reach.
CLASSES = (("[0-9A-Fa-f]+", 3.0), ("[A-Za-z0-9]+", 3.7), ("[A-Za-z0-9+/_=-]+", 3.9))
#: Never reported for their entropy: only letters, only digits, UUIDs, stated examples.
ALLOW = r"^[A-Za-z+/_-]+=*$|^[0-9+/_-]+=*$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|(?i)example|sample|placeholder|dummy|changeme"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_SCALE = 10**9
_TERMS = [round(_SCALE * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


def window_entropy(candidate: Column) -> Column:
    """Largest entropy, in billionths of a bit a character, of any window of ``candidate``."""
    places = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    terms = F.array(*[F.lit(t).cast("long") for t in _TERMS])
    zero = F.array_repeat(F.lit(0), len(_ALPHABET))
    letters = F.sequence(F.lit(1), F.lit(len(_ALPHABET)))

    def step(codes: Column):
        def moved(state: Column, i: Column) -> Column:
            enters, full = F.get(codes, i), i >= WINDOW
            leaves = F.when(full, F.get(codes, i - WINDOW)).otherwise(F.lit(0))
            held = F.when(full, F.get(state["counts"], leaves - 1)).otherwise(F.lit(0))
            without = state["sum"] - F.when(full, F.get(terms, held) - F.get(terms, held - 1)).otherwise(F.lit(0).cast("long"))
            there = F.get(state["counts"], enters - 1) - F.when(leaves == enters, 1).otherwise(0)
            total = without + F.get(terms, there + 1) - F.get(terms, there)
            counts = F.zip_with(state["counts"], letters, lambda n, at: n + F.when(at == enters, 1).otherwise(0) - F.when(at == leaves, 1).otherwise(0))
            bits = F.lit(round(_SCALE * math.log2(WINDOW))).cast("long") - (total / WINDOW).cast("long")
            best = F.when(i >= WINDOW - 1, F.greatest(state["best"], bits)).otherwise(state["best"])
            return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

        return moved

    start = F.struct(zero.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("best"))
    # A one-element array names the codes once for the whole fold.
    return F.transform(F.array(places), lambda codes: F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step(codes), lambda s: s["best"]))[0]


def _running(sizes: str) -> str:
    """SQL for the sums of all earlier elements of array ``sizes``, in blocks so that long arrays stay cheap."""
    return f"""flatten(transform(array(transform(sequence(0, (size({sizes}) - 1) div 256), b -> aggregate(slice({sizes}, b * 256 + 1, 256), array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x))))),
        blocks -> flatten(transform(array(aggregate(blocks, array(0L), (a, l) -> concat(a, array(element_at(a, -1) + element_at(l, -1))))),
            bases -> flatten(zip_with(blocks, slice(bases, 1, size(blocks)), (l, base) -> transform(slice(l, 1, size(l) - 1), v -> v + base)))))))"""


def _spans(df: DataFrame, out: str, pattern: str, kind: int, has: Column) -> DataFrame:
    """Add array ``out`` of (start, kind, end, hit) for the matches of ``pattern``."""
    hits = F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))
    df = df.withColumn("__has", has)
    df = df.withColumn("__hits", F.when(F.col("__has"), hits)).withColumn("__gaps", F.when(F.size("__hits") > 0, F.split("__text", pattern, -1)))
    df = df.withColumn("__sizes", F.when(F.size("__hits") > 0, F.zip_with(F.slice("__gaps", F.lit(1), F.size("__hits")), "__hits", lambda g, h: (F.length(g) + F.length(h)).cast("long"))))
    df = df.withColumn("__before", F.when(F.size("__hits") > 0, F.expr(_running("__sizes"))))
    spans = F.transform("__before", lambda b, i: F.struct(
        (b + F.length(F.get("__gaps", i))).alias("start"), F.lit(kind).alias("kind"),
        (b + F.get("__sizes", i)).alias("end"), F.get("__hits", i).alias("hit")))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hit:string>>")
    return df.withColumn(out, F.when(F.size("__hits") > 0, spans).otherwise(empty)).drop("__has", "__hits", "__gaps", "__sizes", "__before")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) for each row of ``docs``.

    Spans are whole matches as code points, end exclusive, in order of start, then
    kind. Entropy spans are added to the base spans and never replace them; a
    candidate that a base span overlaps is already reported and adds none. A null
    text is empty. Repeated rows give repeated results; other columns are ignored.
    """
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    low = F.lower("__text")
    named = F.lit(False)
    for word in KEYWORDS:
        named = named | F.contains(low, F.lit(word))
    df = df.withColumn("__run", F.col("__text").rlike(r"[A-Za-z0-9+/_-]{20}"))
    df = _spans(df, "__assign", ASSIGN, 0, named)
    df = df.withColumn("__assign", F.filter("__assign", lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6))
    df = _spans(df, "__access", ACCESS, 1, F.contains("__text", F.lit("AKIA")))
    df = _spans(df, "__hex", HEX, 2, F.col("__run"))
    df = _spans(df, "__tokens", TOKEN, 3, F.col("__run"))
    df = df.withColumn("__base", F.concat("__assign", "__access", "__hex"))

    def suspicious(s: Column) -> Column:
        least = F.lit(round(CLASSES[-1][1] * _SCALE))
        for pattern, bits in reversed(CLASSES[:-1]):
            least = F.when(s["hit"].rlike(f"^(?:{pattern})$"), F.lit(round(bits * _SCALE))).otherwise(least)
        free = ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return ~s["hit"].rlike(ALLOW) & free & (window_entropy(s["hit"]) >= least)

    df = df.withColumn("__entropy", F.when(F.size("__tokens") > 0, F.filter("__tokens", suspicious)).otherwise(F.col("__tokens")))
    return df.select(
        "doc_id", F.size("__assign").cast("long").alias("n_assign"), F.size("__access").cast("long").alias("n_access"), F.size("__hex").cast("long").alias("n_hex"),
        F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.concat("__base", "__entropy")).alias("spans"), F.size("__entropy").cast("long").alias("n_entropy"))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
