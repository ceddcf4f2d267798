"""Cross-site line removal by distinct-site spread.

Each line hash gathers a HyperLogLog sketch of the sites it stands on; sketches
merge on the map side and after the shuffle, so a line on a third of all rows costs
one sketch per task. Lines whose estimate is clearly above or below the threshold
are decided by it; lines near it get an exact count of distinct sites.

Sites are counted twice. First wherever a line stands. Then, of lines found so, each
context counts once, by its smallest site: the context is the line with the lines before
and after it. Copies of one text on many sites share their contexts, so they keep
it, for document de-duplication to handle; a notice on pages with text of their own has as
many contexts as pages, whatever its share of them. Lines that are spread in the second
count go from every document. What always stands between the same two lines, as the
middle of a notice of several lines, has one context and stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import dealt, durable, table, unused

SITES = 10
#: Estimates within these factors of the threshold are counted exactly (a dozen standard errors).
NEAR = (0.8, 1.25)
_BLANK = " \t\r"


def _texts() -> Column:
    return F.transform(F.split(F.col("text").cast("string"), "\n", -1), lambda x: F.trim(x, F.lit(_BLANK)))


def _line_key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")]


def _row_key() -> list[Column]:
    text = F.col("text").cast("string")
    return [F.xxhash64("doc_id", text).alias("__k1"), F.hash("doc_id", text).alias("__k2")]


def _widely(lines: DataFrame, sites: int, name: str) -> DataFrame:
    """(h1, h2): keys in ``lines`` (h1, h2, source) with at least ``sites`` distinct sources; null sources don't count."""
    lines = lines.filter("source IS NOT NULL")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source")).alias("estimate"))
    spread = durable(spread.filter(F.col("estimate") >= NEAR[0] * sites), name)
    near = spread.filter(F.col("estimate") < NEAR[1] * sites).select("h1", "h2")
    exact = dealt(lines, near, ["h1", "h2"], ["source"], "left_semi").select("h1", "h2", "source").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return spread.filter(F.col("estimate") >= NEAR[1] * sites).select("h1", "h2").union(exact.filter(F.col("n") >= sites).select("h1", "h2"))


def spread_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(__k1, __k2, pos, h1, h2): the places of the lines that are spread over ``sites`` distinct sources, contexts counted once.

    Lines are compared without blanks at their ends; blank lines and null sources don't
    count. ``__k1`` and ``__k2`` name a row by its doc_id and text; equal rows have one name.
    """
    source = F.col("source").cast("string").alias("source")
    keys = F.filter(F.transform(_texts(), lambda x, i: F.struct(i.alias("pos"), (x == "").alias("blank"), *_line_key(x))), lambda x: ~x["blank"])
    # A one-element array names the keys once for the whole text.
    placed = F.transform(F.array(keys), lambda a: F.transform(a, lambda x, i: F.struct(x["pos"].alias("pos"), x["h1"].alias("h1"), x["h2"].alias("h2"), F.get(a, i - 1)["h1"].alias("before"), F.get(a, i + 1)["h1"].alias("after"))))[0]
    lines = docs.select(*_row_key(), source, F.explode(placed).alias("x")).select("__k1", "__k2", "source", "x.*")
    wide = durable(_widely(lines.select("source", "h1", "h2"), sites, "spread"), "wide")
    found = durable(dealt(lines, wide, ["h1", "h2"], ["__k1", "pos"], "left_semi"), "placed")
    contexts = found.filter("source IS NOT NULL").groupBy("h1", "h2", "before", "after").agg(F.min("source").alias("source"))
    boiler = durable(_widely(contexts.select("h1", "h2", "source"), sites, "contexts"), "boiler")
    return dealt(found, boiler, ["h1", "h2"], ["__k1", "pos"], "left_semi").select("__k1", "__k2", "pos", "h1", "h2")


ADDED = ("__n_lines", "__n_removed")


def remove_spread_lines(docs: DataFrame, sites: int = SITES, added: Sequence[str] = ADDED) -> DataFrame:
    """``docs`` with ``text`` less its widely spread lines, and counts of lines before and removed.

    All columns are kept, ``n_chars`` (if there) follows the new text, and
    ``__n_lines`` and ``__n_removed``, or the names ``added``, are added; columns of
    ``docs`` with these names are replaced. A null text stays null with no
    lines; a text of spread lines only becomes empty. Equal rows are treated alike,
    each giving a row; null ids and sources are allowed; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    k1, k2, cut = unused(docs, "__k1", "__k2", "__cut")
    found = spread_lines(docs, sites).groupBy(F.col("__k1").alias(k1), F.col("__k2").alias(k2)).agg(F.array_sort(F.collect_set("pos")).alias(cut))
    rows = docs.withColumns(dict(zip([k1, k2], _row_key(), strict=True)))
    joined = rows.join(found, [k1, k2], "left")
    # The lines between removed positions, as slices: linear in the text.
    kept = F.expr(f"""array_join(flatten(transform(sequence(0, size({cut})), j -> slice(split(CAST(text AS STRING), '\\n', -1),
        coalesce(get({cut}, j - 1), -1) + 2,
        coalesce(get({cut}, j), size(split(CAST(text AS STRING), '\\n', -1))) - coalesce(get({cut}, j - 1), -1) - 1))), '\\n')""")
    new = F.when(F.col(cut).isNotNull(), kept).otherwise(text)
    counts = [F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long"), F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).cast("long")]
    out = joined.select(*[f"`{c}`" for c in docs.columns if c not in ("text", *added)], new.alias("text"), *[c.alias(n) for c, n in zip(counts, added, strict=True)])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns if c not in added], *added)


def op8_lines(spark, sf_dir: str) -> DataFrame:
    out = remove_spread_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.length(text).cast("long").alias("n_kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH parts AS (
  SELECT doc_id, source, pos, string_split(text, chr(10))[pos] AS raw, trim(string_split(text, chr(10))[pos], ' ' || chr(9) || chr(13)) AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(pos)),
wide AS (SELECT line FROM parts WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
placed AS (
  SELECT line, source, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS above, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS below FROM parts WHERE line <> ''),
spread AS (
  SELECT line FROM (SELECT line, min(source) AS source FROM placed WHERE line IN (SELECT line FROM wide) GROUP BY line, above, below)
  GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
docs AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_hit, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS rest
  FROM (SELECT *, line IN (SELECT line FROM spread) AS hit FROM parts) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_removed,
       CAST(length(coalesce(rest, '')) AS BIGINT) AS n_kept_chars, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents d LEFT JOIN docs USING (doc_id)"""
