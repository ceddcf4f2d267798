"""What a write of unknown types is answered with: similar types and examples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import likeness, tokens, trigrams
from graphloom.operators.joins import dealt
from graphloom.operators.limits import clamp
from graphloom.operators.vectors import hashed_embedding

# Suggestions and examples for one unknown type, least score of a suggestion.
SUGGESTIONS, EXAMPLES, LEAST = 10, 3, 0.35


def alike(typed: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """(typed, name, score): names (name) like the distinct typed ones, above ``least``, other case apart.

    A score above 0.3 needs a common trigram, so pairs come from a join of trigram postings, dealt
    for common ones. Numbers of trigrams and lengths bound the score before edits are counted.
    """
    side = lambda df, c, g: df.select(c).distinct().withColumns({f"{g}_text": F.lower(c), f"{g}_grams": trigrams(F.lower(c))})
    a, b = side(typed.filter("typed IS NOT NULL"), "typed", "a"), side(known.filter("name IS NOT NULL"), "name", "b")
    # Occurrences count on the left, presence on the right.
    a = a.select("typed", "a_text", F.size("a_grams").alias("a_n"), F.explode("a_grams").alias("gram")).groupBy("typed", "a_text", "a_n", "gram").agg(F.count(F.lit(1)).alias("k"))
    b = b.select("name", "b_text", F.size("b_grams").alias("b_n"), F.explode(F.array_distinct("b_grams")).alias("gram"))
    pairs = dealt(b, a, ["gram"], ["name"]).groupBy("typed", "name", "a_text", "b_text", "a_n", "b_n").agg(F.sum("k").alias("shared"))
    longer = F.greatest(F.length("a_text"), F.length("b_text"))
    apart = F.abs(F.length("a_text") - F.length("b_text")) / longer
    bound = 0.7 * 2 * F.col("shared") / (F.col("a_n") + F.col("b_n")) + 0.3 * (1 - apart)
    near = pairs.filter((F.col("a_text") != F.col("b_text")) & (bound > least - 1e-6))
    return near.select("typed", "name", F.round(likeness(F.col("a_text"), F.col("b_text")), 6).alias("score")).filter(F.col("score") > max(least, 0.3))


def similar_types(typed: DataFrame, known: DataFrame, most: int = SUGGESTIONS) -> DataFrame:
    """(typed, name, score, place): up to ``most`` known types (name, n) like each distinct typed one, best first, then by name.

    Equal names and types without members are skipped.
    """
    place = F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("score"), "name"))
    return alike(typed, known.filter("n > 0")).withColumn("place", place).filter(F.col("place") <= most)


def near_in_meaning(typed: DataFrame, known: DataFrame) -> DataFrame:
    """(typed, name, score): the cosine of the hashed embeddings of both names where it is above 0.

    Such names share a place of the embedding: a join on places, dealt, adds the products up.
    """
    side = lambda df, c, v: df.select(c).distinct().select(c, F.posexplode(hashed_embedding(F.col(c))).alias("place", v)).filter(f"{v} <> 0")
    met = dealt(side(known, "name", "y"), side(typed, "typed", "x"), ["place"], ["name"])
    near = met.filter(F.lower("typed") != F.lower("name")).groupBy("typed", "name").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("score"))
    return near.filter("score > 0")


def suggest(typed: DataFrame, known: DataFrame, top: int | None = None) -> DataFrame:
    """(typed, name, source, score, place): known types (name, n) near in meaning first, then those like in letters, 1 to 100 of each typed one.

    Meaning is the cosine of the hashed embeddings of both names, above 0; a name found
    both ways counts by its meaning. Equal names and types without members are skipped.
    """
    most = clamp(top, SUGGESTIONS, 100)
    near = near_in_meaning(typed, known.filter("n > 0")).select("typed", "name", F.lit(0).alias("source"), "score")
    letters = similar_types(typed, known, most).select("typed", "name", F.lit(1).alias("source"), "score")
    best = near.union(letters).groupBy("typed", "name").agg(F.min(F.struct("source", (-F.col("score")).alias("minus"))).alias("b"))
    place = F.row_number().over(Window.partitionBy("typed").orderBy("b", "name"))
    rows = best.withColumn("place", place).filter(F.col("place") <= most)
    return rows.select("typed", "name", F.when(F.col("b.source") == 0, "meaning").otherwise("letters").alias("source"), (-F.col("b.minus")).alias("score"), "place")


def unknown_types(typed: DataFrame, known: DataFrame) -> DataFrame:
    return typed.select("typed").distinct().join(known.filter("n > 0").select(F.col("name").alias("typed")), "typed", "left_anti")


def _first(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key; each task keeps no more of a key before the shuffle."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("__at", at).filter(F.col("__at") <= most).drop("__at")


def example_relations(similar: DataFrame, relation: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """(typed, from_id, relation_type, to_id): up to ``most`` relations of the similar types, in the order of the types."""
    wanted = relation.join(similar.select(F.col("name").alias("relation_type")).distinct(), "relation_type", "left_semi")
    some = _first(wanted, "relation_type", ["from_id", "to_id"], most)
    rows = similar.select("typed", "place", F.col("name").alias("relation_type")).join(some, "relation_type")
    return _first(rows, "typed", ["place", "from_id", "to_id"], most).select("typed", "from_id", "relation_type", "to_id")


def example_entities(similar: DataFrame, entity: DataFrame, observation: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """(typed, name, entity_type): up to ``most`` entities of the similar types, in the order of the types.

    A type's candidates are the first ``most`` entities whose name, then whose bodies,
    hold all words of the type's name; those of another type are dropped after that cap.
    """
    types = similar.select(F.col("name").alias("type")).distinct().withColumn("words", F.array_distinct(tokens(F.col("type")))).filter(F.size("words") > 0)
    asked = types.select("type", F.size("words").alias("n"), F.explode("words").alias("word"))

    def holders(texts: DataFrame, source: int) -> DataFrame:
        words = texts.select("id", "at", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
        full = words.join(asked, "word").groupBy("type", "n", "id", "at").agg(F.count(F.lit(1)).alias("c")).filter("c = n")
        return _first(full.select("type", "id").distinct(), "type", ["id"], most).withColumn("source", F.lit(source))

    named = holders(entity.select("id", F.lit(0).alias("at"), F.col("name").alias("text")), 0)
    told = holders(observation.select(F.col("entity_id").alias("id"), F.col("idx").alias("at"), F.col("body").alias("text")), 1)
    found = named.union(told).groupBy("type", "id").agg(F.min("source").alias("source"))
    hits = _first(found, "type", ["source", "id"], most)
    rows = hits.join(entity, "id").filter(F.col("entity_type") == F.col("type"))
    rows = similar.select("typed", "place", F.col("name").alias("type")).join(rows, "type")
    return _first(rows, "typed", ["place", "source", "id"], most).select("typed", "name", "entity_type")
