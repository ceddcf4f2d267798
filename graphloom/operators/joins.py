"""Joins for keys that hold much of a table, and for intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks over which the rows of one key are dealt.
DEALS = 16
#: Bins that an interval may cover before it goes one level up, where bins are this many times as wide.
COVER = 4


def dealt(many: DataFrame, few: DataFrame, on: list[str], by: list[str], deals: int = DEALS) -> DataFrame:
    """Inner join on ``on`` in which rows of ``many`` with one key are dealt by ``by``, and those of ``few`` go to every deal."""
    many = many.withColumn("__deal", F.pmod(F.xxhash64(*by), F.lit(deals)).cast("int"))
    few = few.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    return many.join(few, [*on, "__deal"]).drop("__deal")


def _level(width: Column, levels: int) -> Column:
    """The lowest level whose bins (COVER ** level wide) an interval of ``width`` covers with few."""
    out = F.lit(levels - 1)
    for level in reversed(range(levels - 1)):
        out = F.when(width <= (COVER ** (level + 1)), F.lit(level)).otherwise(out)
    return out


def containing(points: DataFrame, intervals: DataFrame, on: list[str], at: str, low: str, high: str, levels: int = 16) -> DataFrame:
    """Rows of ``points`` with those of ``intervals`` of the same ``on`` that hold them: low <= at <= high, whole numbers.

    An equi-join, not a nested loop: an interval stands in the bins that it covers, COVER + 1 at
    most, of the level that fits its width, and a point asks for its bin of each level that
    is in use. Both sides are dealt, so an interval over all points is many tasks' work.
    Rows with a null end or place, and intervals that end before they begin, meet nothing.
    """
    width = F.col(high) - F.col(low)
    cut = intervals.filter(width >= 0).withColumn("__level", _level(width, levels))
    wide = F.pow(F.lit(float(COVER)), F.col("__level")).cast("long")
    used = [r["__level"] for r in cut.select("__level").distinct().collect()]  # one row a level
    cut = cut.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / wide), F.floor(F.col(high) / wide))))
    asked = F.array(*[F.struct(F.lit(level).alias("level"), F.floor(F.col(at) / COVER**level).alias("bin")) for level in used]) if used else F.array().cast("array<struct<level:int,bin:bigint>>")
    asks = points.filter(F.col(at).isNotNull()).withColumn("__ask", F.explode(asked)).withColumns({"__level": F.col("__ask.level"), "__bin": F.col("__ask.bin")}).drop("__ask")
    met = dealt(asks, cut, [*on, "__level", "__bin"], [at, *on])
    return met.filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__level", "__bin")


def smallest_around(points: DataFrame, intervals: DataFrame, on: list[str], key: list[str], at: str, low: str, high: str, name: str) -> DataFrame:
    """(on, key, at, low, high, name): of each point the smallest interval around it, then the first by ``low`` and ``name``; points in none are left out."""
    met = containing(points, intervals, on, at, low, high)
    best = met.groupBy(*on, *key, at).agg(F.min(F.struct((F.col(high) - F.col(low)).alias("width"), low, name, high)).alias("b"))
    return best.select(*on, *key, at, f"b.{low}", f"b.{high}", f"b.{name}")
