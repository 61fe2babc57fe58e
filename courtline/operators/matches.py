"""What the sets of a match say about it: set context, leads, comebacks, and being first to a score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_table(finals: DataFrame, firsts: DataFrame, match: Sequence[str], order: str, sides: tuple[str, str]) -> DataFrame:
    """One row per set: set_no within its match, final_a, final_b, first_to, set_winner (null when tied), margin."""
    a, b = F.col("final_a"), F.col("final_b")
    number = F.row_number().over(Window.partitionBy(*match).orderBy(order)).cast("long")
    winner = F.when(a > b, sides[0]).when(b > a, sides[1])
    both = finals.join(firsts.select(*match, order, "first_to"), [*match, order])
    return both.select(*match, order, number.alias("set_no"), "final_a", "final_b", "first_to", winner.alias("set_winner"), F.abs(a - b).alias("margin"))


def set_sides(sets: DataFrame, sides: tuple[str, str]) -> DataFrame:
    """Two rows per set: side, first (was first to the score), won_set (null when tied)."""
    side = F.explode(F.array(*map(F.lit, sides)))
    each = sets.withColumn("side", side)
    return each.withColumn("first", F.coalesce(F.col("first_to") == F.col("side"), F.lit(False))).withColumn("won_set", (F.col("set_winner") == F.col("side")).cast("double"))


def set_context(each: DataFrame, match: Sequence[str]) -> DataFrame:
    """One row per match and side: sets_played, sets_first, won_set1 (null when tied), set1_margin, sets_for, sets_against, won.

    won is null where both sides won as many sets.
    """
    one = F.col("set_no") == 1
    out = each.groupBy(*match, "side").agg(
        F.count(F.lit(1)).alias("sets_played"), F.count_if("first").alias("sets_first"), F.max(F.when(one, F.col("won_set"))).alias("won_set1"),
        F.max(F.when(one, F.col("margin"))).alias("set1_margin"), F.count_if(F.col("won_set") == 1).alias("sets_for"), F.count_if(F.col("won_set") == 0).alias("sets_against"),
    )
    return out.withColumn("won", F.when(F.col("sets_for") > F.col("sets_against"), 1.0).when(F.col("sets_for") < F.col("sets_against"), 0.0))


def with_first_margins(matches: DataFrame, margins: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Matches with the value of their key; of several rows of a key the least value counts, and a match without any keeps null."""
    return matches.join(margins.groupBy(*keys).agg(F.min(value).alias(value)), list(keys), "left")


def by_length(sides: DataFrame) -> DataFrame:
    """Match lengths and their shares, how often the first set's winner wins by length, and that side's final scores: kind, key, n, value."""
    length = sides.groupBy(F.col("sets_played").cast("string").alias("key"))
    total = F.sum("rows").over(Window.partitionBy())  # as many rows as lengths
    mix = length.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("length").alias("kind"), "key", F.floor(F.col("rows") / 2).alias("n"), (F.col("rows") / total).alias("value"))
    ahead = F.col("won_set1") == 1
    wins = length.agg(F.floor(F.count(F.lit(1)) / 2).alias("n"), F.avg(F.when(ahead, F.col("won"))).alias("value")).select(F.lit("set1_winner").alias("kind"), "key", "n", "value")
    return mix.unionByName(wins).unionByName(final_scores(sides.where(ahead), "score"))


def final_scores(sides: DataFrame, kind: str) -> DataFrame:
    score = F.concat_ws("-", F.col("sets_for").cast("string"), F.col("sets_against").cast("string"))
    return sides.groupBy(score.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "key", "n", F.lit(None).cast("double").alias("value"))


def comebacks(sides: DataFrame, band: Column) -> DataFrame:
    """Sides that lost the first set: how many won, by final score and by deficit, and the mean deficit made up: kind, key, n, value."""
    lost = sides.where("won_set1 = 0")
    back = lost.where("won = 1")
    rows = [
        lost.agg(F.count_if(F.col("won") == 1).alias("n"), F.avg("won").alias("value")).select(F.lit("all").alias("kind"), F.lit("won").alias("key"), "n", "value"),
        lost.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("won") == 1, F.col("set1_margin"))).alias("value")).select(F.lit("all").alias("kind"), F.lit("of").alias("key"), "n", "value"),
        lost.groupBy(band.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.avg("won").alias("value")).where("key is not null").select(F.lit("deficit").alias("kind"), "key", "n", "value"),
        final_scores(back, "score"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def lead_table(leads: DataFrame, band: Column, floor: int) -> DataFrame:
    """For the side that leads at a checkpoint: n, how often it wins the set and the match, and its mean lead; by size of the lead too, from floor rows on."""
    measures = [F.count(F.lit(1)).alias("n"), F.avg("won_set1").alias("wins_set1"), F.avg("won").alias("wins_match"), F.avg("lead").alias("mean_lead")]
    every = leads.groupBy("checkpoint").agg(*measures).select("checkpoint", F.lit("all").alias("size"), "n", "wins_set1", "wins_match", "mean_lead")
    sized = leads.withColumn("size", band).where("size is not null").groupBy("checkpoint", "size").agg(*measures).where(F.col("n") >= floor)
    return every.unionByName(sized)


def first_by_set(each: DataFrame) -> DataFrame:
    """By set: how often the side first to the score wins the set and the match, the other side the match, and the lift."""
    out = each.groupBy("set_no").agg(
        F.count_if("first").alias("n"), F.avg(F.when(F.col("first"), F.coalesce("won_set", F.lit(0.0)))).alias("wins_set"),
        F.avg(F.when(F.col("first"), F.col("won"))).alias("wins_match"), F.avg(F.when(~F.col("first"), F.col("won"))).alias("wins_match_if_not"),
    )
    return out.withColumn("lift", F.col("wins_match") - F.col("wins_match_if_not"))


def first_counts(sides: DataFrame, each: DataFrame, match: Sequence[str], floor: int) -> DataFrame:
    """Win share by how many sets a side was first in, 0 included; from floor rows on."""
    counted = each.where("first").groupBy(*match, "side").agg(F.count(F.lit(1)).alias("sets_first_to"))
    both = sides.select(*match, "side", "won").join(counted, [*match, "side"], "left").fillna(0, ["sets_first_to"])
    return both.groupBy("sets_first_to").agg(F.count(F.lit(1)).alias("n"), F.avg("won").alias("win_pct")).where(F.col("n") >= floor)


def first_and_set(each: DataFrame) -> DataFrame:
    """What being first adds to winning the set: part, n, win_pct for six parts of the rows."""
    first, won = F.col("first"), F.coalesce(F.col("won_set") == 1, F.lit(False))
    parts = {"first": first, "won_set": won, "first_and_won": first & won, "won_from_behind": ~first & won, "first_but_lost": first & ~won, "neither": ~first & ~won}
    # One pass: every part is a column, then a row.
    sums = each.agg(*[F.struct(F.count_if(c).alias("n"), F.avg(F.when(c, F.col("won"))).alias("win_pct")).alias(k) for k, c in parts.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(f"{k}.n").alias("n"), F.col(f"{k}.win_pct").alias("win_pct")) for k in parts])).alias("x")).select("x.*")
