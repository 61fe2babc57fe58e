"""Knock-out tournaments from their matches: rounds, outcomes, the tree, and what is wrong with a damaged one.

A tournament is a group of match rows (match, day, home, away, home_won, and optionally neutral and
seed labels), once for each match. Nothing but who met whom, when, and who won is needed: a team's k-th
match by day is its round k, its wins are the rounds it survived, and the tree follows from each
winner's next match. Many tournaments, seasons or scenarios, are handled at once: every step is keyed by
the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import saved_rows

#: Rounds of a bracket of 64.
ROUNDS = 6


def played(field: DataFrame, by: Sequence[str], slot: str, form: str, rounds: int = ROUNDS) -> DataFrame:
    """The matches of brackets whose meetings are decided by what is known of the teams: by, round, game, home, away, home_won.

    field: by, team, slot (0 and on), and form, an array with a team's value in each round; the larger one
    wins, a missing one loses to any, and ties go to the smaller team. Neighbouring slots meet, then the
    winners of neighbouring pairs. A team without an opponent goes on without a match. One grouping a
    round; a group's rows are a bracket's.
    """
    team = field.schema["team"].dataType
    game = T.StructType([T.StructField("round", T.IntegerType()), T.StructField("game", T.LongType()), T.StructField("home", team), T.StructField("away", team), T.StructField("home_won", T.DoubleType())])
    rows = field.select(*by, F.col(slot).cast("long").alias("pos"), "team", F.col(form).alias("form"), F.array().cast(T.ArrayType(game)).alias("games"))
    for k in range(rounds):
        strength = F.coalesce(F.get("form", F.lit(k)).cast("double"), F.lit(float("-inf")))
        out = rows.withColumn("v", strength).groupBy(*by, F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.min_by(F.struct("team", "form", "v"), "pos").alias("a"), F.max_by(F.struct("team", "form", "v"), "pos").alias("b"), F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("games")).alias("games"),
        )
        first = (F.col("a.v") > F.col("b.v")) | ((F.col("a.v") == F.col("b.v")) & (F.col("a.team") <= F.col("b.team")))
        match = F.struct(F.lit(k + 1).alias("round"), F.col("pos").alias("game"), F.col("a.team").alias("home"), F.col("b.team").alias("away"), first.cast("double").alias("home_won"))
        rows = out.select(*by, "pos", F.when(first, F.col("a.team")).otherwise(F.col("b.team")).alias("team"), F.when(first, F.col("a.form")).otherwise(F.col("b.form")).alias("form"), F.when(F.col("n") == 2, F.concat("games", F.array(match))).otherwise(F.col("games")).alias("games"))
    return rows.select(*by, F.explode("games").alias("g")).select(*by, "g.*")


def entries(matches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two rows for each match: by, match, day, team, opponent, won, at_home, neutral, round (the team's matches so far by day)."""
    neutral = F.coalesce("neutral", F.lit(False)) if "neutral" in matches.columns else F.lit(False)
    side = lambda team, other, won, home: F.struct(F.col(team).alias("team"), F.col(other).alias("opponent"), won.alias("won"), F.lit(home).alias("at_home"))
    won = F.col("home_won") == 1
    both = F.explode(F.array(side("home", "away", won, True), side("away", "home", ~won, False)))
    rows = matches.dropna(subset=["home", "away", "home_won", "day"]).select(*by, "match", "day", neutral.alias("neutral"), both.alias("s")).select(*by, "match", "day", "neutral", "s.*")
    return rows.withColumn("round", F.row_number().over(Window.partitionBy(*by, "team").orderBy("day", "match")))


def outcomes(matches: DataFrame, by: Sequence[str], early: int = 2) -> DataFrame:
    """by, team, reached (1 and the wins), host (at home, not on a neutral floor, in one of the early rounds), lost_to and lost_in (round)."""
    rows = entries(matches, by)
    lost = F.when(~F.col("won"), F.struct("round", "opponent"))
    return rows.groupBy(*by, "team").agg(
        (1 + F.count_if("won")).alias("reached"), F.coalesce(F.bool_or(F.col("at_home") & ~F.col("neutral") & (F.col("round") <= early)), F.lit(False)).alias("host"), F.min(lost).alias("_lost"),
    ).withColumns({"lost_to": F.col("_lost.opponent"), "lost_in": F.col("_lost.round")}).drop("_lost")


def tree(matches: DataFrame, by: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    """Matches with their place in the tree: node (1 the final; 2v and 2v + 1 the two that lead to v) and depth (0 the final).

    A match leads to its winner's next one. Matches that no final is reached from, or a third one that
    leads to the same, have no node. One join a round; of two feeders the left one is that of the smaller winner.
    """
    rows = entries(matches, by)
    onward = rows.withColumn("next", F.lead("match").over(Window.partitionBy(*by, "team").orderBy("day", "match"))).where("won").select(*by, "match", F.col("team").alias("winner"), "next")
    onward = onward.withColumn("feeder", F.when(F.col("next").isNotNull(), F.row_number().over(Window.partitionBy(*by, "next").orderBy("winner", "match"))))
    onward = saved_rows(onward, "onward")  # every level reads it
    level = onward.where("next is null").select(*by, "match", F.row_number().over(Window.partitionBy(*by).orderBy("match")).alias("_k")).where("_k = 1").select(*by, "match", F.lit(1).cast("long").alias("node"))
    found = level.withColumn("depth", F.lit(0))
    feeders = onward.where("feeder <= 2").select(*by, "match", F.col("next").alias("_next"), "feeder")
    for depth in range(1, rounds):
        above = level.select(*by, F.col("match").alias("_next"), F.col("node").alias("_node"))
        level = saved_rows(feeders.join(above, [*by, "_next"]).select(*by, "match", (2 * F.col("_node") + F.col("feeder") - 1).alias("node")), "level")
        found = found.unionByName(level.withColumn("depth", F.lit(depth)))
    return matches.join(found, [*by, "match"], "left")


def slots(placed: DataFrame, by: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    """by, team and slot of every team of the first round of a tree: 0 and on from its left end."""
    first = placed.where(F.col("depth") == rounds - 1).withColumn("at", 2 * (F.col("node") - 2 ** (rounds - 1)))
    lo, hi = F.least("home", "away"), F.greatest("home", "away")
    return first.select(*by, F.explode(F.array(F.struct(lo.alias("team"), F.col("at").alias("slot")), F.struct(hi.alias("team"), (F.col("at") + 1).alias("slot")))).alias("s")).select(*by, "s.*")


def integrity(matches: DataFrame, by: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    """A row for each tournament: matches, teams, how many teams reached each round (r1: went out in the first, and so on; the last are champions), placed (matches in the tree), and fault: null if it is a whole bracket.

    Faults in the order in which they are told: another number of matches, results that are no bracket's (a
    loser plays on, two champions), and matches that do not make one tree.
    """
    size = 2**rounds
    matches = saved_rows(matches, "matches")
    got = outcomes(matches, by)
    counts = got.groupBy(*by).agg(F.count(F.lit(1)).alias("teams"), *[F.count_if(F.col("reached") == k).alias(f"r{k}") for k in range(1, rounds + 2)], F.max("reached").alias("_most"))
    n = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("matches"))
    depths = tree(matches, by, rounds).groupBy(*by).agg(F.count("node").alias("placed"), *[(F.count_if(F.col("depth") == d) == 2**d).alias(f"_d{d}") for d in range(rounds)])
    shape = F.col("_most") == rounds + 1
    for k in range(1, rounds + 2):
        shape = shape & (F.col(f"r{k}") == (size >> k if k <= rounds else 1))
    whole = F.lit(True)
    for d in range(rounds):
        whole = whole & F.col(f"_d{d}")
    fault = F.when(F.col("matches") != size - 1, "number of matches").when(~shape, "results").when(~whole, "tree")
    return n.join(counts, list(by), "left").join(depths, list(by), "left").select(*by, "matches", "teams", *[f"r{k}" for k in range(1, rounds + 2)], "placed", fault.alias("fault"))


def seeds_of(rows: DataFrame, by: Sequence[str], late: int = 3) -> DataFrame:
    """by, team and seed from labels (by, round, team, label, as opponents' rows show them).

    Labels of late rounds hold if a team has one; those of early rounds fill in where, in their tournament, each
    team has one and none contradicts a late one.
    """
    by = list(by)
    sets = rows.where("label is not null").groupBy(*by, "team").agg(*[F.array_sort(F.collect_set(F.when(when, F.col("label")))).alias(c) for c, when in (("early", F.col("round") < late), ("late", F.col("round") >= late))])
    clash = (F.size("early") > 1) | ((F.size("early") > 0) & (F.size("late") > 0) & (F.col("early") != F.col("late")))
    agree = sets.groupBy(*by).agg((~F.bool_or(clash)).alias("_agree"))
    seed = F.when(F.size("late") == 1, F.get("late", F.lit(0))).when(F.col("_agree") & (F.size("early") == 1), F.get("early", F.lit(0)))
    return sets.join(agree, by).select(*by, "team", seed.alias("seed")).where("seed is not null")


def chalk(rows: DataFrame, by: Sequence[str], picks: dict[str, tuple[int, Column]]) -> DataFrame:
    """What the seeds alone got right: for each name (a round, which seeds), the hits and the number of those seeds."""
    each = [x for name, (k, seeds) in picks.items() for x in (F.count_if(seeds & (F.col("reached") >= k)).alias(f"{name}_hits"), F.count_if(seeds).alias(f"{name}_of"))]
    return rows.groupBy(*by).agg(*each)
