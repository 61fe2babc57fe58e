"""Reads of published tables: parameters in, DataFrame out. Ranks are taken before filters.

Tables: team_seasons (season, team, conf, n_matches, metrics, wins, losses), matches (one row per
team and match), ratings (season, team, rating columns), players (season, player, position, team,
conf, rating, ranked), predictions (season, day, home, away, p_home, home_won), schedule (unplayed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators.metrics import ranked, top


def _where(rows: DataFrame, **equal) -> DataFrame:
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == v)
    return rows


def seasons(rows: DataFrame) -> DataFrame:
    """Seasons, newest first."""
    return rows.select("season").distinct().orderBy(F.desc("season"))


def distinct_values(rows: DataFrame, column: str, season=None) -> DataFrame:
    """Values of a column that are neither null nor blank: conferences, positions, teams."""
    return _where(rows, season=season).where(F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "")).select(column).distinct()


def board(rows: DataFrame, season, value: str, conf: str | None = None, least: int = 15) -> DataFrame:
    """Teams by a value with their rank over the whole season; the conference is filtered afterwards."""
    x = ranked(_where(rows, season=season), ["season"], value, "rank", only=F.col("n_matches") >= least).where(F.col("n_matches") >= least)
    return _where(x, conf=conf)


def rankings(ratings: DataFrame, team_seasons: DataFrame, season, rating: str, conf: str | None = None, least: int = 5) -> DataFrame:
    """Ratings with record and conference, in order of rating."""
    x = _where(ratings, season=season).join(team_seasons.select("season", "team", "conf", "n_matches", "wins", "losses"), ["season", "team"], "left")
    x = ranked(x, ["season"], rating, "rank", only=F.col("n_matches") >= least).where(F.col("n_matches") >= least)
    return _where(x, conf=conf).orderBy("rank", "team")


def conference_schedule(strength: DataFrame, ratings: DataFrame, team_seasons: DataFrame, season, rating: str, least: int = 4) -> DataFrame:
    """Mean schedule strength and rating by conference, and their gap, for conferences of enough teams."""
    x = _where(strength, season=season).join(ratings.select("season", "team", rating), ["season", "team"]).join(team_seasons.select("season", "team", "conf"), ["season", "team"])
    g = x.groupBy("conf").agg(F.count(F.lit(1)).alias("teams"), F.avg("sos").alias("sos"), F.avg(rating).alias("rating")).where(F.col("teams") >= least)
    return g.withColumn("gap", F.col("sos") - F.col("rating"))


def team_schedule(matches: DataFrame, ratings: DataFrame, season, team, rating: str) -> DataFrame:
    """A team's opponents with rating and rank, the strongest first."""
    r = ranked(_where(ratings, season=season), ["season"], rating, "opp_rank").select(F.col("team").alias("opponent"), F.col(rating).alias("opp_rating"), "opp_rank")
    return _where(matches, season=season, team=team).join(r, "opponent", "left").orderBy(F.desc_nulls_last("opp_rating"), "opponent", "day", "contest_id")


def team_matches(matches: DataFrame, season, team) -> DataFrame:
    return _where(matches, season=season, team=team).orderBy("day", "contest_id")


def player_rankings(players: DataFrame, season, position, conf=None, team=None, unranked: bool = False) -> DataFrame:
    """A position's board; ranks are over all ranked players of the position."""
    x = ranked(_where(players, season=season, position=position), ["season", "position"], "rating", "rank", only=F.col("ranked"))
    x = x if unranked else x.where("ranked")
    return _where(x, conf=conf, team=team).orderBy(F.asc_nulls_last("rank"), "player")


def interleaved(players: DataFrame, season, positions: Sequence[str], conf=None, team=None) -> DataFrame:
    """Several positions' boards in one, by rank and then in the order of positions."""
    x = ranked(_where(players, season=season).where(F.col("position").isin(*positions)), ["season", "position"], "rating", "rank", only=F.col("ranked")).where("ranked")
    return _where(x, conf=conf, team=team).orderBy("rank", F.array_position(F.array(*map(F.lit, positions)), F.col("position")), "player")


def position_boards(players: DataFrame, season, positions: Sequence[str], conf=None, team=None) -> DataFrame:
    """Boards of all positions, one after the other."""
    return interleaved(players, season, positions, conf, team).orderBy(F.array_position(F.array(*map(F.lit, positions)), F.col("position")), "rank", "player")


def scoped(players: DataFrame, season, n: int, teams: Sequence | None = None) -> DataFrame:
    """The first n of each position, or those of chosen teams."""
    x = _where(players, season=season).where("ranked")
    return x.where(F.col("team").isin(*teams)) if teams else top(x, ["position"], [F.desc("rating"), "player"], n)


def lookup(rows: DataFrame, column: str, **equal) -> DataFrame:
    """One value or no row."""
    return _where(rows, **equal).where(F.col(column).isNotNull()).agg(F.min(column).alias(column)).where(F.col(column).isNotNull())


def metric_ranks(team_seasons: DataFrame, season, metrics: dict[str, bool], conf=None, least: int = 5) -> DataFrame:
    """Rank of each metric over a pool, which is filtered before ranks are taken; metrics: name to whether higher is better."""
    x = _where(team_seasons, season=season, conf=conf).where(F.col("n_matches") >= least)
    for c, higher in metrics.items():
        x = ranked(x, [], c, f"rank_{c}", higher)
    return x.select("team", *[f"rank_{c}" for c in metrics])


def sides_of(predictions: DataFrame, season, team) -> DataFrame:
    """A team's predicted matches from its side, with running wins and expected wins."""
    home = F.col("home") == team
    x = _where(predictions, season=season).where(home | (F.col("away") == team))
    x = x.select("contest_id", "day", F.when(home, F.col("away")).otherwise(F.col("home")).alias("opponent"), F.when(home, F.col("p_home")).otherwise(1 - F.col("p_home")).alias("p"), F.when(home, F.col("home_won")).otherwise(1 - F.col("home_won")).alias("won"))
    w = Window.orderBy("day", "contest_id").rowsBetween(Window.unboundedPreceding, 0)  # one team's matches
    return x.withColumn("cum_won", F.sum("won").over(w)).withColumn("cum_p", F.sum("p").over(w))


def head_to_head(predictions: DataFrame, season, a, b) -> DataFrame:
    return sides_of(predictions, season, a).where(F.col("opponent") == b)


def upcoming(schedule: DataFrame, season, team, after: Column) -> DataFrame:
    """A team's unplayed matches after a day, from its side."""
    home = F.col("home") == team
    return _where(schedule, season=season).where((home | (F.col("away") == team)) & (F.col("day") > after)).select("contest_id", "day", F.when(home, F.col("away")).otherwise(F.col("home")).alias("opponent"), F.when(home, F.col("p_home")).otherwise(1 - F.col("p_home")).alias("p")).orderBy("day", "contest_id")


def ratings_as_of(predictions: DataFrame, season) -> DataFrame:
    return _where(predictions, season=season).agg(F.max("day").alias("as_of"))


def season_frame(matches: DataFrame, season, team, metrics: Sequence[str], back: int = 0) -> DataFrame:
    """A team's season means beside one of its matches, the latest but back."""
    x = _where(matches, season=season, team=team)
    one = x.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("day"), F.desc("contest_id")))).where(F.col("_r") == back + 1)  # one team's matches
    means = x.agg(*[F.avg(c).alias(f"{c}_mean") for c in metrics])
    return one.select("contest_id", "day", *metrics).crossJoin(F.broadcast(means))  # one row
