"""Landing of play-by-play text files and per-match JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as x
from .box import any_date, order_landed, strings

EVENTS = ["date", "away_team", "home_team", "set", "event", "team", "player", "score"]

_S = T.StringType()
_TEAM = T.ArrayType(T.StructType([T.StructField("teamId", _S), T.StructField("isHome", T.BooleanType()), T.StructField("nameShort", _S)]))
_PLAY = T.StructType([T.StructField("playText", _S), T.StructField("homeScore", T.IntegerType()), T.StructField("visitorScore", T.IntegerType())])
POINTS = T.StructType([*[T.StructField(c, _S) for c in ("_date", "_away_team", "_home_team")], T.StructField("teams", _TEAM), T.StructField("periods", T.ArrayType(T.StructType([T.StructField("playbyplayStats", T.ArrayType(T.StructType([T.StructField("teamId", _S), T.StructField("plays", T.ArrayType(_PLAY))])))])))])
#: Names in a box document and in the landed table.
COUNTS = {"gamesPlayed": "S", "kills": "Kills", "attackErrors": "Errors", "attackAttempts": "TotalAttacks", "assists": "Assists", "setAttempts": "SetAtt", "setErrors": "SetErr", "serviceAces": "Aces", "serviceErrors": "SErr", "serveAttempts": "ServeAtt", "digs": "Digs", "receptionAttempts": "RetAtt", "receptionErrors": "RErr", "blockSolos": "BlockSolos", "blockAssists": "BlockAssists", "blockingErrors": "BErr", "points": "PTS", "ballHandlingErrors": "BHE"}
BOX = T.StructType([*[T.StructField(c, _S) for c in ("_date", "_away_team", "_home_team", "_contest_id")], T.StructField("teams", _TEAM), T.StructField("teamBoxscore", T.ArrayType(T.StructType([T.StructField("teamId", _S), T.StructField("playerStats", T.ArrayType(T.StructType([*[T.StructField(c, _S) for c in ("firstName", "lastName", "position", *COUNTS)], T.StructField("participated", T.BooleanType())])))])))])


def land_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with seq, their place in their file; a score parsed into two columns; the season from the file name, if it has one."""
    rows = spark.read.schema(strings(EVENTS)).option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    placed = order_landed(rows)
    return placed.select("path", "seq", any_date(F.col("date")).alias("day"), "away_team", "home_team", F.col("set").try_cast("int").alias("set_no"), "event", "team", "player", x.score_part(F.col("score"), 0).alias("score_away"), x.score_part(F.col("score"), 1).alias("score_home"), season_of(F.col("path")).alias("file_season"))


#: A season in a file's name.
SEASON = r"((?:19|20)\d{2})[^/]*$"


def season_of(path: Column, pattern: str = SEASON) -> Column:
    return F.regexp_extract(path, pattern, 1).try_cast("int")


def _sides(rows: DataFrame) -> DataFrame:
    """home and away ids of documents with one home and one away team; others go."""
    home = lambda t: F.coalesce(t["isHome"], F.lit(False))
    pick = lambda yes: F.filter("teams", lambda t: home(t) if yes else ~home(t))[0]
    return rows.where((F.size("teams") == 2) & (F.size(F.filter("teams", home)) == 1)).withColumn("_h", pick(True)).withColumn("_a", pick(False))


def _stripped(name: Column) -> Column:
    return F.btrim(name, F.lit(" \t\r\n"))


def _named(board: str, short: str | None = None) -> Column:
    """A team's name as the scoreboard has it, which is how results and boxes call it; else the document's own, if that may stand in."""
    name = F.nullif(F.col(board), F.lit(""))
    return F.nullif(_stripped(F.coalesce(name, F.nullif(F.col(short), F.lit(""))) if short else name), F.lit(""))


def season_files(spark: SparkSession, path: str, pattern: str = SEASON) -> DataFrame:
    """path and season of the CSV files under a folder; files without a season in their path go. A row for each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select("path")
    return files.withColumn("season", season_of(F.col("path"), pattern)).where("season is not null")


def union_seasons(spark: SparkSession, path: str, pattern: str = SEASON) -> DataFrame:
    """All CSV files under a folder as one table of strings with season (the pattern's group, of a file's path) and path.

    Files may have different columns in any order: a file has null in those that it lacks, as a column that came
    with a later season. Files with the same header are one scan; only headers are read before.
    """
    headers: dict[tuple[str, ...], list[str]] = {}
    for r in season_files(spark, path, pattern).collect():  # a row for each file
        names = spark.read.option("header", True).csv(r["path"]).columns
        headers.setdefault(tuple(names), []).append(r["path"])
    out = None
    for names, paths in headers.items():
        rows = spark.read.schema(strings(names)).option("header", True).csv(paths).select("*", F.col("_metadata.file_path").alias("path"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "path string, season int")
    return out.withColumn("season", season_of(F.col("path"), pattern))


def land_points(spark: SparkSession, path: str) -> DataFrame:
    """One row per scored play of each document: set_no, seq, team, kind, actor, scores after the play.

    Teams are told apart by id and called as the scoreboard calls them; a play of any other id is none, and a set
    without a scored play is not counted. Documents without two names go.
    """
    rows = _sides(spark.read.schema(POINTS).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumn("_file", F.col("_metadata.file_path")))
    rows = rows.select("_file", any_date(F.col("_date")).alias("day"), _named("_home_team", "_h.nameShort").alias("home_team"), _named("_away_team", "_a.nameShort").alias("away_team"), F.col("_h.teamId").alias("_hid"), F.col("_a.teamId").alias("_aid"), "periods")
    known = lambda s: ((s["teamId"] == F.col("_hid")) | (s["teamId"] == F.col("_aid"))) & F.exists(s["plays"], lambda p: p["homeScore"].isNotNull())
    scored = F.filter("periods", lambda p: F.coalesce(F.exists(p["playbyplayStats"], known), F.lit(False)))
    sets = rows.where("home_team is not null and away_team is not null").select("_file", "day", "away_team", "home_team", "_hid", "_aid", F.posexplode(scored).alias("_set", "_p"))
    stats = sets.select("*", F.posexplode("_p.playbyplayStats").alias("_i", "_s"))
    plays = stats.select("*", F.posexplode("_s.plays").alias("_j", "_play")).where("_play.homeScore is not null and (_s.teamId = _hid or _s.teamId = _aid)")
    told = F.col("_play.playText")
    return plays.select("_file", "day", "away_team", "home_team", (F.col("_set") + 1).alias("set_no"), (F.col("_i") * 100000 + F.col("_j")).alias("seq"), F.when(F.col("_s.teamId") == F.col("_hid"), F.col("home_team")).otherwise(F.col("away_team")).alias("team"), x.play_kind(told).alias("kind"), x.actor(told).alias("actor"), F.col("_play.homeScore").alias("home_score"), F.col("_play.visitorScore").alias("away_score"))


def land_player_stats(spark: SparkSession, path: str, season: str | None = None, conferences: DataFrame | None = None) -> DataFrame:
    """One row per player who took part: contest, season, team, conference, opponent, location and counts as numbers.

    Names are the scoreboard's; documents that lack them or a date go, as do players without a name and rows of a team that
    the document does not list. The contest is the file's name, unless the document tells it; the season is given, or the year of the day.
    conferences: team and conf.
    """
    docs = _sides(spark.read.schema(BOX).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumn("_file", F.col("_metadata.file_name")))
    docs = docs.select(F.coalesce("_contest_id", F.regexp_replace("_file", r"\.[^.]*(\.gz)?$", "")).alias("contest_id"), any_date(F.col("_date")).alias("day"), _named("_home_team").alias("_home"), _named("_away_team").alias("_away"), F.col("_h.teamId").alias("_hid"), F.col("_a.teamId").alias("_aid"), F.explode("teamBoxscore").alias("_b"))
    rows = docs.where("day is not null and _home is not null and _away is not null and (_b.teamId = _hid or _b.teamId = _aid)").select("*", F.explode("_b.playerStats").alias("_p"))
    home = F.col("_b.teamId") == F.col("_hid")
    name = F.trim(F.regexp_replace(F.concat_ws(" ", "_p.firstName", "_p.lastName"), r"\s+", " "))
    year = F.lit(season) if season else F.year("day").cast("string")
    rows = rows.where("_p.participated").withColumn("player", name).where("player <> ''").withColumn("team", F.when(home, F.col("_home")).otherwise(F.col("_away")))
    out = rows.select("contest_id", year.alias("season"), "day", "team", F.when(home, F.col("_away")).otherwise(F.col("_home")).alias("opponent"), F.when(home, "Home").otherwise("Away").alias("location"), "player", F.trim("_p.position").alias("position"), *[x.number(F.col(f"_p.{k}")).alias(v) for k, v in COUNTS.items()])
    if conferences is None:
        return out.withColumn("conference", F.lit(""))
    return out.join(conferences.select("team", F.col("conf").alias("conference")), "team", "left").withColumn("conference", F.coalesce("conference", F.lit("")))


def has_players(box: Column) -> Column:
    """Whether a box document's teamBoxscore has any player."""
    return F.coalesce(F.exists(box, lambda t: F.size(t["playerStats"]) > 0), F.lit(False))


def split_games(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Final and unplayed games of landed scoreboards (games: date, home, away, home_sets, away_sets, home_winner, state); blank names go."""
    named = rows.where((F.trim("home") != "") & (F.trim("away") != ""))
    winner = F.when(F.col("home_winner"), F.col("home")).when(F.col("home_sets") > F.col("away_sets"), F.col("home")).when(F.col("away_sets") > F.col("home_sets"), F.col("away"))
    return named.where("state = 'final'").withColumn("winner", winner), named.where("state <> 'final'")
