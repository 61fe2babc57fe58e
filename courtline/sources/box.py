"""Landing of box scores, results, schedules and quality maps; team boxes from player rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as x

TEAM_BOX = ["Season", "Date", "TeamID", "Team", "Conference", "Opponent", "Result", "S", "Kills", "Errors", "Total Attacks", "Hit Pct", "Assists", "Aces", "SErr", "Digs", "RetAtt", "RErr", "Block Solos", "Block Assists", "BErr", "PTS", "BHE"]
PLAYER_COUNTS = ["Kills", "Errors", "TotalAttacks", "Assists", "SetAtt", "SetErr", "Aces", "SErr", "ServeAtt", "Digs", "RetAtt", "RErr", "BlockSolos", "BlockAssists", "BErr", "PTS", "BHE"]
PLAYER_BOX = ["ContestID", "Season", "Date", "Team", "Conference", "Opponent Team", "Location", "Player", "P", "S", *PLAYER_COUNTS]


def strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def any_date(text: Column) -> Column:
    """An ISO or a US date; null if neither."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "M/d/yyyy"))


def read_csv(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    return spark.read.schema(strings(names)).option("header", True).csv(paths if isinstance(paths, str) else list(paths))


def land_team_box(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Team rows of decided matches, numbers with default 0, sets from the result."""
    rows = read_csv(spark, paths, TEAM_BOX).where(F.col("Result").rlike("^[WL]"))
    numbers = [n for n in TEAM_BOX[7:]]
    return rows.select(
        any_date(F.col("Date")).alias("day"), F.col("Season").alias("season_label"), F.col("Team").alias("team"), F.col("Conference").alias("conference"), x.clean_opponent(F.col("Opponent")).alias("opponent"), F.col("Opponent").startswith("@").alias("away"),
        F.col("Result").startswith("W").alias("won"), x.result_sets(F.col("Result"), 0).alias("sets_for"), x.result_sets(F.col("Result"), 1).alias("sets_against"), *[x.number(F.col(n)).alias(n.lower().replace(" ", "_")) for n in numbers],
    )


def land_player_box(spark: SparkSession, paths: str | Sequence[str], groups: dict[str, str]) -> DataFrame:
    """Player rows with a position group, numbers with default 0, an empty opponent as '(unknown)'."""
    rows = read_csv(spark, paths, PLAYER_BOX).withColumn("position", x.position_group(F.col("P"), groups)).where("position is not null")
    opponent = F.coalesce(F.nullif(F.trim(F.col("`Opponent Team`")), F.lit("")), F.lit("(unknown)"))
    return rows.select(F.col("ContestID").alias("contest_id"), F.substring("Season", 1, 4).try_cast("int").alias("season"), any_date(F.col("Date")).alias("day"), F.col("Team").alias("team"), F.col("Conference").alias("conference"), opponent.alias("opponent"), F.col("Player").alias("player"), x.name_key(F.col("Player")).alias("player_key"), "position", *[x.number(F.col(n)).alias(n) for n in ["S", *PLAYER_COUNTS]])


def land_roster(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """team, player_key and position; of several rows the last of the last file by name."""
    rows = order_landed(read_csv(spark, paths, ["Team", "Player", "Pos"]).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")))
    return rows.groupBy(F.col("Team").alias("team"), x.letters_key(F.col("Player")).alias("player_key")).agg(F.max_by("Pos", F.struct("path", "seq")).alias("position"))


def team_box(rows: DataFrame, by: Sequence[str], sums: Sequence[str], most: str) -> DataFrame:
    """Team rows from player rows: players, sums, the largest of one column as s, and the weighted rate."""
    return rows.groupBy(*by).agg(F.first("day").alias("day"), F.count(F.lit(1)).alias("players"), *[F.sum(c).alias(c) for c in sums], F.max(most).alias("s"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("rate"))


def with_results(box: DataFrame, results: DataFrame) -> DataFrame:
    """Team rows with 'W 3-1' or 'L 1-3' from results keyed by day and unordered pair."""
    lo, hi = F.least("team", "opponent"), F.greatest("team", "opponent")
    r = results.select(F.col("day").alias("_day"), F.col("lo"), F.col("hi"), "home", "home_sets", "away_sets")
    both = box.join(r, (F.col("day") == F.col("_day")) & (lo == F.col("lo")) & (hi == F.col("hi")), "left")
    own, other = F.when(F.col("team") == F.col("home"), F.col("home_sets")).otherwise(F.col("away_sets")), F.when(F.col("team") == F.col("home"), F.col("away_sets")).otherwise(F.col("home_sets"))
    result = F.when(F.col("home").isNotNull(), F.concat(F.when(own > other, "W ").otherwise("L "), own.cast("string"), F.lit("-"), other.cast("string")))
    return both.withColumn("result", result).drop("_day", "lo", "hi", "home", "home_sets", "away_sets")


def last_by(rows: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The last row of each key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in others])


RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("date", "game_id", "away_team", "home_team")] + [T.StructField("away_sets", T.IntegerType()), T.StructField("home_sets", T.IntegerType()), T.StructField("winner", T.StringType()), T.StructField("state", T.StringType())])


def land_results(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Results keyed by day and unordered pair; of several rows the last of the last file by name. Files that are no JSON give no rows."""
    rows = spark.read.schema(RESULT).option("multiLine", True).option("mode", "DROPMALFORMED").json(paths if isinstance(paths, str) else list(paths)).where("home_team is not null and away_team is not null").withColumn("_seq", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))  # a file is read by one task
    keyed = rows.select(any_date(F.col("date")).alias("day"), F.least("home_team", "away_team").alias("lo"), F.greatest("home_team", "away_team").alias("hi"), F.col("home_team").alias("home"), F.col("away_team").alias("away"), "home_sets", "away_sets", "winner", "state", "game_id", "_seq")
    return last_by(keyed, ["day", "lo", "hi"], "_seq").drop("_seq")


SCHEDULED = T.StructType([T.StructField(c, T.StringType()) for c in ("date", "game_id", "away_team", "home_team", "state")])


def land_schedule(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every scheduled game as it is: day, game_id, home, away, state (empty if none is told). Games without a date or a side go; a pair may meet twice on a day."""
    rows = spark.read.schema(SCHEDULED).option("multiLine", True).option("mode", "DROPMALFORMED").json(paths if isinstance(paths, str) else list(paths))
    name = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(any_date(F.col("date")).alias("day"), "game_id", name("home_team").alias("home"), name("away_team").alias("away"), F.coalesce("state", F.lit("")).alias("state")).dropna(subset=["day", "home", "away"])


def conference_by_priority(sources: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    """team and conf from several sources (team, conf): the one with the least priority number wins; empty names do not count."""
    rows = None
    for priority, df in sources:
        part = df.select("team", "conf").where("team is not null and trim(conf) <> ''").withColumn("_p", F.lit(priority))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("team").agg(F.min(F.struct("_p", "conf")).alias("_x")).select("team", F.col("_x.conf").alias("conf"))


QUALITY = T.MapType(T.StringType(), T.StructType([T.StructField("school", T.StringType()), T.StructField("qualified", T.BooleanType()), *[T.StructField(c, T.IntegerType()) for c in ("total", "great", "good", "bad")]]))


def quality_rows(rows: DataFrame, column: str) -> DataFrame:
    """Rows of a quality map in a JSON column: name, school, touches, rating and bad share of the qualified."""
    each = rows.select(*[c for c in rows.columns if c != column], F.explode(F.from_json(column, QUALITY)).alias("key", "q")).where("q.qualified and q.total > 0")
    name = F.trim(F.split_part("key", F.lit("|"), F.lit(1)))
    return each.select(*[c for c in rows.columns if c != column], name.alias("name"), F.col("q.school").alias("school"), F.col("q.total").alias("touches"), ((2 * F.col("q.great") + F.col("q.good")) / F.col("q.total")).alias("rating"), (F.col("q.bad") / F.col("q.total")).alias("bad_share"))


def set_score_rows(rows: DataFrame, column: str) -> DataFrame:
    """contest_id, home and away points of the first set from a JSON map of contests to set scores."""
    each = rows.select(F.explode(F.from_json(column, T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.IntegerType()))))).alias("contest_id", "sets")).where(F.size("sets") > 0)
    first = F.try_element_at("sets", F.lit(1))
    return each.select("contest_id", F.try_element_at(first, F.lit(1)).alias("home"), F.try_element_at(first, F.lit(2)).alias("away"), F.size("sets").alias("n_sets"))


def settled(manifest: DataFrame, today: Column, grace: int = 2, stale: int = 21) -> DataFrame:
    """settled: a day old enough with no games, or with rows held and all games final, or older than stale days with rows held."""
    age = F.datediff(today, F.col("day"))
    done = (F.col("games") == 0) | (F.col("held") & ((F.col("finals") >= F.col("games")) | (age >= stale)))
    return manifest.withColumn("settled", (age >= grace) & F.coalesce(done, F.lit(False)))


def pending(results: DataFrame, landed: DataFrame, ledger: DataFrame, since: Column, retry: bool = False) -> DataFrame:
    """Results with an id that are not landed; without retry, only recent ones that the ledger does not list."""
    rows = results.where("game_id is not null").join(landed.select("game_id").distinct(), "game_id", "left_anti")
    return rows if retry else rows.where(F.col("day") >= since).join(ledger.select("game_id").distinct(), "game_id", "left_anti")


def load_manifest(files: DataFrame) -> DataFrame:
    """Files and bytes by source and status."""
    return files.groupBy("source", "status").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def carried_forward(new: DataFrame, published: DataFrame, season: str = "season") -> DataFrame:
    """The new rows, and published rows of seasons that the new ones do not have."""
    return new.unionByName(published.join(new.select(season).distinct(), season, "left_anti").select(*new.columns))


def seasons_to_adopt(ours: DataFrame, theirs: DataFrame, current: int) -> DataFrame:
    """Seasons of another store that are not current and differ in size from ours."""
    a, b = (d.groupBy("season").agg(F.count(F.lit(1)).alias(n)) for d, n in ((ours, "n_ours"), (theirs, "n_theirs")))
    return b.join(a, "season", "left").where((F.col("season") != current) & (F.coalesce("n_ours", F.lit(-1)) != F.col("n_theirs"))).select("season", "n_theirs")


def order_landed(lines: DataFrame) -> DataFrame:
    """seq: the place of each row in its files, from the split that it was read in and its place there.

    lines: as read from files, with columns path and block (of _metadata). Ids within a split rise in
    file order; the sort key is total, and the number is made once, before rows are written.
    """
    tagged = lines.withColumn("_id", F.monotonically_increasing_id())
    at = Window.partitionBy("path", "block").orderBy("_id")
    placed = tagged.withColumn("_in", F.row_number().over(at))
    sizes = tagged.groupBy("path", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("block")) - F.col("_n")
    return placed.join(sizes.withColumn("_before", before).drop("_n"), ["path", "block"]).withColumn("seq", F.col("_before") + F.col("_in")).drop("_id", "_in", "_before")
