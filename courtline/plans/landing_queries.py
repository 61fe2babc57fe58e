"""Queries that write the given tables as feeds' files into the shared folder, land them, and return what was landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..session import new_folder, saved_rows
from ..sources import box, feeds, tables
from .contest_queries import SIDES_SQL, sides
from .registry import query
from .views import CONTEST_SQL, Tables

text = lambda c: F.col(c).cast("string")


def written_csv(t: Tables, rows: DataFrame, order: str, label: str) -> str:
    """Writes rows as CSV files, each in the order of a column, and gives the folder."""
    folder = new_folder(t.spark, label)
    rows.repartitionByRange(order).sortWithinPartitions(order).drop(order).write.option("header", True).csv(folder)
    return folder


#: Documents of a file.
FILE_DOCS = 2000


def written_json(t: Tables, docs: DataFrame, key: str, label: str) -> str:
    """Writes docs as compressed files of about FILE_DOCS documents, each an array, dealt by a column of them, and gives the folder."""
    folder = new_folder(t.spark, label)
    chunk = F.pmod(F.xxhash64(key), F.lit(docs.count() // FILE_DOCS + 1)).alias("chunk")
    docs.groupBy(chunk).agg(F.to_json(F.collect_list(F.struct(*docs.columns))).alias("value")).write.option("compression", "gzip").partitionBy("chunk").text(folder)
    return folder


@query("""SELECT CAST(ts AS DATE) AS day, event_id, 'h' || user_id AS home_team, (user_id % 5)::INT AS set_no, event_type AS event, (event_id % 26)::INT AS score_away, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 17)::INT END AS score_home, true AS in_order
FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id END AS e FROM events) WHERE e IS NOT NULL
UNION ALL SELECT CAST(ts AS DATE), event_id, 'h' || user_id, (user_id % 5)::INT, event_type, NULL, NULL, true FROM events WHERE event_id % 9 = 0""")
def a1_land_events(t):
    day = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "M/d/yyyy"))
    score = F.when(F.col("event_id") % 9 == 0, "-").otherwise(F.concat((F.col("event_id") % 26).cast("string"), F.lit("-"), (F.col("event_id") % 17).cast("string")))
    rows = t.events.select("event_id", day.alias("date"), F.lit("a").alias("away_team"), F.concat(F.lit("h"), text("user_id")).alias("home_team"), (F.col("user_id") % 5).cast("string").alias("set"), F.col("event_type").alias("event"), F.lit("t").alias("team"), text("event_id").alias("player"), score.alias("score"))
    landed = feeds.land_events(t.spark, written_csv(t, rows, "event_id", "events"))
    number = F.col("player").cast("long")
    before = F.lag(number).over(Window.partitionBy("path").orderBy("seq"))
    return landed.select("day", number.alias("event_id"), "home_team", "set_no", "event", "score_away", "score_home", F.coalesce(before < number, F.lit(True)).alias("in_order"))


@query("WITH " + SIDES_SQL + """ SELECT contest_id::VARCHAR AS season_label, day, team::VARCHAR AS team, conf AS conference, opponent::VARCHAR AS opponent, venue = 'away' AS away, won = 1 AS won, CASE WHEN won = 1 THEN 3 ELSE (contest_id % 3)::INT END AS sets_for, CASE WHEN won = 1 THEN (contest_id % 3)::INT ELSE 3 END AS sets_against, q::DOUBLE AS kills, 0.0::DOUBLE AS errors
FROM sides WHERE contest_id % 7 <> 0""")
def a2_land_team_box(t):
    s, k = sides(t), (F.col("contest_id") % 3).cast("string")
    result = F.when(F.col("contest_id") % 7 == 0, "Canceled").when(F.col("won") == 1, F.concat(F.lit("W 3-"), k)).otherwise(F.concat(F.lit("L "), k, F.lit("-3")))
    known = {"Season": text("contest_id"), "Date": F.date_format("day", "M/d/yyyy"), "Team": text("team"), "Conference": F.col("conf"), "Opponent": F.when(F.col("venue") == "away", F.concat(F.lit("@ "), text("opponent"))).otherwise(F.concat(text("opponent"), F.lit(" @ Omaha"))), "Result": result, "Kills": text("q"), "Errors": F.lit("none")}
    rows = s.select("contest_id", *[known.get(c, F.lit(None).cast("string")).alias(c) for c in box.TEAM_BOX])
    return box.land_team_box(t.spark, written_csv(t, rows, "contest_id", "team-box")).select("season_label", "day", "team", "conference", "opponent", "away", "won", "sets_for", "sets_against", "kills", "errors")


@query("""SELECT l_orderkey::VARCHAR AS contest_id, CAST(year(l_shipdate) AS INT) AS season, CAST(l_shipdate AS DATE) AS day, 'supplier' AS team, CASE WHEN l_linenumber = 2 THEN '(unknown)' ELSE l_suppkey::VARCHAR END AS opponent, 'part ' || l_partkey AS player_key,
CASE l_returnflag WHEN 'A' THEN 'pin' WHEN 'R' THEN 'back' END AS position, l_quantity::DOUBLE AS "Kills", l_linenumber::DOUBLE AS "S" FROM lineitem WHERE l_returnflag IN ('A', 'R')""")
def a3_land_player_box(t):
    known = {
        "ContestID": text("l_orderkey"), "Season": F.concat(F.year("l_shipdate").cast("string"), F.lit("-x")), "Date": F.date_format("l_shipdate", "yyyy-MM-dd"), "Team": F.lit("supplier"), "Opponent Team": F.when(F.col("l_linenumber") == 2, " ").otherwise(text("l_suppkey")),
        "Player": F.concat(F.lit(" PART  "), text("l_partkey")), "P": F.lower("l_returnflag"), "S": text("l_linenumber"), "Kills": text("l_quantity"),
    }
    rows = t.lineitem.select("l_orderkey", *[known.get(c, F.lit(None).cast("string")).alias(c) for c in box.PLAYER_BOX])
    landed = box.land_player_box(t.spark, written_csv(t, rows, "l_orderkey", "player-box"), {"A": "pin", "R": "back"})
    return landed.select("contest_id", "season", "day", "team", "opponent", "player_key", "position", "Kills", "S")


@query("""SELECT c_mktsegment AS team, upper('p ' || chr(97 + (c_custkey % 26)::INT)) AS player_key, arg_max('pos' || c_custkey, c_custkey) AS position FROM customer GROUP BY 1, 2""")
def a25_land_roster(t):
    """Of several rows of a player the last counts; files are in order of the customers, and so are their names."""
    letter = F.chr(97 + F.col("c_custkey") % 26)
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("Team"), F.concat(letter, F.lit(", p")).alias("Player"), F.concat(F.lit("pos"), text("c_custkey")).alias("Pos"))
    return box.land_roster(t.spark, written_csv(t, rows, "c_custkey", "roster"))


@query("WITH " + CONTEST_SQL + """ SELECT day, least(home, away) AS lo, greatest(home, away) AS hi, any_value(home_won)::INT AS home_sets FROM (SELECT day, home::VARCHAR AS home, away::VARCHAR AS away, home_won FROM contest) GROUP BY 1, 2, 3 HAVING count(*) = 1""")
def a8_a9_land_results(t):
    """Results of pairs that met once on a day; which of several counts follows from the files' order."""
    known = t.contest().select(F.date_format("day", "yyyy-MM-dd").alias("date"), text("contest_id").alias("game_id"), text("home").alias("home_team"), text("away").alias("away_team"), F.col("home_won").cast("int").alias("home_sets"), F.lit(0).alias("away_sets"))
    once = known.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date", F.least("home_team", "away_team"), F.greatest("home_team", "away_team")))).where("n = 1").drop("n")
    return box.land_results(t.spark, written_json(t, once, "game_id", "results")).select("day", "lo", "hi", "home_sets")


@query("WITH " + CONTEST_SQL + """ SELECT contest_id, CASE WHEN contest_id % 5 = 0 THEN NULL WHEN contest_id % 2 = 0 THEN home::VARCHAR WHEN home_q > away_q THEN home::VARCHAR WHEN away_q > home_q THEN away::VARCHAR END AS winner, contest_id % 5 <> 0 AS final FROM contest WHERE contest_id % 11 <> 0""")
def a10_a11_split_games(t):
    home = F.when(F.col("contest_id") % 11 == 0, " ").otherwise(text("home"))
    games = t.contest().select("contest_id", home.alias("home"), text("away").alias("away"), F.col("home_q").alias("home_sets"), F.col("away_q").alias("away_sets"), (F.col("contest_id") % 2 == 0).alias("home_winner"), F.when(F.col("contest_id") % 5 == 0, "pre").otherwise("final").alias("state"))
    finals, unplayed = feeds.split_games(games)
    return finals.select("contest_id", "winner", F.lit(True).alias("final")).unionByName(unplayed.select("contest_id", F.lit(None).cast("string").alias("winner"), F.lit(False).alias("final")))


@query("""WITH w AS (SELECT *, count(*) FILTER (event_id % 13 <> 0 AND event_id % 7 <> 0) OVER (PARTITION BY user_id, date_trunc('week', ts)) > 0 AS scored, row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) - 1 AS i FROM events),
e AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('week', ts)) AS set_no FROM w WHERE scored)
SELECT CASE WHEN user_id % 3 = 0 THEN 'home ' ELSE 'board ' END || user_id AS home_team, set_no::INT AS set_no, (i * 100000)::INT AS seq, CASE WHEN event_id % 2 = 0 THEN CASE WHEN user_id % 3 = 0 THEN 'home ' ELSE 'board ' END || user_id ELSE 'away' END AS team, CASE event_type WHEN 'purchase' THEN 'Kill' WHEN 'error' THEN 'Block error' WHEN 'click' THEN 'Ace' ELSE 'Other' END AS kind,
'Player ' || user_id AS actor, (event_id % 30)::INT AS home_score, (event_id % 20)::INT AS away_score FROM e WHERE event_id % 13 <> 0 AND event_id % 7 <> 0""")
def a4_land_points(t):
    """Documents whose scoreboard has another name than the document (but for a third, where it has none), and plays of a team that is neither."""
    week = F.date_trunc("week", "ts")
    told = F.concat(F.element_at(F.create_map(*[F.lit(v) for kv in {"purchase": "Kill", "error": "Block error", "click": "Service ace", "view": "Serve", "signup": "Set"}.items() for v in kv]), F.col("event_type")), F.lit(" by Player "), text("user_id"), F.lit(", assisted."))
    play = F.struct(told.alias("playText"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 30).cast("int").alias("homeScore"), (F.col("event_id") % 20).cast("int").alias("visitorScore"))
    stat = F.struct(F.when(F.col("event_id") % 7 == 0, "9").when(F.col("event_id") % 2 == 0, "1").otherwise("2").alias("teamId"), F.array(play).alias("plays"))
    sets = t.events.groupBy("user_id", week.alias("week")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", stat.alias("stat")))), lambda r: r["stat"]).alias("playbyplayStats"))
    docs = sets.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("week", "playbyplayStats"))), lambda r: F.struct(r["playbyplayStats"].alias("playbyplayStats"))).alias("periods"))
    team = lambda i, home, name: F.struct(F.lit(i).alias("teamId"), F.lit(home).alias("isHome"), name.alias("nameShort"))
    teams = F.array(team("1", True, F.concat(F.lit(" home "), text("user_id"))), team("2", False, F.lit("away ")))
    board = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("board "), text("user_id"), F.lit(" ")))
    folder = written_json(t, docs.select("user_id", F.lit("2024-01-01").alias("_date"), board.alias("_home_team"), teams.alias("teams"), "periods"), "user_id", "points")
    return feeds.land_points(t.spark, folder).select("home_team", F.col("set_no").cast("int").alias("set_no"), F.col("seq").cast("int").alias("seq"), "team", "kind", "actor", "home_score", "away_score")


@query("""SELECT l_orderkey || '-' || l_linenumber AS contest_id, year(l_shipdate)::VARCHAR AS season, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber % 2 = 1 THEN 'board ' || l_suppkey ELSE 'guest' END AS team, CASE WHEN l_linenumber % 2 = 1 THEN coalesce(r_name, '') ELSE '' END AS conference,
CASE WHEN l_linenumber % 2 = 1 THEN 'guest' ELSE 'board ' || l_suppkey END AS opponent, CASE WHEN l_linenumber % 2 = 1 THEN 'Home' ELSE 'Away' END AS location, 'First ' || l_partkey AS player, l_returnflag AS position, l_quantity::DOUBLE AS "Kills", 0.0::DOUBLE AS "Digs"
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_partkey % 5 <> 0 AND l_orderkey % 17 <> 0 AND l_partkey % 11 <> 0""")
def a5_land_player_stats(t):
    """A document for each line: the scoreboard's names differ from the document's, some documents lack them, and some players have no name."""
    nameless = F.col("l_partkey") % 11 == 0
    stats = F.struct(F.when(nameless, " ").otherwise("First ").alias("firstName"), F.when(~nameless, F.concat(F.lit(" "), text("l_partkey"))).alias("lastName"), F.col("l_returnflag").alias("position"), text("l_quantity").alias("kills"), F.lit("").alias("digs"), (F.col("l_partkey") % 5 != 0).alias("participated"))
    team = lambda i, home, name: F.struct(F.lit(i).alias("teamId"), F.lit(home).alias("isHome"), F.lit(name).alias("nameShort"))
    own = F.array(F.struct(F.when(F.col("l_linenumber") % 2 == 1, "1").otherwise("2").alias("teamId"), F.array(stats).alias("playerStats")), F.struct(F.lit("7").alias("teamId"), F.array(stats).alias("playerStats")))
    contest = F.concat(text("l_orderkey"), F.lit("-"), text("l_linenumber"))
    board = F.when(F.col("l_orderkey") % 17 != 0, F.concat(F.lit("board "), text("l_suppkey"), F.lit(" ")))
    docs = t.lineitem.select(contest.alias("_contest_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("_date"), board.alias("_home_team"), F.lit("guest").alias("_away_team"), F.array(team("1", True, "home"), team("2", False, "away ")).alias("teams"), own.alias("teamBoxscore"))
    conferences = t.conference().select(F.concat(F.lit("board "), text("team")).alias("team"), "conf")
    landed = feeds.land_player_stats(t.spark, written_json(t, docs, "_contest_id", "boxes"), None, conferences)
    return landed.select("contest_id", "season", "day", "team", "conference", "opponent", "location", "player", "position", "Kills", "Digs")


@query("WITH " + CONTEST_SQL + """ SELECT contest_id::VARCHAR AS game_id, day, home::VARCHAR AS home, away::VARCHAR AS away, CASE WHEN contest_id % 3 = 0 THEN 'pre' WHEN contest_id % 3 = 1 THEN 'final' ELSE '' END AS state FROM contest WHERE contest_id % 19 <> 0""")
def a9_land_schedule(t):
    """Scheduled games with their state, among them pairs that meet twice on a day; games without a side go."""
    k = F.col("contest_id")
    day = F.when(k % 2 == 0, F.date_format("day", "M/d/yyyy")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    docs = t.contest().select(day.alias("date"), text("contest_id").alias("game_id"), F.when(k % 19 == 0, " ").otherwise(text("home")).alias("home_team"), text("away").alias("away_team"), F.when(k % 3 == 0, "pre").when(k % 3 == 1, "final").alias("state"))
    return box.land_schedule(t.spark, written_json(t, docs, "game_id", "schedule"))


@query("WITH " + CONTEST_SQL + """ SELECT season, count(*) AS rows, count(CASE WHEN season > (SELECT min(season) FROM contest) THEN away_q END) AS with_away_q, sum(home_q)::DOUBLE AS home_q, coalesce(sum(away_q) FILTER (season > (SELECT min(season) FROM contest)), 0)::DOUBLE AS away_q FROM contest GROUP BY 1""")
def a12_season_union(t):
    """A file or more for each season, named by it; the first season's lack a column that later ones have, and the others have theirs in another order."""
    x = saved_rows(t.contest().select("season", "contest_id", "home", "away", "home_q", "away_q"), "contests")
    seasons = sorted(r["season"] for r in x.select("season").distinct().collect())  # a few numbers
    folder = new_folder(t.spark, "seasons")
    for k, season in enumerate(seasons):
        columns = ["contest_id", "home", "away", "home_q", "away_q"][: 4 if k == 0 else None]
        own = x.where(F.col("season") == season).select(*(columns if k % 2 == 0 else columns[::-1]))
        own.write.option("header", True).csv(f"{folder}/games_{season}")
    return season_rows(feeds.union_seasons(t.spark, folder, r"/games_(\d+)/[^/]*$"))


def season_rows(rows):
    number = lambda c: F.coalesce(F.sum(F.col(c).try_cast("double")), F.lit(0.0))
    return rows.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.count("away_q").alias("with_away_q"), number("home_q").alias("home_q"), number("away_q").alias("away_q"))


@query("""SELECT c_custkey, 'p' || c_custkey AS name, c_mktsegment AS school, (c_custkey % 40)::INT AS touches, round((2 * (c_custkey % 10) + c_custkey % 7) / (c_custkey % 40), 6) AS rating, round((c_custkey % 5) / (c_custkey % 40), 6) AS bad_share FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 40 > 0""")
def a6_quality_map(t):
    n = lambda k: (F.col("c_custkey") % k).cast("int")
    value = F.struct(F.col("c_mktsegment").alias("school"), (F.col("c_custkey") % 3 != 0).alias("qualified"), n(40).alias("total"), n(10).alias("great"), n(7).alias("good"), n(5).alias("bad"))
    rows = t.customer.select("c_custkey", F.to_json(F.create_map(F.concat(F.lit("p"), text("c_custkey"), F.lit(" | x")), value)).alias("json"))
    return box.quality_rows(rows, "json").select("c_custkey", "name", "school", "touches", F.round("rating", 6).alias("rating"), F.round("bad_share", 6).alias("bad_share"))


@query("SELECT o_orderkey::VARCHAR AS contest_id, (o_orderkey % 26)::INT AS home, (o_custkey % 26)::INT AS away, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_sets FROM orders WHERE o_orderkey % 3 <> 0")
def a7_set_scores(t):
    one = F.array((F.col("o_orderkey") % 26).cast("int"), (F.col("o_custkey") % 26).cast("int"))
    sets = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<array<int>>")).when(F.col("o_orderkey") % 2 == 0, F.array(one, F.array(F.lit(1), F.lit(2)))).otherwise(F.array(one))
    return box.set_score_rows(t.orders.select(F.to_json(F.create_map(text("o_orderkey"), sets)).alias("json")), "json")


@query("SELECT o_orderkey, o_orderkey % 4 IN (1, 2) AS has_players FROM orders")
def a23_has_players(t):
    some = "array<struct<teamId:string,playerStats:array<struct<lastName:string>>>>"
    doc = F.element_at(F.array(*map(F.lit, ("[]", '[{"teamId": "1", "playerStats": []}, {"teamId": "2", "playerStats": [{"lastName": "A"}]}]', '[{"teamId": "1", "playerStats": [{"lastName": "B"}]}]', "null"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", feeds.has_players(F.from_json(doc, some)).alias("has_players"))


@query("WITH " + SIDES_SQL + """, ts AS (SELECT season, team, count(*) AS n FROM sides GROUP BY 1, 2) SELECT 'main' AS pool, season, team, n FROM ts WHERE season <> 1997 UNION ALL SELECT 'main', season, team, n + 1000 FROM ts WHERE season = 1997 AND n > 5""")
def a14_a16_season_upsert(t):
    """A published table of which one season is written anew; the other seasons stay."""
    folder = new_folder(t.spark, "published")
    rows = sides(t).groupBy("season", "team").agg(F.count(F.lit(1)).alias("n")).select(F.lit("main").alias("pool"), "season", "team", "n")
    tables.write_seasons(rows, folder)
    tables.write_seasons(rows.where("season = 1997 and n > 5").withColumn("n", F.col("n") + 1000), folder)
    return t.spark.read.parquet(folder).select(text("pool").alias("pool"), F.col("season").cast("int").alias("season"), "team", "n")


@query("WITH " + SIDES_SQL + """, s AS (SELECT season, count(*) AS rows, round(avg(q), 4) AS mean_q FROM sides GROUP BY 1) SELECT 'csv' AS kind, * FROM s UNION ALL SELECT 'json', * FROM s""")
def a15_summaries(t):
    rows = sides(t).groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("q"), 4).alias("mean_q"))
    out = None
    for kind in ("csv", "json"):
        folder = new_folder(t.spark, f"summary-{kind}")
        tables.write_summary(rows, folder, kind)
        reader = t.spark.read.schema(rows.schema)
        back = (reader.option("header", True).csv(folder) if kind == "csv" else reader.json(folder)).select(F.lit(kind).alias("kind"), "season", "rows", "mean_q")
        out = back if out is None else out.unionByName(back)
    return out


@query("WITH " + SIDES_SQL + """, theirs AS (SELECT season, count(*) AS n FROM sides GROUP BY 1), ours AS (SELECT season, count(*) AS n FROM sides WHERE season <> 1996 AND NOT (season = 1995 AND q > 40) GROUP BY 1)
SELECT season, t.n AS n_theirs FROM theirs t LEFT JOIN ours o USING (season) WHERE season <> 2001 AND coalesce(o.n, -1) <> t.n""")
def a18_seasons_to_adopt(t):
    theirs = sides(t).select("season", "q")
    return box.seasons_to_adopt(theirs.where("season <> 1996 and not (season = 1995 and q > 40)"), theirs, 2001)
