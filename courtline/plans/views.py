"""Three views of the given tables that carry the operators: feed, contest and player_match.

feed: one row per event, an ordered log within a user's week with two sides. contest: one row per
order whose first two lines have different suppliers, a match between these. player_match: one row
per line, a player's (part's) match for a team (brand) against an opponent (supplier).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved_rows
from ..specs import EventSpec

FEED = EventSpec(
    keys=("user_id", "week"), order=("ts", "event_id"), event="event", team="team", player="player", sides=("A", "B"),
    start="view", receive="click", terminal=("purchase", "error"), direct="purchase", known=("view", "click", "purchase", "error"),
)

#: Lines of a task where lines are joined by order, and the least number of such tasks; for fewer, Spark's own partitions are small enough.
TASK_LINES, LEAST_TASKS = 1 << 19, 16


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str
    contests: DataFrame | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def feed(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            "user_id", F.date_trunc("week", "ts").alias("week"), "ts", "event_id", F.col("event_type").alias("event"),
            F.when(F.pmod(k, F.lit(2)) == 0, "A").otherwise("B").alias("team"), k.alias("player"), "value",
        )

    def contest(self) -> DataFrame:
        """contest_id, day, season, home, away, home_q, away_q, home_p, away_p, home_won (double), home_conf, away_conf.

        One grouping by order gives its first two lines; no window and no self-join. Lines that are equal in the
        columns of their order are equal in all that is taken from them.
        """
        if self.contests is not None:
            return self.contests
        line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        lines = self.lineitem
        n = lines.count() // TASK_LINES
        if n >= LEAST_TASKS:
            lines = lines.repartition(n, "l_orderkey")
        firsts = lines.groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(line)), 1, 2).alias("two")).where(F.size("two") == 2)
        home, away = F.col("two")[0], F.col("two")[1]
        rows = firsts.where(home["l_suppkey"] != away["l_suppkey"]).join(self.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        won = (home["l_quantity"] > away["l_quantity"]) | ((home["l_quantity"] == away["l_quantity"]) & (home["l_extendedprice"] > away["l_extendedprice"]))
        day = F.to_date("o_orderdate")
        rows = rows.select(
            F.col("l_orderkey").alias("contest_id"), day.alias("day"), F.year("o_orderdate").alias("season"), home["l_suppkey"].alias("home"), away["l_suppkey"].alias("away"),
            home["l_quantity"].alias("home_q"), away["l_quantity"].alias("away_q"), home["l_extendedprice"].alias("home_p"), away["l_extendedprice"].alias("away_p"), won.cast("double").alias("home_won"),
        )
        conf = self.conference()
        return rows.join(conf.select(F.col("team").alias("home"), F.col("conf").alias("home_conf")), "home").join(conf.select(F.col("team").alias("away"), F.col("conf").alias("away_conf")), "away")

    def with_contests(self) -> Tables:
        """The same tables with contests made once and written, for queries that read them many times."""
        return replace(self, contests=saved_rows(self.contest(), "contests"))

    def conference(self) -> DataFrame:
        """team and conf: a supplier's region."""
        nation = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("conf"))
        return self.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("team"), "conf")

    def league(self) -> DataFrame:
        """team and league: a supplier's nation."""
        return self.supplier.join(self.nation.select("n_nationkey", F.col("n_name").alias("league")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("team"), "league")

    def player_match(self) -> DataFrame:
        """match_id, day, season, player, position, team, opponent, w (weight), y (rate)."""
        rows = self.lineitem.join(self.part.select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        n = self.lineitem.count() // TASK_LINES
        if n >= LEAST_TASKS:  # what a task sorts and groups does not grow with the table
            rows = rows.repartition(n, "l_orderkey")
        rows = rows.join(self.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.select(
            F.col("l_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"), F.col("l_partkey").alias("player"),
            F.col("p_type").alias("position"), F.col("p_brand").alias("team"), F.col("l_suppkey").alias("opponent"), F.col("l_quantity").alias("w"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("y"),
        )


FEED_SQL = """feed AS (
  SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS week, ts, event_id, event_type AS event,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN 'A' ELSE 'B' END AS team,
         CAST(json_extract_string(props, '$.k') AS INT) AS player, value FROM events)"""
CONTEST_SQL = """line AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate) AS rn FROM lineitem),
conference AS (SELECT s_suppkey AS team, r_name AS conf FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
contest AS (
  SELECT o_orderkey AS contest_id, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INT) AS season, a.l_suppkey AS home, b.l_suppkey AS away,
         a.l_quantity AS home_q, b.l_quantity AS away_q, a.l_extendedprice AS home_p, b.l_extendedprice AS away_p,
         CASE WHEN a.l_quantity > b.l_quantity OR (a.l_quantity = b.l_quantity AND a.l_extendedprice > b.l_extendedprice) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS home_won,
         ch.conf AS home_conf, ca.conf AS away_conf
  FROM orders JOIN line a ON a.l_orderkey = o_orderkey AND a.rn = 1 JOIN line b ON b.l_orderkey = o_orderkey AND b.rn = 2
  JOIN conference ch ON ch.team = a.l_suppkey JOIN conference ca ON ca.team = b.l_suppkey WHERE a.l_suppkey <> b.l_suppkey)"""
#: One row per team and contest.
SIDES_SQL = CONTEST_SQL + """,
sides AS (
  SELECT contest_id, day, season, home AS team, away AS opponent, home_conf AS conf, 'home' AS venue, home_q AS q, away_q AS opp_q, home_p AS p, home_won AS won FROM contest
  UNION ALL
  SELECT contest_id, day, season, away, home, away_conf, 'away', away_q, home_q, away_p, 1.0 - home_won FROM contest)"""
PLAYER_SQL = """player_match AS (
  SELECT l_orderkey AS match_id, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INT) AS season, l_partkey AS player, p_type AS position, p_brand AS team,
         l_suppkey AS opponent, l_quantity AS w, l_extendedprice / l_quantity AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
