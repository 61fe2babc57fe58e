"""Queries of tournaments: brackets, their outcomes, and forecasts beside them.

The given tables hold no tournament, so one is played from their contests: each season's field of 64 (its
conference champions and the best of the others by RPI) stands in bracket slots, and a meeting of round k goes to the team with the larger
margin in its k-th last contest of the season. What the queries are about starts from the matches of these brackets
alone: rounds, outcomes, hosts and the tree are found again from who met whom and who won. A scenario shifts the contests
that decide, and the field: run 0 is the one that is taken for what happened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bracket as b
from ..operators import predict as p
from ..operators import ratings as r
from ..session import saved_rows
from .contest_queries import CHAMP_SQL, R, champion_table, rpi_table, sides
from .registry import query
from .views import Tables

RUNS = 8
#: Of a team's rating that decides the field of a run, what a set of margin counts.
SWAY = 0.002

FIELD_SQL = CHAMP_SQL + f""",
form AS (SELECT season, team, row_number() OVER (PARTITION BY season, team ORDER BY day DESC, contest_id DESC) AS k, q - opp_q AS v FROM sides),
tm AS (SELECT sim.range AS sim, r.season, r.team, c.team IS NOT NULL AS auto, round(r.rpi + CASE WHEN sim.range = 0 THEN 0 ELSE {SWAY} * coalesce(f.v, 0) END, 9) AS ord FROM rpi r CROSS JOIN range({RUNS}) sim LEFT JOIN champ c ON c.season = r.season AND c.team = r.team LEFT JOIN form f ON f.season = r.season AND f.team = r.team AND f.k = sim.range),
at_large AS (SELECT *, row_number() OVER (PARTITION BY season, sim, auto ORDER BY ord DESC NULLS LAST, team) AS rr, count(*) FILTER (auto) OVER (PARTITION BY season, sim) AS na FROM tm),
fld AS (SELECT season, sim, team, auto, row_number() OVER (PARTITION BY season, sim ORDER BY ord DESC NULLS LAST, team) AS overall FROM at_large WHERE auto OR rr <= 64 - na),
sdd AS (SELECT *, CASE WHEN overall <= 32 THEN overall - 1 ELSE 64 - overall END AS sd, CASE WHEN overall <= 32 THEN (overall - 1) // 4 + 1 END AS seed FROM fld),
slt AS (SELECT *, (CASE WHEN (sd // 4) % 2 = 0 THEN sd % 4 ELSE 3 - sd % 4 END) * 16 + list_position([1, 16, 8, 9, 5, 12, 4, 13, 6, 11, 3, 14, 7, 10, 2, 15], sd // 4 + 1) - 1 + CASE WHEN overall <= 32 THEN 0 ELSE 1 END AS slot FROM sdd)"""
PLAYED_SQL = "WITH RECURSIVE " + FIELD_SQL + """,
alive AS (SELECT season, sim, 0 AS k, team, slot AS pos FROM slt UNION ALL
  SELECT season, sim, k + 1, arg_max(team, (coalesce(v, -1e9), -team)), pos // 2 FROM (SELECT alive.*, form.v FROM alive LEFT JOIN form ON form.season = alive.season AND form.team = alive.team AND form.k = alive.k + 1 + alive.sim WHERE alive.k < 6) GROUP BY season, sim, k, pos // 2),
game AS (SELECT a.season, a.sim, a.k + 1 AS round, a.pos // 2 AS game, arg_min(a.team, a.pos) AS home, arg_max(a.team, a.pos) AS away FROM alive a WHERE a.k < 6 GROUP BY 1, 2, 3, 4 HAVING count(*) = 2),
won AS (SELECT g.*, w.team AS winner FROM game g JOIN alive w ON w.season = g.season AND w.sim = g.sim AND w.k = g.round AND w.pos = g.game),
part AS (SELECT season, sim, round, home AS team, away AS opponent, winner = home AS win, round <= 2 AS at_host FROM won UNION ALL SELECT season, sim, round, away, home, winner = away, false FROM won),
res AS (SELECT season, sim, team, 1 + count(*) FILTER (win) AS reached, bool_or(at_host) AS host, min(opponent) FILTER (NOT win) AS lost_to FROM part GROUP BY 1, 2, 3)"""


def rated(t: Tables):
    """t with its contests written, and their RPI: what all steps of a tournament read is made once."""
    t = t.with_contests()
    return t, saved_rows(rpi_table(t), "rpi")


def fields(t: Tables, ratings: DataFrame, runs: int = RUNS):
    """season, sim, team, auto, overall, seed (of the first 32), slot and form (its margins from the run's number on, last contest first)."""
    margins = F.transform(F.array_sort(F.collect_list(F.struct((-F.datediff("day", F.lit("1970-01-01").cast("date"))).alias("d"), (-F.col("contest_id")).alias("c"), (F.col("q") - F.col("opp_q")).alias("v")))), lambda x: x["v"])
    form = sides(t).groupBy("season", "team").agg(margins.alias("margins"))
    champs = champion_table(t, ratings).select("season", "team", F.lit(True).alias("auto"))
    teams = ratings.select("season", "team", "rpi").join(champs, ["season", "team"], "left").withColumn("auto", F.coalesce("auto", F.lit(False))).join(form, ["season", "team"])
    each = teams.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    sway = F.when(F.col("sim") == 0, 0.0).otherwise(SWAY * F.coalesce(F.get("margins", F.col("sim") - 1), F.lit(0.0)))
    out = r.field(each.withColumn("ord", F.round(F.col("rpi") + sway, 9)), ["season", "sim"], "ord", "auto")
    o = F.col("overall").cast("long")
    out = out.select("season", "sim", "team", "auto", o.alias("overall"), F.when(o <= 32, F.floor((o - 1) / 4) + 1).alias("seed"), r.slot(F.col("overall")).alias("slot"), F.slice("margins", F.col("sim") + 1, F.lit(b.ROUNDS)).alias("form"))
    return saved_rows(out, "fields")


def tournament(teams):
    """Matches of the brackets of fields: season, sim, match, day, home, away, home_won, neutral."""
    games = b.played(teams, ["season", "sim"], "slot", "form")
    games = games.select("season", "sim", (F.col("round") * 100 + F.col("game")).alias("match"), F.date_add(F.make_date(F.col("season"), F.lit(12), F.lit(1)), 3 * F.col("round")).alias("day"), "home", "away", "home_won", (F.col("round") > 2).alias("neutral"))
    return saved_rows(games, "tournaments")


def happened(t: Tables, ratings: DataFrame):
    return fields(t, ratings, runs=1)


@query(PLAYED_SQL + ", c AS (SELECT season, count(*) AS teams, " + ", ".join(f"count(*) FILTER (reached = {k}) AS r{k}" for k in range(1, 8)) + """ FROM res WHERE sim = 0 GROUP BY 1), mt AS (SELECT season, count(*) AS matches FROM won WHERE sim = 0 GROUP BY 1)
SELECT season, matches, teams, r1, r2, r3, r4, r5, r6, r7, matches AS placed, CASE WHEN matches <> 63 THEN 'number of matches' END AS fault FROM mt JOIN c USING (season)""")
def h25_bracket_integrity(t):
    return b.integrity(tournament(happened(*rated(t))), ["season"])


@query(PLAYED_SQL + " SELECT season, team, reached, host, lost_to, CASE WHEN lost_to IS NOT NULL THEN reached END AS lost_in FROM res WHERE sim = 0")
def h25_outcomes(t):
    return b.outcomes(tournament(happened(*rated(t))), ["season"]).withColumn("lost_in", F.col("lost_in").cast("long"))


FORECAST_SQL = PLAYED_SQL + """, league AS (SELECT s_suppkey AS team, n_name AS league FROM supplier JOIN nation ON s_nationkey = n_nationkey),
fc AS (SELECT season + 1 AS season, team, league, 1 / (1 + exp(-8 * (rpi - 0.5))) AS p_field, pow(1 / (1 + exp(-8 * (rpi - 0.5))), 3) AS p_reached4, pow(1 / (1 + exp(-8 * (rpi - 0.5))), 4) AS p_reached5, pow(1 / (1 + exp(-8 * (rpi - 0.5))), 6) AS p_champion FROM rpi JOIN league USING (team) WHERE rpi IS NOT NULL),
fr AS (SELECT fc.*, res.team IS NOT NULL AS in_field, coalesce(reached, 0) AS reached, coalesce(host, false) AS host, seed, lost_to FROM fc LEFT JOIN res ON res.season = fc.season AND res.team = fc.team AND res.sim = 0 LEFT JOIN slt ON slt.season = fc.season AND slt.team = fc.team AND slt.sim = 0 WHERE fc.season IN (SELECT season FROM res))"""


def forecast_rows(t: Tables):
    """A season's RPI as the forecast of the next season's tournament, beside what came of it."""
    chance = 1 / (1 + F.exp(-8 * (F.col("rpi") - 0.5)))
    powers = {"p_field": 1, "p_reached4": 3, "p_reached5": 4, "p_champion": 6}
    t, ratings = rated(t)
    fc = ratings.where("rpi is not null").join(t.league(), "team").select((F.col("season") + 1).alias("season"), "team", "league", *[(chance**k).alias(c) for c, k in powers.items()])
    teams = happened(t, ratings)
    found = b.outcomes(tournament(teams), ["season"]).withColumn("_in", F.lit(True))
    seeds = teams.select("season", "team", "seed")
    held = found.select("season").distinct()
    out = fc.join(F.broadcast(held), "season", "left_semi").join(found, ["season", "team"], "left").join(seeds, ["season", "team"], "left")  # a row for each season
    return out.withColumns({"in_field": F.coalesce("_in", F.lit(False)), "reached": F.coalesce("reached", F.lit(0)), "host": F.coalesce("host", F.lit(False))}).drop("_in", "lost_in")


@query(FORECAST_SQL + """, pl AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY p_reached4 DESC, team) AS place, count(*) FILTER (in_field) OVER (PARTITION BY season) AS size FROM fr)
SELECT season, count(*) FILTER (place <= 8 AND reached >= 4) AS hits, count(*) FILTER (reached >= 4) AS "of", round(avg(p_reached4) FILTER (reached >= 4), 6) AS mean_p,
round(1 - sum(pow(p_reached4 - (reached >= 4)::INT, 2)) / nullif(sum(pow(CASE WHEN in_field THEN 8 / size ELSE 0 END - (reached >= 4)::INT, 2)), 0), 6) AS brier_skill FROM pl GROUP BY 1""")
def h26_round_forecasts(t):
    return p.forecast_hits(forecast_rows(t), ["season"], "p_reached4", F.col("reached") >= 4, 8).select("season", "hits", "of", R("mean_p"), R("brier_skill"))


@query(FORECAST_SQL + """, lg AS (SELECT season, league, count(*) FILTER (in_field) AS bids, arg_max(in_field, (p_field, -team)) AS hit FROM fr GROUP BY 1, 2 HAVING count(*) FILTER (in_field) = 1)
SELECT season, count(*) AS one_bid_leagues, count(*) FILTER (hit) AS one_bid_right FROM lg GROUP BY 1""")
def h26_one_bid_leagues(t):
    return p.one_bid_leagues(forecast_rows(t), ["season"], "league", "p_field")


@query(FORECAST_SQL + """, rk AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY p_champion DESC) AS r FROM fr)
SELECT season, min(r) FILTER (reached >= 7) AS champion_rank, round(sum(p_champion / p_reached5) FILTER (reached >= 5 AND p_reached5 > 0), 6) AS title_given_round FROM rk GROUP BY 1""")
def h26_title_odds(t):
    out = p.title_odds(forecast_rows(t), ["season"], "p_champion", "p_reached5", F.col("reached") >= 5, F.col("reached") >= 7)
    return out.select("season", F.col("champion_rank").cast("long").alias("champion_rank"), R("title_given_round"))


@query(FORECAST_SQL + """, pl AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY p_field DESC, team) AS place FROM fr)
SELECT season, count(*) FILTER (in_field) AS field, count(*) FILTER (place <= 64 AND in_field) AS field_hits, count(*) FILTER (place <= 16 AND host) AS host_hits, count(*) FILTER (place <= 8 AND reached >= 4) AS round4_hits, round(avg(pow(p_reached4 - (reached >= 4)::INT, 2)), 6) AS brier FROM pl GROUP BY 1""")
def h26_h27_forecast_scores(t):
    """The likeliest teams of a forecast against the field, the hosts and a round as they came out."""
    place = F.row_number().over(Window.partitionBy("season").orderBy(F.desc("p_field"), "team"))
    at, far = F.col("place"), F.col("reached") >= 4
    return forecast_rows(t).withColumn("place", place).groupBy("season").agg(
        F.count_if("in_field").alias("field"), F.count_if((at <= 64) & F.col("in_field")).alias("field_hits"), F.count_if((at <= 16) & F.col("host")).alias("host_hits"), F.count_if((at <= 8) & far).alias("round4_hits"), R(F.avg((F.col("p_reached4") - far.cast("double")) ** 2), "brier"),
    )


@query(FORECAST_SQL + " SELECT season, count(*) FILTER (seed <= 2 AND reached >= 4) AS round4_hits, count(*) FILTER (seed <= 2) AS round4_of, count(*) FILTER (seed = 1 AND reached >= 5) AS round5_hits, count(*) FILTER (seed = 1) AS round5_of FROM fr GROUP BY 1")
def h27_seeds_alone(t):
    """What the seeds alone got right."""
    seed = F.coalesce("seed", F.lit(99))
    return b.chalk(forecast_rows(t), ["season"], {"round4": (4, seed <= 2), "round5": (5, seed == 1)})


FINISH = {1: "first round", 2: "second round", 3: "regional semifinal", 4: "regional final", 5: "national semifinal", 6: "final", 7: "champion"}


@query(FORECAST_SQL + """, rk AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY p_champion DESC) AS r FROM fr)
SELECT rk.season, rk.team, round(rk.p_field, 6) AS p_field, round(rk.p_champion, 6) AS p_champion, rk.r AS title_rank, rk.seed, CASE rk.reached """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FINISH.items()) + """ ELSE 'not in the field' END AS finish,
rk.lost_to, f.seed AS lost_to_seed, round(f.p_champion, 6) AS lost_to_p FROM rk LEFT JOIN fr f ON f.season = rk.season AND f.team = rk.lost_to WHERE rk.team = 3""")
def h27_focus_team(t):
    """One team's odds beside its finish and who ended it; the team is the parameter."""
    rows = forecast_rows(t)
    title = F.rank().over(Window.partitionBy("season").orderBy(F.desc("p_champion"))).cast("long")
    foe = rows.select("season", F.col("team").alias("lost_to"), F.col("seed").alias("lost_to_seed"), R("p_champion", "lost_to_p"))
    finish = F.lit("not in the field")
    for k, name in FINISH.items():
        finish = F.when(F.col("reached") == k, name).otherwise(finish)
    return rows.withColumn("title_rank", title).where("team = 3").join(foe, ["season", "lost_to"], "left").select("season", "team", R("p_field"), R("p_champion"), "title_rank", "seed", finish.alias("finish"), "lost_to", "lost_to_seed", "lost_to_p")


@query(PLAYED_SQL + f""" SELECT s.season, s.team, round(count(*) / {RUNS}::DOUBLE, 6) AS p_field, round(count(*) FILTER (auto) / {RUNS}::DOUBLE, 6) AS p_auto, round(avg(overall), 6) AS mean_overall, round(count(*) FILTER (overall <= 16) / {RUNS}::DOUBLE, 6) AS p_host, round(count(*) FILTER (seed = 1) / {RUNS}::DOUBLE, 6) AS p_1seed,
round(count(*) FILTER (reached >= 4) / {RUNS}::DOUBLE, 6) AS p_reached4, round(count(*) FILTER (reached >= 7) / {RUNS}::DOUBLE, 6) AS p_reached7 FROM slt s JOIN res USING (season, sim, team) GROUP BY 1, 2""")
def e29_run_summary(t):
    """Shares over a season's runs, each a field and a bracket of its own."""
    teams = fields(*rated(t))
    rows = teams.join(b.outcomes(tournament(teams), ["season", "sim"]), ["season", "sim", "team"])
    return r.run_summary(rows, ["season", "team"], 7).select("season", "team", *[R(c) for c in ("p_field", "p_auto", "mean_overall", "p_host", "p_1seed", "p_reached4", "p_reached7")])
