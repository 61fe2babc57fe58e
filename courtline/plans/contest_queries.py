"""Queries over the contest view: joins, aggregates, ranks, benchmarks, ratings and predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rates as fr
from ..operators import contests as c
from ..operators import metrics as m
from ..operators import predict as p
from ..operators import ratings as r
from ..operators import sequence as s
from ..specs import Benchmark
from .registry import query
from .views import CONTEST_SQL, SIDES_SQL, Tables

R = lambda col, name=None: F.round(col, 6).alias(name or col)


def binary_round(col):
    """col to six decimals as DuckDB rounds: the whole number nearest to the double 10^6 * col, halves away from 0; F.round goes by decimal digits, which differs beside a tie."""
    value = F.col(col) if isinstance(col, str) else col
    scaled = value * 1e6
    return F.when(F.abs(scaled) < 2.0**52, F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / 1e6).otherwise(value)


SPECS = (Benchmark("q", 30.0), Benchmark("p", 40000.0), Benchmark("opp_q", 20.0, higher=False))


def sides(t: Tables):
    """One row per team and contest: team, opponent, conf, venue, q, opp_q, p, won."""
    mirrored = {"team": ("home", "away"), "opponent": ("away", "home"), "conf": ("home_conf", "away_conf"), "q": ("home_q", "away_q"), "opp_q": ("away_q", "home_q"), "p": ("home_p", "away_p"), "won": ("home_won", 1.0 - F.col("home_won"))}
    return c.team_view(t.contest(), ["contest_id", "day", "season"], mirrored)


def with_chance(t: Tables):
    """Contests with a chance for the home side: a fixed logistic of the quantity of earlier lines' price gap, so that it is the same everywhere."""
    gap = (F.col("home_p") - F.col("away_p")) / 50000.0
    return t.contest().withColumn("p_home", fr.sigmoid(0.2 + gap))


CHANCE_SQL = CONTEST_SQL + ", chance AS (SELECT *, 1 / (1 + exp(-(0.2 + (home_p - away_p) / 50000.0))) AS p_home FROM contest)"
CHANCE_SIDES_SQL = CHANCE_SQL + """,
cs AS (SELECT contest_id, day, season, home AS team, away AS opponent, home_conf AS conf, p_home AS p, home_won AS won FROM chance
       UNION ALL SELECT contest_id, day, season, away, home, away_conf, 1 - p_home, 1 - home_won FROM chance)"""


def chance_sides(t: Tables):
    mirrored = {"team": ("home", "away"), "opponent": ("away", "home"), "conf": ("home_conf", "away_conf"), "p": ("p_home", 1 - F.col("p_home")), "won": ("home_won", 1.0 - F.col("home_won"))}
    return c.team_view(with_chance(t), ["contest_id", "day", "season"], mirrored)


@query("WITH " + SIDES_SQL + " SELECT contest_id, day, season, team, opponent, conf, venue, q, opp_q, p, won FROM sides")
def d1_d2_team_view(t):
    return sides(t).select("contest_id", "day", "season", "team", "opponent", "conf", "venue", "q", "opp_q", "p", "won")


@query("WITH " + CONTEST_SQL + " SELECT contest_id, day, season, home, away, home_q AS q, home_won AS won FROM contest")
def d3_home_view(t):
    return c.home_view(sides(t), ["contest_id", "day", "season"], "team", "opponent", ["q", "won"])


@query("WITH " + SIDES_SQL + " SELECT a.contest_id, a.team, a.q, b.q AS o_q, b.p AS o_p, b.won AS o_won, a.q - b.q AS margin FROM sides a JOIN sides b ON a.contest_id = b.contest_id AND a.team <> b.team")
def d4_mirror_join(t):
    """Both sides' values beside each other: known before the sides are made, so no join is needed."""
    lost = 1.0 - F.col("home_won")
    mirrored = {"team": ("home", "away"), "q": ("home_q", "away_q"), "o_q": ("away_q", "home_q"), "o_p": ("away_p", "home_p"), "o_won": (lost, "home_won")}
    return c.team_view(t.contest(), ["contest_id"], mirrored).select("contest_id", "team", "q", "o_q", "o_p", "o_won", (F.col("q") - F.col("o_q")).alias("margin"))


@query("WITH " + CONTEST_SQL + """,
l AS (SELECT *, least(home, away) AS lo, greatest(home, away) AS hi, count(*) OVER (PARTITION BY season, least(home, away), greatest(home, away)) AS n FROM contest WHERE home_q > 20),
rr AS (SELECT *, least(home, away) AS lo, greatest(home, away) AS hi, count(*) OVER (PARTITION BY season, least(home, away), greatest(home, away)) AS n FROM contest WHERE away_q > 20)
SELECT l.season, l.lo, l.hi, l.contest_id AS left_id, rr.contest_id AS right_id FROM l JOIN rr ON l.season = rr.season AND l.lo = rr.lo AND l.hi = rr.hi WHERE l.n = 1 AND rr.n = 1""")  # fmt: skip
def d5_unique_pair_join(t):
    keyed = t.contest().select("season", F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi"), "contest_id", "home_q", "away_q")
    left = keyed.where("home_q > 20").select("season", "lo", "hi", F.col("contest_id").alias("left_id"))
    right = keyed.where("away_q > 20").select("season", "lo", "hi", F.col("contest_id").alias("right_id"))
    return c.unique_join(left, right, ["season", "lo", "hi"])


SEASON_SQL = SIDES_SQL + """,
ts AS (SELECT season, team, count(*) AS n_matches, avg(q) AS q_mean, avg(p) AS p_mean, avg(won) AS won_mean, stddev_samp(q) AS q_sd, stddev_samp(p) AS p_sd, stddev_samp(won) AS won_sd FROM sides GROUP BY 1, 2),
rec AS (SELECT season, team, sum(won)::BIGINT AS wins, sum(1 - won)::BIGINT AS losses FROM sides GROUP BY 1, 2)"""


def team_seasons(t: Tables):
    x = sides(t)
    return m.season_means(x, ["season", "team"], ["q", "p", "won"]).join(m.records(x, ["season", "team"]), ["season", "team"], "left")


@query("WITH " + SEASON_SQL + """ SELECT season, team, n_matches, wins, losses, round(wins::DOUBLE / (wins + losses), 6) AS win_pct, round(q_mean, 6) AS q_mean, round(p_mean, 6) AS p_mean, round(q_sd, 6) AS q_sd, round(p_sd, 6) AS p_sd,
rank() OVER (PARTITION BY season ORDER BY round(q_mean, 6) DESC) AS rank_q FROM ts LEFT JOIN rec USING (season, team)""")
def e3_e4_d7_f1_team_seasons(t):
    x = team_seasons(t).select("season", "team", "n_matches", "wins", "losses", R("win_pct"), R("q_mean"), R("p_mean"), R("q_sd"), R("p_sd"))
    return m.ranked(x, ["season"], "q_mean", "rank_q").withColumn("rank_q", F.col("rank_q").cast("long"))


@query("WITH " + SIDES_SQL + """, l AS (SELECT season, 'q' AS metric, q AS v FROM sides UNION ALL SELECT season, 'p', p FROM sides)
SELECT season, metric, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95 FROM l GROUP BY 1, 2""")
def e5_league_baselines(t):
    b = m.baselines(sides(t).select("season", "q", "p"), ["season"], ["q", "p"])
    return b.select("season", "metric", "n", *[R(x) for x in ("mean", *m.QUANTILES)])


@query("WITH " + SIDES_SQL + """, f AS (SELECT *, (q >= 30)::INT::DOUBLE AS b_q, (p >= 40000)::INT::DOUBLE AS b_p, (opp_q <= 20)::INT::DOUBLE AS b_opp_q FROM sides)
SELECT contest_id, team, b_q, b_p, b_opp_q, 3::BIGINT AS bench_of, b_q + b_p + b_opp_q AS grade FROM f""")
def g1_g2_benchmark_grades(t):
    return fr.with_benchmarks(sides(t), SPECS).select("contest_id", "team", *[b.flag for b in SPECS], "bench_of", "grade")


@query("WITH " + SIDES_SQL + """, f AS (SELECT season, team, conf, won, (q >= 30)::INT::DOUBLE AS b_q, (p >= 40000)::INT::DOUBLE AS b_p, (opp_q <= 20)::INT::DOUBLE AS b_opp_q FROM sides),
l AS (SELECT season, team, 'b_q' AS flag, b_q AS v FROM f UNION ALL SELECT season, team, 'b_p', b_p FROM f UNION ALL SELECT season, team, 'b_opp_q', b_opp_q FROM f),
lg AS (SELECT season, flag, avg(v) AS league FROM l GROUP BY 1, 2)
SELECT l.season, l.team, l.flag, round(avg(v), 6) AS team_rate, round(any_value(league), 6) AS league_rate FROM l JOIN lg ON l.season = lg.season AND l.flag = lg.flag GROUP BY 1, 2, 3""")
def e15_g4_benchmark_profile(t):
    f = m.long(fr.with_benchmarks(sides(t), SPECS).select("season", "team", *[b.flag for b in SPECS]), ["season", "team"], [b.flag for b in SPECS]).withColumnRenamed("metric", "flag")
    team = f.groupBy("season", "team", "flag").agg(F.avg("value").alias("team_rate"))
    league = f.groupBy("season", "flag").agg(F.avg("value").alias("league_rate"))
    return team.join(league, ["season", "flag"]).select("season", "team", "flag", R("team_rate"), R("league_rate"))


@query("WITH " + SEASON_SQL + """, g AS (SELECT s.season, s.team, avg((q >= 30)::INT + (p >= 40000)::INT + (opp_q <= 20)::INT) AS grade, avg(won) AS w, count(*) AS n FROM sides s GROUP BY 1, 2)
SELECT season, round(corr(grade, w), 6) AS r, count(*) AS teams FROM g WHERE n >= 5 GROUP BY 1 HAVING count(*) >= 5""")
def e13_grade_vs_wins(t):
    g = fr.with_benchmarks(sides(t), SPECS).groupBy("season", "team").agg(F.avg("grade").alias("grade"), F.avg("won").alias("w"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return g.groupBy("season").agg(R(F.corr("grade", "w"), "r"), F.count(F.lit(1)).alias("teams")).where("teams >= 5")


@query("WITH " + SIDES_SQL + " SELECT season, count(*) FILTER (q > 25) AS n_with, round(avg(won) FILTER (q > 25), 6) AS \"with\", count(*) FILTER (q <= 25) AS n_without, round(avg(won) FILTER (q <= 25), 6) AS without, round(avg(won) FILTER (q > 25) - avg(won) FILTER (q <= 25), 6) AS swing FROM sides GROUP BY 1")
def e16_split_by_condition(t):
    return m.split(sides(t), ["season"], F.col("q") > 25, "won").select("season", "n_with", R("with"), "n_without", R("without"), R("swing"))


BANDS = [("low", 0.0, 10.0), ("mid", 10.0, 25.0), ("high", 25.0, 50.0)]


@query("WITH " + SIDES_SQL + """, b AS (SELECT *, CASE WHEN q BETWEEN 0 AND 10 THEN 'low' WHEN q BETWEEN 10 AND 25 THEN 'mid' WHEN q BETWEEN 25 AND 50 THEN 'high' END AS inclusive,
CASE WHEN q > 0 AND q <= 10 THEN 'low' WHEN q > 10 AND q <= 25 THEN 'mid' WHEN q > 25 AND q <= 50 THEN 'high' END AS half_open FROM sides)
SELECT inclusive, half_open, count(*) AS n, round(avg(won), 6) AS win_pct, round(avg(CASE WHEN opp_q <= 5 THEN 1.0 ELSE 0 END), 6) AS sweep_pct FROM b GROUP BY 1, 2""")
def e17_e18_bands(t):
    x = sides(t).withColumn("inclusive", fr.band(F.col("q"), BANDS)).withColumn("half_open", fr.band(F.col("q"), BANDS, False))
    return x.groupBy("inclusive", "half_open").agg(F.count(F.lit(1)).alias("n"), R(F.avg("won"), "win_pct"), R(F.avg((F.col("opp_q") <= 5).cast("double")), "sweep_pct"))


@query("WITH " + SIDES_SQL + """, d AS (SELECT season, (floor((q + opp_q) / 20))::BIGINT AS length, won FROM sides)
SELECT season, length, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY season), 6) AS share FROM d GROUP BY 1, 2""")
def e19_length_mix(t):
    d = sides(t).withColumn("length", F.floor((F.col("q") + F.col("opp_q")) / 20).cast("long"))
    return m.shares(d, ["season"], "length").select("season", "length", "n", R("share"))


@query("WITH " + SIDES_SQL + """, d AS (SELECT *, (venue = 'away' AND won = 1) AS back FROM sides), t10 AS (SELECT contest_id, team, q - opp_q AS lead, row_number() OVER (ORDER BY q - opp_q DESC, contest_id, team) AS place FROM d WHERE back)
SELECT place, contest_id, team, lead FROM t10 WHERE place <= 10""")
def e20_f7_top_comebacks(t):
    d = sides(t).where("venue = 'away' and won = 1").withColumn("lead", F.col("q") - F.col("opp_q"))
    first = d.orderBy(F.desc("lead"), "contest_id", "team").limit(10)  # a top-k report; the window runs over its ten rows
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("lead"), "contest_id", "team")).cast("long")).select("place", "contest_id", "team", "lead")


@query("WITH " + SIDES_SQL + """ SELECT venue, season, grouping_id(venue, season)::BIGINT AS level, count(*) AS n, round(avg(won), 6) AS win_pct, round(avg(q), 6) AS mean_q FROM sides GROUP BY GROUPING SETS ((venue, season), (venue), (season), ())""")
def e23_e24_slices(t):
    x = sides(t)
    return x.groupingSets([["venue", "season"], ["venue"], ["season"], []], "venue", "season").agg(F.grouping_id("venue", "season").alias("level"), F.count(F.lit(1)).alias("n"), R(F.avg("won"), "win_pct"), R(F.avg("q"), "mean_q"))


@query("WITH " + CHANCE_SQL + """, r AS (SELECT greatest(0, ceil(p_home / 0.1) - 1)::BIGINT AS bin, p_home, home_won FROM chance), l AS (SELECT least(9, floor(p_home / 0.1))::BIGINT AS bin, p_home, home_won FROM chance)
SELECT 'right' AS closed, bin, count(*) AS n, round(avg(p_home), 6) AS predicted, round(avg(home_won), 6) AS observed FROM r GROUP BY 2 UNION ALL SELECT 'left', bin, count(*), round(avg(p_home), 6), round(avg(home_won), 6) FROM l GROUP BY 2""")
def e25_e26_calibration(t):
    x = with_chance(t)
    each = [m.calibration(x, b, "p_home", "home_won").select(F.lit(k).alias("closed"), "bin", "n", R("predicted"), R("observed")) for k, b in (("right", fr.bin_right(F.col("p_home"), 0.1)), ("left", fr.bin_left(F.col("p_home"), 0.1, 9)))]
    return each[0].unionByName(each[1])


SETS_SQL = """ss AS (SELECT *, CASE WHEN home_won = 1 THEN 3 ELSE CAST(home_q AS INT) % 3 END AS hs, CASE WHEN home_won = 1 THEN CAST(away_q AS INT) % 3 ELSE 3 END AS aws FROM chance),
fav AS (SELECT CASE WHEN p_home >= 0.5 THEN p_home ELSE 1 - p_home END AS fav, CASE WHEN p_home >= 0.5 THEN hs ELSE aws END AS fs, CASE WHEN p_home >= 0.5 THEN aws ELSE hs END AS ds FROM ss),
sl AS (SELECT greatest(0, ceil((fav - 0.5) / 0.1) - 1)::BIGINT AS bin, avg(fav) AS p_fav, count(*) AS n, avg((fs = 3 AND ds = 0)::INT) AS fav_3_0, avg((fs = 3 AND ds = 1)::INT) AS fav_3_1, avg((fs = 3 AND ds = 2)::INT) AS fav_3_2,
       avg((ds = 3 AND fs = 0)::INT) AS dog_3_0, avg((ds = 3 AND fs = 1)::INT) AS dog_3_1, avg((ds = 3 AND fs = 2)::INT) AS dog_3_2 FROM fav GROUP BY 1)"""
LINES = [f"{a}_3_{k}" for a in ("fav", "dog") for k in (0, 1, 2)]


def scoreline_table(t):
    sets = lambda won, q: F.when(won, 3).otherwise(F.col(q).cast("int") % 3)
    x = with_chance(t).withColumn("hs", sets(F.col("home_won") == 1, "home_q")).withColumn("aws", sets(F.col("home_won") != 1, "away_q"))
    return p.scorelines(x, "p_home", "hs", "aws", fr.bin_right(F.col("fav"), 0.1, 0.5))


@query("WITH " + CHANCE_SQL + ", " + SETS_SQL + " SELECT bin, n, round(p_fav, 6) AS p_fav, " + ", ".join(f"round({x}, 6) AS {x}" for x in LINES) + " FROM sl")
def e27_scorelines(t):
    return scoreline_table(t).select("bin", "n", R("p_fav"), *[R(x) for x in LINES])


@query("WITH " + CHANCE_SQL + ", " + SETS_SQL + """, b AS (SELECT *, lead(p_fav) OVER (ORDER BY p_fav) AS p2, lead(fav_3_0) OVER (ORDER BY p_fav) AS f2, row_number() OVER (ORDER BY p_fav) AS rn, count(*) OVER () AS k FROM sl),
q AS (SELECT contest_id, greatest(p_home, 1 - p_home) AS f FROM chance)
SELECT contest_id, round(CASE WHEN p2 IS NULL THEN fav_3_0 WHEN f < p_fav THEN fav_3_0 ELSE fav_3_0 + (f2 - fav_3_0) * (f - p_fav) / (p2 - p_fav) END, 6) AS fav_3_0
FROM q JOIN b ON (f >= p_fav AND (p2 IS NULL OR f < p2)) OR (rn = 1 AND f < p_fav)""")
def h14_pair_scorelines(t):
    return p.pair_scorelines(with_chance(t).select("contest_id", "p_home"), scoreline_table(t), "p_home", ["fav_3_0"]).select("contest_id", R("fav_3_0"))


#: Weights of venue, Elo and ridge in three choices of a model.
PAIR_MODELS = {"blend": (0.3, 0.4, 0.6), "elo": (0.3, 0.7, 0.0), "ridge": (0.3, 0.0, 1.1)}


def lines_sql(team: str, k: int) -> str:
    fav, dog = (f"{x}_3_{k} * {p} / nullif({x}_3_0 + {x}_3_1 + {x}_3_2, 0)" for x, p in (("fav", "f"), ("dog", "(1 - f)")))
    return f"round(CASE WHEN (p_a >= 0.5) = {'true' if team == 'a' else 'false'} THEN {fav} ELSE {dog} END, 6) AS {team}_3_{k}"


@query("WITH " + CHANCE_SQL + ", " + SETS_SQL + """, sd AS (SELECT season, home AS team, home_q AS q, away_q AS opp_q, home_p AS pts FROM contest UNION ALL SELECT season, away, away_q, home_q, away_p FROM contest),
rt AS (SELECT season, team, 1500 + 20 * (avg(q) - 25) AS elo, avg(pts) / 1e3 AS rating_overall, (avg(q) - 25) / 10 AS rating_off, (25 - avg(opp_q)) / 10 AS rating_def FROM sd GROUP BY 1, 2),
pr AS (SELECT c.contest_id, c.season, c.home AS a, c.away AS b, (c.contest_id % 3 - 1)::INT AS venue, model, 1 / (1 + exp(-(w0 * (c.contest_id % 3 - 1) + w1 * (ra.elo - rb.elo) / 100 + w2 * (ra.rating_overall - rb.rating_overall) / 10))) AS p_a, 60 + ra.rating_off - rb.rating_def AS sideout_a, 60 + rb.rating_off - ra.rating_def AS sideout_b
  FROM contest c JOIN rt ra ON ra.season = c.season AND ra.team = c.home JOIN rt rb ON rb.season = c.season AND rb.team = c.away, (VALUES """ + ", ".join(f"('{m}', {w[0]}, {w[1]}, {w[2]})" for m, w in PAIR_MODELS.items()) + """) m(model, w0, w1, w2)),
q AS (SELECT *, greatest(p_a, 1 - p_a) AS f FROM pr), """ + "b AS (SELECT *, lead(p_fav) OVER o AS p2, " + ", ".join(f"lead({x}) OVER o AS n_{x}" for x in LINES) + """, row_number() OVER o AS rn FROM sl WINDOW o AS (ORDER BY p_fav)),
i AS (SELECT q.*, """ + ", ".join(f"CASE WHEN p2 IS NULL OR f < p_fav THEN {x} ELSE {x} + (n_{x} - {x}) * (f - p_fav) / (p2 - p_fav) END AS {x}" for x in LINES) + """ FROM q JOIN b ON (f >= p_fav AND (p2 IS NULL OR f < p2)) OR (rn = 1 AND f < p_fav)),
o AS (SELECT contest_id, model, round(p_a, 6) AS p_a, """ + ", ".join(lines_sql(t, k) for t in "ab" for k in range(3)) + """, sideout_a, sideout_b FROM i)
SELECT contest_id, model, p_a, """ + ", ".join(f"{t}_3_{k}" for t in "ab" for k in range(3)) + """, round(sideout_a, 6) AS sideout_a, round(sideout_b, 6) AS sideout_b, abs(a_3_0 + a_3_1 + a_3_2 + b_3_0 + b_3_1 + b_3_2 - 1) < 1e-5 AS whole FROM o""")
def h14_blended_pairs(t):
    """Every contest as a pair under three models, at home, away and on neutral floors, with ratings of its season."""
    x = sides(t)
    rated = x.groupBy("season", "team").agg((1500 + 20 * (F.avg("q") - 25)).alias("elo"), (F.avg("p") / 1e3).alias("rating_overall"), ((F.avg("q") - 25) / 10).alias("rating_off"), ((25 - F.avg("opp_q")) / 10).alias("rating_def"), F.lit(60.0).alias("league"))
    key = lambda team: F.struct("season", F.col(team).alias("team"))
    ratings = rated.select(key("team").alias("team"), "elo", "rating_overall", "rating_off", "rating_def", "league")
    pairs = t.contest().select("contest_id", key("home").alias("a"), key("away").alias("b"), (F.col("contest_id") % 3 - 1).cast("int").alias("venue"))
    out = p.predicted_pairs(pairs, ratings, PAIR_MODELS, scoreline_table(t))
    lines = [f"{team}_3_{k}" for team in "ab" for k in range(3)]
    whole = F.abs(sum((F.col(c) for c in lines), F.lit(0.0)) - 1) < 1e-5
    return out.select("contest_id", "model", R("p_a"), *[R(c) for c in lines], R("sideout_a"), R("sideout_b"), whole.alias("whole"))


@query("WITH " + CHANCE_SIDES_SQL + """ SELECT season, team, count(*) AS n, round(sum(won), 6) AS wins, round(sum(p), 6) AS x_wins, round(sum(p * (1 - p)), 6) AS var, count(*) FILTER (p < 0.5 AND won = 1) AS upset_wins, count(*) FILTER (p > 0.5 AND won = 0) AS upset_losses,
round(sum(won) - sum(p), 6) AS diff, round((sum(won) - sum(p)) / sqrt(nullif(sum(p * (1 - p)), 0)), 6) AS z FROM cs GROUP BY 1, 2""")
def e28_expected_wins(t):
    return m.expected_wins(chance_sides(t), ["season", "team"], "p", "won").select("season", "team", "n", R("wins"), R("x_wins"), R("var"), "upset_wins", "upset_losses", R("diff"), R("z"))


@query("WITH " + SIDES_SQL + """, n AS (SELECT team, count(DISTINCT contest_id) AS n_now FROM sides WHERE season = 1998 GROUP BY 1), b AS (SELECT team, count(DISTINCT contest_id) AS n_before FROM sides WHERE season = 1997 GROUP BY 1),
s AS (SELECT list_sort(list(n_now)) AS x FROM n), md AS (SELECT x[len(x) // 2 + 1] AS median FROM s)
SELECT coalesce(n.team, b.team) AS team, coalesce(n_now, 0) AS n_now, coalesce(n_before, 0) AS n_before, coalesce(n_now * 2 < median, false) AS thin, n_now IS NULL AS missing FROM n FULL JOIN b ON n.team = b.team, md""")
def e30_coverage(t):
    x = sides(t)
    return m.coverage(x.where("season = 1998"), x.where("season = 1997"), "team", "contest_id")


@query("WITH " + SIDES_SQL + """, n AS (SELECT team, count(DISTINCT contest_id) AS n_now FROM sides WHERE season = 1998 AND conf <> 'ASIA' GROUP BY 1), b AS (SELECT team, max(conf) AS conf FROM sides WHERE season = 1997 GROUP BY 1),
l AS (SELECT b.team, conf, n_now FROM b LEFT JOIN n ON n.team = b.team)
SELECT (SELECT count(*) FROM n) AS teams, (SELECT min(n_now) FROM n) AS least, (SELECT list_sort(list(n_now))[count(*) // 2 + 1] FROM n) AS median, (SELECT max(n_now) FROM n) AS most, (SELECT count(*) FROM l WHERE n_now IS NULL) AS missing,
(SELECT count(*) FROM (SELECT conf FROM l GROUP BY 1 HAVING count(n_now) = 0)) AS conferences_wiped""")
def e30_coverage_summary(t):
    """A season that lost a conference, against the one before."""
    x = sides(t)
    return m.coverage_summary(x.where("season = 1998 and conf <> 'ASIA'"), x.where("season = 1997"), "team", "contest_id", "conf")


@query("SELECT * FROM (VALUES (0, 'q', 'higher_is_better', 30.0::DOUBLE, 'b_q', true), (1, 'p', 'higher_is_better', 40000.0::DOUBLE, 'b_p', true), (2, 'opp_q', 'lower_is_better', 20.0::DOUBLE, 'b_opp_q', true)) v(place, metric, direction, threshold, flag_column, graded), (SELECT count(*) AS n_rows FROM lineitem)")
def g3_spec_table(t):
    """The benchmark definitions as rows, beside how many lines they are applied to."""
    specs = t.spark.createDataFrame(*fr.spec_rows(SPECS))
    return specs.crossJoin(t.lineitem.agg(F.count(F.lit(1)).alias("n_rows")))  # one row


@query("WITH " + SEASON_SQL + """, v AS (SELECT season, team, round(q_mean, 6) AS q, round(p_mean, 6) AS p FROM ts), l AS (SELECT season, team, 'q' AS metric, q AS value, q >= 30 AS met FROM v UNION ALL SELECT season, team, 'p', p, p >= 40000 FROM v)
SELECT season, team, metric, value, met, rank() OVER (PARTITION BY season, metric ORDER BY value DESC) AS rank_in_pool, count(*) OVER (PARTITION BY season, metric) AS pool FROM l""")
def g4_season_benchmarks(t):
    """A season's values judged by the match thresholds, with their rank among all teams."""
    x = m.season_means(sides(t), ["season", "team"], ["q", "p"]).select("season", "team", R("q_mean", "q"), R("p_mean", "p"))
    rows = m.ranked(m.long(x, ["season", "team"], ["q", "p"]), ["season", "metric"], "value", "rank_in_pool")
    met = F.when(F.col("metric") == "q", F.col("value") >= SPECS[0].threshold).otherwise(F.col("value") >= SPECS[1].threshold)
    return rows.select("season", "team", "metric", "value", met.alias("met"), F.col("rank_in_pool").cast("long").alias("rank_in_pool"), F.count(F.lit(1)).over(Window.partitionBy("season", "metric")).alias("pool"))


@query("WITH " + SIDES_SQL + " SELECT count(*) AS rows, count(DISTINCT team) AS teams, count(DISTINCT season) AS seasons, min(day) AS first_day, max(day) AS last_day, round(quantile_cont(q, 0.5), 6) AS median_q FROM sides")
def e32_build_metadata(t):
    return sides(t).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("team").alias("teams"), F.countDistinct("season").alias("seasons"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), R(F.percentile("q", F.lit(0.5)), "median_q"))


@query("WITH " + SIDES_SQL + " SELECT day, team, opponent, count(*) AS n, round(sum(q), 6) AS attempts FROM sides GROUP BY 1, 2, 3")
def e33_attempts_by_opponent(t):
    return sides(t).groupBy("day", "team", "opponent").agg(F.count(F.lit(1)).alias("n"), R(F.sum("q"), "attempts"))


@query("WITH " + SIDES_SQL + """, t AS (SELECT season, team, conf, round(avg(p), 6) AS v, count(*) AS n FROM sides GROUP BY 1, 2, 3)
SELECT season, team, conf, v, n, CASE WHEN n >= 5 THEN rank() OVER (PARTITION BY season, n >= 5 ORDER BY v DESC) END AS rank_all, CASE WHEN n >= 5 THEN rank() OVER (PARTITION BY season, conf, n >= 5 ORDER BY v DESC) END AS rank_conf,
CASE WHEN n >= 5 THEN rank() OVER (PARTITION BY season, n >= 5 ORDER BY v) END AS rank_low, count(*) FILTER (n >= 5) OVER (PARTITION BY season, conf) AS pool FROM t""")
def f2_f3_f4_pool_ranks(t):
    x = sides(t).groupBy("season", "team", "conf").agg(R(F.avg("p"), "v"), F.count(F.lit(1)).alias("n"))
    ok = F.col("n") >= 5
    x = m.ranked(m.ranked(m.ranked(x, ["season"], "v", "rank_all", only=ok), ["season", "conf"], "v", "rank_conf", only=ok), ["season"], "v", "rank_low", higher=False, only=ok)
    return x.withColumn("pool", F.count_if(ok).over(Window.partitionBy("season", "conf"))).select("season", "team", "conf", "v", "n", *[F.col(k).cast("long").alias(k) for k in ("rank_all", "rank_conf", "rank_low")], "pool")


@query("WITH " + SIDES_SQL + """, t AS (SELECT season, team, avg(p) AS v, stddev_samp(p) / sqrt(count(*)) AS se FROM sides GROUP BY 1, 2), md AS (SELECT season, quantile_cont(se, 0.5) AS mid FROM t GROUP BY 1),
u AS (SELECT t.season, team, v, coalesce(se, mid) AS se FROM t JOIN md USING (season))
SELECT season, team, 1 + (SELECT count(*) FROM u x WHERE x.season = u.season AND x.v > u.v + 1.645 * u.se) AS rank_lo, 1 + (SELECT count(*) FROM u x WHERE x.season = u.season AND x.v > u.v - 1.645 * u.se) AS rank_hi FROM u""")
def f5_rank_bands(t):
    x = sides(t).groupBy("season", "team").agg(F.avg("p").alias("v"), (F.stddev_samp("p") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return m.rank_band(x, ["season"], "v", "se").select("season", "team", "rank_lo", "rank_hi")


@query("WITH " + SEASON_SQL + ", x AS (SELECT season, team, q_mean, p_mean FROM ts) SELECT season, team, round((q_mean - avg(q_mean) OVER w) / stddev_samp(q_mean) OVER w, 6) AS z_q, count(*) OVER w AS group_size, round(avg(q_mean) OVER w, 6) AS group_mean FROM x WINDOW w AS (PARTITION BY season)")
def f8_f10_z_scores(t):
    x = m.z_scores(m.season_means(sides(t), ["season", "team"], ["q", "p"]), ["season"], "q_mean", "z_q")
    w = Window.partitionBy("season")
    return x.select("season", "team", R("z_q"), F.count(F.lit(1)).over(w).alias("group_size"), R(F.avg("q_mean").over(w), "group_mean"))


@query("WITH " + SIDES_SQL + " SELECT team, arg_max(conf, season) AS last_conf, max(season) AS last_season FROM sides GROUP BY 1")
def f11_last_known(t):
    return sides(t).groupBy("team").agg(F.max_by("conf", "season").alias("last_conf"), F.max("season").alias("last_season"))


@query("WITH " + SIDES_SQL + """, t AS (SELECT season, conf, team, round(avg(q), 6) AS v FROM sides GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY season, conf ORDER BY v DESC, team) AS place FROM t)
SELECT season, conf, team, v, place, list_position(['ASIA', 'EUROPE', 'AFRICA', 'AMERICA', 'MIDDLE EAST'], conf)::BIGINT AS board FROM o WHERE place <= 3""")
def f7_f9_boards(t):
    x = sides(t).groupBy("season", "conf", "team").agg(R(F.avg("q"), "v"))
    board = F.array_position(F.array(*map(F.lit, ("ASIA", "EUROPE", "AFRICA", "AMERICA", "MIDDLE EAST"))), F.col("conf"))
    return m.top(x, ["season", "conf"], [F.desc("v"), "team"], 3).select("season", "conf", "team", "v", F.col("place").cast("long").alias("place"), F.nullif(board.cast("long"), F.lit(0).cast("long")).alias("board"))


@query("WITH " + SIDES_SQL + """, cand AS (SELECT unnest([quantile_cont(q, 0.2), quantile_cont(q, 0.35), quantile_cont(q, 0.5), quantile_cont(q, 0.65), quantile_cont(q, 0.8)]) AS threshold FROM sides),
x AS (SELECT threshold, avg((q >= threshold)::INT) AS hit_rate, avg(won) FILTER (q >= threshold) - avg(won) FILTER (q < threshold) AS lift FROM sides, (SELECT DISTINCT threshold FROM cand) GROUP BY 1)
SELECT round(threshold, 6) AS threshold, round(hit_rate, 6) AS hit_rate, round(lift, 6) AS lift FROM x WHERE hit_rate BETWEEN 0.3 AND 0.7 ORDER BY lift DESC, threshold LIMIT 1""")
def g6_threshold_search(t):
    return m.best_threshold(sides(t), "q", "won", (0.2, 0.35, 0.5, 0.65, 0.8)).select(R("threshold"), R("hit_rate"), R("lift"))


@query("WITH " + SIDES_SQL + """, r AS (SELECT season, won, rank() OVER (PARTITION BY season ORDER BY q) + (count(*) OVER (PARTITION BY season, q) - 1) / 2.0 AS rk FROM sides)
SELECT season, round((sum(rk) FILTER (won = 1) - sum(won) * (sum(won) + 1) / 2) / (sum(won) * sum(1 - won)), 6) AS auc FROM r GROUP BY 1""")
def g8_metric_auc(t):
    return m.auc(sides(t), ["season"], "q", "won").select("season", R("auc"))


@query("WITH " + SEASON_SQL + """, l AS (SELECT season, team, 'q' AS metric, q_mean AS v FROM ts UNION ALL SELECT season, team, 'p', p_mean FROM ts)
SELECT a.season, a.metric, round(a.v, 6) AS left_value, round(b.v, 6) AS right_value, CASE WHEN a.v > b.v THEN 'left' WHEN b.v > a.v THEN 'right' END AS better FROM l a JOIN l b ON a.season = b.season AND a.metric = b.metric AND a.team = 1 AND b.team = 2""")
def g5_two_team_comparison(t):
    x = m.long(m.season_means(sides(t), ["season", "team"], ["q", "p"]).select("season", "team", F.col("q_mean").alias("q"), F.col("p_mean").alias("p")), ["season", "team"], ["q", "p"])
    a, b = (x.where(F.col("team") == k).select("season", "metric", F.col("value").alias(n)) for k, n in ((1, "left_value"), (2, "right_value")))
    return a.join(b, ["season", "metric"]).select("season", "metric", R("left_value"), R("right_value"), F.when(F.col("left_value") > F.col("right_value"), "left").when(F.col("right_value") > F.col("left_value"), "right").alias("better"))


@query("WITH " + CHANCE_SQL + """, q AS (SELECT season, least(1 - 1e-6, greatest(1e-6, p_home)) AS p, home_won AS y FROM chance)
SELECT season, count(*) AS n, round(avg(((p > 0.5)::INT = y)::INT), 6) AS accuracy, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM q GROUP BY 1""")
def h6_prediction_scores(t):
    return m.prediction_score(with_chance(t), ["season"], "p_home", "home_won").select("season", "n", R("accuracy"), R("log_loss"), R("brier"))


@query("WITH " + SEASON_SQL + ", j AS (SELECT s.season, s.team, t.q_mean AS o FROM sides s JOIN ts t ON t.season = s.season AND t.team = s.opponent) SELECT season, team, round(avg(o), 6) AS sos, count(*) AS sos_matches FROM j GROUP BY 1, 2")
def h7_d8_schedule_strength(t):
    x = sides(t)
    return r.schedule_strength(x, m.season_means(x, ["season", "team"], ["q"]), ["season"], "q_mean").select("season", "team", R("sos"), "sos_matches")


@query("WITH " + SEASON_SQL + """, z AS (SELECT season, team, p_mean, stddev_samp(p_mean) OVER w AS sd, (p_mean - avg(p_mean) OVER w) / stddev_samp(p_mean) OVER w AS zp, (won_mean - avg(won_mean) OVER w) / stddev_samp(won_mean) OVER w AS zw FROM ts WINDOW w AS (PARTITION BY season)),
c AS (SELECT season, team, round((0.5 * coalesce(zw, zp) + 0.5 * zp) * sd, 6) AS rating_composite FROM z) SELECT *, rank() OVER (PARTITION BY season ORDER BY rating_composite DESC) AS rank_composite FROM c WHERE rating_composite IS NOT NULL""")
def h8_composite(t):
    x = r.composite(m.season_means(sides(t), ["season", "team"], ["p", "won"]), ["season"], "p_mean", {"p_mean": 0.5, "won_mean": 0.5}).where("rating_composite is not null")
    return m.ranked(x.select("season", "team", R("rating_composite")), ["season"], "rating_composite", "rank_composite").withColumn("rank_composite", F.col("rank_composite").cast("long"))


RPI_SQL = SIDES_SQL + """,
rec AS (SELECT season, team, sum(won) AS w, count(*) AS n FROM sides GROUP BY 1, 2), h2h AS (SELECT season, team, opponent, sum(won) AS hw, count(*) AS hn FROM sides GROUP BY 1, 2, 3),
g AS (SELECT h.season, h.team, h.opponent, h.hn, (o.w - (h.hn - h.hw)) / nullif(o.n - h.hn, 0) AS wp FROM h2h h JOIN rec o ON o.season = h.season AND o.team = h.opponent),
owp AS (SELECT season, team, sum(wp * hn) / sum(hn) FILTER (wp IS NOT NULL) AS owp FROM g GROUP BY 1, 2),
oowp AS (SELECT h.season, h.team, sum(o.owp * h.hn) / sum(h.hn) FILTER (o.owp IS NOT NULL) AS oowp FROM h2h h LEFT JOIN owp o ON o.season = h.season AND o.team = h.opponent GROUP BY 1, 2),
rpi AS (SELECT season, team, w / n AS wp, owp, oowp, round(0.25 * w / n + 0.5 * owp + 0.25 * oowp, 9) AS rpi FROM rec JOIN owp USING (season, team) JOIN oowp USING (season, team))"""


def rpi_table(t):
    out = r.rpi(sides(t), ["season"]).withColumn("rpi", F.round("rpi", 9))
    return m.ranked(out.drop("rpi_rank"), ["season"], "rpi", "rpi_rank")


@query("WITH " + RPI_SQL + " SELECT season, team, round(wp, 6) AS wp, round(owp, 6) AS owp, round(oowp, 6) AS oowp, round(rpi, 6) AS rpi, CASE WHEN rpi IS NOT NULL THEN rank() OVER (PARTITION BY season, rpi IS NOT NULL ORDER BY rpi DESC) END AS rpi_rank FROM rpi")
def h17_h18_rpi(t):
    """The season is the scenario: every key carries it, so many scenarios run at once."""
    return rpi_table(t).select("season", "team", R("wp"), R("owp"), R("oowp"), R("rpi"), F.col("rpi_rank").cast("long").alias("rpi_rank"))


CHAMP_SQL = RPI_SQL + """,
cg AS (SELECT s.season, s.conf, s.team, s.won AS x FROM sides s JOIN conference k ON k.team = s.opponent WHERE k.conf = s.conf),
cp AS (SELECT season, conf, team, round(avg(x), 9) AS conf_pct FROM cg GROUP BY 1, 2, 3),
champ AS (SELECT season, conf, team, conf_pct FROM (SELECT cp.*, row_number() OVER (PARTITION BY cp.season, cp.conf ORDER BY conf_pct DESC, rpi DESC NULLS LAST, cp.team) AS rr FROM cp LEFT JOIN rpi USING (season, team)) WHERE rr = 1)"""


def champion_table(t, ratings=None):
    x = sides(t)
    games = x.join(t.conference().select(F.col("team").alias("opponent"), F.col("conf").alias("opp_conf")), "opponent").where("conf = opp_conf")
    return r.champions(games, None, rpi_table(t) if ratings is None else ratings, ["season"], "conf", "rpi")


@query("WITH " + CHAMP_SQL + " SELECT season, conf, team, round(conf_pct, 6) AS conf_pct FROM champ")
def h19_h20_champions(t):
    return champion_table(t).select("season", "conf", "team", R("conf_pct"))


@query("WITH " + CHAMP_SQL + """, tm AS (SELECT r.season, r.team, r.rpi, c.team IS NOT NULL AS auto FROM rpi r LEFT JOIN champ c ON c.season = r.season AND c.team = r.team),
k AS (SELECT *, row_number() OVER (PARTITION BY season, auto ORDER BY rpi DESC NULLS LAST, team) AS rr, count(*) FILTER (auto) OVER (PARTITION BY season) AS na FROM tm),
f AS (SELECT season, team, auto, row_number() OVER (PARTITION BY season ORDER BY rpi DESC NULLS LAST, team) AS overall FROM k WHERE auto OR rr <= 64 - na),
s AS (SELECT *, CASE WHEN overall <= 32 THEN overall - 1 ELSE 64 - overall END AS sd FROM f)
SELECT season, team, auto, overall, (CASE WHEN (sd // 4) % 2 = 0 THEN sd % 4 ELSE 3 - sd % 4 END) * 16 + list_position([1, 16, 8, 9, 5, 12, 4, 13, 6, 11, 3, 14, 7, 10, 2, 15], sd // 4 + 1) - 1 + CASE WHEN overall <= 32 THEN 0 ELSE 1 END AS slot FROM s""")
def h21_h22_field_and_slots(t):
    champs = champion_table(t).select("season", "team", F.lit(True).alias("auto"))
    teams = rpi_table(t).select("season", "team", "rpi").join(champs, ["season", "team"], "left").withColumn("auto", F.coalesce("auto", F.lit(False)))
    return r.field(teams, ["season"], "rpi", "auto").select("season", "team", "auto", F.col("overall").cast("long").alias("overall"), r.slot(F.col("overall")).alias("slot"))


@query("WITH " + CHANCE_SIDES_SQL + """, g AS (SELECT season, team, won, p, won - p AS resid, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY season, team) AS n FROM cs WINDOW w AS (PARTITION BY season, team ORDER BY day, contest_id)),
x AS (SELECT season, team, count(*) AS n, avg(resid) FILTER (i % 2 = 1) AS odd, avg(resid) FILTER (i % 2 = 0) AS even, avg(resid) FILTER (i < n / 2.0) AS h1, avg(resid) FILTER (i >= n / 2.0) AS h2, sum(resid) / sqrt(sum(p * (1 - p))) AS z FROM g GROUP BY 1, 2 HAVING count(*) >= 16)
SELECT count(*) AS groups, round(corr(odd, even), 6) AS odd_even, round(corr(h1, h2), 6) AS halves, round(stddev_samp(z), 6) AS z_sd, round(avg((abs(z) > 2)::INT), 6) AS beyond_2sd FROM x""")
def h12_persistence(t):
    return p.persistence(chance_sides(t), ["season", "team"], ["day", "contest_id"], "p", "won").select("groups", R("odd_even"), R("halves"), R("z_sd"), R("beyond_2sd"))


@query("WITH RECURSIVE " + CHANCE_SIDES_SQL + """, g AS (SELECT season, team, p, row_number() OVER (PARTITION BY season, team ORDER BY contest_id) AS i, count(*) OVER (PARTITION BY season, team) AS games FROM cs WHERE month(day) >= 11),
d AS (SELECT season, team, games, 0::BIGINT AS i, 0::BIGINT AS k, 1.0::DOUBLE AS pr FROM g GROUP BY ALL
      UNION ALL SELECT d.season, d.team, d.games, g.i, x.k, sum(d.pr * CASE WHEN x.k = d.k THEN 1 - g.p ELSE g.p END) FROM d JOIN g ON g.season = d.season AND g.team = d.team AND g.i = d.i + 1, LATERAL (SELECT unnest([d.k, d.k + 1]) AS k) x GROUP BY ALL),
f AS (SELECT season, team, games, k, pr, sum(pr) OVER (PARTITION BY season, team ORDER BY k) AS cdf FROM d WHERE i = games)
SELECT season, team, games, round(sum(pr * k), 6) AS mean, min(k) FILTER (cdf >= 0.1 - 1e-12) AS q10, min(k) FILTER (cdf >= 0.9 - 1e-12) AS q90, round(max(pr) FILTER (k = games), 6) AS win_out FROM f GROUP BY 1, 2, 3""")
def h15_h16_win_distribution(t):
    left = chance_sides(t).where(F.month("day") >= 11)  # what is left of each season from November on
    return p.win_distribution(left, ["season", "team"], "p", "contest_id").select("season", "team", "games", R("mean"), "q10", "q90", R("win_out"))


@query("WITH " + SIDES_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, contest_id) AS i, row_number() OVER (PARTITION BY team, won ORDER BY day, contest_id) AS j, lead(won) OVER (PARTITION BY team ORDER BY day, contest_id) AS nx FROM sides WHERE q <> opp_q)
SELECT team, (i - j)::BIGINT AS run_no, count(*) AS length, min(day) AS first, max(day) AS last, coalesce(max((nx = 0)::INT), 0) AS broken FROM o WHERE won = 1 GROUP BY 1, 2""")
def c8_streaks(t):
    x = sides(t).withColumn("w", F.when(F.col("q") != F.col("opp_q"), F.col("won")))
    return s.streaks(x, "team", ["day", "contest_id"], "w", "day").select("team", "run_no", "length", "first", "last", "broken")


@query("WITH " + SIDES_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, contest_id) AS i, row_number() OVER (PARTITION BY team, won ORDER BY day, contest_id) AS j FROM sides),
runs AS (SELECT team, i - j AS run_no, count(*) AS length, min(day) AS first, max(day) AS last FROM o WHERE won = 1 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT r.team, r.run_no::BIGINT AS run_no, count(*) AS n, count(*) FILTER (s.venue = 'home') AS n_home FROM runs r JOIN sides s ON s.team = r.team AND s.day BETWEEN r.first AND r.last GROUP BY 1, 2""")
def d13_span_join(t):
    x = sides(t)
    runs = s.streaks(x, "team", ["day", "contest_id"], "won", "day").where("length >= 3").select("team", "run_no", "first", "last")
    return c.within_spans(x.select("team", "day", "venue"), runs, "team", "day", "first", "last").groupBy("team", "run_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("venue") == "home").alias("n_home"))


@query("WITH " + SIDES_SQL + """, w AS (SELECT season, team, date_trunc('week', day)::DATE AS wk, sum(won) AS w, count(*) AS n FROM sides GROUP BY 1, 2, 3), wk AS (SELECT DISTINCT season, date_trunc('week', day)::DATE AS week_start FROM sides),
v AS (SELECT w.season, w.team, week_start, sum(w.w) / sum(w.n) AS before FROM w JOIN wk ON wk.season = w.season AND w.wk < wk.week_start GROUP BY 1, 2, 3)
SELECT s.contest_id, s.team, round(v.before, 6) AS before FROM sides s LEFT JOIN v ON v.season = s.season AND v.team = s.team AND v.week_start = date_trunc('week', s.day)::DATE""")
def d12_as_of_week(t):
    x = sides(t)
    week = F.date_trunc("week", "day").cast("date")
    sums = x.groupBy("season", "team", week.alias("week_start")).agg(F.sum("won").alias("w"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("season", "team").orderBy("week_start").rowsBetween(Window.unboundedPreceding, -1)
    v = sums.select("season", "team", "week_start", (F.sum("w").over(earlier) / F.sum("n").over(earlier)).alias("before"))
    return c.as_of_week(x, "day", v, ["season", "team"]).select("contest_id", "team", R("before"))


@query("WITH " + SIDES_SQL + """ SELECT 'missing' AS kind, team FROM (SELECT DISTINCT team FROM sides WHERE season = 1995 EXCEPT SELECT team FROM sides WHERE season = 1996 AND q > 45)
UNION ALL SELECT 'kept', team FROM (SELECT DISTINCT team FROM sides WHERE season = 1995 INTERSECT SELECT team FROM sides WHERE season = 1996 AND q > 45)""")
def d14_j1_j4_set_operations(t):
    x = sides(t)
    before, now = x.where("season = 1995").select("team").distinct(), x.where("season = 1996 and q > 45").select("team")
    return before.join(now, "team", "left_anti").select(F.lit("missing").alias("kind"), "team").unionByName(before.join(now, "team", "left_semi").select(F.lit("kept").alias("kind"), "team"))


@query("WITH " + CONTEST_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY season, least(home, away), greatest(home, away) ORDER BY day, contest_id) AS rr, count(*) OVER (PARTITION BY season, least(home, away), greatest(home, away)) AS n FROM contest)
SELECT contest_id, 's' || least(home, away) || '-' || greatest(home, away) || CASE WHEN n > 1 THEN ' (game ' || rr || ')' ELSE '' END AS label, rr = 1 AS once FROM o""")
def c17_c18_d17_labels_and_rounds(t):
    label = F.concat(F.lit("s"), F.least("home", "away").cast("string"), F.lit("-"), F.greatest("home", "away").cast("string"))
    x = c.numbered_labels(t.contest(), ["season"], ["day", "contest_id"], label)
    return x.select("contest_id", "label", (~F.col("label").contains("(game") | F.col("label").endswith("(game 1)")).alias("once"))


@query("WITH " + CONTEST_SQL + """, a AS (SELECT contest_id, CASE WHEN home_won = 1 THEN home ELSE away END AS w FROM contest), b AS (SELECT contest_id, CASE WHEN home_p > away_p THEN home ELSE away END AS w FROM contest WHERE home_p <> away_p)
SELECT count(*) AS n_both, count(*) FILTER (a.w = b.w) AS n_agree, round(avg((a.w <> b.w)::INT), 6) AS disagree_share FROM a JOIN b USING (contest_id)""")
def d18_source_agreement(t):
    x = t.contest()
    a = x.select("contest_id", F.when(F.col("home_won") == 1, F.col("home")).otherwise(F.col("away")).alias("w"))
    b = x.where("home_p <> away_p").select("contest_id", F.when(F.col("home_p") > F.col("away_p"), F.col("home")).otherwise(F.col("away")).alias("w"))
    return c.agreement(a, b, ["contest_id"], "w").select("n_both", "n_agree", R("disagree_share"))


@query("WITH " + SIDES_SQL + """, u AS (SELECT DISTINCT team, s.season FROM conference, (SELECT DISTINCT season FROM sides) s), f AS (SELECT season, team, count(*) AS upsets FROM sides WHERE won = 1 AND p < 10000 GROUP BY 1, 2) SELECT u.season, u.team, coalesce(upsets, 0) AS upsets FROM u LEFT JOIN f USING (season, team)""")
def d20_universe_fill(t):
    x = sides(t)
    universe = t.conference().select("team").distinct().crossJoin(F.broadcast(x.select("season").distinct()))  # a few seasons
    return c.filled(universe, x.where("won = 1 and p < 10000").groupBy("season", "team").agg(F.count(F.lit(1)).alias("upsets")), ["season", "team"], ["upsets"]).select("season", "team", "upsets")
