"""Queries over the player_match view: identity, thresholds, opponent effects, percentiles, reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import players as pl
from ..operators import sequence as s
from .contest_queries import R, binary_round
from .model_sql import effects_sql
from .registry import query
from .views import PLAYER_SQL, Tables

TOTALS_SQL = PLAYER_SQL + ", tot AS (SELECT season, player, position, team, sum(w) AS w, sum(w * y) AS wy, count(*) AS n FROM player_match GROUP BY 1, 2, 3, 4), rated AS (SELECT *, wy / w AS rate FROM tot)"


def totals(t: Tables):
    """One row per player and season: w, wy, n and rate. Sums are exact to six decimals of each row, so that they do not depend on the order of rows."""

    def exact(v):
        d = v.try_cast("decimal(28,6)")
        return F.when(F.count(d) == F.count(v), F.sum(d).cast("double")).otherwise(F.sum(v))

    x = t.player_match().groupBy("season", "player", "position", "team").agg(exact(F.col("w")).alias("w"), exact(F.col("w") * F.col("y")).alias("wy"), F.count(F.lit(1)).alias("n"))
    return x.withColumn("rate", F.col("wy") / F.col("w"))


@query("WITH " + TOTALS_SQL + " SELECT season, player, position, team, n, round(w, 6) AS w, round(wy, 4) AS wy, round(rate, 6) AS rate FROM rated")
def e9_b13_player_totals(t):
    return totals(t).select("season", "player", "position", "team", "n", R("w"), F.round("wy", 4).alias("wy"), R("rate"))


@query("WITH " + PLAYER_SQL + """, x AS (SELECT player, opponent, sum(w) AS w FROM player_match GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY w DESC, opponent) AS r FROM x)
SELECT player, opponent FROM o WHERE r = 1""")
def e10_d16_majority(t):
    return pl.majority(t.player_match(), ["player"], "opponent", "w").select("player", "opponent")


@query("WITH " + TOTALS_SQL + """, c AS (SELECT season, CASE WHEN count(*) >= 100 THEN quantile_cont(rate, 0.37) ELSE 1.5 END AS cut FROM rated WHERE position IN ('ECONOMY', 'STANDARD') GROUP BY 1)
SELECT season, player, round(coalesce(cut, 1.5), 6) AS cut, rate >= coalesce(cut, 1.5) AS high FROM rated LEFT JOIN c USING (season)""")
def e11_split_by_share(t):
    return pl.split_by_share(totals(t), ["season"], "rate", F.col("position").isin("ECONOMY", "STANDARD")).select("season", "player", R("cut"), "high")


@query("WITH " + TOTALS_SQL + """, l AS (SELECT position, 'w' AS metric, w AS v FROM rated UNION ALL SELECT position, 'rate', rate FROM rated)
SELECT position, metric, round(quantile_cont(v, 0.5), 6) AS threshold, count(*) < 50 AS few FROM l GROUP BY 1, 2""")
def e12_fixed_thresholds(t):
    return pl.medians(totals(t).select("position", "w", "rate"), ["position"], ["w", "rate"]).select("position", "metric", R("threshold"), "few")


@query("WITH " + TOTALS_SQL + " SELECT season, count(*) AS n, round(avg((n >= 5)::INT), 6) AS cover, avg((n >= 5)::INT) >= 0.4 AS usable FROM rated GROUP BY 1")
def e31_coverage_gate(t):
    cover = F.avg((F.col("n") >= 5).cast("double"))
    return totals(t).groupBy("season").agg(F.count(F.lit(1)).alias("n"), R(cover, "cover"), (cover >= 0.4).alias("usable"))


@query("WITH " + PLAYER_SQL + """, g AS (SELECT DISTINCT team, match_id, day FROM player_match), nb AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day DESC, match_id DESC) AS back FROM g),
o AS (SELECT p.team, p.player, p.match_id, sum(w) AS w, any_value(back) AS back FROM player_match p JOIN nb USING (team, match_id) GROUP BY 1, 2, 3), tw AS (SELECT team, sum(w) FILTER (back <= 30) AS team_w FROM o GROUP BY 1)
SELECT o.team, o.player, count(*) FILTER (back <= 30) AS recent, min(back) - 1 AS missed, round(coalesce(sum(w) FILTER (back <= 30), 0) / any_value(team_w), 6) AS share, min(back) - 1 < 30 AS active FROM o JOIN tw USING (team) GROUP BY 1, 2""")
def c14_recency(t):
    out = s.recency(t.player_match(), ["player"], ["team"], "match_id", "day", "w", k=30)
    return out.select("team", "player", "recent", "missed", R("share"), "active")


EFFECT_SQL = PLAYER_SQL + """,
pr AS (SELECT season, position, player, opponent, sum(w) AS w, sum(w * y) AS wy FROM player_match WHERE w > 0 GROUP BY 1, 2, 3, 4), mu AS (SELECT season, position, sum(wy) / sum(w) AS mu FROM pr GROUP BY 1, 2),
q AS (SELECT pr.*, wy - w * mu AS wr, mu FROM pr JOIN mu USING (season, position)), ow AS (SELECT season, position, opponent, sum(w) AS ow FROM q GROUP BY 1, 2, 3), rg AS (SELECT season, position, 0.5 * avg(ow) AS ridge FROM ow GROUP BY 1, 2),
p1 AS (SELECT season, position, player, sum(wr) / sum(w) AS p FROM q GROUP BY 1, 2, 3),
o1 AS (SELECT q.season, q.position, q.opponent, sum(q.w * p1.p - q.wr) / (any_value(ow.ow) + any_value(rg.ridge)) AS o FROM q JOIN p1 USING (season, position, player) JOIN ow USING (season, position, opponent) JOIN rg USING (season, position) GROUP BY 1, 2, 3),
p2 AS (SELECT q.season, q.position, q.player, sum(q.wr + q.w * o1.o) / sum(q.w) AS p, any_value(mu) AS mu FROM q JOIN o1 USING (season, position, opponent) GROUP BY 1, 2, 3)"""


@query("WITH " + EFFECT_SQL + " SELECT season, position, player, round(mu + p, 4) AS value_adj FROM p2")
def i1_opponent_effects_two_rounds(t):
    return pl.opponent_effects(t.player_match(), ["season", "position"], "player", "opponent", "w", "y", rounds=2)[0].select("season", "position", "player", F.round("value_adj", 4).alias("value_adj"))


#: Groups of fewer rows are left out; a season of real leagues has enough for 500.
LEAST_ROWS = 100


@query(effects_sql(LEAST_ROWS))
def i1_opponent_effects(t):
    """The full forty rounds, each group's in one task; checked by a planted-effects test and against the distributed rounds."""
    return pl.opponent_effects_grouped(t.player_match(), ["season", "position"], "player", "opponent", "w", "y", least=LEAST_ROWS).select("season", "position", "player", F.round("value_adj", 4).alias("value_adj"))


@query(effects_sql(LEAST_ROWS))
def i1_opponent_effects_distributed(t):
    """The same for groups of any size: those beyond a task's pairs go round by round as joins."""
    return pl.opponent_effects(t.player_match(), ["season", "position"], "player", "opponent", "w", "y", least=LEAST_ROWS)[0].select("season", "position", "player", F.round("value_adj", 4).alias("value_adj"))


@query("WITH " + TOTALS_SQL + ", f AS (SELECT season, regr_slope(rate, w) AS b, avg(w) AS mw, count(*) AS n FROM rated GROUP BY 1) SELECT season, player, round(CASE WHEN f.n >= 200 THEN rate - b * (w - mw) ELSE rate END, 2) AS rate_adj FROM rated JOIN f USING (season)")
def i2_i4_residual_adjusted(t):
    return pl.residual_adjusted(totals(t), ["season"], "rate", "w", "rate_adj").select("season", "player", F.round("rate_adj", 2).alias("rate_adj"))


@query("WITH " + TOTALS_SQL + ", g AS (SELECT season, covar_pop(w, rate) AS xy, covar_pop(n, rate) AS cy, covar_pop(w, n) AS xc, var_pop(w) AS xx, var_pop(n) AS cc, avg(w) AS mx, count(*) AS n FROM rated GROUP BY 1) SELECT season, n, round(mx, 6) AS mean_x, round((xy * cc - cy * xc) / (xx * cc - xc * xc), 4) AS slope FROM g")
def i3_controlled_slope(t):
    x = totals(t).select("season", "rate", "w", F.col("n").cast("double").alias("c"))
    return pl.controlled_slope(x, ["season"], "rate", "w", "c").select("season", "n", R("mean_x"), F.round("slope", 4).alias("slope"))


PCT_SQL = TOTALS_SQL + """,
l AS (SELECT season, player, position, n, 'w' AS metric, round(w, 6) AS v FROM rated UNION ALL SELECT season, player, position, n, 'rate', round(rate, 6) FROM rated), rf AS (SELECT * FROM l WHERE season <= 1997),
sz AS (SELECT position, metric, count(*) AS size FROM rf GROUP BY 1, 2), steps AS (SELECT position, metric, v, count(*) AS k FROM rf GROUP BY 1, 2, 3),
cum AS (SELECT position, metric, v, sum(k) OVER (PARTITION BY position, metric ORDER BY v) AS upto FROM steps),
pct AS (SELECT l.season, l.player, l.position, l.n, l.metric, 100.0 * coalesce(c.upto, 0) / sz.size AS pct FROM l JOIN sz USING (position, metric) ASOF LEFT JOIN cum c ON c.position = l.position AND c.metric = l.metric AND c.v < l.v),
rating AS (SELECT season, player, position, any_value(n) AS n, avg(CASE WHEN metric = 'w' THEN pct ELSE 100 - pct END) AS rating FROM pct GROUP BY 1, 2, 3)"""


def percentiles(t):
    x = totals(t)
    long = x.select("season", "player", "position", "n", binary_round("w").alias("w"), binary_round("rate").alias("rate")).unpivot(["season", "player", "position", "n"], ["w", "rate"], "metric", "v")
    return pl.percentile_against(long, long.where("season <= 1997"), ["position", "metric"], "v")


@query("WITH " + PCT_SQL + " SELECT season, player, position, metric, round(pct, 6) AS pct FROM pct")
def i5_i6_percentiles(t):
    return percentiles(t).select("season", "player", "position", "metric", R("pct"))


@query("WITH " + PCT_SQL + """, b AS (SELECT season, player, position, n, round(CASE WHEN position = 'ECONOMY' THEN (rating + CASE WHEN n >= 6 THEN 2.5 ELSE 0 END) / 1.025 ELSE rating END, 6) AS rating FROM rating),
e AS (SELECT *, season < 2001 OR n >= 3 AS ranked FROM b WHERE n >= 2)
SELECT season, player, position, rating, ranked, CASE WHEN ranked THEN rank() OVER (PARTITION BY season, position, ranked ORDER BY rating DESC) END AS rank_in_position FROM e""")
def i7_i9_player_board(t):
    """Ratings with a bonus for one position, eligibility by matches, and ranks over those who are ranked."""
    x = pl.rating_of(percentiles(t), ["season", "player", "position", "n"], F.col("metric") == "w")
    x = pl.with_bonus(x, F.col("position") == "ECONOMY", F.col("n") >= 6).withColumn("rating", binary_round("rating")).where("n >= 2").withColumn("ranked", (F.col("season") < 2001) | (F.col("n") >= 3))
    x = m.ranked(x, ["season", "position"], "rating", "rank_in_position", only=F.col("ranked"))
    return x.select("season", "player", "position", "rating", "ranked", F.col("rank_in_position").cast("long").alias("rank_in_position"))


HALF_SQL = PLAYER_SQL + """,
i AS (SELECT *, row_number() OVER (PARTITION BY position, player ORDER BY day, match_id, opponent, w, y) - 1 AS i FROM player_match),
h AS (SELECT position, player, round(sum(w * y) FILTER (i % 2 = 0) / sum(w) FILTER (i % 2 = 0), 9) AS a, round(sum(w * y) FILTER (i % 2 = 1) / sum(w) FILTER (i % 2 = 1), 9) AS b, sum(w) FILTER (i % 2 = 0) AS wa, sum(w) FILTER (i % 2 = 1) AS wb, sum(w) AS w FROM i GROUP BY 1, 2),
k AS (SELECT * FROM h WHERE wa >= 25 AND wb >= 25)"""


def half_rates(t):
    x = t.player_match().withColumn("num", F.col("w") * F.col("y")).withColumn("den", F.col("w"))
    return pl.halves(x, ["position", "player"], ["day", "match_id", "opponent", "w", "y"], "num", "den", 25).select("position", "player", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


@query("WITH " + HALF_SQL + """, r AS (SELECT position, rank() OVER (PARTITION BY position ORDER BY a) + (count(*) OVER (PARTITION BY position, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY position ORDER BY b) + (count(*) OVER (PARTITION BY position, b) - 1) / 2.0 AS rb FROM k)
SELECT position, count(*) AS n, round(corr(ra, rb), 6) AS split_half, round(2 * corr(ra, rb) / (1 + corr(ra, rb)), 6) AS full_estimate FROM r GROUP BY 1 HAVING count(*) >= 30""")
def i10_split_half_reliability(t):
    return pl.reliability(half_rates(t), ["position"]).select("position", "n", R("split_half"), R("full_estimate"))


@query("WITH " + HALF_SQL + " SELECT floor(a / 1000)::BIGINT AS bucket, round(stddev_samp(a - b) / 2, 4) AS rating_se, count(*) AS n FROM k GROUP BY 1")
def i11_rating_error(t):
    return pl.rating_error(half_rates(t), F.floor(F.col("a") / 1000).cast("long")).select("bucket", F.round("rating_se", 4).alias("rating_se"), "n")


@query("WITH " + PLAYER_SQL + " SELECT player, match_id, day, opponent, count(*) AS n, round(CASE WHEN sum(w) >= 3 THEN sum(w * y) / sum(w) END, 6) AS rate FROM player_match WHERE season = 1998 GROUP BY 1, 2, 3, 4")
def i12_n14_player_log(t):
    from ..functions.rates import rate

    g = t.player_match().where("season = 1998").groupBy("player", "match_id", "day", "opponent").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("sw"))
    return g.select("player", "match_id", "day", "opponent", "n", R(rate("wy", "sw", 3), "rate"))


@query("WITH " + PLAYER_SQL + ", x AS (SELECT position, stddev_samp(y) / avg(y) AS width FROM player_match GROUP BY position, player HAVING count(*) >= 2) SELECT position, round(quantile_cont(width, 0.5), 6) AS median_width FROM x GROUP BY 1")
def i14_median_band_width(t):
    g = t.player_match().groupBy("position", "player").agg((F.stddev_samp("y") / F.avg("y")).alias("width"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return g.groupBy("position").agg(R(F.percentile("width", F.lit(0.5)), "median_width"))


@query("WITH " + PLAYER_SQL + """ SELECT match_id, team, any_value(day) AS day, count(*) AS players, round(sum(w), 6) AS w, round(max(w), 6) AS s, round(sum(w * y) / sum(w), 6) AS rate FROM player_match GROUP BY 1, 2""")
def a19_team_box_from_players(t):
    from ..sources.box import team_box

    return team_box(t.player_match(), ["match_id", "team"], ["w"], "w").select("match_id", "team", "day", "players", R("w"), R("s"), R("rate"))


@query("WITH " + PLAYER_SQL + """, k AS (SELECT team, opponent, sum(w) AS kills, sum(w) FILTER (position IN ('PROMO', 'SMALL')) AS in_system FROM player_match GROUP BY 1, 2)
SELECT team, opponent, round(kills, 6) AS kills, round(coalesce(in_system, 0), 6) AS in_system, round(coalesce(in_system, 0) / kills, 6) AS share FROM k""")
def e6_e7_e8_in_system_shares(t):
    chosen = t.part.where(F.col("p_type").isin("PROMO", "SMALL")).select(F.col("p_partkey").alias("player")).distinct().withColumn("in_set", F.lit(True))
    x = t.player_match().join(chosen, "player", "left")
    g = x.groupBy("team", "opponent").agg(F.sum("w").alias("kills"), F.coalesce(F.sum(F.when(F.col("in_set"), F.col("w"))), F.lit(0.0)).alias("in_system"))
    return g.select("team", "opponent", R("kills"), R("in_system"), R(F.col("in_system") / F.col("kills"), "share"))


@query("WITH " + TOTALS_SQL + """, l AS (SELECT season, player, position, 'w' AS metric, w AS value FROM rated UNION ALL SELECT season, player, position, 'rate', rate FROM rated), th AS (SELECT position, metric, quantile_cont(value, 0.5) AS threshold FROM l GROUP BY 1, 2)
SELECT season, player, position, count(*) FILTER (CASE WHEN l.metric = 'w' THEN value >= threshold ELSE value <= threshold END) AS met, count(*) AS "of" FROM l JOIN th USING (position, metric) GROUP BY 1, 2, 3""")
def g7_benchmarks_by_position(t):
    """How many of its position's benchmarks each player meets, and of how many; a low rate is better here."""
    x = totals(t)
    thresholds = pl.medians(x.select("position", "w", "rate"), ["position"], ["w", "rate"])
    rows = m.long(x.select("season", "player", "position", "w", "rate"), ["season", "player", "position"], ["w", "rate"])
    return m.benchmarks_met(rows, ["season", "player", "position"], thresholds, {"w": True, "rate": False})


@query("WITH " + TOTALS_SQL + """, q AS (SELECT ps_partkey AS player, v AS touch FROM (SELECT p_partkey AS ps_partkey, p_retailprice AS v FROM part WHERE p_partkey % 10 <> 3)),
j AS (SELECT rated.season, rated.player, rated.position, q.touch FROM rated LEFT JOIN q USING (player)) SELECT season, player, position, CASE WHEN position = 'ECONOMY' THEN touch END AS economy_touch, CASE WHEN position = 'PROMO' THEN touch END AS promo_touch FROM j""")
def i13_touch_quality(t):
    """Charted quality joined to players and kept only for the positions that it covers."""
    quality = t.part.where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("player"), F.col("p_retailprice").alias("touch"))
    joined = totals(t).select("season", "player", "position").join(quality, "player", "left")
    return pl.for_positions(joined, "position", {"economy_touch": ("touch", ["ECONOMY"]), "promo_touch": ("touch", ["PROMO"])}).select("season", "player", "position", "economy_touch", "promo_touch")


@query("WITH " + PLAYER_SQL + """, rs AS (SELECT DISTINCT team, player FROM player_match WHERE season = 1997), h AS (SELECT p.season, p.team, p.player, sum(p.w) AS kills, bool_or(rs.player IS NOT NULL) AS known FROM player_match p LEFT JOIN rs ON rs.team = p.team AND rs.player = p.player GROUP BY 1, 2, 3)
SELECT season, team, count(*) AS hitters, count(*) FILTER (NOT known) AS unmatched, round(sum(kills) FILTER (known) / sum(kills), 6) AS coverage, count(*) FILTER (known) = 0 AS team_unmatched FROM h GROUP BY 1, 2""")
def e7_unmatched_coverage(t):
    """Hitters that the roster knows, by team and season: how many are not matched, the share of kills that is, and teams without any match."""
    x = t.player_match()
    return pl.name_coverage(x, x.where("season = 1997").select("team", "player").distinct(), ["season", "team"], "player", "w").select("season", "team", "hitters", "unmatched", R("coverage"), "team_unmatched")
