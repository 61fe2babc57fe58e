"""Queries of fitted models and of the read functions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from .. import read_api as api
from ..operators import elo as e
from ..operators import metrics as m
from ..operators import predict as p
from ..operators import ratings as r
from ..session import saved_rows
from ..specs import EloConfig
from . import model_sql as q
from .contest_queries import CHANCE_SIDES_SQL, CHANCE_SQL, SEASON_SQL, R, binary_round, chance_sides, sides, team_seasons, with_chance
from .player_queries import PCT_SQL, percentiles
from .registry import query
from .views import CONTEST_SQL, SIDES_SQL, Tables


@query(q.RIDGE_BOARD_SQL)
def h1_h2_ridge_ratings(t):
    """Exact additive fits by season; tested against a dense solve and the conjugate-gradient form."""
    fit = r.additive_ratings(r.pair_sums(sides(t), ["season"], "team", "opponent", "q"), ["season"])
    fit = fit.select("season", "team", "n_matches", *[F.round(c, 4).alias(c) for c in ("rating_off", "rating_def", "rating_overall", "league")])
    return r.ridge_board(fit, ["season"])


def elo_input(t: Tables):
    """Contests with two margins: the difference of both sides' sets, and the home side's share of points beyond a half, in hundredths."""
    margins = {"margin": F.abs(F.col("home_q") - F.col("away_q")), "share_margin": F.abs(F.col("home_p") / (F.col("home_p") + F.col("away_p")) - 0.5) * 100}
    return t.contest().withColumns(margins).select(F.lit("all").alias("pool"), F.col("contest_id").alias("match"), "season", "day", "home", "away", "home_won", *margins, "home_conf", "away_conf")


@query(q.ELO_LOG_SQL)
def h3_elo_log(t):
    """One replay by pool; tested against a plain fold."""
    return e.elo_log(elo_input(t.with_contests()), ["pool"]).select("match", *[F.round(c, 6).alias(c) for c in ("elo_home", "elo_away", "p_home")])


@query(q.ELO_COMPONENTS_SQL)
def h3_elo_components(t):
    """Matches within a conference only: the schedule falls into pools that nothing links, which are found and replayed side by side."""
    x = saved_rows(e.by_component(elo_input(t.with_contests()).where("home_conf = away_conf")), "components")
    return e.elo_log(x, ["component"]).select("component", "match", *[F.round(c, 6).alias(c) for c in ("elo_home", "elo_away", "p_home")])


@query(q.ELO_ENDS_SQL)
def h4_elo_season_ends(t):
    x = elo_input(t.with_contests())
    return e.elo_season_ends(x, e.elo_log(x, ["pool"], more=e.SIDES), ["pool"]).select("season", "team", F.round("elo", 6).alias("elo"), "n_matches", "rank_elo")


def elo_grid() -> dict[str, EloConfig]:
    """The grid of 540 configurations."""
    kinds = {"none": (False, "margin"), "sets": (True, "margin"), "rally": (True, "share_margin")}
    grid = product((10, 15, 20, 25, 30, 40), (0, 20, 35, 50, 65), (0.0, 0.4, 0.6, 0.75, 0.9, 1.0), kinds)
    return {f"k{k}h{h}c{c}{kind}": EloConfig(k=k, home=h, carryover=c, margin=kinds[kind][0], margin_column=kinds[kind][1]) for k, h, c, kind in grid}


@query()
def h5_elo_sweep(t):
    """Scores of the whole grid over all seasons but the first, in which ratings settle; one pass of the matches."""
    x = elo_input(t.with_contests())
    first = x.agg(F.min("season")).first()[0]
    return e.elo_sweep(x, ["pool"], elo_grid(), F.col("season") > F.lit(first)).select("config", "n", R("accuracy"), R("log_loss"), R("brier"))


@query(q.WALK_FORWARD_SQL)
def h9_walk_forward_ratings(t):
    """Ratings of each week of every season, fitted on the season's weeks before it."""
    return r.walk_forward(sides(t), "season", "day", "q").select("season", "week_start", "team", F.round("rating_overall", 4).alias("rating_overall"))


def prematch(t):
    """Contests with both sides' Elo and weekly ridge ratings from before the match."""
    t = t.with_contests()
    x = elo_input(t)
    return p.prematch_features(x, e.elo_log(x, ["pool"]), r.walk_forward(sides(t), "season", "day", "q"))


@query(q.PREMATCH_FEATURES_SQL)
def h9_prematch_features(t):
    """One row per match with elo, ridge and season; tested against refits from scratch and a plain fold."""
    return prematch(t).select("match", "season", *[F.round(c, 4).alias(c) for c in ("elo_home", "elo_away", "ridge_home", "ridge_away")])


def seasons_of(x):
    return sorted(s["season"] for s in x.where("season is not null").select("season").distinct().collect())  # a few numbers


def newton_sql(train: str) -> str:
    """Newton's method in SQL: fit (k, out, spec, u, b0, b1, b2) from x (season, y, gap, level) and m (out, spec, u), u telling whether level is used; twelve rounds."""
    sums = "sum(y - p) AS g0, sum(gap * (y - p)) AS g1, sum(u * level * (y - p)) AS g2, sum(v) AS a, sum(v * gap) AS b, sum(v * u * level) AS c, sum(v * gap * gap) AS d, sum(v * gap * u * level) AS e, sum(v * u * level * level) + 1 - any_value(u) AS f"
    det = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
    return f"""fit AS (SELECT 0 AS k, m.out, spec, u, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM m UNION ALL
SELECT k + 1, out, spec, u, b0 + (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / {det}, b1 + (a * (g1 * f - e * g2) - g0 * (b * f - c * e) + c * (b * g2 - c * g1)) / {det},
       b2 + u * (a * (d * g2 - g1 * e) - b * (b * g2 - c * g1) + g0 * (b * e - c * d)) / {det}
FROM (SELECT k, out, spec, u, b0, b1, b2, {sums} FROM (SELECT *, p * (1 - p) AS v FROM (SELECT fit.*, y, gap, level, 1 / (1 + exp(-(b0 + b1 * gap + b2 * u * level))) AS p FROM fit JOIN x ON {train} WHERE k < 12)) GROUP BY ALL))"""


@query(q.PREMATCH_SQL + """,
x AS (SELECT season, spec, home_won AS y, CASE spec WHEN 'ridge' THEN (ridge_home - ridge_away) / 10 ELSE (elo_home - elo_away) / 100 END AS gap, CASE spec WHEN 'blend' THEN (ridge_home - ridge_away) / 10 ELSE 0 END AS level
  FROM prematch, unnest(['elo', 'ridge', 'blend']) AS t(spec) WHERE season > (SELECT min(season) FROM prematch)),
m AS (SELECT DISTINCT season AS out, spec, (spec = 'blend')::DOUBLE AS u FROM x), """ + newton_sql("x.season <> fit.out AND x.spec = fit.spec") + """,
s AS (SELECT x.season, x.spec, y, least(1 - 1e-6, greatest(1e-6, 1 / (1 + exp(-(b0 + b1 * gap + b2 * level))))) AS p FROM x JOIN fit ON fit.out = x.season AND fit.spec = x.spec WHERE k = 12)
SELECT season, spec, count(*) AS n, round(avg(((p > 0.5)::INT = y)::INT), 6) AS accuracy, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier FROM s GROUP BY 1, 2""")
def h11_rating_specs(t):
    """Leave-one-season-out scores of Elo, ridge and their blend; the first season, in which Elo settles, is neither fitted nor scored."""
    x = saved_rows(prematch(t), "prematch")
    seasons = seasons_of(x)[1:]
    out = p.leave_one_out(x.where(F.col("season").isin(seasons)), "season", seasons, p.SPECS, p.rating_gaps(), "home_won")
    return m.prediction_score(out, ["season", "spec"], "p", "home_won").select("season", "spec", "n", R("accuracy"), R("log_loss"), R("brier"))


@query("WITH RECURSIVE " + CONTEST_SQL + """, x AS (SELECT season, home_won AS y, (home_p - away_p) / 1e5 AS gap, (home_p + away_p) / 1e5 AS level FROM contest),
m AS (SELECT season AS out, spec, u FROM (SELECT DISTINCT season FROM x), (VALUES ('gap', 0.0::DOUBLE), ('both', 1.0::DOUBLE)) s(spec, u)), """ + newton_sql("x.season <> fit.out") + """,
s AS (SELECT x.season, spec, y, least(1 - 1e-6, greatest(1e-6, 1 / (1 + exp(-(b0 + b1 * gap + b2 * level))))) AS p FROM x JOIN fit ON fit.out = x.season WHERE k = 12)
SELECT season, spec, count(*) AS n, round(avg(((p > 0.5)::INT = y)::INT), 6) AS accuracy, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier FROM s GROUP BY 1, 2""")
def h10_h11_logistic_validation(t):
    """Leave-one-season-out scores of two specs, all fitted together; SQL does twelve rounds of the same method."""
    x = t.contest()
    features = {"gap": (F.col("home_p") - F.col("away_p")) / 1e5, "level": (F.col("home_p") + F.col("away_p")) / 1e5}
    out = p.leave_one_out(x, "season", seasons_of(x), {"gap": ("gap",), "both": ("gap", "level")}, features, "home_won")
    return m.prediction_score(out, ["season", "spec"], "p", "home_won").select("season", "spec", "n", R("accuracy"), R("log_loss"), R("brier"))


@query("WITH RECURSIVE " + CONTEST_SQL + """, x AS (SELECT season, home_won AS y, (home_p - away_p) / 1e5 AS gap, 0.0::DOUBLE AS level FROM contest WHERE season < 1998), m AS (SELECT 0 AS out, 'gap' AS spec, 0.0::DOUBLE AS u), """ + newton_sql("true") + """
SELECT (SELECT count(*) FROM x) AS n, round(b0, 6) AS home, round(b1, 6) AS gap FROM fit WHERE k = 12""")
def h23_coefficients_before(t):
    """Weights fitted on earlier seasons only, as rows."""
    x = t.contest().where("season < 1998").withColumn("gap", (F.col("home_p") - F.col("away_p")) / 1e5)
    w = p.logistic_fit(x, [F.col("gap")], "home_won")
    return x.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(round(w[0], 6)).alias("home"), F.lit(round(w[1], 6)).alias("gap"))


@query("WITH " + SEASON_SQL + """, rt AS (SELECT team, q_mean, p_mean FROM ts WHERE season = 1997 AND n_matches >= 5), low AS (SELECT quantile_cont(q_mean, 0.05) AS lq, quantile_cont(p_mean, 0.05) AS lp FROM rt),
g AS (SELECT DISTINCT ON (day, home, away) day, home, away FROM contest WHERE season = 1998 AND day >= DATE '1998-11-01' AND (day, home, away) NOT IN (SELECT (day, home, away) FROM contest WHERE home_q > 40))
SELECT g.day, g.home, g.away, round(coalesce(h.q_mean, lq), 6) AS q_home, round(coalesce(a.q_mean, lq), 6) AS q_away, round(coalesce(h.p_mean, lp), 2) AS p_home, (h.team IS NULL) OR (a.team IS NULL) AS fallback
FROM g LEFT JOIN rt h ON h.team = g.home LEFT JOIN rt a ON a.team = g.away, low""")
def h13_projection(t):
    x = t.contest()
    rt = m.season_means(sides(t), ["season", "team"], ["q", "p"]).where("season = 1997 and n_matches >= 5").select("team", F.col("q_mean").alias("q"), F.col("p_mean").alias("p"))
    games = x.where("season = 1998").select("day", "home", "away")
    out = p.project(games, x.where("home_q > 40"), rt, ["q", "p"], F.lit("1998-11-01").cast("date"))
    return out.select("day", "home", "away", R("q_home"), R("q_away"), F.round("p_home", 2).alias("p_home"), "fallback")


H13_SQL = "WITH " + SEASON_SQL + """, rt AS (SELECT team, q_mean FROM ts WHERE season = 1997 AND n_matches >= 30), low AS (SELECT quantile_cont(q_mean, 0.05) AS lq FROM rt), g AS (SELECT DISTINCT day, home, away FROM contest WHERE season = 1998 AND day >= DATE '1998-11-01')"""


def projected_1998(t):
    rt = m.season_means(sides(t), ["season", "team"], ["q"]).where("season = 1997 and n_matches >= 30").select("team", F.col("q_mean").alias("q"))
    x = t.contest()
    return p.project(x.where("season = 1998").select("day", "home", "away"), x.where("false"), rt, ["q"], F.lit("1998-11-01").cast("date")), rt


@query(H13_SQL + """ SELECT g.day, g.home, g.away, round(1 / (1 + exp(-(0.2 + 0.05 * (coalesce(h.q_mean, lq) - coalesce(a.q_mean, lq))))), 6) AS p_home, h.team IS NULL OR a.team IS NULL AS fallback FROM g LEFT JOIN rt h ON h.team = g.home LEFT JOIN rt a ON a.team = g.away, low""")
def h13_projected_chances(t):
    """Unplayed games with the home side's chance by given weights of home and rating gap."""
    games, _ = projected_1998(t)
    return p.with_chances(games, (0.2, 0.05), [F.col("q_home") - F.col("q_away")]).select("day", "home", "away", R("p_home"), "fallback")


@query(H13_SQL + """ SELECT team FROM (SELECT home AS team FROM g UNION SELECT away FROM g) EXCEPT SELECT team FROM rt""")
def h13_unrated_teams(t):
    games, rt = projected_1998(t)
    return p.unrated(games, rt)


@query("WITH " + CHANCE_SQL + """, met AS (SELECT season, least(home, away) AS lo, greatest(home, away) AS hi, count(*) AS n FROM chance GROUP BY 1, 2, 3), best AS (SELECT arg_max((season, lo, hi), (n, -season, -lo, -hi)) AS b FROM met)
SELECT contest_id, day, round(CASE WHEN home = b[2] THEN p_home ELSE 1 - p_home END, 6) AS p, CASE WHEN home = b[2] THEN home_won ELSE 1 - home_won END AS won FROM chance, best WHERE season = b[1] AND least(home, away) = b[2] AND greatest(home, away) = b[3]""")
def n24_most_frequent_pair(t):
    """Meetings of the pair that met most often in a season, from the side of the smaller number."""
    x = with_chance(t)
    met = x.groupBy("season", F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi")).agg(F.count(F.lit(1)).alias("n"))
    season, lo, hi = met.agg(F.max_by(F.struct("season", "lo", "hi"), F.struct("n", -F.col("season"), -F.col("lo"), -F.col("hi"))).alias("b")).first()["b"]
    return api.head_to_head(x, season, lo, hi).select("contest_id", "day", R("p"), "won")


@query("WITH " + CHANCE_SQL + " SELECT season, count(*) AS games, count(*) FILTER (month(day) >= 11) AS remaining, round(avg((month(day) < 11)::INT), 6) AS share_played, round(sum(p_home) FILTER (month(day) >= 11), 6) AS expected_home FROM chance GROUP BY 1")
def h24_remaining_schedule(t):
    late = F.month("day") >= 11
    return with_chance(t).groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.count_if(late).alias("remaining"), R(F.avg((~late).cast("double")), "share_played"), R(F.sum(F.when(late, F.col("p_home"))), "expected_home"))


def published(t: Tables):
    x = team_seasons(t).join(t.conference(), "team")
    return x.select("season", "team", "conf", "n_matches", "wins", "losses", R("q_mean"), R("p_mean"))


PUB_SQL = SEASON_SQL + ", pub AS (SELECT season, team, conf, n_matches, wins, losses, round(q_mean, 6) AS q_mean, round(p_mean, 6) AS p_mean FROM ts JOIN rec USING (season, team) JOIN conference USING (team))"


@query("WITH " + PUB_SQL + " SELECT DISTINCT season FROM pub")
def n1_seasons(t):
    return api.seasons(published(t))


@query("WITH " + PUB_SQL + " SELECT DISTINCT conf FROM pub WHERE season = 1998")
def n2_n11_n13_n18_distinct_values(t):
    return api.distinct_values(published(t), "conf", 1998)


@query("WITH " + PUB_SQL + ", x AS (SELECT *, rank() OVER (ORDER BY q_mean DESC) AS rank FROM pub WHERE season = 1998 AND n_matches >= 15) SELECT team, q_mean, rank FROM x WHERE conf = 'ASIA'")
def n3_n9_board(t):
    return api.board(published(t), 1998, "q_mean", "ASIA").select("team", "q_mean", F.col("rank").cast("long").alias("rank"))


@query("WITH " + PUB_SQL + " SELECT team, conf, wins, losses, q_mean, rank() OVER (ORDER BY q_mean DESC) AS rank FROM pub WHERE season = 1998 AND n_matches >= 5")
def n4_n10_d11_rankings(t):
    pub = published(t)
    return api.rankings(pub.select("season", "team", "q_mean"), pub, 1998, "q_mean").select("team", "conf", "wins", "losses", "q_mean", F.col("rank").cast("long").alias("rank"))


@query("WITH " + PUB_SQL + """, sos AS (SELECT s.season, s.team, avg(o.q_mean) AS sos FROM sides s JOIN pub o ON o.season = s.season AND o.team = s.opponent GROUP BY 1, 2)
SELECT p.conf, count(*) AS teams, round(avg(sos), 6) AS sos, round(avg(q_mean), 6) AS rating, round(avg(sos) - avg(q_mean), 6) AS gap FROM sos JOIN pub p USING (season, team) WHERE season = 1998 GROUP BY 1 HAVING count(*) >= 4""")
def n5_e14_conference_schedule(t):
    pub = published(t)
    sos = r.schedule_strength(sides(t), pub, ["season"], "q_mean")
    return api.conference_schedule(sos, pub, pub, 1998, "q_mean").select("conf", "teams", R("sos"), R("rating"), R("gap"))


@query("WITH " + PUB_SQL + ", rk AS (SELECT team, q_mean, rank() OVER (ORDER BY q_mean DESC) AS opp_rank FROM pub WHERE season = 1998) SELECT s.contest_id, s.opponent, rk.q_mean AS opp_rating, opp_rank FROM sides s LEFT JOIN rk ON rk.team = s.opponent WHERE s.season = 1998 AND s.team = 3")
def n6_team_schedule(t):
    return api.team_schedule(sides(t), published(t), 1998, 3, "q_mean").select("contest_id", "opponent", "opp_rating", F.col("opp_rank").cast("long").alias("opp_rank"))


@query("WITH " + SIDES_SQL + " SELECT contest_id, day, opponent, q, won FROM sides WHERE season = 1998 AND team = 3")
def n7_team_matches(t):
    return api.team_matches(sides(t), 1998, 3).select("contest_id", "day", "opponent", "q", "won")


def player_table(t: Tables):
    from ..operators import players as pl

    x = pl.rating_of(percentiles(t), ["season", "player", "position", "n"], F.col("metric") == "w").withColumn("rating", binary_round("rating"))
    return x.withColumn("ranked", F.col("n") >= 2).withColumn("team", F.col("player") % 7).withColumn("conf", F.concat(F.lit("c"), (F.col("player") % 3).cast("string")))


PLAYERS_SQL = PCT_SQL + ", players AS (SELECT season, player, position, round(rating, 6) AS rating, n >= 2 AS ranked, player % 7 AS team, 'c' || (player % 3) AS conf FROM rating)"


@query("WITH " + PLAYERS_SQL + ", x AS (SELECT *, CASE WHEN ranked THEN rank() OVER (PARTITION BY ranked ORDER BY rating DESC) END AS rank FROM players WHERE season = 1998 AND position = 'ECONOMY') SELECT player, rating, ranked, rank FROM x WHERE conf = 'c1'")
def n12_player_rankings(t):
    return api.player_rankings(player_table(t), 1998, "ECONOMY", conf="c1", unranked=True).select("player", "rating", "ranked", F.col("rank").cast("long").alias("rank"))


@query("WITH " + PLAYERS_SQL + ", x AS (SELECT *, rank() OVER (PARTITION BY position ORDER BY rating DESC) AS rank FROM players WHERE season = 1998 AND position IN ('ECONOMY', 'PROMO') AND ranked) SELECT position, player, rating, rank FROM x WHERE team = 2")
def n15_n16_n17_boards(t):
    return api.interleaved(player_table(t), 1998, ["ECONOMY", "PROMO"], team=2).select("position", "player", "rating", F.col("rank").cast("long").alias("rank"))


@query("WITH " + PLAYERS_SQL + ", x AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY rating DESC, player) AS place FROM players WHERE season = 1998 AND ranked) SELECT position, player, place FROM x WHERE place <= 25")
def n29_scoped_boards(t):
    return api.scoped(player_table(t), 1998, 25).select("position", "player", F.col("place").cast("long").alias("place"))


@query("WITH " + PUB_SQL + " SELECT conf FROM pub WHERE season = 1998 AND team = 3")
def n19_lookup(t):
    return api.lookup(published(t), "conf", season=1998, team=3)


@query("WITH " + PUB_SQL + " SELECT team, rank() OVER (ORDER BY q_mean DESC) AS rank_q_mean, rank() OVER (ORDER BY p_mean) AS rank_p_mean FROM pub WHERE season = 1998 AND conf = 'ASIA' AND n_matches >= 5")
def n20_metric_ranks(t):
    return api.metric_ranks(published(t), 1998, {"q_mean": True, "p_mean": False}, conf="ASIA").select("team", F.col("rank_q_mean").cast("long").alias("rank_q_mean"), F.col("rank_p_mean").cast("long").alias("rank_p_mean"))


@query("WITH " + CHANCE_SIDES_SQL + """, w AS (SELECT season, team, count(*) AS n, round(sum(won), 6) AS wins, round(sum(p), 6) AS x_wins FROM cs WHERE month(day) < 11 GROUP BY 1, 2), l AS (SELECT season, team, count(*) AS games_left, round(sum(p), 6) AS x_left FROM cs WHERE month(day) >= 11 GROUP BY 1, 2)
SELECT season, team, n, wins, x_wins, coalesce(games_left, 0) AS games_left, round((wins + coalesce(x_left, 0)) / (n + coalesce(games_left, 0)), 6) AS share FROM w LEFT JOIN l USING (season, team)""")
def n22_n26_h16_projected_records(t):
    """Every season as it stood at the end of October: records, chances left, and the share of wins that they project."""
    x = chance_sides(t)
    late = F.month("day") >= 11
    w = m.expected_wins(x.where(~late), ["season", "team"], "p", "won").select("season", "team", "n", R("wins"), R("x_wins"))
    left = x.where(late).groupBy("season", "team").agg(F.count(F.lit(1)).alias("games_left"), R(F.sum("p"), "x_left"))
    out = w.join(left, ["season", "team"], "left").fillna(0, subset=["games_left", "x_left"])
    return out.select("season", "team", "n", "wins", "x_wins", "games_left", binary_round((F.col("wins") + F.col("x_left")) / (F.col("n") + F.col("games_left"))).alias("share"))


@query("WITH " + CHANCE_SIDES_SQL + " SELECT contest_id, day, opponent, round(p, 6) AS p, won, round(sum(won) OVER w, 6) AS cum_won, round(sum(p) OVER w, 6) AS cum_p FROM cs WHERE season = 1998 AND team = 3 WINDOW w AS (ORDER BY day, contest_id ROWS UNBOUNDED PRECEDING)")
def n23_c15_team_predictions(t):
    return api.sides_of(with_chance(t), 1998, 3).select("contest_id", "day", "opponent", R("p"), "won", R("cum_won"), R("cum_p"))


@query("WITH " + CHANCE_SIDES_SQL + """, o AS (SELECT arg_max(opponent, (n, -opponent)) AS foe FROM (SELECT opponent, count(*) AS n FROM cs WHERE season = 1998 AND team = 3 GROUP BY 1))
SELECT contest_id, day, opponent, round(p, 6) AS p, won FROM cs, o WHERE season = 1998 AND team = 3 AND opponent = foe""")
def n24_d19_head_to_head(t):
    """One side's meetings with the opponent that it met most in the season."""
    x = with_chance(t)
    foe = api.sides_of(x, 1998, 3).groupBy("opponent").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("opponent", F.struct("n", -F.col("opponent")))).first()[0]
    return api.head_to_head(x, 1998, 3, foe).select("contest_id", "day", F.lit(foe).alias("opponent"), R("p"), "won")


@query("WITH " + CHANCE_SIDES_SQL + " SELECT contest_id, day, opponent, round(p, 6) AS p FROM cs WHERE season = 1998 AND team = 3 AND day > DATE '1998-11-01'")
def n25_upcoming(t):
    return api.upcoming(with_chance(t), 1998, 3, F.lit("1998-11-01").cast("date")).select("contest_id", "day", "opponent", R("p"))


@query("WITH " + CHANCE_SQL + " SELECT max(day) AS as_of FROM chance WHERE season = 1998")
def n27_ratings_as_of(t):
    return api.ratings_as_of(with_chance(t), 1998)


@query("WITH " + SIDES_SQL + ", x AS (SELECT * FROM sides WHERE season = 1998 AND team = 3), l AS (SELECT * FROM x ORDER BY day DESC, contest_id DESC LIMIT 1) SELECT l.contest_id, l.day, l.q, l.p, round((SELECT avg(q) FROM x), 6) AS q_mean, round((SELECT avg(p) FROM x), 6) AS p_mean FROM l")
def n28_season_frame(t):
    return api.season_frame(sides(t), 1998, 3, ["q", "p"]).select("contest_id", "day", "q", "p", R("q_mean"), R("p_mean"))


MANIFEST_SQL = "man AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS games, count(*) FILTER (o_orderstatus = 'F') AS finals, count(*) FILTER (o_orderpriority = '1-URGENT') > 0 AS held FROM orders GROUP BY 1)"


@query("WITH " + MANIFEST_SQL + " SELECT day, games, finals, held, date_diff('day', day, DATE '1998-07-01') >= 2 AND (games = 0 OR (held AND (finals >= games OR date_diff('day', day, DATE '1998-07-01') >= 21))) AS settled FROM man")
def a21_settled_days(t):
    from ..sources.box import settled

    man = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("o_orderstatus") == "F").alias("finals"), (F.count_if(F.col("o_orderpriority") == "1-URGENT") > 0).alias("held"))
    return settled(man, F.lit("1998-07-01").cast("date"))


@query("SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.07)")
def a22_pending_work(t):
    from ..sources.box import pending

    res = t.orders.select(F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("day"))
    key = F.col("l_orderkey").alias("game_id")
    return pending(res, t.lineitem.where("l_quantity > 40").select(key), t.lineitem.where("l_tax > 0.07").select(key), F.lit("1998-01-01").cast("date"))


@query("SELECT o_orderpriority AS source, o_orderstatus AS status, count(*) AS files, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY 1, 2")
def a24_load_manifest(t):
    from ..sources.box import load_manifest

    return load_manifest(t.orders.select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("bytes"))).withColumn("bytes", F.round("bytes", 2))


@query("WITH " + SIDES_SQL + ", n AS (SELECT season, team, q FROM sides WHERE season >= 2000), o AS (SELECT season, team, q FROM sides WHERE q > 30) SELECT season, count(*) AS rows, round(sum(q), 6) AS q FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE season NOT IN (SELECT season FROM n)) GROUP BY 1")
def a17_a18_carried_forward(t):
    from ..sources.box import carried_forward

    x = sides(t).select("season", "team", "q")
    return carried_forward(x.where("season >= 2000"), x.where("q > 30")).groupBy("season").agg(F.count(F.lit(1)).alias("rows"), R(F.sum("q"), "q"))


@query("WITH " + CONTEST_SQL + """, a AS (SELECT DISTINCT home AS team, 'told ' || home_conf AS conf, 1 AS p FROM contest WHERE home_q > 48), n AS (SELECT max(season) AS season FROM contest),
b AS (SELECT DISTINCT away AS team, 'newest ' || away_conf AS conf, 2 AS p FROM contest WHERE season = (SELECT season FROM n) AND home_won = 0), d AS (SELECT team, conf, 3 AS p FROM conference), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d) SELECT team, arg_min(conf, p) AS conf FROM u GROUP BY 1""")
def a20_conference_by_priority(t):
    """Three sources, each with other teams: those told outright, those seen in the newest season, and the list of all."""
    from ..sources.box import conference_by_priority

    x = t.contest()
    newest = x.agg(F.max("season").alias("newest"))
    told = x.where("home_q > 48").select(F.col("home").alias("team"), F.concat(F.lit("told "), "home_conf").alias("conf")).distinct()
    seen = x.crossJoin(F.broadcast(newest)).where("season = newest and home_won = 0").select(F.col("away").alias("team"), F.concat(F.lit("newest "), "away_conf").alias("conf")).distinct()  # one row
    return conference_by_priority([(1, told), (2, seen), (3, t.conference())])


@query("WITH k AS (SELECT *, least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi FROM lineitem) SELECT lo, hi, arg_max(l_quantity, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_extendedprice, e := l_quantity)) AS last_q FROM k GROUP BY 1, 2")
def a8_last_row_wins(t):
    from ..sources.box import last_by

    x = t.lineitem.select(F.least("l_partkey", "l_suppkey").alias("lo"), F.greatest("l_partkey", "l_suppkey").alias("hi"), F.col("l_quantity").alias("last_q"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("o"))
    return last_by(x, ["lo", "hi"], "o").select("lo", "hi", "last_q")


@query("SELECT date_trunc('week', ts)::TIMESTAMP AS week, count(*) AS rows, bool_or(props IS NOT NULL) AS has_props, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS with_k, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def a13_optional_column_probe(t):
    """Whether an optional column is there, and set, by week rather than by file."""
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.count(F.lit(1)).alias("rows"), F.bool_or(F.col("props").isNotNull()).alias("has_props"), F.count(k).alias("with_k"), F.sum(k.try_cast("long")).alias("k"))
