"""Queries over matches of the feed view: a user's weeks are the sets of a match between the two sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rates as fr
from ..operators import contests as c
from ..operators import matches as ms
from ..operators import metrics as m
from ..operators import sequence as s
from .contest_queries import SEASON_SQL, SIDES_SQL, R, sides
from .feed_queries import SCORED_SQL, SET, rallies, scored
from .registry import query
from .views import FEED

MATCH = ["user_id"]
#: The score that a side is first to, as sets of the feed are short.
FIRST_TO = 2
CHECKPOINTS = (1, 2, 3)
FLOOR = 5

MATCH_SQL = SCORED_SQL + """,
final AS (SELECT user_id, week, arg_max(score_a + (winner = 'A')::INT, rally_no)::BIGINT AS final_a, arg_max(score_b + (winner = 'B')::INT, rally_no)::BIGINT AS final_b FROM scored GROUP BY 1, 2),
f AS (SELECT user_id, week, min(rally_no) FILTER (score_a >= 2) AS at_a, min(rally_no) FILTER (score_b >= 2) AS at_b FROM scored GROUP BY 1, 2),
st AS (SELECT user_id, week, row_number() OVER (PARTITION BY user_id ORDER BY week) AS set_no, final_a, final_b, abs(final_a - final_b) AS margin, CASE WHEN final_a > final_b THEN 'A' WHEN final_b > final_a THEN 'B' END AS set_winner,
         CASE WHEN coalesce(at_a, 99999) < coalesce(at_b, 99999) THEN 'A' WHEN coalesce(at_b, 99999) < coalesce(at_a, 99999) THEN 'B' END AS first_to FROM final JOIN f USING (user_id, week)),
es AS (SELECT st.*, side, coalesce(first_to = side, false) AS first, (set_winner = side)::INT::DOUBLE AS won_set FROM st, (VALUES ('A'), ('B')) v(side)),
c0 AS (SELECT user_id, side, count(*) AS sets_played, count(*) FILTER (first) AS sets_first, max(won_set) FILTER (set_no = 1) AS won_set1, max(margin) FILTER (set_no = 1) AS set1_margin,
         count(*) FILTER (won_set = 1) AS sets_for, count(*) FILTER (won_set = 0) AS sets_against FROM es GROUP BY 1, 2),
ctx AS (SELECT *, CASE WHEN sets_for > sets_against THEN 1.0::DOUBLE WHEN sets_for < sets_against THEN 0.0::DOUBLE END AS won FROM c0),
decided AS (SELECT * FROM ctx WHERE won IS NOT NULL),
x AS (SELECT es.*, decided.won FROM es JOIN decided USING (user_id, side) WHERE set_no <= 4 AND first_to IS NOT NULL)"""


def set_rows(t):
    rows = scored(t)
    firsts = s.first_to(rows, SET, FIRST_TO, False, "winner", FEED.sides)
    return ms.set_table(s.final_state(rows, SET, "winner", FEED.sides), firsts, MATCH, "week", FEED.sides)


def context(t):
    return ms.set_context(ms.set_sides(set_rows(t), FEED.sides), MATCH)


def decided(t):
    return context(t).where("won is not null")


def sets_of_decided(t):
    """Sets one to four of decided matches in which a side was first, from each side."""
    each = ms.set_sides(set_rows(t), FEED.sides).where("set_no <= 4 and first_to is not null")
    return each.join(decided(t).select("user_id", "side", "won"), ["user_id", "side"])


@query("WITH " + MATCH_SQL + " SELECT user_id, side, sets_played, sets_first, won_set1, set1_margin, sets_for, sets_against, won FROM ctx")
def e2_set_context(t):
    return context(t)


COUNTS_SQL = MATCH_SQL + """,
rs AS (SELECT *, serve_team AS side, true AS serving FROM rally UNION ALL SELECT *, recv_team, false FROM rally),
cnt AS (SELECT user_id, side, count(*) FILTER (NOT serving) AS recv_rallies, count(*) FILTER (serving) AS serve_rallies, count(*) FILTER (NOT serving AND winner = side) AS so_won,
  count(*) FILTER (NOT serving AND winner = side AND first_ball) AS fbso_won, count(*) FILTER (serving AND winner = side) AS ps_won, count(*) FILTER (serving AND winner <> side AND first_ball) AS opp_fbso_won,
  count(*) FILTER (serving AND winner = side AND passer IS NULL) AS aces, count(*) FILTER (serving AND winner <> side AND touches = 2) AS serve_errs,
  count(*) FILTER (winner = side AND end_event = 'purchase') AS kills, count(*) FILTER (winner <> side AND end_event = 'error') AS att_errors, count(*) FILTER (touches > 2) AS attacks,
  count(*) FILTER (NOT serving AND passer IS NOT NULL) AS ret_att, count(*) FILTER (NOT serving AND passer IS NOT NULL AND winner <> side) AS rec_errors,
  count(*) FILTER (winner = side AND touches = 3) AS block_solos, count(*) FILTER (winner = side AND touches = 4) AS block_assists, sum(touches)::BIGINT AS digs, count(DISTINCT week) AS sets,
  count(*) FILTER (winner = side AND end_event = 'purchase' AND touches > 2) AS kill_pts, count(*) FILTER (winner = side AND end_event = 'purchase' AND touches <= 2) AS block_pts, count(*) FILTER (winner = side AND end_event = 'error') AS opp_error_pts,
  bool_or(passer IS NOT NULL) AS detail FROM rs GROUP BY 1, 2),
j AS (SELECT cnt.*, sets_played, sets_first FROM cnt JOIN ctx USING (user_id, side)),
rt AS (SELECT user_id, side, aces, serve_errs, so_won / nullif(recv_rallies, 0) AS sideout_pct, CASE WHEN detail THEN fbso_won / nullif(recv_rallies, 0) END AS fbso_pct, ps_won / nullif(serve_rallies, 0) AS point_score_pct,
  CASE WHEN detail THEN opp_fbso_won / nullif(serve_rallies, 0) END AS opp_fbso_allowed, aces / nullif(serve_rallies, 0) AS ace_pct, serve_errs / nullif(serve_rallies, 0) AS serve_err_pct,
  (kills - att_errors) / nullif(attacks, 0) AS hit_pct, kills / nullif(attacks, 0) AS kill_pct, att_errors / nullif(attacks, 0) AS att_err_pct, rec_errors / nullif(ret_att, 0) AS rec_err_pct,
  (block_solos + block_assists / 2) / nullif(sets, 0) AS blocks_per_set, digs / nullif(sets, 0) AS digs_per_set, kill_pts / nullif(kill_pts + block_pts + opp_error_pts, 0) AS kill_pt_share,
  (so_won + ps_won) / nullif(recv_rallies + serve_rallies, 0) AS rally_win_pct, CASE WHEN detail THEN (so_won - fbso_won) / nullif(recv_rallies - fbso_won, 0) END AS trans_so_pct, sets_first / nullif(sets_played, 0) AS first20_share FROM j)"""
RATES = ["sideout_pct", "fbso_pct", "point_score_pct", "opp_fbso_allowed", "ace_pct", "serve_err_pct", "hit_pct", "kill_pct", "att_err_pct", "rec_err_pct", "blocks_per_set", "digs_per_set", "kill_pt_share", "rally_win_pct", "trans_so_pct", "first20_share"]


def side_counts(t):
    """The counts of each side's match that rates are made of, from rallies and their touches; one grouping."""
    r = rallies(t)
    each = r.select("*", F.explode(F.array(F.struct(F.col("serve_team").alias("side"), F.lit(True).alias("serving")), F.struct(F.col("recv_team").alias("side"), F.lit(False).alias("serving")))).alias("x")).select("*", "x.*")
    serving, won, passed, kill = F.col("serving"), F.col("winner") == F.col("side"), F.col("passer").isNotNull(), F.col("end_event") == "purchase"
    touches = F.col("touches")
    counts = {
        "recv_rallies": ~serving, "serve_rallies": serving, "so_won": ~serving & won, "fbso_won": ~serving & won & F.col("first_ball"), "ps_won": serving & won, "opp_fbso_won": serving & ~won & F.col("first_ball"),
        "aces": serving & won & ~passed, "serve_errs": serving & ~won & (touches == 2), "kills": won & kill, "att_errors": ~won & ~kill, "attacks": touches > 2, "ret_att": ~serving & passed, "rec_errors": ~serving & passed & ~won,
        "block_solos": won & (touches == 3), "block_assists": won & (touches == 4), "kill_pts": won & kill & (touches > 2), "block_pts": won & kill & (touches <= 2), "opp_error_pts": won & ~kill,
    }
    return each.groupBy("user_id", "side").agg(*[F.count_if(x).alias(k) for k, x in counts.items()], F.sum("touches").alias("digs"), F.countDistinct("week").alias("sets"), F.bool_or(passed).alias("detail"))


@query("WITH " + COUNTS_SQL + " SELECT rt.user_id, rt.side, " + ", ".join(f"round(rt.{x}, 6) AS {x}" for x in RATES) + """, round(coalesce(rt.aces / nullif(rt.serve_errs, 0), rt.aces), 6) AS ace_to_err,
round(o.hit_pct, 6) AS opp_hit_pct, round(rt.hit_pct - o.hit_pct, 6) AS hit_margin FROM rt JOIN rt o ON o.user_id = rt.user_id AND o.side <> rt.side""")  # fmt: skip
def b11_b12_b14_match_rates(t):
    rated = side_counts(t).join(context(t).select("user_id", "side", "sets_played", "sets_first"), ["user_id", "side"])
    rated = rated.select("user_id", "side", "aces", "serve_errs", *[e.alias(k) for k, e in fr.match_rates(F.col("detail")).items()])
    both = c.mirror(rated, ["user_id"], "side", ["hit_pct"])
    return both.select("user_id", "side", *map(R, RATES), R(fr.ratio_or_count(F.col("aces"), F.col("serve_errs")), "ace_to_err"), R("opp_hit_pct"), R(F.col("hit_pct") - F.col("opp_hit_pct"), "hit_margin"))


@query("WITH " + MATCH_SQL + " SELECT user_id, side, sets_for, sets_against, won, (SELECT min(margin) FROM st WHERE st.user_id = decided.user_id AND set_no = 1) AS margin FROM decided")
def d9_set_margins(t):
    margins = set_rows(t).where("set_no = 1").select("user_id", "margin")
    return ms.with_first_margins(decided(t).select("user_id", "side", "sets_for", "sets_against", "won"), margins, MATCH, "margin")


@query("WITH " + MATCH_SQL + " SELECT user_id, side, set_no, first, won_set, won FROM x")
def d10_set_leaders(t):
    return sets_of_decided(t).select("user_id", "side", "set_no", "first", "won_set", "won")


@query("WITH " + MATCH_SQL + """
SELECT 'length' AS kind, sets_played::VARCHAR AS key, count(*) // 2 AS n, round(count(*) / sum(count(*)) OVER (), 6) AS value FROM decided GROUP BY sets_played
UNION ALL SELECT 'set1_winner', sets_played::VARCHAR, count(*) // 2, round(avg(won) FILTER (won_set1 = 1), 6) FROM decided GROUP BY sets_played
UNION ALL SELECT 'score', sets_for || '-' || sets_against, count(*), NULL FROM decided WHERE won_set1 = 1 GROUP BY sets_for, sets_against""")
def e19_match_lengths(t):
    return ms.by_length(decided(t)).select("kind", "key", "n", R("value"))


DEFICITS = [("down 1", 1.0, 1.0), ("down 2", 2.0, 2.0), ("down 3+", 3.0, 99.0)]


@query("WITH " + MATCH_SQL + """, lost AS (SELECT *, CASE WHEN set1_margin = 1 THEN 'down 1' WHEN set1_margin = 2 THEN 'down 2' WHEN set1_margin >= 3 THEN 'down 3+' END AS band FROM decided WHERE won_set1 = 0)
SELECT 'all' AS kind, 'won' AS key, count(*) FILTER (won = 1) AS n, round(avg(won), 6) AS value FROM lost UNION ALL SELECT 'all', 'of', count(*), round(avg(set1_margin) FILTER (won = 1), 6) FROM lost
UNION ALL SELECT 'deficit', band, count(*), round(avg(won), 6) FROM lost WHERE band IS NOT NULL GROUP BY band UNION ALL SELECT 'score', sets_for || '-' || sets_against, count(*), NULL FROM lost WHERE won = 1 GROUP BY sets_for, sets_against""")
def e20_comebacks(t):
    return ms.comebacks(decided(t), fr.band(F.col("set1_margin"), DEFICITS)).select("kind", "key", "n", R("value"))


LEADS = [("up 1", 1.0, 1.0), ("up 2", 2.0, 2.0), ("up 3+", 3.0, 99.0)]


@query("WITH " + MATCH_SQL + """,
cp AS (SELECT user_id, c AS checkpoint, arg_min(score_a, rally_no) AS a, arg_min(score_b, rally_no) AS b FROM scored JOIN st USING (user_id, week), (VALUES (1), (2), (3)) v(c) WHERE set_no = 1 AND greatest(score_a, score_b) >= c GROUP BY 1, 2),
ld AS (SELECT checkpoint, abs(a - b) AS lead, won, won_set1 FROM cp JOIN decided d ON d.user_id = cp.user_id AND d.side = CASE WHEN a > b THEN 'A' WHEN b > a THEN 'B' END),
sz AS (SELECT *, CASE WHEN lead = 1 THEN 'up 1' WHEN lead = 2 THEN 'up 2' WHEN lead >= 3 THEN 'up 3+' END AS size FROM ld)
SELECT checkpoint, 'all' AS size, count(*) AS n, round(avg(won_set1), 6) AS wins_set1, round(avg(won), 6) AS wins_match, round(avg(lead), 6) AS mean_lead FROM ld GROUP BY 1
UNION ALL SELECT checkpoint, size, count(*), round(avg(won_set1), 6), round(avg(won), 6), round(avg(lead), 6) FROM sz GROUP BY 1, 2 HAVING count(*) >= 5""")
def e21_lead_bands(t):
    first_sets = set_rows(t).where("set_no = 1").select(*SET)
    leads = s.checkpoints(scored(t), SET, CHECKPOINTS).join(first_sets, list(SET), "left_semi").select("user_id", "checkpoint", F.col("leader").alias("side"), F.col("margin").alias("lead"))
    rows = leads.join(decided(t).select("user_id", "side", "won", "won_set1"), ["user_id", "side"])
    return ms.lead_table(rows, fr.band(F.col("lead"), LEADS), FLOOR).select("checkpoint", "size", "n", R("wins_set1"), R("wins_match"), R("mean_lead"))


@query("WITH " + MATCH_SQL + """ SELECT set_no, count(*) FILTER (first) AS n, round(avg(coalesce(won_set, 0)) FILTER (first), 6) AS wins_set, round(avg(won) FILTER (first), 6) AS wins_match,
round(avg(won) FILTER (NOT first), 6) AS wins_match_if_not, round(avg(won) FILTER (first) - avg(won) FILTER (NOT first), 6) AS lift FROM x GROUP BY 1""")
def e23_first_to_by_set(t):
    return ms.first_by_set(sets_of_decided(t)).select("set_no", "n", R("wins_set"), R("wins_match"), R("wins_match_if_not"), R("lift"))


@query("WITH " + MATCH_SQL + """, n AS (SELECT user_id, side, count(*) AS k FROM x WHERE first GROUP BY 1, 2)
SELECT coalesce(k, 0) AS sets_first_to, count(*) AS n, round(avg(won), 6) AS win_pct FROM decided LEFT JOIN n USING (user_id, side) GROUP BY 1 HAVING count(*) >= 5""")
def e23_first_to_counts(t):
    return ms.first_counts(decided(t), sets_of_decided(t), MATCH, FLOOR).select("sets_first_to", "n", R("win_pct"))


@query("WITH " + MATCH_SQL + """, y AS (SELECT first AS f, coalesce(won_set = 1, false) AS w, won FROM x)
SELECT part, count(*) FILTER (hit) AS n, round(avg(won) FILTER (hit), 6) AS win_pct FROM (
  SELECT won, unnest([{'part': 'first', 'hit': f}, {'part': 'won_set', 'hit': w}, {'part': 'first_and_won', 'hit': f AND w}, {'part': 'won_from_behind', 'hit': NOT f AND w}, {'part': 'first_but_lost', 'hit': f AND NOT w}, {'part': 'neither', 'hit': NOT f AND NOT w}], recursive := true) FROM y) GROUP BY 1""")
def e23_first_to_and_set(t):
    return ms.first_and_set(sets_of_decided(t)).select("part", "n", R("win_pct"))


@query("WITH " + SIDES_SQL + """, g AS (SELECT season, team, count(*) AS n, avg(won) AS w, avg((q > 25)::INT) AS ahead FROM sides GROUP BY 1, 2)
SELECT season, count(*) AS teams, round(corr(ahead, w), 6) AS r, max(ahead) AS best FROM g WHERE n >= 5 GROUP BY 1""")
def e24_team_level(t):
    g = sides(t).groupBy("season", "team").agg(F.count(F.lit(1)).alias("n"), F.avg("won").alias("w"), F.avg((F.col("q") > 25).cast("double")).alias("ahead")).where("n >= 5")
    return g.groupBy("season").agg(F.count(F.lit(1)).alias("teams"), R(F.corr("ahead", "w"), "r"), F.max("ahead").alias("best"))


@query("WITH " + SIDES_SQL + """ SELECT season, count(*) FILTER (won = 1) AS wins, count(*) FILTER (won = 0) AS losses, round(avg((q > 25)::INT), 6) AS ahead_rate, count(*) FILTER (q > 25 AND won = 1) AS wins_ahead, count(*) FILTER (q > 25 AND won = 0) AS losses_ahead,
count(*) FILTER (q <= 25 AND won = 1) AS wins_behind, count(*) FILTER (q <= 25 AND won = 0) AS losses_behind FROM sides WHERE team = 3 GROUP BY 1""")
def e24_focus_team(t):
    """The record of one team by season, after being ahead and after being behind; the team is the parameter."""
    won, ahead = F.col("won") == 1, F.col("q") > 25
    return sides(t).where("team = 3").groupBy("season").agg(
        F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"), R(F.avg(ahead.cast("double")), "ahead_rate"), F.count_if(ahead & won).alias("wins_ahead"), F.count_if(ahead & ~won).alias("losses_ahead"),
        F.count_if(~ahead & won).alias("wins_behind"), F.count_if(~ahead & ~won).alias("losses_behind"),
    )


@query("WITH " + SEASON_SQL + """, pr AS (SELECT season, team, q_mean AS v FROM ts WHERE n_matches >= 3)
SELECT a.season, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM pr a JOIN pr b ON b.team = a.team AND b.season = a.season + 1 GROUP BY 1""")
def h12_year_over_year(t):
    """Correlation of a team's value with its value of the season after."""
    x = m.season_means(sides(t), ["season", "team"], ["q"]).where("n_matches >= 3").select("season", "team", F.col("q_mean").alias("v"))
    after = x.select((F.col("season") - 1).alias("season"), "team", F.col("v").alias("v_after"))
    return x.join(after, ["season", "team"]).groupBy("season").agg(F.count(F.lit(1)).alias("n"), R(F.corr("v", "v_after"), "r"))
