"""Queries over the feed view: sources, sequences, and the flagship that goes from events to grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rates import rate, with_benchmarks
from ..operators import sequence as s
from ..specs import Benchmark
from .registry import query
from .views import FEED, FEED_SQL, Tables

SET = ("user_id", "week")
SPECS = (Benchmark("sideout_pct", 0.5, label="side-out"), Benchmark("first_ball_pct", 0.25, label="first ball"), Benchmark("mean_touches", 3.0, higher=False, label="short rallies"))

#: Attempts, valid serves and rallies as window SQL.
RALLY_SQL = FEED_SQL + """,
pos AS (SELECT *, row_number() OVER w AS pos, count(*) FILTER (event = 'view') OVER (w ROWS UNBOUNDED PRECEDING) AS attempt
        FROM feed WHERE event IN ('view', 'click', 'purchase', 'error') WINDOW w AS (PARTITION BY user_id, week ORDER BY ts, event_id)),
att AS (SELECT user_id, week, attempt, min(pos) AS s_pos, arg_min(team, pos) AS serve_team, arg_min(player, pos) AS server,
               min(pos) FILTER (event IN ('purchase', 'error')) AS t_pos, arg_min(event, pos) FILTER (event IN ('purchase', 'error')) AS end_event,
               arg_min(team, pos) FILTER (event IN ('purchase', 'error')) AS winner, arg_min(player, pos) FILTER (event IN ('purchase', 'error')) AS end_player,
               min(pos) FILTER (event = 'click') AS r_pos, arg_min(player, pos) FILTER (event = 'click') AS r_player, min(pos) FILTER (event = 'purchase') AS d_pos
        FROM pos WHERE attempt > 0 GROUP BY 1, 2, 3),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY attempt) AS rally_no FROM att),
rally AS (SELECT user_id, week, rally_no, serve_team, server, end_event, winner, end_player, CASE WHEN r_pos < t_pos THEN r_player END AS passer,
                 coalesce(d_pos <= t_pos, false) AS first_ball, t_pos - s_pos + 1 AS touches, CASE serve_team WHEN 'A' THEN 'B' ELSE 'A' END AS recv_team
          FROM numbered WHERE t_pos IS NOT NULL)"""
SCORED_SQL = RALLY_SQL + """,
scored AS (SELECT *, count(*) FILTER (winner = 'A') OVER w AS score_a, count(*) FILTER (winner = 'B') OVER w AS score_b FROM rally
           WINDOW w AS (PARTITION BY user_id, week ORDER BY rally_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def rallies(t: Tables):
    return s.rallies(t.feed(), FEED)


def scored(t: Tables):
    return s.running_score(rallies(t), SET, "winner", FEED.sides)


def graded(t: Tables):
    """Events to rallies to counts, rates, flags and grade by user and side: one scan, one sort by set, one grouping."""
    sides = rallies(t).select("user_id", "first_ball", "touches", F.explode(F.array(
        F.struct(F.col("recv_team").alias("side"), F.lit(1).alias("recv"), (F.col("winner") == F.col("recv_team")).cast("int").alias("won")),
        F.struct(F.col("serve_team").alias("side"), F.lit(0).alias("recv"), (F.col("winner") == F.col("serve_team")).cast("int").alias("won")),
    )).alias("x"))
    recv, won = F.col("x.recv") == 1, F.col("x.won") == 1
    counts = sides.groupBy("user_id", F.col("x.side").alias("side")).agg(
        F.count_if(recv).alias("receptions"), F.count_if(recv & won).alias("sideouts"), F.count_if(recv & won & F.col("first_ball")).alias("first_balls"),
        F.count_if(~recv).alias("serves"), F.count_if(~recv & won).alias("points"), F.avg("touches").alias("mean_touches"),
    )
    rates = counts.withColumns({"sideout_pct": rate("sideouts", "receptions"), "first_ball_pct": rate("first_balls", "receptions"), "point_pct": rate("points", "serves")})
    out = with_benchmarks(rates, SPECS)
    return out.select("user_id", "side", "receptions", "sideouts", "first_balls", "serves", "points", *[F.round(c, 6).alias(c) for c in ("sideout_pct", "first_ball_pct", "point_pct", "mean_touches")], *[b.flag for b in SPECS], "bench_of", "grade")


@query("WITH " + RALLY_SQL + """,
sides AS (SELECT user_id, recv_team AS side, true AS recv, winner = recv_team AS won, first_ball, touches FROM rally
          UNION ALL SELECT user_id, serve_team, false, winner = serve_team, first_ball, touches FROM rally),
counts AS (SELECT user_id, side, count(*) FILTER (recv) AS receptions, count(*) FILTER (recv AND won) AS sideouts, count(*) FILTER (recv AND won AND first_ball) AS first_balls,
                  count(*) FILTER (NOT recv) AS serves, count(*) FILTER (NOT recv AND won) AS points, avg(touches) AS mean_touches FROM sides GROUP BY 1, 2),
rates AS (SELECT *, sideouts::DOUBLE / nullif(receptions, 0) AS sideout_pct, first_balls::DOUBLE / nullif(receptions, 0) AS first_ball_pct, points::DOUBLE / nullif(serves, 0) AS point_pct FROM counts),
flags AS (SELECT *, (sideout_pct >= 0.5)::INT::DOUBLE AS b_sideout_pct, (first_ball_pct >= 0.25)::INT::DOUBLE AS b_first_ball_pct, (mean_touches <= 3)::INT::DOUBLE AS b_mean_touches FROM rates)
SELECT user_id, side, receptions, sideouts, first_balls, serves, points, round(sideout_pct, 6) AS sideout_pct, round(first_ball_pct, 6) AS first_ball_pct, round(point_pct, 6) AS point_pct,
       round(mean_touches, 6) AS mean_touches, b_sideout_pct, b_first_ball_pct, b_mean_touches,
       (b_sideout_pct IS NOT NULL)::BIGINT + (b_first_ball_pct IS NOT NULL)::BIGINT + (b_mean_touches IS NOT NULL)::BIGINT AS bench_of,
       CASE WHEN b_sideout_pct IS NOT NULL OR b_first_ball_pct IS NOT NULL OR b_mean_touches IS NOT NULL THEN coalesce(b_sideout_pct, 0) + coalesce(b_first_ball_pct, 0) + coalesce(b_mean_touches, 0) END AS grade
FROM flags""")  # fmt: skip
def e1_g2_rally_grades(t):
    return graded(t)


@query("WITH " + RALLY_SQL + " SELECT user_id, week, rally_no, serve_team, recv_team, winner, server, passer, end_event, end_player, first_ball, touches FROM rally")
def c1_rally_carving(t):
    return rallies(t).select("user_id", "week", F.col("rally_no").cast("long").alias("rally_no"), "serve_team", "recv_team", "winner", "server", "passer", "end_event", "end_player", "first_ball", F.col("touches").cast("long").alias("touches"))


@query("WITH " + RALLY_SQL + " SELECT user_id, count(*) AS n_serves, count(*) FILTER (t_pos IS NULL) AS n_abandoned FROM numbered GROUP BY 1")
def c2_abandoned_serves(t):
    return s.abandoned_counts(t.feed(), FEED, ["user_id"])


@query("WITH " + FEED_SQL + " SELECT week, count(*) AS n_rows, count(*) FILTER (event NOT IN ('view', 'click', 'purchase', 'error')) AS n_malformed FROM feed GROUP BY 1")
def b10_malformed_rows(t):
    return s.malformed_counts(t.feed(), FEED, ["week"])


@query("WITH " + SCORED_SQL + " SELECT user_id, week, rally_no, score_a, score_b, coalesce(lag(winner) OVER (PARTITION BY user_id, week ORDER BY rally_no), CASE end_event WHEN 'purchase' THEN winner ELSE CASE winner WHEN 'A' THEN 'B' ELSE 'A' END END) AS serving FROM scored")
def c3_c6_serve_order_and_score(t):
    anchor = s.opening_anchor(F.col("end_event"), F.col("winner"), "purchase", "error", FEED.sides)
    out = s.serve_order(scored(t), SET, "winner", anchor)
    return out.select("user_id", "week", F.col("rally_no").cast("long").alias("rally_no"), "score_a", "score_b", "serving")


@query("WITH " + RALLY_SQL + """,
sets AS (SELECT user_id, week, min(rally_no) AS r1, count(*) FILTER (serve_team = 'A') AS box_a, count(*) FILTER (serve_team = 'B') AS box_b,
                count(*) - 1 AS later, arg_min(winner, rally_no) AS w1 FROM rally GROUP BY 1, 2),
later AS (SELECT user_id, week, count(*) FILTER (prev = 'A') AS la, count(*) FILTER (prev = 'B') AS lb
          FROM (SELECT user_id, week, lag(winner) OVER (PARTITION BY user_id, week ORDER BY rally_no) AS prev FROM rally) GROUP BY 1, 2),
m AS (SELECT user_id, sum(la)::BIGINT AS base_a, sum(lb)::BIGINT AS base_b, count(*) AS free, sum(box_a)::BIGINT AS box_a, sum(box_b)::BIGINT AS box_b FROM sets JOIN later USING (user_id, week) GROUP BY 1),
tried AS (SELECT *, unnest(range(0, free + 1)) AS k FROM m),
err AS (SELECT *, CASE WHEN box_a > 0 THEN abs(base_a + k - box_a) ELSE 0 END + CASE WHEN box_b > 0 THEN abs(base_b + free - k - box_b) ELSE 0 END AS e FROM tried),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e, k DESC) AS r FROM err)
SELECT user_id, free, k AS opened_by_a, e AS error, CASE WHEN coalesce(box_a, 0) <= 0 AND coalesce(box_b, 0) <= 0 THEN 'assumed' WHEN free = 0 THEN 'anchored' WHEN e = 0 THEN 'exact' WHEN e <= 10 THEN 'closest' ELSE 'rejected' END AS status FROM best WHERE r = 1""")  # fmt: skip
def c5_choose_openers(t):
    r = rallies(t).withColumn("prev", F.lag("winner").over(s.rally_window(SET)))
    sets = r.groupBy(*SET).agg(F.count_if(F.col("prev") == "A").alias("la"), F.count_if(F.col("prev") == "B").alias("lb"), F.count_if(F.col("serve_team") == "A").alias("a"), F.count_if(F.col("serve_team") == "B").alias("b"))
    m = sets.groupBy("user_id").agg(F.sum("la").alias("base_a"), F.sum("lb").alias("base_b"), F.count(F.lit(1)).alias("free"), F.sum("a").alias("box_a"), F.sum("b").alias("box_b"))
    return s.choose_openers(m).select("user_id", "free", "opened_by_a", "error", "status")


FIRST_SQL = """, firsts AS (SELECT user_id, week, min(rally_no) FILTER (score_a + {a} >= 3) AS at_a, min(rally_no) FILTER (score_b + {b} >= 3) AS at_b FROM scored GROUP BY 1, 2)
SELECT user_id, week, at_a, at_b, CASE WHEN coalesce(at_a, 2147483647) < coalesce(at_b, 2147483647) THEN 'A' WHEN coalesce(at_b, 2147483647) < coalesce(at_a, 2147483647) THEN 'B' END AS first_to FROM firsts"""


def first_to(t, after):
    out = s.first_to(scored(t), SET, 3, after, "winner", FEED.sides)
    return out.select(*SET, F.col("at_a").cast("long").alias("at_a"), F.col("at_b").cast("long").alias("at_b"), "first_to")


@query("WITH " + SCORED_SQL + FIRST_SQL.format(a="0", b="0"))
def c9_first_to_before_points(t):
    return first_to(t, False)


@query("WITH " + SCORED_SQL + FIRST_SQL.format(a="(winner = 'A')::INT", b="(winner = 'B')::INT"))
def c10_first_to_after_points(t):
    return first_to(t, True)


CHECK_SQL = SCORED_SQL + """,
cp AS (SELECT user_id, week, c AS checkpoint, arg_min(score_a, rally_no) AS score_a, arg_min(score_b, rally_no) AS score_b
       FROM scored, (VALUES (1), (2), (3), (5), (8)) v(c) WHERE greatest(score_a, score_b) >= c GROUP BY 1, 2, 3),
state AS (SELECT *, CASE WHEN score_a > score_b THEN 'A' WHEN score_b > score_a THEN 'B' END AS leader, abs(score_a - score_b) AS margin FROM cp),
final AS (SELECT user_id, week, arg_max(score_a + (winner = 'A')::INT, rally_no) AS final_a, arg_max(score_b + (winner = 'B')::INT, rally_no) AS final_b, max(rally_no) AS n_rallies FROM scored GROUP BY 1, 2)"""
POINTS = (1, 2, 3, 5, 8)


@query("WITH " + CHECK_SQL + " SELECT user_id, week, checkpoint, score_a, score_b, leader, margin FROM state")
def c11_checkpoints(t):
    return s.checkpoints(scored(t), SET, POINTS)


@query("WITH " + CHECK_SQL + " SELECT user_id, week, final_a, final_b, n_rallies FROM final")
def c12_final_state(t):
    return s.final_state(scored(t), SET, "winner", FEED.sides).withColumn("n_rallies", F.col("n_rallies").cast("long"))


@query("WITH " + CHECK_SQL + """ SELECT checkpoint, margin, count(*) AS n, round(avg(CASE WHEN (final_a > final_b) = (leader = 'A') THEN 1.0 ELSE 0.0 END), 6) AS lead_won
FROM state JOIN final USING (user_id, week) WHERE leader IS NOT NULL AND final_a <> final_b GROUP BY 1, 2""")
def e21_checkpoint_leads(t):
    r = scored(t)
    both = s.checkpoints(r, SET, POINTS).join(s.final_state(r, SET, "winner", FEED.sides), list(SET)).where("leader is not null and final_a <> final_b")
    kept = ((F.col("final_a") > F.col("final_b")) == (F.col("leader") == "A")).cast("double")
    return both.groupBy("checkpoint", "margin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(kept), 6).alias("lead_won"))


@query("WITH " + CHECK_SQL + """, p AS (SELECT user_id, week, max(leader) FILTER (checkpoint = 1) AS l1, max(leader) FILTER (checkpoint = 3) AS l3, max(leader) FILTER (checkpoint = 5) AS l5 FROM state GROUP BY 1, 2)
SELECT count(*) FILTER (l1 IS NOT NULL AND l3 IS NOT NULL) AS n13, round(avg((l1 = l3)::INT), 6) AS same13, count(*) FILTER (l3 IS NOT NULL AND l5 IS NOT NULL) AS n35, round(avg((l3 = l5)::INT), 6) AS same35 FROM p""")
def e22_lead_persistence(t):
    p = s.checkpoints(scored(t), SET, POINTS).groupBy(*SET).pivot("checkpoint", [1, 3, 5]).agg(F.first("leader"))
    same = lambda a, b: F.round(F.avg((F.col(a) == F.col(b)).cast("double")), 6)
    n = lambda a, b: F.count(F.col(a) == F.col(b))
    return p.agg(n("1", "3").alias("n13"), same("1", "3").alias("same13"), n("3", "5").alias("n35"), same("3", "5").alias("same35"))


@query("WITH " + CHECK_SQL + """, j AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY week) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, final_a > final_b AS w FROM final)
SELECT user_id, week, (i % 2)::INT AS parity, (i >= n / 2.0)::INT AS half, sum(w::INT) OVER (PARTITION BY user_id ORDER BY week ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_won,
       round(avg(n_rallies) OVER (PARTITION BY user_id ORDER BY week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last3 FROM j""")
def c13_c16_sequence_positions(t):
    from pyspark.sql import Window

    f = s.alternating(s.final_state(scored(t), SET, "winner", FEED.sides), ["user_id"], ["week"])
    w = Window.partitionBy("user_id").orderBy("week")
    won = (F.col("final_a") > F.col("final_b")).cast("int")
    return f.select("user_id", "week", "parity", "half", F.sum(won).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_won"), F.round(F.avg("n_rallies").over(w.rowsBetween(-2, 0)), 6).alias("last3"))


KINDS = {"start": ("view",), "receive": ("click",), "dig": ("signup",), "set": ("click",), "attack": ("signup",), "terminal": ("purchase", "error"), "kill": ("purchase",), "error": ("error",), "block": ()}


@query("WITH " + FEED_SQL + """,
a AS (SELECT *, count(*) FILTER (event = 'view') OVER (PARTITION BY user_id, week ORDER BY ts, event_id) AS rally FROM feed),
b AS (SELECT *, coalesce(count(*) FILTER (event IN ('purchase', 'error')) OVER w, 0) AS ended, row_number() OVER (PARTITION BY user_id, week, rally ORDER BY ts, event_id) AS pos
      FROM a WHERE rally > 0 WINDOW w AS (PARTITION BY user_id, week, rally ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT * FROM b WHERE ended = 0),
x AS (SELECT r.user_id, r.week, r.rally, r.team, r.player, r.pos,
        (SELECT max(p.pos) FROM c p WHERE p.user_id = r.user_id AND p.week = r.week AND p.rally = r.rally AND p.pos < r.pos AND p.event IN ('signup', 'click')) AS last_touch,
        (SELECT max(p.pos) FROM c p WHERE p.user_id = r.user_id AND p.week = r.week AND p.rally = r.rally AND p.pos < r.pos AND p.event IN ('signup', 'view')) AS last_stop,
        (SELECT max(p.pos) FROM c p WHERE p.user_id = r.user_id AND p.week = r.week AND p.rally = r.rally AND p.pos < r.pos AND p.event = 'click') AS last_set,
        (SELECT min(p.pos) FROM c p WHERE p.user_id = r.user_id AND p.week = r.week AND p.rally = r.rally AND p.pos > r.pos AND p.event IN ('purchase', 'error')) AS end_pos,
        (SELECT count(*) FROM c p WHERE p.user_id = r.user_id AND p.week = r.week AND p.rally = r.rally AND p.pos > r.pos AND p.event = 'signup') AS more
      FROM c r WHERE r.event = 'signup')
SELECT x.user_id, x.week, x.rally, x.team, x.player, CASE WHEN tch.event = 'signup' THEN 'transition' ELSE 'first_ball' END AS phase,
       CASE WHEN st.team = x.team AND x.last_set > coalesce(x.last_stop, 0) THEN st.player END AS setter,
       CASE WHEN more > 0 THEN 'in_play' WHEN e.event = 'purchase' AND e.team = x.team THEN 'kill' WHEN e.event = 'error' THEN 'error' ELSE 'in_play' END AS outcome
FROM x LEFT JOIN c tch ON tch.user_id = x.user_id AND tch.week = x.week AND tch.rally = x.rally AND tch.pos = x.last_touch
       LEFT JOIN c st ON st.user_id = x.user_id AND st.week = x.week AND st.rally = x.rally AND st.pos = x.last_set
       LEFT JOIN c e ON e.user_id = x.user_id AND e.week = x.week AND e.rally = x.rally AND e.pos = x.end_pos""")  # fmt: skip
def c7_attack_phases(t):
    """Sign-ups stand for attacks and digs here, clicks for receptions and sets."""
    return s.attack_phases(t.feed(), SET, ["ts", "event_id"], KINDS, FEED.sides)
