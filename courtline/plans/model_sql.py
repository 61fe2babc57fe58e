"""DuckDB SQL of the fitted models, as recursive tables: replays fold lists of ratings match by match, fits go on round by round from the last one's lists."""

from __future__ import annotations

from .views import CONTEST_SQL, PLAYER_SQL, SIDES_SQL

#: Contests with their two margins.
MARGINS = "home_won, abs(home_q - away_q)::DOUBLE AS margin, abs(home_p / (home_p + away_p) - 0.5) * 100 AS share_margin"
ONE_POOL = f"ordered AS (SELECT 'all' AS pool, contest_id AS match, season, day, home, away, {MARGINS} FROM contest)"
#: The components of matches within a conference: each team's least team that it reaches.
COMPONENT_POOLS = f"""linked AS (SELECT home AS team, away AS other FROM contest WHERE home_conf = away_conf UNION SELECT away, home FROM contest WHERE home_conf = away_conf),
reach AS (SELECT DISTINCT team, team AS other FROM linked UNION SELECT reach.team, linked.other FROM reach JOIN linked ON linked.team = reach.other),
component AS (SELECT team, min(other) AS component FROM reach GROUP BY 1),
ordered AS (SELECT component AS pool, contest_id AS match, season, day, home, away, {MARGINS} FROM contest JOIN component ON team = home WHERE home_conf = away_conf)"""
ONE_CONFIG = "config AS (SELECT 'default' AS config, 60::DOUBLE AS k, 50::DOUBLE AS edge_home, 0.95::DOUBLE AS kept, 'sets' AS kind)"
GRID = """config AS (SELECT concat('k', k, 'h', h, 'c', c, kind) AS config, k::DOUBLE AS k, h::DOUBLE AS edge_home, c::DOUBLE AS kept, kind
  FROM unnest([10, 15, 20, 25, 30, 40]) a(k), unnest([0, 20, 35, 50, 65]) b(h), unnest(['0.0', '0.4', '0.6', '0.75', '0.9', '1.0']) d(c), unnest(['none', 'sets', 'rally']) e(kind))"""

#: A pool's matches by number, with the places of their teams in its list of ratings.
PLAYED = """team_no AS (SELECT pool, team, row_number() OVER (PARTITION BY pool ORDER BY team) AS place FROM (SELECT pool, home AS team FROM ordered UNION SELECT pool, away FROM ordered)),
played AS MATERIALIZED (
  SELECT o.*, row_number() OVER w AS n, coalesce(season <> lag(season) OVER w, false) AS turns, h.place AS hi, a.place AS ai
  FROM ordered o JOIN team_no h ON h.pool = o.pool AND h.team = home JOIN team_no a ON a.pool = o.pool AND a.team = away WINDOW w AS (PARTITION BY o.pool ORDER BY day, home, away, match)),
start AS (SELECT pool, config, 0::BIGINT AS n, list(1500::DOUBLE) AS r FROM team_no, config GROUP BY 1, 2)"""
#: The next match of each pool and configuration: its ratings before, the home side's chance, and what they change by.
NEXT = """(SELECT *, k * (CASE WHEN size > 0 THEN size * 2.2::DOUBLE / (0.001::DOUBLE * CASE WHEN home_won > 0 THEN edge ELSE -edge END + 2.2::DOUBLE) ELSE 1 END) * (home_won - p) AS change
  FROM (SELECT *, 1 / (1 + pow(10::DOUBLE, -edge / 400)) AS p
  FROM (SELECT *, r[hi] AS h, r[ai] AS a, r[hi] - r[ai] + edge_home AS edge
  FROM (SELECT m.*, c.*, replay.* EXCLUDE (pool, config, n, r), ln(1 + CASE kind WHEN 'sets' THEN margin WHEN 'rally' THEN share_margin ELSE 0 END) AS size,
               CASE WHEN turns THEN list_transform(r, lambda x: 1500 + kept * (x - 1500)) ELSE r END AS r
        FROM replay JOIN played m ON m.pool = replay.pool AND m.n = replay.n + 1 JOIN config c ON c.config = replay.config))))"""
CHANGED = "r[:least(hi, ai) - 1] || [CASE WHEN hi < ai THEN h + change ELSE a - change END] || r[least(hi, ai) + 1:greatest(hi, ai) - 1] || [CASE WHEN hi < ai THEN a - change ELSE h + change END] || r[greatest(hi, ai) + 1:] AS r"
REPLAY = f"""{PLAYED},
replay AS (
  SELECT *, NULL::DOUBLE AS h, NULL::DOUBLE AS a, NULL::DOUBLE AS p, NULL::DOUBLE AS change FROM start
  UNION ALL SELECT pool, config, n, {CHANGED}, h, a, p, change FROM {NEXT.replace("(pool, config, n, r)", "(pool, config, n, r, h, a, p, change)")}),
elo AS (SELECT m.pool, match, season, day, home, away, h AS elo_home, a AS elo_away, p AS p_home, h + change AS elo_home_after, a - change AS elo_away_after FROM replay JOIN played m ON m.pool = replay.pool AND m.n = replay.n)"""

ELO_SQL = f"WITH RECURSIVE {CONTEST_SQL},\n{ONE_POOL},\n{ONE_CONFIG},\n{REPLAY}"
ELO_LOG_SQL = ELO_SQL + "\nSELECT match, round(elo_home, 6) AS elo_home, round(elo_away, 6) AS elo_away, round(p_home, 6) AS p_home FROM elo"
ELO_COMPONENTS_SQL = f"WITH RECURSIVE {CONTEST_SQL},\n{COMPONENT_POOLS},\n{ONE_CONFIG},\n{REPLAY}\nSELECT pool AS component, match, round(elo_home, 6) AS elo_home, round(elo_away, 6) AS elo_away, round(p_home, 6) AS p_home FROM elo"
ELO_ENDS_SQL = ELO_SQL + """,
two AS (SELECT season, home AS team, elo_home_after AS elo, (day, home, away, match) AS o FROM elo UNION ALL SELECT season, away, elo_away_after, (day, home, away, match) FROM elo),
ends AS (SELECT season, team, arg_max(elo, o) AS elo, count(*) AS n_matches FROM two GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT season, team, round(elo, 6) AS elo, n_matches, rank() OVER (PARTITION BY season ORDER BY elo DESC) AS rank_elo FROM ends"""
#: Only the last list and the sums of each configuration are kept. Two minutes on the 0.01 tables, so it serves tests on the smallest ones.
ELO_SWEEP_SQL = f"""WITH RECURSIVE {CONTEST_SQL},
{ONE_POOL},
{GRID},
{PLAYED},
replay(pool, config, n, r, scored, hits, loss, square) USING KEY (pool, config) AS (
  SELECT *, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM start
  UNION SELECT pool, config, n, {CHANGED}, scored + y, hits + y * ((q > 0.5) = (home_won = 1))::INT, loss - y * CASE WHEN home_won = 1 THEN ln(q) ELSE ln(1 - q) END, square + y * (q - home_won) ** 2
  FROM (SELECT *, least(1 - 1e-6, greatest(1e-6, p)) AS q, (season > (SELECT min(season) FROM contest))::INT AS y FROM {NEXT}))
SELECT config, scored AS n, round(hits / scored, 6) AS accuracy, round(loss / scored, 6) AS log_loss, round(square / scored, 6) AS brier FROM replay"""

#: Rounds of the additive fit: each at least halves its error.
ROUNDS = 45


def additive_sql(rounds: int = ROUNDS) -> str:
    """The additive fit of all groups of pair (g, team, opponent, n, s), off and def in turn, centred, until a group no longer moves: rated (g, team, n_matches, rating_off, rating_def, league)."""
    packed = lambda v, at: f"list_transform(list({v} ORDER BY {at}), lambda x: x - avg({v}))"
    return f"""place AS (SELECT g, team, row_number() OVER (PARTITION BY g ORDER BY team) AS i FROM (SELECT g, team FROM pair UNION SELECT g, opponent FROM pair)),
numbered AS MATERIALIZED (SELECT p.g, a.i AS i, b.i AS j, p.n::DOUBLE AS n, p.s::DOUBLE AS s FROM pair p JOIN place a ON a.g = p.g AND a.team = p.team JOIN place b ON b.g = p.g AND b.team = p.opponent),
sums AS MATERIALIZED (SELECT g, sum(n) AS n, sum(s) AS s FROM numbered GROUP BY 1),
solved AS (
  SELECT 0 AS k, g, sums.s / sums.n AS mu, list(0::DOUBLE) AS o, list(0::DOUBLE) AS d, NULL::DOUBLE AS size, true AS moves FROM sums JOIN place USING (g) GROUP BY g, sums.s, sums.n
  UNION ALL
  SELECT k + 1, g, (any_value(s) + sum(nd * d) - avg(d) * sum(nd) - any_value(no)) / any_value(n), any_value(os), {packed("d", "j")}, sum(d * d), coalesce(abs(sum(d * d) - any_value(size)) > 1e-15 * sum(d * d), true)
  FROM (SELECT k, f.g, any_value(size) AS size, j, any_value(t.s) AS s, any_value(t.n) AS n, any_value(no) AS no, any_value(os) AS os, sum(p.n) AS nd, (sum(p.n * (mu + o)) - sum(p.s)) / (sum(p.n) + 1) AS d
        FROM (SELECT *, unnest(os) AS o, generate_subscripts(os, 1) AS i
              FROM (SELECT k, g, any_value(mu) AS mu, any_value(size) AS size, {packed("o", "i")} AS os, sum(no * o) - avg(o) * sum(no) AS no
                    FROM (SELECT k, f.g, i, any_value(mu) AS mu, any_value(size) AS size, sum(p.n) AS no, sum(p.s - p.n * (mu - d)) / (sum(p.n) + 1) AS o
                          FROM (SELECT k, g, mu, size, unnest(d) AS d, generate_subscripts(d, 1) AS j FROM solved WHERE moves AND k < {rounds}) f JOIN numbered p USING (g, j) GROUP BY k, f.g, i) GROUP BY k, g)) f
        JOIN numbered p USING (g, i) JOIN sums t ON t.g = f.g GROUP BY k, f.g, j) GROUP BY k, g),
rated AS (SELECT g, team, coalesce(m.n, 0)::BIGINT AS n_matches, 100 * o[i] AS rating_off, 100 * d[i] AS rating_def, 100 * mu AS league
  FROM solved SEMI JOIN (SELECT g, max(k) AS k FROM solved GROUP BY 1) USING (g, k) JOIN place USING (g) LEFT JOIN (SELECT g, i, sum(n) AS n FROM numbered GROUP BY 1, 2) m USING (g, i))"""


RIDGE_SQL = f"""{SIDES_SQL},
pair AS (SELECT season AS g, team, opponent, count(*) AS n, sum(q) AS s FROM sides GROUP BY 1, 2, 3),
{additive_sql()}"""
RIDGE_BOARD_SQL = f"""WITH RECURSIVE {RIDGE_SQL},
board AS (SELECT g AS season, team, n_matches, round(rating_off, 4) AS rating_off, round(rating_def, 4) AS rating_def, round(rating_off + rating_def, 4) AS rating_overall, round(league, 4) AS league FROM rated WHERE n_matches >= 5)
SELECT *, rank() OVER (PARTITION BY season ORDER BY rating_overall DESC) AS rank_overall, rank() OVER (PARTITION BY season ORDER BY rating_off DESC) AS rank_off, rank() OVER (PARTITION BY season ORDER BY rating_def DESC) AS rank_def FROM board"""

#: Ratings of each week of a season, on its rows before the week.
WEEKLY_SQL = f"""{SIDES_SQL},
week AS (SELECT DISTINCT season, date_trunc('week', day)::DATE AS week_start FROM sides),
by_week AS (SELECT season, date_trunc('week', day)::DATE AS own_week, team, opponent, count(*) AS n, sum(q) AS s FROM sides GROUP BY 1, 2, 3, 4),
before AS (SELECT (w.season, week_start) AS g, team, opponent, sum(n) AS n, sum(s) AS s FROM week w JOIN by_week b ON b.season = w.season AND own_week < week_start GROUP BY 1, 2, 3),
pair AS MATERIALIZED (SELECT * FROM before SEMI JOIN (SELECT g FROM before GROUP BY 1 HAVING sum(n) >= 50) USING (g)),
{additive_sql()},
weekly AS (SELECT g[1] AS season, g[2] AS week_start, team, rating_off + rating_def AS rating_overall FROM rated)"""
WALK_FORWARD_SQL = f"WITH RECURSIVE {WEEKLY_SQL}\nSELECT season, week_start, team, round(rating_overall, 4) AS rating_overall FROM weekly"
PREMATCH_SQL = f"""WITH RECURSIVE {WEEKLY_SQL},
{ONE_POOL},
{ONE_CONFIG},
{REPLAY},
prematch AS MATERIALIZED (
  SELECT elo.match, elo.season, elo_home, elo_away, coalesce(h.rating_overall, 0) AS ridge_home, coalesce(a.rating_overall, 0) AS ridge_away, o.home_won
  FROM elo JOIN ordered o ON o.match = elo.match
  LEFT JOIN weekly h ON h.season = elo.season AND h.week_start = date_trunc('week', elo.day) AND h.team = elo.home
  LEFT JOIN weekly a ON a.season = elo.season AND a.week_start = date_trunc('week', elo.day) AND a.team = elo.away)"""
PREMATCH_FEATURES_SQL = PREMATCH_SQL + "\nSELECT match, season, round(elo_home, 4) AS elo_home, round(elo_away, 4) AS elo_away, round(ridge_home, 4) AS ridge_home, round(ridge_away, 4) AS ridge_away FROM prematch"


def effects_sql(least: int, rounds: int = 40) -> str:
    """Adjusted values after rounds of weighted means of players and opponents in turn, of groups of least rows or more."""
    return f"""WITH RECURSIVE {PLAYER_SQL},
known AS (SELECT (season, position) AS g, player, opponent, w::DOUBLE AS w, y::DOUBLE AS y FROM player_match WHERE w > 0 AND y IS NOT NULL),
whole AS (SELECT g, sum(w * y) / sum(w) AS mu FROM known GROUP BY 1 HAVING count(*) >= {least}),
i AS (SELECT g, player, row_number() OVER (PARTITION BY g ORDER BY player) AS i FROM (SELECT DISTINCT g, player FROM known)),
j AS (SELECT g, opponent, row_number() OVER (PARTITION BY g ORDER BY opponent) AS j FROM (SELECT DISTINCT g, opponent FROM known)),
pair AS MATERIALIZED (SELECT known.g, i, j, any_value(mu) AS mu, sum(w) AS w, sum(w * y) - sum(w) * any_value(mu) AS r
  FROM known JOIN whole ON whole.g = known.g JOIN i ON i.g = known.g AND i.player = known.player JOIN j ON j.g = known.g AND j.opponent = known.opponent GROUP BY 1, 2, 3),
ridge AS MATERIALIZED (SELECT g, 0.5 * avg(w) AS ridge FROM (SELECT g, j, sum(w) AS w FROM pair GROUP BY 1, 2) GROUP BY 1),
fit AS (
  SELECT 0 AS k, g, NULL::DOUBLE[] AS p, list(0::DOUBLE) AS o FROM (SELECT DISTINCT g, j FROM pair) GROUP BY g
  UNION ALL
  SELECT k + 1, g, any_value(ps), list(o ORDER BY j)
  FROM (SELECT k, f.g, j, any_value(ps) AS ps, sum(w * p - r) / (sum(w) + any_value(ridge)) AS o
        FROM (SELECT *, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
              FROM (SELECT k, g, list(p ORDER BY i) AS ps
                    FROM (SELECT k, f.g, i, sum(r + w * o) / sum(w) AS p
                          FROM (SELECT k, g, unnest(o) AS o, generate_subscripts(o, 1) AS j FROM fit WHERE k < {rounds}) f JOIN pair USING (g, j) GROUP BY k, f.g, i) GROUP BY k, g)) f
        JOIN pair USING (g, i) JOIN ridge ON ridge.g = f.g GROUP BY k, f.g, j) GROUP BY k, g)
SELECT g[1] AS season, g[2] AS position, player, round(mu + p[i], 4) AS value_adj FROM fit JOIN whole USING (g) JOIN i USING (g) WHERE k = {rounds}"""
