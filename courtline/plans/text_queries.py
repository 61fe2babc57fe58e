"""Queries over text columns made from the given tables: names, opponents, results, scores and play text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import contests as c
from .registry import query
from .views import SIDES_SQL

#: Texts of plays as feeds tell them; {a} and {b} are names.
PHRASES = [
    "Kill by {a} (from {b}).", "Kill by {a}, block error by {b}.", "Attack error by {a}.", "Attack error by {a} (block by {b}).", "Block error by {a}.", "Blocking error by {a}.", "Service ace ({a}).", "Service ace by {a}.",
    "Service error by {a}.", "Bad set by {a}.", "Set error by {a}.", "Ball handling error by {a}.", "Dig error by {a}.", "Block by {a}, {b}.", "Blocked ball.", "Reception error by {a}.", "Timeout {a}.", "{a} serves.",
    "kill BY {a}.", "KILL by {a}, assist by {b}", "Roadkill by {a}", "Point awarded.", "Rotation fault by the home side.", "Served by team, kill by {a}", "Sub in: {a}; sub out: {b}", "Attack error by {a}, kill by {b}", "set error, ball handling error by {b}.", "block by the net, by {a}", "Kill by {a}", "Dig error by {a} Jr. (own)",
]
NAMES = ["Jane Doe", "Ana-Maria O'Neil", "B. Smith", "van Dyk", "Émilie Roy", "Li Na (Captain)"]


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


PLAYS_SQL = f"""WITH nm AS (SELECT event_id, {listed(PHRASES)}[(event_id % {len(PHRASES)} + 1)::INT] AS phrase, {listed(NAMES)}[(event_id // 7 % {len(NAMES)} + 1)::INT] AS a, {listed(NAMES)}[(user_id % {len(NAMES)} + 1)::INT] AS b FROM events),
told AS (SELECT event_id, replace(replace(phrase, '{{a}}', a), '{{b}}', b) AS told FROM nm)"""


def plays(t):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    text = F.replace(F.replace(pick(PHRASES, F.col("event_id")), F.lit("{a}"), pick(NAMES, F.floor(F.col("event_id") / 7))), F.lit("{b}"), pick(NAMES, F.col("user_id")))
    return t.events.select("event_id", text.alias("told"))


KINDS_SQL = " ".join(f"WHEN regexp_matches(told, '\\b({p})\\b', 'i') THEN '{k}'" for k, p in x.PLAYS)


@query(PLAYS_SQL + f" SELECT event_id, CASE {KINDS_SQL} ELSE 'Other' END AS kind, nullif(trim(regexp_extract(told, '\\bby ([A-Z][^.(,]*)', 1)), '') AS actor FROM told")
def b6_b7_play_kinds(t):
    return plays(t).select("event_id", x.play_kind(F.col("told")).alias("kind"), x.actor(F.col("told")).alias("actor"))


@query(PLAYS_SQL + " SELECT event_id, nullif(trim(regexp_extract(told, '(?i)kill by ([^.(]+)', 1)), '') AS hitter, nullif(trim(regexp_extract(told, '\\(from ([^)]+)\\)', 1)), '') AS setter FROM told")
def b8_kill_parts(t):
    hitter, setter = x.kill_parts(F.col("told"))
    return plays(t).select("event_id", hitter.alias("hitter"), setter.alias("setter"))


ASKED_SQL = """WITH asked AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 6 WHEN 0 THEN '@ ' || c_name WHEN 1 THEN c_name || ' @ Omaha, Neb.' WHEN 2 THEN '@#' || (o_orderkey % 25) || ' ' || c_name WHEN 3 THEN '#' || (o_orderkey % 25) || ' ' || c_name || ' Semifinal'
WHEN 4 THEN '  ' || c_name || '  ' ELSE 'Unknown Side' END AS opponent FROM orders JOIN customer ON c_custkey = o_custkey)"""


def asked(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    k, name, rank = F.col("o_orderkey") % 6, F.col("c_name"), (F.col("o_orderkey") % 25).cast("string")
    text = F.when(k == 0, F.concat(F.lit("@ "), name)).when(k == 1, F.concat(name, F.lit(" @ Omaha, Neb."))).when(k == 2, F.concat(F.lit("@#"), rank, F.lit(" "), name))
    text = text.when(k == 3, F.concat(F.lit("#"), rank, F.lit(" "), name, F.lit(" Semifinal"))).when(k == 4, F.concat(F.lit("  "), name, F.lit("  "))).otherwise("Unknown Side")
    return rows.select("o_orderkey", "o_custkey", text.alias("opponent"))


@query(ASKED_SQL + " SELECT o_orderkey, trim(regexp_replace(regexp_replace(trim(opponent), '^@\\s*', ''), '\\s+@.*$', '')) AS opponent FROM asked")
def b1_clean_opponents(t):
    return asked(t).select("o_orderkey", x.clean_opponent(F.col("opponent")).alias("opponent"))


@query(ASKED_SQL + """, bare AS (SELECT *, trim(regexp_replace(trim(opponent), '^@?\\s*(#\\d+\\s+)?', '')) AS b FROM asked)
SELECT o_orderkey, m.c_name AS matched, starts_with(trim(opponent), '@') AS away, try_cast(nullif(regexp_extract(trim(opponent), '^@?\\s*#(\\d+)\\s', 1), '') AS INT) AS label,
CASE WHEN m.c_name IS NOT NULL THEN nullif(trim(substr(b, length(m.c_name) + 1)), '') END AS rest FROM bare LEFT JOIN customer m ON b = m.c_name OR starts_with(b, m.c_name || ' ')""")  # fmt: skip
def b2_match_opponents(t):
    return c.match_names(asked(t), "opponent", t.customer, "c_name").select("o_orderkey", "matched", "away", "label", "rest")


PEOPLE_SQL = """WITH people AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ',  ' || c_name WHEN 1 THEN '  ' || c_mktsegment || '   ' || c_name ELSE c_name || ', Jr., ' || c_mktsegment END AS n FROM customer),
sw AS (SELECT *, CASE WHEN contains(n, ',') THEN trim(substr(n, instr(n, ',') + 1)) || ' ' || trim(substr(n, 1, instr(n, ',') - 1)) ELSE n END AS s FROM people)"""


@query(PEOPLE_SQL + """ SELECT c_custkey, lower(trim(regexp_replace(n, '\\s+', ' ', 'g'))) AS key, lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS key_swapped,
upper(trim(regexp_replace(regexp_replace(s, '[^A-Za-z ]', ' ', 'g'), '\\s+', ' ', 'g'))) AS letters FROM sw""")
def b3_b4_b5_name_keys(t):
    k, a, b = F.col("c_custkey") % 3, F.col("c_mktsegment"), F.col("c_name")
    n = F.when(k == 0, F.concat(a, F.lit(",  "), b)).when(k == 1, F.concat(F.lit("  "), a, F.lit("   "), b)).otherwise(F.concat(b, F.lit(", Jr., "), a))
    return t.customer.select("c_custkey", n.alias("n")).select("c_custkey", x.name_key(F.col("n")).alias("key"), x.name_key_swapped(F.col("n")).alias("key_swapped"), x.letters_key(F.col("n")).alias("letters"))


SCORES_SQL = """WITH sc AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS a, (l_partkey % 30)::INT AS b, CASE l_linenumber WHEN 1 THEN l_quantity::INT || '-' || l_partkey % 30 WHEN 2 THEN ' ' || l_quantity::INT || ' - ' || l_partkey % 30 || ' ' WHEN 3 THEN l_quantity::INT || '' WHEN 4 THEN 'a-b' ELSE '-' || l_quantity::INT || '-3' END AS score,
CASE WHEN l_quantity > 25 THEN 'W ' ELSE 'L ' END || l_linenumber % 4 || '-' || l_suppkey % 4 AS result FROM lineitem)"""


@query(SCORES_SQL + """ SELECT l_orderkey, l_linenumber, try_cast(nullif(regexp_extract(score, '^\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$', 1), '') AS INT) AS score_a, try_cast(nullif(regexp_extract(score, '^\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$', 2), '') AS INT) AS score_b,
try_cast(regexp_extract(result, '(\\d+)\\s*-\\s*(\\d+)', 1) AS INT) AS sets_for, try_cast(regexp_extract(result, '(\\d+)\\s*-\\s*(\\d+)', 2) AS INT) AS sets_against, coalesce(try_cast(score AS DOUBLE), 0) AS number,
greatest(a, b) >= 25 AND abs(a - b) >= 2 AND (greatest(a, b) = 25 OR abs(a - b) = 2) AS legal FROM sc""")
def b9_b15_b16_k7_scores(t):
    q, p, n = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 30).cast("int"), F.col("l_linenumber")
    qs, ps = q.cast("string"), p.cast("string")
    score = F.when(n == 1, F.concat(qs, F.lit("-"), ps)).when(n == 2, F.concat(F.lit(" "), qs, F.lit(" - "), ps, F.lit(" "))).when(n == 3, qs).when(n == 4, "a-b").otherwise(F.concat(F.lit("-"), qs, F.lit("-3")))
    result = F.concat(F.when(F.col("l_quantity") > 25, "W ").otherwise("L "), (n % 4).cast("string"), F.lit("-"), (F.col("l_suppkey") % 4).cast("string"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", q.alias("a"), p.alias("b"), score.alias("score"), result.alias("result"))
    return rows.select(
        "l_orderkey", "l_linenumber", x.score_part(F.col("score"), 0).alias("score_a"), x.score_part(F.col("score"), 1).alias("score_b"), x.result_sets(F.col("result"), 0).alias("sets_for"), x.result_sets(F.col("result"), 1).alias("sets_against"),
        x.number(F.col("score")).alias("number"), x.legal_final(F.col("a"), F.col("b")).alias("legal"),
    )


@query("WITH " + SIDES_SQL + """ SELECT contest_id, team, venue AS location, opponent, CASE WHEN won = 1 THEN 'W ' ELSE 'L ' END || own || '-' || other AS result, (own - other)::INT AS margin
FROM (SELECT *, CASE WHEN won = 1 THEN 3 ELSE (contest_id % 3)::INT END AS own, CASE WHEN won = 1 THEN (contest_id % 3)::INT ELSE 3 END AS other FROM sides)""")
def b15_orientation(t):
    """Each side of a match from the match's row: where it played, whom, its result's text and its margin in sets."""
    sets = F.when(F.col("home_won") == 1, F.array(F.lit(3), (F.col("contest_id") % 3).cast("int"))).otherwise(F.array((F.col("contest_id") % 3).cast("int"), F.lit(3)))
    rows = t.contest().select("contest_id", "home", "away", "home_won", sets.alias("s"), F.explode(F.array("home", "away")).alias("team"))
    home = F.col("team") == F.col("home")
    own, other = F.when(home, F.col("s")[0]).otherwise(F.col("s")[1]), F.when(home, F.col("s")[1]).otherwise(F.col("s")[0])
    sides = F.col("team"), F.col("home"), F.col("away")
    return rows.select("contest_id", "team", x.location(*sides).alias("location"), x.opponent_of(*sides).alias("opponent"), x.result_text((F.col("home_won") == 1) == home, own, other).alias("result"), x.signed_margin(own, other).alias("margin"))


GROUPS = {"BUILDING": "front", "MACHINERY": "front", "FURNITURE": "back"}


@query("""SELECT c_custkey, CASE upper(trim(' ' || lower(c_mktsegment) || ' ')) WHEN 'BUILDING' THEN 'front' WHEN 'MACHINERY' THEN 'front' WHEN 'FURNITURE' THEN 'back' END AS position_group,
CASE WHEN regexp_matches(c_name, '(?i)\\bfinal') THEN 'final' WHEN regexp_matches(c_name, '(?i)1|regional') THEN 'regional' WHEN regexp_matches(c_name, '(?i)^customer#0000000[2-4]') THEN 'first round' ELSE 'none' END AS tag FROM customer""")
def b17_b18_groups_and_tags(t):
    tags = [("final", r"(?i)\bfinal"), ("regional", r"(?i)1|regional"), ("first round", r"(?i)^customer#0000000[2-4]")]
    label = F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "))
    return t.customer.select("c_custkey", x.position_group(label, GROUPS).alias("position_group"), x.first_match(F.col("c_name"), tags, "none").alias("tag"))
