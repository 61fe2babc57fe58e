"""What a job writes, reads again and holds at once as its tables grow."""

import gzip
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from courtline.operators import elo, sequence
from courtline.plans import QUERIES, landing_queries, views
from courtline.plans.model_queries import elo_input
from courtline.plans.views import Tables
from courtline.sources import feeds
from courtline.specs import EloConfig

DATA = "/root/testdata/sf0.001"


def test_landed_documents_are_written_compressed(spark, tmp_path):
    """And a compressed document that does not tell its contest has its file's name."""
    docs = spark.range(3000).select("id", F.lit("board " * 20).alias("text"))
    files = [p for p in Path(landing_queries.written_json(Tables(spark, DATA), docs, "id", "docs").removeprefix("file:")).rglob("part-*")]
    held = [json.loads(gzip.decompress(p.read_bytes())) for p in files]
    assert sorted(d["id"] for f in held for d in f) == list(range(3000))
    assert sum(p.stat().st_size for p in files) < 3000 * 20
    doc = {"_date": "2024-09-01", "_home_team": "H", "_away_team": "A", "teams": [{"teamId": "1", "isHome": True}, {"teamId": "2", "isHome": False}], "teamBoxscore": [{"teamId": "1", "playerStats": [{"firstName": "P", "lastName": "Q", "participated": True}]}]}
    (tmp_path / "77.json.gz").write_bytes(gzip.compress(json.dumps(doc).encode()))
    (tmp_path / "78.json").write_text(json.dumps(doc))
    assert sorted(r["contest_id"] for r in feeds.land_player_stats(spark, str(tmp_path)).collect()) == ["77", "78"]


def test_a_tournament_reads_lines_once(spark, monkeypatch):
    """Contests and RPI are made once for a forecast and the bracket beside it."""
    read, plain = [], views.Tables.__getattr__
    monkeypatch.setattr(views.Tables, "__getattr__", lambda self, name: (read.append(name), plain(self, name))[1])
    assert QUERIES["h26_title_odds"](spark, DATA).count() > 0
    assert read.count("lineitem") == 1


def test_lines_that_share_a_number(spark):
    """The order of lines with one number goes by what they hold."""
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate date"
    lines = [(1, 1, 9, 5, 2.0, 1.0, 0.1, None), (1, 1, 9, 4, 3.0, 1.0, 0.0, None), (1, 1, 9, 4, 3.0, 1.0, 0.2, None), (2, 1, 1, 4, 3.0, 1.0, 0.2, None), (2, 1, 1, 5, 3.0, 2.0, 0.2, None)]

    class Small(views.Tables):
        lineitem = spark.createDataFrame(lines, line)
        orders = spark.createDataFrame([(k, None) for k in (1, 2)], "o_orderkey long, o_orderdate date")

        def conference(self):
            return spark.createDataFrame([(4, "x"), (5, "y")], "team long, conf string")

    assert [(r["contest_id"], r["home"], r["away"], r["home_won"]) for r in Small(spark, "").contest().collect()] == [(2, 4, 5, 0.0)]


def test_lines_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    """A table beyond one round of tasks is joined and grouped in as many tasks as its lines ask for."""
    monkeypatch.setattr(views, "TASK_LINES", 300)
    n = Tables(spark, DATA).lineitem.count()
    box = QUERIES["a19_team_box_from_players"](spark, DATA)
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey#" in plan and f", {n // 300})" in plan
    assert box.agg(F.sum("players")).first()[0] == n


def test_recency_like_a_count(spark):
    """Days with many matches, no day, and entities with a null name, against a plain count; no window holds a team's matches."""
    rng = random.Random(5)
    games = [(t, m, rng.choice([None, 1, 2, 3])) for m in range(60) for t in ("a", "b")]
    rows = [(t, rng.choice(["p", "q", "r", None]), m, d, rng.choice([1.0, 2.0, None])) for t, m, d in games for _ in range(rng.randrange(1, 3))] + [("a", "old", 0, games[0][2], 1.0)]
    df = spark.createDataFrame(rows, "team string, player string, m int, day int, w double")
    got = sequence.recency(df, ["player"], ["team"], "m", "day", "w", k=4)
    assert "row_number() windowspecdefinition(team#" not in got._jdf.queryExecution().toString()
    want = set()
    for team in ("a", "b"):
        order = sorted({(d if d is not None else -1, m) for t, _, m, d, _ in rows if t == team}, reverse=True)
        back = {m: i + 1 for i, (_, m) in enumerate(order)}
        total = sum(w or 0 for t, _, m, _, w in rows if t == team and back[m] <= 4)
        for player in {p for t, p, *_ in rows if t == team}:
            own = [(m, w) for t, p, m, _, w in rows if t == team and p == player]
            missed = min(back[m] for m, _ in own) - 1
            want.add((team, player, len({m for m, _ in own if back[m] <= 4}), missed, round(sum(w or 0 for m, w in own if back[m] <= 4) / total, 9), missed < 4))
    assert {(r["team"], r["player"], r["recent"], r["missed"], round(r["share"], 9), r["active"]) for r in got.collect()} == want


@pytest.mark.parametrize("team", ["string", "int"])
def test_elo_in_rounds(spark, monkeypatch, team):
    """A replay cut into rounds is that of one task, value by value: pools of other lengths, one of them over before the last round, a null one, seasons that end inside a round; no task gets more than a round and the ratings before it."""
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        pool = rng.choices(["a", "b", None], [8, 3, 1])[0]
        h, a = rng.sample(range(12 if pool == "b" else 40), 2)
        day = i // 5 if pool != "b" else i // 15
        rows.append((pool, i, day // 70, day, h, a, float(rng.random() < 0.6), rng.choice([None, 0.0, 2.0]), rng.random() * 20))
    df = spark.createDataFrame(rows, "pool string, match int, season int, day int, home int, away int, home_won double, margin double, share double").repartition(3)
    df = df.withColumns({"home": F.col("home").cast(team), "away": F.col("away").cast("string" if team == "string" else "long")})
    configs = {"x": EloConfig(), "y": EloConfig(k=20, carryover=0.4, margin_column="share")}
    log = lambda: {(r["config"], r["match"]): tuple(r) for r in elo.elo_log(df, ["pool"], configs).collect()}
    sweep = lambda: {r["config"]: tuple(r)[1:] for r in elo.elo_sweep(df, ["pool"], configs, F.col("season") > 0).collect()}
    whole, scores, got = log(), sweep(), []
    cut = elo.in_turn
    monkeypatch.setattr(elo, "in_turn", lambda rows, n, keys, f, *more: cut(rows, n, keys, lambda some, passes: (got.append((n, some.where("day is not null").count(), some.where("day is null").count())), f(some, passes))[1], *more))
    monkeypatch.setattr(elo, "ROUND", 200)
    monkeypatch.setattr(elo, "GRID_ROUND", 400)
    assert log() == whole and len(whole) == 2 * len(rows)
    assert len(got) == 8 and sum(n for _, n, _ in got) == len(rows) and max(n for _, n, _ in got) < 400 and got[0][2] == 0 and 0 < got[-1][2] <= 40 + 40 + 12
    assert sweep() == {c: pytest.approx(v, abs=1e-12) for c, v in scores.items()} and sum(n for _, n, _ in got) == 2 * len(rows)


def test_season_ends_in_rounds(spark, monkeypatch):
    """The season's last ratings of a replay in rounds are those of one task; lines are read once, and dealt to tasks by their number."""
    ends = lambda: sorted(map(tuple, QUERIES["h4_elo_season_ends"](spark, DATA).collect()))
    x = elo_input(Tables(spark, DATA))
    joined = elo.elo_season_ends(x, elo.elo_log(x, ["pool"]), ["pool"]).select("season", "team", F.round("elo", 6), "n_matches", "rank_elo")
    whole, read, plain = sorted(map(tuple, joined.collect())), [], views.Tables.__getattr__
    assert ends() == whole
    monkeypatch.setattr(elo, "ROUND", 300)
    monkeypatch.setattr(elo, "TASK_MATCHES", 50)
    monkeypatch.setattr(views, "TASK_LINES", 300)
    n = Tables(spark, DATA).lineitem.count() // 300
    plan = Tables(spark, DATA).contest()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey#" in plan and f", {n})" in plan
    monkeypatch.setattr(views.Tables, "__getattr__", lambda self, name: (read.append(name), plain(self, name))[1])
    assert ends() == whole and len(whole) > 0
    assert read.count("lineitem") == 1
