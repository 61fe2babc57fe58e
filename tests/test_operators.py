"""Operators on small tables with known results."""

import datetime as dt
import itertools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from courtline.functions import rates, text
from courtline.operators import bracket, contests, elo, metrics, players, predict, ratings, sequence
from courtline.specs import Benchmark, EloConfig, EventSpec

SPEC = EventSpec(("set",), ("seq",), "event", "team", "player", ("A", "B"), "Serve", "Reception", ("Kill", "First ball kill", "Attack error"), "First ball kill", ("Serve", "Reception", "Kill", "First ball kill", "Attack error"))


def carving_log(spark):
    rows = [
        (1, "Serve", "A", "a1"), (2, "Reception", "B", "b1"), (3, "First ball kill", "B", "b2"), (4, "Serve", "B", "b1"), (5, "Timeout text", "B", None), (6, "Attack error", "B", "a2"), (7, "Kill", "A", "a9"),
        (8, "Serve", "X", "x"), (9, "Serve", "A", "a1"), (10, "Serve", "B", "b1"), (11, "Reception", "A", "a3"), (12, "Kill", "Z", "z"), (13, "Kill", "A", "a2"),
    ]
    return spark.createDataFrame([(1, *r) for r in rows], "set int, seq int, event string, team string, player string")


def test_carving(spark):
    log = carving_log(spark)
    got = {r["rally_no"]: r for r in sequence.rallies(log, SPEC).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["serve_team"], got[1]["recv_team"], got[1]["winner"], got[1]["passer"], got[1]["first_ball"], got[1]["touches"]) == ("A", "B", "B", "b1", True, 3)
    assert (got[2]["serve_team"], got[2]["winner"], got[2]["passer"], got[2]["first_ball"], got[2]["touches"]) == ("B", "B", None, False, 2)
    assert sequence.malformed_counts(log, SPEC, ["set"]).first()["n_malformed"] == 1
    numbers = {r["attempt"]: (r["valid"], r["rally_no"], r["completed"]) for r in sequence.attempts(log, SPEC).collect()}
    assert numbers[4] == (True, 3, False) and numbers[5] == (True, 4, True) and not numbers[3][0]


def test_carving_like_a_state_machine(spark):
    rng, rows = random.Random(3), []
    for s in range(60):
        for q in range(rng.randint(1, 25)):
            rows.append((s, q, rng.choice(["Serve", "Serve", "Reception", "Kill", "First ball kill", "Attack error", "junk"]), rng.choice("ABX"), rng.choice("pqr")))
    want = []
    for s, group in itertools.groupby(rows, key=lambda r: r[0]):
        number, serve, touches, passer, direct = 0, None, 0, None, False
        for _, _, event, team, player in group:
            if event == "junk":
                continue
            if event == "Serve":
                serve, touches, passer, direct = None, 1, None, False
                if team in "AB":
                    number += 1
                    serve = team
                continue
            if serve is None:
                continue
            touches += 1
            if event == "Reception" and passer is None:
                passer = player
            direct |= event == "First ball kill"
            if event in SPEC.terminal:
                if team in "AB":
                    want.append((s, number, serve, team, passer, direct, touches))
                serve = None
    got = [tuple(r) for r in sequence.rallies(spark.createDataFrame(rows, "set int, seq int, event string, team string, player string"), SPEC).select("set", "rally_no", "serve_team", "winner", "passer", "first_ball", "touches").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_openers_like_enumeration(spark):
    rng, rows = random.Random(1), []
    for i in range(300):
        f = rng.randint(0, 5)
        a, b = rng.randint(0, 60), rng.randint(0, 60)
        rows.append((i, a, b, f, rng.choice([None, 0, a + rng.randint(0, 8)]), rng.choice([None, 0, b + rng.randint(0, 8)])))
    got = {r["i"]: r for r in sequence.choose_openers(spark.createDataFrame(rows, "i int, base_a int, base_b int, free int, box_a int, box_b int")).collect()}
    for i, a, b, f, xa, xb in rows:
        error = lambda m, a=a, b=b, f=f, xa=xa, xb=xb: (abs(a + m - xa) if xa else 0) + (abs(b + f - m - xb) if xb else 0)
        best = max(range(f + 1), key=lambda m: (-error(m), m))
        assert (got[i]["opened_by_a"], got[i]["error"]) == (best, error(best))


def test_checkpoints_and_first_to(spark):
    rows = [(1, n, a, b, w) for n, (a, b, w) in enumerate([(4, 5, "A"), (5, 5, "B"), (5, 6, "B")], 1)]
    df = spark.createDataFrame(rows, "set int, rally_no int, score_a int, score_b int, winner string")
    r = sequence.checkpoints(df, ["set"], [5]).first()
    assert (r["score_a"], r["score_b"], r["leader"], r["margin"]) == (4, 5, "B", 1)
    tie = spark.createDataFrame([(1, 1, 3, 3, "A"), (2, 1, 2, 2, "A")], "set int, rally_no int, score_a int, score_b int, winner string")
    before = {x["set"]: x["first_to"] for x in sequence.first_to(tie, ["set"], 3, False, "winner", ("A", "B")).collect()}
    after = {x["set"]: x["first_to"] for x in sequence.first_to(tie, ["set"], 3, True, "winner", ("A", "B")).collect()}
    assert before == {1: None, 2: None} and after == {1: None, 2: "A"}


def test_streaks(spark):
    rows = [("t", i, w) for i, w in enumerate([1.0, 1.0, None, 1.0, 0.0, 1.0])]
    got = [(r["length"], r["broken"]) for r in sequence.streaks(spark.createDataFrame(rows, "t string, d int, w double"), "t", ["d"], "w", "d").orderBy("first").collect()]
    assert got == [(3, 1), (1, 0)]


def test_unique_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, b string")
    assert [tuple(r) for r in contests.unique_join(a, b, ["k"]).collect()] == [(1, "x", "p")]


def test_within_spans(spark):
    """The sweep gives what the join of all events with all spans gives; neighbours may overlap, more than lanes take are refused."""
    rng = random.Random(9)
    spans = []
    for e in "abc":
        at = 0
        for k in range(12):
            at += rng.randint(0, 4)  # may touch the one before
            spans.append((e, k, at, at := at + rng.randint(1, 5)))
    events = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([None, *range(90)]), i) for i in range(700)]
    s, v = spark.createDataFrame(spans + [("a", 99, None, 5), (None, 98, 1, 2)], "team string, run int, first int, last int"), spark.createDataFrame(events, "team string, day int, i int")
    want = sorted((e, d, i, k, lo, hi) for e, d, i in events for x, k, lo, hi in spans if e == x and d is not None and lo <= d <= hi)
    assert sorted(map(tuple, contests.within_spans(v.repartition(3), s, "team", "day", "first", "last").collect())) == want and len(want) > 200
    with pytest.raises(Exception, match="overlap"):
        contests.within_spans(v, s.union(spark.createDataFrame([("a", 50, 1, 80)], s.schema)), "team", "day", "first", "last", lanes=1).collect()


def test_match_names(spark):
    names = spark.createDataFrame([("Penn",), ("Penn State",), ("Ohio",)], "team string")
    df = spark.createDataFrame([("@ Penn State Reno, NV",), ("#4 Ohio",), ("Pennsylvania",), (None,), ("Penn",)], "opponent string")
    got = {r["opponent"]: (r["matched"], r["away"], r["label"], r["rest"]) for r in contests.match_names(df, "opponent", names, "team").collect()}
    assert got["@ Penn State Reno, NV"] == ("Penn State", True, None, "Reno, NV") and got["#4 Ohio"] == ("Ohio", False, 4, None)
    assert got["Pennsylvania"][0] is None and got["Penn"][0] == "Penn" and got[None][0] is None


def test_null_grades(spark):
    specs = (Benchmark("a", 1.0), Benchmark("b", 1.0, higher=False))
    got = rates.with_benchmarks(spark.createDataFrame([(None, None), (2.0, None), (0.0, 0.5)], "a double, b double"), specs).collect()
    assert [(r["grade"], r["bench_of"]) for r in got] == [(None, 0), (1.0, 1), (1.0, 2)]


def test_text(spark):
    df = spark.createDataFrame([("@ State  U @Reno, NV", "Doe,  Jane", " 12-9 ", "Kill by Jane Doe (from Ann Bo).", "W 3-1")], "o string, n string, s string, k string, r string")
    hitter, setter = text.kill_parts(F.col("k"))
    r = df.select(text.clean_opponent(F.col("o")), text.name_key_swapped(F.col("n")), text.letters_key(F.col("n")), text.score_part(F.col("s"), 0), text.score_part(F.col("s"), 1), hitter, setter, text.result_sets(F.col("r"), 1), text.legal_final(F.lit(27), F.lit(25)), text.legal_final(F.lit(27), F.lit(24)), text.first_match(F.col("k"), [("Ace", "(?i)ace"), ("Kill", "(?i)kill")])).first()
    assert tuple(r) == ("State  U", "jane doe", "JANE DOE", 12, 9, "Jane Doe", "Ann Bo", 1, True, False, "Kill")


def dense(pairs, ridge):
    teams = sorted({t for p in pairs for t in p[:2]})
    k, rows, y = len(teams), [], []
    for t, o, v in pairs:
        x = np.zeros(2 * k + 1)
        x[teams.index(t)], x[k + teams.index(o)], x[-1] = 1, -1, 1
        rows.append(x)
        y.append(v)
    a = np.array(rows)
    pen = np.eye(2 * k + 1) * ridge
    pen[-1, -1] = 0
    b = np.linalg.solve(a.T @ a + pen, a.T @ np.array(y))
    off, d = b[:k] - b[:k].mean(), b[k:-1] - b[k:-1].mean()
    return {t: (100 * off[i], 100 * d[i]) for i, t in enumerate(teams)}


def test_ridge_both_forms(spark, tmp_path):
    rng = random.Random(2)
    rows = [(a, b, rng.random()) for a in range(8) for b in range(8) if a != b for _ in range(rng.randint(0, 2))]
    want = dense(rows, 1.0)
    pairs = ratings.pair_sums(spark.createDataFrame([(1, *r) for r in rows], "season int, team int, opponent int, y double"), ["season"], "team", "opponent", "y")
    for r in ratings.additive_ratings(pairs, ["season"]).collect():
        assert (r["rating_off"], r["rating_def"]) == pytest.approx(want[r["team"]], abs=1e-6)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    for r in ratings.additive_ratings_wide(pairs.drop("season"), 1.0).collect():
        assert (r["rating_off"], r["rating_def"]) == pytest.approx(want[r["team"]], abs=1e-3)


def test_elo(spark):
    rows = [("p", 1, 2020, 1, "a", "b", 1.0, 5.0), ("p", 2, 2020, 2, "b", "a", 0.0, 0.0), ("p", 3, 2021, 3, "a", "c", 0.0, 3.0)]
    df = spark.createDataFrame(rows, "pool string, match int, season int, day int, home string, away string, home_won double, margin double")
    got = {r["match"]: r for r in elo.elo_log(df, ["pool"], {"x": EloConfig(margin=False)}).collect()}
    e = 1 / (1 + 10 ** (-50 / 400))
    assert got[1]["p_home"] == pytest.approx(e) and got[1]["elo_home_after"] == pytest.approx(1500 + 60 * (1 - e))
    a = 1500 + 60 * (1 - e)
    b = 3000 - a
    p2 = 1 / (1 + 10 ** (-(b - a + 50) / 400))
    a2 = a + 60 * p2
    assert got[3]["elo_home"] == pytest.approx(1500 + 0.95 * (a2 - 1500)) and got[3]["elo_away"] == 1500
    with_margin = {r["match"]: r for r in elo.elo_log(df, ["pool"]).collect()}
    assert with_margin[1]["elo_home_after"] == pytest.approx(1500 + 60 * math.log(6) * 2.2 / (0.001 * 50 + 2.2) * (1 - e))


def plain_elo(matches, config, margin):
    """The fold as it is written down: season, home, away, home_won, margins in order."""
    ratings, held, out = {}, None, []
    for season, home, away, won, margins in matches:
        if held not in (None, season):
            ratings = {t: config.mean + config.carryover * (r - config.mean) for t, r in ratings.items()}
        held = season
        h, a = ratings.get(home, config.mean), ratings.get(away, config.mean)
        edge = h - a + config.home
        p = 1 / (1 + 10 ** (-edge / config.scale))
        size = margins[margin] or 0
        factor = math.log(size + 1) * 2.2 / (0.001 * (edge if won else -edge) + 2.2) if config.margin and size > 0 else 1.0
        ratings[home], ratings[away] = h + config.k * factor * (won - p), a - config.k * factor * (won - p)
        out.append((h, a, p, ratings[home], ratings[away]))
    return out


def schedule(n, teams, seasons, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h, a = rng.sample(range(teams), 2)
        day = i * seasons * 10 // n
        rows.append((i, day // 10, day, f"t{h}", f"t{a}", float(rng.random() < 0.6), rng.choice([None, 0.0, 1.0, 3.0]), rng.random() * 20))
    return sorted(rows, key=lambda r: (r[2], r[3], r[4], r[0]))


MATCHES = "match int, season int, day int, home string, away string, home_won double, margin double, share double"


@pytest.mark.parametrize(("n", "teams"), [(3000, 40), (600, 2), (900, 500)])
def test_elo_like_a_fold(spark, n, teams):
    """Layers of random schedules give the fold's ratings, for several configurations at once and over many batches."""
    rows = schedule(n, teams, 3, n)
    df = spark.createDataFrame(rows, MATCHES).withColumn("pool", F.lit("p")).repartition(3)
    configs = {"a": EloConfig(), "b": EloConfig(k=20, home=0, carryover=0.4, margin=False), "c": EloConfig(margin_column="share")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
        got = {(r["config"], r["match"]): r for r in elo.elo_log(df, ["pool"], configs).collect()}
        plain = [(r[1], *r[3:6], {"margin": r[6], "share": r[7]}) for r in rows]
        for name, c in configs.items():
            for r, want in zip(rows, plain_elo(plain, c, c.margin_column), strict=True):
                assert [got[name, r[0]][x] for x in elo.ELO] == pytest.approx(want, abs=1e-9)
        swept = {r["config"]: r for r in elo.elo_sweep(df, ["pool"], configs, F.col("season") > 0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, c in configs.items():
        scored = [(w[2], r[5]) for r, w in zip(rows, plain_elo(plain, c, c.margin_column), strict=True) if r[1] > 0]
        p, y = map(np.array, zip(*scored, strict=True))
        want = (len(p), ((p > 0.5) == (y == 1)).mean(), -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), np.mean((p - y) ** 2))
        assert [swept[name][x] for x in ("n", "accuracy", "log_loss", "brier")] == pytest.approx(want, abs=1e-9)


def test_elo_grid_in_parts(spark, monkeypatch):
    """Parts of a grid are replayed in tasks of their own, with the figures of one part; ratings are moved a few times as teams come."""
    df = spark.createDataFrame(schedule(400, 30, 3, 9), MATCHES).withColumn("pool", F.col("match") % 2)
    configs = {f"k{k}": EloConfig(k=k) for k in (10, 20, 30)} | {"share": EloConfig(margin_column="share")}
    found = []
    for parts in (1, 4):
        monkeypatch.setattr(elo, "GRID_PARTS", parts)
        found.append({r["config"]: r[1:] for r in elo.elo_sweep(df, ["pool"], configs, F.col("season") > 0).collect()})
    assert set(found[0]) == set(configs) and found[0] == {c: pytest.approx(v) for c, v in found[1].items()}
    replay, rooms = elo.EloReplay(list(configs.values())), set()
    for i in range(300):
        replay.teams(pa.array([f"t{i}"]))
        rooms.add(len(replay.room))
    assert replay.ratings.shape == (300, 4) and (replay.ratings == 1500).all() and len(rooms) <= 10


def test_elo_layers():
    """A layer's matches share no team, and every match comes after the earlier ones of its teams."""
    rng = np.random.default_rng(1)
    home, away = rng.integers(0, 30, 500), rng.integers(30, 60, 500)
    place = np.zeros(500, dtype=int)
    for k, at in enumerate(elo.layers(home, away, 60)):
        assert len(set(home[at]) | set(away[at])) == 2 * len(at)
        place[at] = k + 1
    assert place.min() == 1 and all(place[i] < place[j] for j in range(500) for i in range(j) if {home[i], away[i]} & {home[j], away[j]})


def test_elo_components(spark, tmp_path):
    """Pools that nothing links, one of them a long chain; matches without a side or a result count for nothing."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(i, 0, i, f"c{i:03}", f"c{i + 1:03}", 1.0, 1.0, 1.0) for i in range(70)] + [(100 + i, 0, i, f"x{i % 3}", f"x{(i + 1) % 3}", 0.0, 1.0, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows + [(200, 0, 3, None, "x1", 1.0, 1.0, 1.0), (201, 0, 3, "x0", "x1", None, 1.0, 1.0)], MATCHES)
    found = {r["team"]: r["component"] for r in elo.components(df).collect()}
    assert found == {f"c{i:03}": "c000" for i in range(71)} | {f"x{i}": "x0" for i in range(3)}
    got = {r["match"]: r["elo_home"] for r in elo.elo_log(elo.by_component(df), ["component"]).collect()}
    whole = {r["match"]: r["elo_home"] for r in elo.elo_log(df.withColumn("pool", F.lit(1)), ["pool"]).collect()}
    assert got == pytest.approx(whole) and len(got) == 79
    assert elo.components(df.where("false")).count() == 0 and elo.elo_log(df.withColumn("pool", F.lit(1)).where("false"), ["pool"]).count() == 0


def test_logistic(spark):
    rng = random.Random(4)
    rows = [(x := rng.gauss(0, 1), z := rng.gauss(0, 1), float(rng.random() < 1 / (1 + math.exp(-(0.3 + x - 0.5 * z))))) for _ in range(800)]
    w = predict.logistic_fit(spark.createDataFrame(rows, "x double, z double, y double"), [F.col("x"), F.col("z")], "y")
    a = np.array([(1, x, z) for x, z, _ in rows])
    y, b = np.array([r[2] for r in rows]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ b))
        b += np.linalg.solve((a.T * (p * (1 - p))) @ a, a.T @ (y - p))
    assert w == pytest.approx(b.tolist(), abs=1e-6)


def newton(x, y):
    a, b = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        b += np.linalg.solve((a.T * (p * (1 - p))) @ a + 1e-9 * np.eye(len(b)), a.T @ (y - p))
    return b


def test_leave_one_out_like_single_fits(spark):
    """All folds and specs fitted together give what each fit alone gives; a spec needs its own features only."""
    rng = random.Random(6)
    rows = [(i, 2000 + i % 4, x := rng.gauss(0, 1), rng.choice([None, rng.gauss(0, 2)]) if i % 9 == 0 else (z := rng.gauss(0, 2)), float(rng.random() < 1 / (1 + math.exp(-(0.3 + x))))) for i in range(900)]
    rows += [(9001, None, 1.0, 1.0, 1.0), (9002, 2001, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "i int, fold int, x double, z double, y double").repartition(3)
    features, specs = {"x": F.col("x"), "z": F.col("z")}, {"x": ("x",), "z": ("z",), "both": ("x", "z")}
    names = list(features)
    models = [predict.LogisticModel(s, tuple(names.index(c) for c in used), f) for f in range(2000, 2004) for s, used in specs.items()]
    fits = predict.logistic_fits(df, list(features.values()), "y", models, F.col("fold"))
    got = {(r["i"], r["spec"]): r["p"] for r in predict.leave_one_out(df, "fold", range(2000, 2004), specs, features, "y").collect()}
    assert len(got) == 3 * 901
    for m, w in zip(models, fits, strict=True):
        own = [r for r in rows if r[1] is not None and r[1] != m.held_out and r[4] is not None and all(r[2 + i] is not None for i in m.uses)]
        want = newton(np.array([[r[2 + i] for i in m.uses] for r in own]), np.array([r[4] for r in own]))
        assert [w[0], *[w[i + 1] for i in m.uses]] == pytest.approx(want.tolist(), abs=1e-7) and all(w[i + 1] == 0 for i in (0, 1) if i not in m.uses)
        for r in rows:
            if r[1] == m.held_out and all(r[2 + i] is not None for i in m.uses):
                z = want[0] + sum(want[j + 1] * r[2 + i] for j, i in enumerate(m.uses))
                assert got[r[0], m.name] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-7)


def test_additive_solve_makes_no_array_of_all_pairs():
    """Two million pairs, 16 MB of each number: what the solution makes beside them stays below that."""
    rng = np.random.default_rng(3)
    size, k = 1 << 21, 40
    i, j = rng.integers(0, k, size, dtype=np.int32), rng.integers(0, k, size, dtype=np.int32)
    off = rng.normal(size=k)
    n, s = np.ones(size), 5 + off[i] - off[j]
    tracemalloc.start()
    x = ratings.additive_solve(i, j, n, s, k, 1e-6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6 and x[:k] - x[:k].mean() == pytest.approx(off - off.mean(), abs=1e-6)


@pytest.mark.parametrize("block_weeks", [1, 3, 100])
def test_walk_forward_like_refits(spark, block_weeks):
    """Every week of every season as fitted from scratch on what is before it, however weeks are cut into blocks."""
    rng = random.Random(7)
    monday = dt.date(2024, 9, 2)
    rows = [(s, monday + dt.timedelta(days=365 * s + rng.randrange(70)), a, b, None if rng.random() < 0.05 else rng.random()) for s in (0, 1) for _ in range(400) for a, b in [rng.sample([f"t{i}" for i in range(12 + s)], 2)]]
    rows.append((2, monday, "t1", "t2", 0.5))
    df = spark.createDataFrame(rows, "season int, day date, team string, opponent string, y double").repartition(3)
    found = {(r["season"], r["week_start"], r["team"]): r for r in ratings.walk_forward(df, "season", "day", "y", block_weeks=block_weeks).collect()}
    n = 0
    for s in (0, 1, 2):
        for week in sorted({r[1] - dt.timedelta(days=r[1].weekday()) for r in rows if r[0] == s}):
            before = [(r[2], r[3], r[4]) for r in rows if r[0] == s and r[1] < week and r[4] is not None]
            if len(before) >= 50:
                for team, (off, deff) in dense(before, 1.0).items():
                    r = found.pop((s, week, team))
                    assert (r["rating_off"], r["rating_def"], r["rating_overall"]) == pytest.approx((off, deff, off + deff), abs=1e-6)
                    n += 1
    assert not found and n > 150


def test_prematch_features(spark):
    """One row per match; 0 where the week's fit does not know a team."""
    day = dt.date(2024, 9, 11)
    matches = spark.createDataFrame([(1, 0, day, "a", "b"), (2, 0, day, "a", "new"), (3, 1, day, "a", "b")], "match int, season int, day date, home string, away string")
    log = spark.createDataFrame([(i, 1500.0 + i, 1400.0) for i in (1, 2, 3)], "match int, elo_home double, elo_away double")
    weekly = spark.createDataFrame([(0, dt.date(2024, 9, 9), "a", 3.0), (0, dt.date(2024, 9, 9), "b", -2.0), (0, dt.date(2024, 9, 2), "new", 9.0)], "season int, week_start date, team string, rating_overall double")
    got = {r["match"]: (r["elo_home"], r["elo_away"], r["ridge_home"], r["ridge_away"]) for r in predict.prematch_features(matches, log, weekly).collect()}
    assert got == {1: (1501.0, 1400.0, 3.0, -2.0), 2: (1502.0, 1400.0, 3.0, 0.0), 3: (1503.0, 1400.0, 0.0, 0.0)}


def test_predicted_pairs(spark):
    """Three models; scorelines of the favourite add up to its chance, the other's to the rest; missing ratings give no row."""
    table = spark.createDataFrame([(0.55, 0.3, 0.2, 0.1, 0.1, 0.1, 0.2), (0.85, 0.6, 0.2, 0.1, 0.02, 0.03, 0.05)], ["p_fav", *predict.LINES])
    ratings_of = spark.createDataFrame([("x", 1600.0, 5.0, 0.03, 0.01, 0.6), ("y", 1500.0, 15.0, 0.01, 0.02, 0.6), ("z", None, 1.0, 0.0, 0.0, 0.6)], "team string, elo double, rating_overall double, rating_off double, rating_def double, league double")
    pairs = spark.createDataFrame([("x", "y", 1), ("y", "x", 0), ("x", "z", 0), ("x", "w", 0)], "a string, b string, venue int")
    models = {"blend": (0.3, 0.4, 0.6), "elo": (0.3, 0.4, 0.0), "ridge": (0.3, 0.0, 0.6)}
    got = {(r["a"], r["b"], r["model"]): r for r in predict.predicted_pairs(pairs, ratings_of, models, table).collect()}
    assert set(got) == {(*ab, m) for ab in (("x", "y"), ("y", "x")) for m in models}
    for (a, b, m), r in got.items():
        w, sign = models[m], 1 if a == "x" else -1
        p = 1 / (1 + math.exp(-(w[0] * r["venue"] + sign * (w[1] * 1 - w[2] * 1))))
        fav = max(p, 1 - p)
        at = min(max((fav - 0.55) / 0.3, 0), 1)
        raw = dict(zip(predict.LINES, [lo + at * (hi - lo) for lo, hi in zip((0.3, 0.2, 0.1, 0.1, 0.1, 0.2), (0.6, 0.2, 0.1, 0.02, 0.03, 0.05), strict=True)], strict=True))
        mine, other = ("fav", "dog") if p >= 0.5 else ("dog", "fav")
        scale = lambda side, total: [raw[f"{side}_3_{k}"] * total / sum(raw[f"{side}_3_{j}"] for j in range(3)) for k in range(3)]
        want = scale(mine, p) + scale(other, 1 - p)
        assert r["p_a"] == pytest.approx(p) and [r[f"{s}_3_{k}"] for s in "ab" for k in range(3)] == pytest.approx(want) and sum(want) == pytest.approx(1) and r["five_sets"] == pytest.approx(want[2] + want[5])
        assert (r["sideout_a"], r["sideout_b"]) == pytest.approx((0.61, 0.60) if a == "x" else (0.60, 0.61))


def test_win_distribution(spark):
    df = spark.createDataFrame([("t", i, p) for i, p in enumerate((0.2, 0.7, 0.9))], "t string, i int, p double")
    r = predict.win_distribution(df, ["t"], "p", "i").first()
    assert r["dist"] == pytest.approx([0.024, 0.278, 0.572, 0.126]) and (r["q10"], r["q90"]) == (1, 3)


def test_percentiles(spark):
    ref = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 2.0, 3.0)], "g string, v double")
    ask = spark.createDataFrame([("g", 2.0), ("g", 2.5), ("g", 0.0), ("g", 9.0), ("g", None), ("h", 1.0)], "g string, v double")
    got = {(r["g"], r["v"]): r["pct"] for r in players.percentile_against(ask, ref, ["g"], "v").collect()}
    assert got == {("g", 2.0): 25.0, ("g", 2.5): 75.0, ("g", 0.0): 0.0, ("g", 9.0): 100.0, ("g", None): None, ("h", 1.0): None}


def test_opponent_effects(spark, tmp_path):
    rng = random.Random(5)
    skill, defence = [rng.gauss(0, 1) for _ in range(12)], [rng.gauss(0, 1) for _ in range(6)]
    rows = [(1, p, o, float(rng.randint(1, 5)), 10 + skill[p] - defence[o]) for p in range(12) for o in range(6) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "s int, p int, o int, w double, y double")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    a = {r["player"]: r["value_adj"] for r in players.opponent_effects(df, ["s"], "p", "o", "w", "y", rounds=6, checkpoint_every=3)[0].collect()}
    b = {r["player"]: r["value_adj"] for r in players.opponent_effects_grouped(df, ["s"], "p", "o", "w", "y", rounds=6).collect()}
    assert a == pytest.approx(b)
    # Groups that settle leave the loop; small ones are left out; both forms agree on all others after forty rounds.
    more = [(s, p, o, w, y) for s, n in ((2, 40), (3, 3)) for p in range(n) for o in range(6) if (p + o) % 3 for w, y in [(float(rng.randint(0, 5)), None if rng.random() < 0.1 else rng.random())]] + [(4, p, 0, 1.0, float(p)) for p in range(60)]
    both = spark.createDataFrame(rows + more, "s int, p int, o int, w double, y double")
    whole, effects = players.opponent_effects(both, ["s"], "p", "o", "w", "y", least=20)
    c = {(r["s"], r["player"]): r["value_adj"] for r in whole.collect()}
    d = {(r["s"], r["player"]): r["value_adj"] for r in players.opponent_effects_grouped(both, ["s"], "p", "o", "w", "y", least=20).collect()}
    assert c == pytest.approx(d, abs=1e-9) and {s for s, _ in c} == {1, 2, 4} and {r["s"] for r in effects.collect()} == {1, 2, 4}
    free = {r["player"]: r["value_adj"] for r in players.opponent_effects_grouped(df, ["s"], "p", "o", "w", "y", ridge_k=1e-9, rounds=400).collect()}
    assert np.corrcoef([free[p] for p in sorted(free)], [skill[p] for p in sorted(free)])[0, 1] > 0.999


def test_effects_of_a_group_in_one_task_or_by_joins(spark, tmp_path, monkeypatch):
    """Groups of few pairs take no job for each round; those beyond the bound go round by round, with the same values."""
    rows = [(s, p, o, float(1 + (p * o) % 4), float((7 * p + 3 * o) % 11)) for s, n in ((1, 30), (2, 6)) for p in range(n) for o in range(8) if (p + o) % 3]
    df = spark.createDataFrame(rows, "s int, p int, o int, w double, y double").withColumn("p", F.nullif("p", F.lit(3)))
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    found, jobs = [], []
    for bound in (1 << 23, 60):
        monkeypatch.setattr(players, "GROUP_PAIRS", bound)
        spark.sparkContext.setJobGroup(f"effects {bound}", "effects")
        p, o = players.opponent_effects(df, ["s"], "p", "o", "w", "y", rounds=40)
        found.append([{(r["s"], r[1]): r[2] for r in x.collect()} for x in (p, o)])
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"effects {bound}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == [pytest.approx(x, abs=1e-9) for x in found[1]] and len(found[0][0]) == 36 and len(found[0][1]) == 16
    assert jobs[0] <= 20 < jobs[1]


def test_slots(spark):
    got = {r["o"]: r["s"] for r in spark.range(1, 65).select(F.col("id").alias("o"), ratings.slot(F.col("id")).alias("s")).collect()}
    assert got[1] == 0 and got[64] == 1 and got[5] // 16 == 3 and got[8] // 16 == 0 and sorted(got.values()) == list(range(64))


def test_coverage_takes_the_upper_median(spark):
    """Of an even number of teams the upper of the two middle counts."""
    now = spark.createDataFrame([(t, i, "x") for t, n in (("a", 1), ("b", 2), ("c", 5), ("d", 9)) for i in range(n)], "team string, match int, conf string")
    before = spark.createDataFrame([(t, 1, c) for t, c in (("a", "x"), ("e", "gone"), ("f", "x"))], "team string, match int, conf string")
    assert metrics.coverage_summary(now, before, "team", "match", "conf").first().asDict() == {"teams": 4, "least": 1, "median": 5, "most": 9, "missing": 2, "conferences_wiped": 1}
    assert {r["team"] for r in metrics.coverage(now, before, "team", "match").where("thin").collect()} == {"a", "b"}


def test_rank_band_and_ranks(spark):
    df = spark.createDataFrame([("g", i, v, se) for i, (v, se) in enumerate([(5.0, 1.0), (4.0, None), (4.0, 0.1), (1.0, 0.1)])], "g string, i int, v double, se double")
    got = {r["i"]: (r["rank_lo"], r["rank_hi"]) for r in metrics.rank_band(df, ["g"], "v", "se").collect()}
    assert got == {0: (1, 4), 1: (2, 4), 2: (2, 4), 3: (4, 5)}  # a rating is above its own lower bound
    ranks = [r["r"] for r in metrics.ranked(df, ["g"], "v", "r").orderBy("i").collect()]
    assert ranks == [1, 2, 2, 4]


def random_bracket(seed, rounds=6, of=0):
    """Matches of a bracket in slot order, and each team's slot, wins and first-round side."""
    rng = random.Random(seed)
    alive, rows, reached = [f"t{i:02}" for i in rng.sample(range(2**rounds), 2**rounds)], [], {}
    order = list(alive)
    for k in range(rounds):
        new = []
        for a, b in zip(alive[::2], alive[1::2], strict=True):
            home, away = rng.sample([a, b], 2)
            won = rng.random() < 0.5
            rows.append((of, len(rows), dt.date(2024, 12, 1 + 3 * k), home, away, float(won), k >= 2))
            new.append(home if won else away)
            reached[away if won else home] = k + 1
        alive = new
    return rows, reached | {alive[0]: rounds + 1}, order


BRACKET = "season int, match int, day date, home string, away string, home_won double, neutral boolean"


def test_bracket_outcomes_and_tree(spark):
    """Reached rounds, hosts, and a tree in which the same teams can meet as in the bracket that was played."""
    both = [random_bracket(s, of=s) for s in (1, 2)]
    df = spark.createDataFrame([r for rows, _, _ in both for r in rows], BRACKET).repartition(4)
    got = {(r["season"], r["team"]): r for r in bracket.outcomes(df, ["season"]).collect()}
    spots = {(r["season"], r["team"]): r["slot"] for r in bracket.slots(bracket.tree(df, ["season"]), ["season"]).collect()}
    for season, (rows, reached, order) in zip((1, 2), both, strict=True):
        hosts = {r[3] for r in rows if not r[6]}
        for team, k in reached.items():
            r = got[season, team]
            lost = next((x for x in rows if team in x[3:5] and (x[3] if x[5] else x[4]) != team), None)
            assert r["reached"] == k and r["host"] == (team in hosts) and r["lost_in"] == (k if lost else None) and r["lost_to"] == (None if lost is None else lost[3] if lost[3] != team else lost[4])
        assert sorted(spots[season, t] for t in order) == list(range(64))
        depth = lambda i, j: next(k for k in range(1, 7) if i >> k == j >> k)  # noqa: E731  the round in which two slots can meet
        assert all(depth(i, j) == depth(spots[season, order[i]], spots[season, order[j]]) for i in range(64) for j in range(i))
    whole = bracket.integrity(df, ["season"]).collect()
    assert [tuple(r)[1:] for r in whole] == [(63, 64, 32, 16, 8, 4, 2, 1, 1, 63, None)] * 2


def test_damaged_brackets(spark):
    """A missing match, a loser that plays on, and two brackets of half the size that never meet are told apart."""
    rows = [random_bracket(s, of=s)[0] for s in range(4)]
    rows[0] = rows[0][:-1]  # no final
    last = rows[1][40]
    loser = last[4] if last[5] else last[3]
    after = next(i for i, r in enumerate(rows[1]) if i > 40 and (last[3] if last[5] else last[4]) in r[3:5])
    r = rows[1][after]
    rows[1][after] = (*r[:3], *[loser if t == (last[3] if last[5] else last[4]) else t for t in r[3:5]], *r[5:])
    a, b = random_bracket(8, 5, 3)[0], random_bracket(9, 5, 3)[0]
    rows[3] = a + [(3, 100 + x[1], x[2], "u" + x[3], "u" + x[4], *x[5:]) for x in b] + [(3, 200, dt.date(2024, 12, 30), "x", "y", 1.0, True)]
    got = {r["season"]: r for r in bracket.integrity(spark.createDataFrame(sum(rows, []), BRACKET), ["season"]).collect()}
    assert [got[s]["fault"] for s in range(4)] == ["number of matches", "results", None, "results"]
    # Two home sides of the first round change places: whole if both went out there, else a loser plays on.
    moved = random_bracket(4, of=9)[0]
    i, j = [k for k, r in enumerate(moved) if k < 32][:2]
    swap = {moved[i][3]: moved[j][3], moved[j][3]: moved[i][3]}
    first = [(*r[:3], swap.get(r[3], r[3]), swap.get(r[4], r[4]), *r[5:]) if k in (i, j) else r for k, r in enumerate(moved)]
    plays_on = any(moved[k][5] for k in (i, j))
    assert bracket.integrity(spark.createDataFrame(first, BRACKET), ["season"]).first()["fault"] == ("results" if plays_on else None)
    assert bracket.integrity(spark.createDataFrame([], BRACKET), ["season"]).count() == 0


def test_played_brackets(spark):
    """Brackets decided by form: the larger value of the round wins, a team alone goes on, ties go to the smaller team."""
    rng = random.Random(3)
    form = {t: [rng.choice([None, 1.0, 2.0, 3.0]) for _ in range(6)] for t in range(64)}
    rows = [(1, t, t, form[t]) for t in range(64)] + [(2, t, t, form[t]) for t in range(0, 64, 2)]
    got = {(r["season"], r["round"], r["game"]): (r["home"], r["away"], r["home_won"]) for r in bracket.played(spark.createDataFrame(rows, "season int, team int, slot int, form array<double>").repartition(3), ["season"], "slot", "form").collect()}
    value = lambda t, k: -9 if form[t][k] is None else form[t][k]
    want = {}
    for season, alive in ((1, {t: t for t in range(64)}), (2, {t: t for t in range(0, 64, 2)})):
        for k in range(6):
            new = {}
            for g in {p // 2 for p in alive}:
                pair = [alive[p] for p in (2 * g, 2 * g + 1) if p in alive]
                best = max(pair, key=lambda t: (value(t, k), -t))
                if len(pair) == 2:
                    want[season, k + 1, g] = (*pair, float(best == pair[0]))
                new[g] = best
            alive = new
    assert got == want and len(got) == 63 + 31


def test_seeds_from_labels(spark):
    rows = [(1, 1, "a", 1), (1, 3, "a", 1), (1, 2, "b", 4), (1, 4, "c", 2), (1, 5, "c", 3), (2, 1, "a", 1), (2, 3, "a", 2), (2, 1, "b", 7), (2, 1, "d", None)]
    got = {(r["season"], r["team"]): r["seed"] for r in bracket.seeds_of(spark.createDataFrame(rows, "season int, round int, team string, label int"), ["season"]).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 4, (2, "a"): 2}
