"""Landing of small files."""

import json

from pyspark.sql import functions as F

from courtline.functions import text
from courtline.sources import box, feeds, tables


def test_team_box(spark, tmp_path):
    p = tmp_path / "box.csv"
    p.write_text(",".join(box.TEAM_BOX) + "\n" + "2024,09/01/2024,1,A,Conf,@ B,W 3-1,4,50,x,120\n" + "2024,9/2/2024,1,A,Conf,C @Reno,PPD,4\n")
    r = box.land_team_box(spark, str(p)).collect()
    assert len(r) == 1 and (r[0]["opponent"], r[0]["sets_for"], r[0]["sets_against"], r[0]["kills"], r[0]["errors"], r[0]["away"], str(r[0]["day"])) == ("B", 3, 1, 50.0, 0.0, True, "2024-09-01")


def test_roster_keeps_last(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('Team,Player,Pos\nA,"Doe, Jane",S\nA,Jane Doe,OH\n')
    assert [tuple(r) for r in box.land_roster(spark, str(p)).collect()] == [("A", "JANE DOE", "OH")]


def test_results_and_page_that_is_no_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"date": "09/01/2024", "game_id": "1", "home_team": "H", "away_team": "A", "home_sets": 3, "away_sets": 0, "winner": "H"}, {"date": "09/01/2024", "game_id": "2", "home_team": "A", "away_team": "H", "home_sets": 1, "away_sets": 3, "winner": "H"}]))
    (tmp_path / "b.json").write_text("<html>502</html>")
    r = box.land_results(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0]["game_id"] == "2"


def test_points_and_box(spark, tmp_path):
    play = lambda text, h=None, v=None: {"playText": text, "homeScore": h, "visitorScore": v}
    (tmp_path / "m.json").write_text(json.dumps({"_date": "09/01/2024", "_away_team": "A", "_home_team": "H", "teams": [{"teamId": "1", "isHome": True, "nameShort": "H "}, {"teamId": "2", "isHome": False, "nameShort": "A"}], "periods": [{"playbyplayStats": [{"teamId": 1, "plays": [play("Kill by J (from S)", 1, 0), play("Timeout")]}, {"teamId": "2", "plays": [play("Service ace by Q", 1, 1)]}]}]}))
    r = feeds.land_points(spark, str(tmp_path)).orderBy("set_no", "seq").collect()
    assert [(x["team"], x["kind"], x["home_score"], x["away_score"], x["actor"]) for x in r] == [("H", "Kill", 1, 0, "J"), ("A", "Ace", 1, 1, "Q")]
    (tmp_path / "box").mkdir()
    player = lambda first, last, **more: {"firstName": first, "lastName": last, "participated": True, **more}
    teams = [{"teamId": "1", "isHome": True, "nameShort": "Payload H"}, {"teamId": "2", "isHome": False, "nameShort": "Payload A"}]
    own = [{"teamId": 1, "playerStats": [player("J", "D", position=" OH ", gamesPlayed="3", kills="7"), {"firstName": "N", "lastName": "O", "participated": False}, player(None, "  ")]}, {"teamId": 3, "playerStats": [player("X", "Y")]}]
    (tmp_path / "box/2024-77.json").write_text(json.dumps({"_date": "09/01/2024", "_home_team": "H", "_away_team": "A ", "teams": teams, "teamBoxscore": own}))
    (tmp_path / "box/c.json").write_text(json.dumps({"_date": "09/01/2024", "_home_team": "H", "teams": teams, "teamBoxscore": own}))  # no name of the away side
    conferences = spark.createDataFrame([("H", "East")], "team string, conf string")
    for conf, of in ((None, ""), (conferences, "East")):
        r = feeds.land_player_stats(spark, str(tmp_path / "box"), conferences=conf).collect()
        assert [(x["contest_id"], x["season"], x["conference"], x["team"], x["opponent"], x["player"], x["position"], x["location"], x["Kills"], x["S"]) for x in r] == [("2024-77", "2024", of, "H", "A", "J D", "OH", "Home", 7.0, 3.0)]
    assert feeds.land_player_stats(spark, str(tmp_path / "box"), "2023-24").first()["season"] == "2023-24"


def test_points_are_called_as_the_scoreboard_calls_teams(spark, tmp_path):
    """Names of the scoreboard first, the document's where they are missing; other ids and sets without a scored play count for nothing."""
    plays = lambda tid, *scores: {"teamId": tid, "plays": [{"playText": "Kill by Q", "homeScore": h, "visitorScore": 0} for h in scores]}
    teams = [{"teamId": "1", "isHome": True, "nameShort": "Payload Home"}, {"teamId": "2", "isHome": False, "nameShort": " Payload Away\t"}]
    doc = {"_date": "09/01/2024", "_home_team": "Board Home ", "_away_team": "", "teams": teams, "periods": [{"playbyplayStats": [plays("1", None), plays("9", 5)]}, {"playbyplayStats": [plays("1", 1), plays("9", 7), plays("2", 2)]}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    (tmp_path / "n.json").write_text(json.dumps(doc | {"_away_team": "  "}))  # a name of blanks is none, and is not replaced
    r = feeds.land_points(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(x["home_team"], x["away_team"], x["team"], x["set_no"], x["home_score"]) for x in r] == [("Board Home", "Payload Away", "Board Home", 1, 1), ("Board Home", "Payload Away", "Payload Away", 1, 2)]


def test_union_of_seasons(spark, tmp_path):
    """A column that came later, another order of columns, a file of a header only, and files that are no season's."""
    for name, text in {"games_2019.csv": "Team,Kills\nA,3\nB,4\n", "x/games_2020.csv": "Kills,Team,Digs\n5,A,9\n", "games_2021.csv": "Team,Kills,Digs\n", "games_2022.csv": "Team,Kills,Digs\nC,,1\n", "notes.csv": "a\n1\n", "games_2023.txt": "Team\nZ\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    r = feeds.union_seasons(spark, str(tmp_path))
    assert sorted((x["season"], x["Team"], x["Kills"], x["Digs"]) for x in r.collect()) == [(2019, "A", "3", None), (2019, "B", "4", None), (2020, "A", "5", "9"), (2022, "C", None, "1")]
    (tmp_path / "none").mkdir()
    assert feeds.union_seasons(spark, str(tmp_path / "none")).count() == 0


def test_schedule(spark, tmp_path):
    rows = [{"date": "09/01/2024", "game_id": "1", "home_team": "H ", "away_team": "A", "state": "pre"}, {"date": "2024-09-01", "game_id": "2", "home_team": "H", "away_team": "A"}, {"date": "?", "home_team": "H", "away_team": "A"}, {"date": "2024-09-01", "home_team": "", "away_team": "A"}]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    assert sorted(tuple(r)[1:] for r in box.land_schedule(spark, str(tmp_path)).collect()) == [("1", "H", "A", "pre"), ("2", "H", "A", "")]


def test_quality_and_set_scores(spark):
    q = spark.createDataFrame([('{"Jane|x": {"school": "A", "qualified": true, "total": 10, "great": 3, "good": 2, "bad": 1}, "N|y": {"school": "A", "qualified": false, "total": 9, "great": 1, "good": 1, "bad": 0}}',)], "j string")
    assert [(r["name"], r["touches"], r["rating"]) for r in box.quality_rows(q, "j").collect()] == [("Jane", 10, 0.8)]
    s = spark.createDataFrame([('{"c1": [[25, 20], [20, 25]], "c2": []}',)], "j string")
    assert [tuple(r) for r in box.set_score_rows(s, "j").collect()] == [("c1", 25, 20, 2)]


def test_settled(spark):
    rows = [("2024-09-30", 5, 5, True), ("2024-09-01", 0, 0, False), ("2024-09-11", 52, 51, True), ("2024-09-10", 52, 51, True), ("2024-09-05", 4, 4, False)]
    df = spark.createDataFrame(rows, "d string, games int, finals int, held boolean").withColumn("day", F.to_date("d"))
    assert [r["settled"] for r in box.settled(df, F.to_date(F.lit("2024-10-01"))).orderBy(F.desc("d")).collect()] == [False, False, True, False, True]


def test_order_and_upsert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in (1, 2):
        (tmp_path / f"in/{k}.csv").write_text("date,away_team,home_team,set,event,team,player,score\n" + "".join(f"09/0{k}/2024,A,H,1,Serve,A,p{i},{i}-0\n" for i in range(50)))
    r = feeds.land_events(spark, str(tmp_path / "in")).orderBy("path", "seq").collect()
    assert [x["player"] for x in r] == [f"p{i}" for _ in (1, 2) for i in range(50)] and r[0]["seq"] == 1
    out = str(tmp_path / "out")
    rows = lambda s, v: spark.createDataFrame([("w", s, v)], "pool string, season int, v int")
    tables.write_seasons(rows(2023, 1).unionByName(rows(2024, 2)), out)
    tables.write_seasons(rows(2024, 3), out)
    assert sorted((r["season"], r["v"]) for r in spark.read.parquet(out).collect()) == [(2023, 1), (2024, 3)]
    tables.write_summary(rows(2024, 3), str(tmp_path / "csv"), "csv")
    tables.write_summary(rows(2024, 3), str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).first()["v"] == 3


def test_play_kinds_and_actors(spark):
    """Errors count before kills and blocks, phrases are whole words, and a name ends at a comma."""
    want = [
        ("Block error by X.", "Block error", "X"), ("Blocking error by X", "Block error", "X"), ("Bad set by X", "Set error", "X"), ("set error by X Y.", "Set error", "X Y"), ("Kill by J, block error by K", "Block error", "J"), ("Blocked ball", "Other", None),
        ("Kill by Jane Doe, assist by A", "Kill", "Jane Doe"), ("Service ace by Q", "Ace", "Q"), ("Service error (X)", "Service error", None), ("Attack error by A (block by B)", "Attack error", "A"), ("Block by A, B", "Block", "A"), ("Reception error by A", "Other", "A"),
        ("kill by the net, by Ann B. Lee", "Kill", "Ann B"), ("Roadkill", "Other", None), ("Dig error, ball handling error by Z", "Ball handling error", "Z"), ("", "Other", None),
    ]
    df = spark.createDataFrame([(t,) for t, *_ in want], "t string")
    got = {r["t"]: (r["k"], r["a"]) for r in df.select("t", text.play_kind(F.col("t")).alias("k"), text.actor(F.col("t")).alias("a")).collect()}
    assert got == {t: (k, a) for t, k, a in want}


def test_the_last_file_wins(spark, tmp_path):
    for name, pos in (("b.csv", "S"), ("a.csv", "OH"), ("c.csv", "L")):
        (tmp_path / name).write_text(f"Team,Player,Pos\nT,\"Doe, Jane\",{pos}\n" + "T,Other,X\n" * (50 if name == "a.csv" else 1))
    assert {r["position"] for r in box.land_roster(spark, str(tmp_path)).where("player_key = 'JANE DOE'").collect()} == {"L"}
