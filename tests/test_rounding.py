"""Sums and rounding that decide ranks: the same whatever the order of rows, and as the SQL rounds."""

from types import SimpleNamespace

import duckdb
from pyspark.sql import functions as F

from courtline.plans.contest_queries import binary_round
from courtline.plans.player_queries import totals


def test_binary_round(spark):
    """26.858494 / 52 is .5165095, but the double times 10^6 lies below the half; the other values are signs, halves and numbers without a rounding."""
    values = [26.858494 / 52, 1039.2295625, 0.0000005, -0.0000005, -26.858494 / 52, 0.0, 1e300, float("inf"), float("nan"), None, 2.5]
    want = [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(binary_round("v")).collect()]
    assert list(map(repr, got)) == list(map(repr, want)) and got[0] == 0.516509


def test_totals_in_any_order(spark):
    """Three weights of tenths add up to .6 in one order and to .6000000000000001 in the other; a value that is no number stays one."""
    rows = [(1998, 1, "P", "t", 1.0, y) for y in (0.1, 0.2, 0.3)] + [(1998, 2, "P", "t", 1.0, float("nan")), (1998, 2, "P", "t", 1.0, 2.0)]
    sums = []
    for some in (rows, rows[::-1]):
        one = spark.createDataFrame(some, "season int, player long, position string, team string, w double, y double").coalesce(1)
        sums.append({r["player"]: r["wy"] for r in totals(SimpleNamespace(player_match=lambda one=one: one)).orderBy(F.col("player")).collect()})
    assert [s[1] for s in sums] == [0.6, 0.6] and all(s[2] != s[2] for s in sums)
