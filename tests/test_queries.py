"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables; the others run."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from courtline.plans import QUERIES, SQL
from courtline.plans.model_sql import ELO_SWEEP_SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, (bool,)) or type(x).__name__ == "bool_":
        return str(bool(x))
    return f"{float(x):.5f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x).replace(" 00:00:00", "")


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_sweep_like_sql(spark, duck):
    """The whole grid against a fold of every configuration, whose SQL is too slow for larger tables."""
    got, want = QUERIES["h5_elo_sweep"](spark, DATA).toPandas(), duck.execute(ELO_SWEEP_SQL).df()
    assert len(got) == 540 and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["user_id", "side"]
    assert set(SQL) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def later(tmp_path_factory):
    """The smallest tables with the orders of 1997 on fifteen years later."""
    at, con = tmp_path_factory.mktemp("later"), duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        kind = con.execute(f"select typeof(o_orderdate) from '{DATA}/orders.parquet' limit 1").fetchone()[0]
        moved = f"replace ((o_orderdate + CASE WHEN year(o_orderdate) >= 1997 THEN INTERVAL 15 YEAR ELSE INTERVAL 0 YEAR END)::{kind} AS o_orderdate)" if t == "orders" else ""
        con.execute(f"copy (select * {moved} from '{DATA}/{t}.parquet') to '{at}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    return str(at), con


def test_seasons_from_the_tables(spark, later):
    at, con = later
    seasons = {r[0] for r in con.execute("select distinct year(o_orderdate) from orders").fetchall()}
    assert {2012, 2013} < seasons
    assert rows(QUERIES["d20_universe_fill"](spark, at).toPandas()) == rows(con.execute(SQL["d20_universe_fill"]).df())
    assert {r["season"] for r in QUERIES["h10_h11_logistic_validation"](spark, at).collect()} == seasons
    assert {r["season"] for r in QUERIES["h9_walk_forward_ratings"](spark, at).select("season").distinct().collect()} == seasons


@pytest.fixture(scope="module")
def dealt_anew(tmp_path_factory):
    """The 0.01 tables, and the same with quantities and prices of lines dealt anew: other results of the same contests."""
    at, con = tmp_path_factory.mktemp("dealt"), duckdb.connect()
    con.execute("set timezone = 'UTC'")
    whole = DATA.replace("0.001", "0.01")
    for t in TABLES:
        rows = f"select * from '{whole}/{t}.parquet'"
        if t == "lineitem":
            order = "hash(l_orderkey * 8 + l_linenumber)"
            rows = f"""select a.* replace (b.q as l_quantity, b.p as l_extendedprice) from (select *, row_number() over (order by l_orderkey, l_linenumber) as n from ({rows})) a
                       join (select l_quantity as q, l_extendedprice as p, row_number() over (order by {order}) as n from ({rows})) b using (n)"""
        con.execute(f"copy (select {'* exclude (n)' if t == 'lineitem' else '*'} from ({rows})) to '{at}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    return whole, str(at), con


@pytest.mark.parametrize("name", ["h25_outcomes", "h26_title_odds", "h26_one_bid_leagues", "h27_seeds_alone", "h27_focus_team", "e29_run_summary"])
def test_tournaments_follow_results(spark, dealt_anew, name):
    """With other results of the same contests every figure moves, and still is the SQL's."""
    whole, at, con = dealt_anew
    got = QUERIES[name](spark, at).toPandas()
    assert len(got) and rows(got) == rows(con.execute(SQL[name]).df())
    assert rows(got) != rows(QUERIES[name](spark, whole).toPandas())
