"""Team ratings: additive ridge, schedule strength, composite, RPI, champions, field and bracket slots; Elo is in elo."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, with_checkpoints
from .metrics import ranked, z_scores


def pair_sums(sides: DataFrame, by: Sequence[str], team: str, opponent: str, y: str) -> DataFrame:
    """n and sum of y by group, team and opponent: all that the additive fit needs of the matches."""
    rows = sides.dropna(subset=[team, opponent, y])
    return rows.groupBy(*by, F.col(team).alias("team"), F.col(opponent).alias("opponent")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"))


def additive_solve(i: np.ndarray, j: np.ndarray, n: np.ndarray, s: np.ndarray, k: int, ridge: float, start: np.ndarray | None = None) -> np.ndarray:
    """Solution of y = mu + off of team i - def of team j from pair sums, for k teams: off of each, def of each, mu.

    Conjugate gradient on the normal equations, preconditioned by their diagonal: memory and a round's
    work are linear in the pairs, whatever the number of teams. start: a solution nearby, as that of
    a week before, which leaves few rounds.
    """
    step = max(1 << 18, 4 * k)  # pairs at once: no array as long as the pairs is made
    some = [slice(lo, lo + step) for lo in range(0, len(i), step)]
    total = lambda at, v: sum((np.bincount(at[c], weights=v[c], minlength=k) for c in some), np.zeros(k))
    b = np.concatenate([total(i, s), -total(j, s), [s.sum()]])
    diagonal = np.concatenate([total(i, n) + ridge, total(j, n) + ridge, [n.sum()]])

    def normal(x: np.ndarray) -> np.ndarray:
        out = ridge * x
        out[-1] = 0.0
        for c in some:
            fitted = n[c] * (x[i[c]] - x[k + j[c]] + x[-1])
            out[:k] += np.bincount(i[c], weights=fitted, minlength=k)
            out[k:-1] -= np.bincount(j[c], weights=fitted, minlength=k)
            out[-1] += fitted.sum()
        return out

    if start is None:
        x = np.zeros(2 * k + 1)
        x[-1] = s.sum() / n.sum()
    else:
        x = start.copy()
    r = b - normal(x)
    z = r / diagonal
    direction, rz = z, r @ z
    for _ in range(20 * (2 * k + 1)):
        if rz <= 1e-26 * max(1.0, b @ (b / diagonal)):
            break
        step = normal(direction)
        alpha = rz / (direction @ step)
        x, r = x + alpha * direction, r - alpha * step
        z = r / diagonal
        rz, before = r @ z, rz
        direction = z + rz / before * direction
    return x


def coded_pairs(batches: Iterator[pa.RecordBatch], more: Sequence[str] = ()) -> tuple[pa.Array, list[np.ndarray]]:
    """Teams, and arrays of batches of pair sums: numbers of team and opponent, n, s and more; teams are numbered as they come, so a batch is let go."""
    numbers, kind, parts = {}, pa.null(), [[] for _ in range(4 + len(more))]
    for b in batches:
        kind = b.column("team").type
        for k, c in enumerate(("team", "opponent")):
            coded = b.column(c).dictionary_encode()
            known = np.array([numbers.setdefault(t, len(numbers)) for t in coded.dictionary.to_pylist()], dtype=np.int32)
            parts[k].append(known[coded.indices.to_numpy(zero_copy_only=False)])
        for k, c in enumerate(("n", "s", *more)):
            parts[2 + k].append((b.column(c).cast(pa.float64()) if k < 2 else b.column(c)).to_numpy(zero_copy_only=False).copy())
    return pa.array(list(numbers), kind), [np.concatenate(x) if x else np.zeros(0) for x in parts]


def board_of(teams: pa.Array, i: np.ndarray, j: np.ndarray, n: np.ndarray, x: np.ndarray) -> dict[str, pa.Array]:
    """Ratings of a solution: team effects centred over the teams that played or were met."""
    k = len(teams)
    played, met = np.bincount(i, weights=n, minlength=k), np.bincount(j, weights=n, minlength=k)
    seen = np.flatnonzero((played > 0) | (met > 0))
    off, deff = x[:k][seen] - x[:k][seen].mean(), x[k:-1][seen] - x[k:-1][seen].mean()
    numbers = {"rating_off": 100 * off, "rating_def": 100 * deff, "rating_overall": 100 * (off + deff), "league": np.full(len(seen), 100 * x[-1]), "n_matches": played[seen].astype(np.int64)}
    return {"team": teams.take(pa.array(seen)), **{c: pa.array(v) for c, v in numbers.items()}}


def with_keys(board: dict[str, pa.Array], keys: dict[str, pa.Scalar]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({**{c: pa.repeat(v, len(board["team"])) for c, v in keys.items()}, **board})


def additive_ratings(pairs: DataFrame, by: Sequence[str], ridge: float = 1.0) -> DataFrame:
    """The exact fit of every group at once. A group's rows are bounded by its pairs of teams, not by its matches."""
    ship(pairs.sparkSession)
    keys = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by)
    team = pairs.schema["team"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teams, (i, j, n, s) = coded_pairs(batches)
        yield with_keys(board_of(teams, i, j, n, additive_solve(i, j, n, s, len(teams), ridge)), dict(zip(by, key, strict=True)))

    return pairs.select(*by, "team", "opponent", "n", "s").groupBy(*by).applyInArrow(run, f"{keys}, team {team}, rating_off double, rating_def double, rating_overall double, league double, n_matches long")


def additive_ratings_wide(pairs: DataFrame, ridge: float = 1.0, rounds: int = 40, tolerance: float = 1e-10) -> DataFrame:
    """The same fit for one group of very many teams: conjugate gradient preconditioned by the diagonal.

    Every product with the normal matrix is two joins and two groupings over the pair sums; the
    driver holds a few numbers. Vectors are written with checkpoint() every round.
    """
    with_checkpoints(pairs.sparkSession)
    pairs = pairs.select("team", "opponent", "n", "s").persist()
    total = pairs.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mu0 = total["s"] / total["n"]
    # Unknowns: off of a team, minus def of a team, and the change of mu, each a row (kind, team).
    off = pairs.groupBy("team").agg(F.sum("n").alias("d"), F.sum(F.col("s") - mu0 * F.col("n")).alias("b")).withColumn("kind", F.lit("off"))
    dee = pairs.groupBy(F.col("opponent").alias("team")).agg(F.sum("n").alias("d"), F.sum(F.col("s") - mu0 * F.col("n")).alias("b")).withColumn("kind", F.lit("def"))
    state = off.unionByName(dee).select("kind", "team", (F.col("d") + ridge).alias("d"), F.col("b").alias("r"), F.lit(0.0).alias("x"))
    state = state.withColumn("p", F.col("r") / F.col("d")).checkpoint()
    mu = {"x": 0.0, "r": 0.0, "d": float(total["n"])}
    mu["p"] = mu["r"] / mu["d"]
    rz = state.agg(F.sum(F.col("r") ** 2 / F.col("d"))).first()[0] + mu["r"] ** 2 / mu["d"]
    for _ in range(rounds):
        if rz < tolerance:
            break
        p = state.select("kind", "team", "p")
        each = pairs.join(p.where("kind = 'off'").select("team", F.col("p").alias("po")), "team").join(p.where("kind = 'def'").select(F.col("team").alias("opponent"), F.col("p").alias("pd")), "opponent")
        each = each.withColumn("v", F.col("n") * (F.col("po") + F.col("pd") + mu["p"])).persist()
        ap = each.groupBy("team").agg(F.sum("v").alias("v")).withColumn("kind", F.lit("off")).unionByName(each.groupBy(F.col("opponent").alias("team")).agg(F.sum("v").alias("v")).withColumn("kind", F.lit("def")))
        mu_ap = each.agg(F.sum("v")).first()[0]
        joined = state.join(ap, ["kind", "team"], "left").withColumn("ap", F.coalesce("v", F.lit(0.0)) + ridge * F.col("p")).drop("v")
        alpha = rz / (joined.agg(F.sum(F.col("p") * F.col("ap"))).first()[0] + mu["p"] * mu_ap)
        state = joined.withColumn("x", F.col("x") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("ap")).drop("ap").checkpoint()
        each.unpersist()
        mu["x"] += alpha * mu["p"]
        mu["r"] -= alpha * mu_ap
        new = state.agg(F.sum(F.col("r") ** 2 / F.col("d"))).first()[0] + mu["r"] ** 2 / mu["d"]
        beta, rz = new / rz, new
        state = state.withColumn("p", F.col("r") / F.col("d") + beta * F.col("p"))
        mu["p"] = mu["r"] / mu["d"] + beta * mu["p"]
    wide = state.groupBy("team").agg(F.max(F.when(F.col("kind") == "off", F.col("x"))).alias("o"), F.max(F.when(F.col("kind") == "def", -F.col("x"))).alias("d")).fillna(0.0, subset=["o", "d"])
    mean = wide.agg(F.avg("o").alias("mo"), F.avg("d").alias("md"))
    out = wide.crossJoin(F.broadcast(mean)).select("team", (100 * (F.col("o") - F.col("mo"))).alias("rating_off"), (100 * (F.col("d") - F.col("md"))).alias("rating_def"))  # one row
    return out.withColumn("rating_overall", F.col("rating_off") + F.col("rating_def"))


def ridge_board(ratings: DataFrame, by: Sequence[str], least: int = 5) -> DataFrame:
    """Ratings of teams with enough matches, with their three ranks."""
    out = ratings.where(F.col("n_matches") >= least)
    for c, name in (("rating_overall", "rank_overall"), ("rating_off", "rank_off"), ("rating_def", "rank_def")):
        out = ranked(out, by, c, name)
    return out


BLOCK_WEEKS = 8


def weekly_fits(batches: Iterator[pa.RecordBatch], least: int, ridge: float) -> Iterator[tuple[dt.date, dict[str, pa.Array]]]:
    """Fits for the weeks of a block, each on the pair sums before it and begun at the one before it.

    Rows are pair sums: those without a week are of all weeks before the block, those without n mark the weeks asked for. They are
    kept by week, so that a week's fit is on the first of them.
    """
    marks: set[dt.date] = set()

    def sums() -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks.update(b.filter(pc.is_null(b.column("n"))).column("week_start").to_pylist())
            days = pc.fill_null(b.column("week_start").cast(pa.int32()), -(1 << 31))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("team", "opponent", "n", "s")), days], names=["team", "opponent", "n", "s", "week"]).filter(pc.is_valid(b.column("n")))

    teams, columns = coded_pairs(sums(), ["week"])
    order = np.argsort(columns[-1], kind="stable")
    for c in range(len(columns)):
        columns[c] = columns[c][order]
    i, j, n, s, week = columns
    x = None
    for mark in sorted(marks):
        m = np.searchsorted(week, (mark - dt.date(1970, 1, 1)).days)
        if m and n[:m].sum() >= least:
            x = additive_solve(i[:m], j[:m], n[:m], s[:m], len(teams), ridge, x)
            yield mark, board_of(teams, i[:m], j[:m], n[:m], x)


def walk_forward(sides: DataFrame, season: str, day: str, y: str, least: int = 50, ridge: float = 1.0, block_weeks: int = BLOCK_WEEKS) -> DataFrame:
    """Ratings for every week of a season, fitted on its matches before the week; none where these are fewer than least rows.

    Pair sums are made by week once. A task fits a block of a season's weeks: it gets the sums of all
    weeks before the block, added up by pair, and the block's own by week; its first fit starts from
    nothing and each later one from the one before it. So a season is as many tasks as it has blocks.
    """
    week = F.date_trunc("week", day).cast("date")
    block = F.floor(F.datediff(F.col("week_start"), F.lit("1970-01-05").cast("date")) / (7 * block_weeks)).cast("int")
    asked = sides.where(F.col(season).isNotNull() & F.col(day).isNotNull()).withColumn("week_start", week).withColumn("block", block)
    sums = asked.dropna(subset=["team", "opponent", y]).groupBy(season, "block", "week_start", "team", "opponent").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"))
    weeks = asked.select(season, "block", "week_start").distinct()
    last = weeks.groupBy(season).agg(F.max("block").alias("last"))
    by_block = sums.groupBy(season, "block", "team", "opponent").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(last, season)
    later = by_block.where("block < last").withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("last"))))
    before = later.groupBy(season, "block", "team", "opponent").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("week_start", F.lit(None).cast("date"))
    marks = weeks.select("*", *[F.lit(None).cast(sums.schema[c].dataType).alias(c) for c in ("team", "opponent", "n", "s")])
    team, kind = sums.schema["team"].dataType.simpleString(), sums.schema[season].dataType.simpleString()
    ship(sides.sparkSession)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mark, board in weekly_fits(batches, least, ridge):
            yield with_keys(board, {season: key[0], "week_start": pa.scalar(mark, pa.date32())})

    every = sums.unionByName(before.select(sums.columns)).unionByName(marks.select(sums.columns))
    # Blocks without a match in them still ask for nothing; those without marks have no row.
    asked_blocks = every.join(weeks.select(season, "block").distinct(), [season, "block"], "left_semi")
    return asked_blocks.groupBy(season, "block").applyInArrow(run, f"{season} {kind}, week_start date, team {team}, rating_off double, rating_def double, rating_overall double, league double, n_matches long")


def schedule_strength(sides: DataFrame, ratings: DataFrame, by: Sequence[str], rating: str) -> DataFrame:
    """Mean rating of rated opponents and how many matches that covers."""
    opp = ratings.select(*by, F.col("team").alias("opponent"), F.col(rating).alias("_r"))
    return sides.join(opp, [*by, "opponent"]).groupBy(*by, "team").agg(F.avg("_r").alias("sos"), F.count(F.lit(1)).alias("sos_matches"))


def composite(rows: DataFrame, by: Sequence[str], base: str, weights: dict[str, float]) -> DataFrame:
    """Weighted z-scores on the scale of base; a missing part counts as base's z."""
    for c in weights:
        rows = z_scores(rows, by, c, f"_z_{c}")
    z = sum((w * F.coalesce(f"_z_{c}", f"_z_{base}") for c, w in weights.items()), F.lit(0.0))
    rows = rows.withColumn("rating_composite", z * F.stddev_samp(base).over(Window.partitionBy(*by))).drop(*[f"_z_{c}" for c in weights])
    return ranked(rows, by, "rating_composite", "rank_composite")


def rpi(sides: DataFrame, by: Sequence[str]) -> DataFrame:
    """25 % own win share, 50 % opponents' without their games against the team, 25 % opponents' opponents'."""
    rec = sides.groupBy(*by, "team").agg(F.sum("won").alias("w"), F.count(F.lit(1)).alias("n"))
    h2h = sides.groupBy(*by, "team", "opponent").agg(F.sum("won").alias("hw"), F.count(F.lit(1)).alias("hn"))
    # An opponent's games against us: our games against it, seen from its side.
    opp = rec.select(*by, F.col("team").alias("opponent"), F.col("w").alias("ow"), F.col("n").alias("on"))
    pairs = h2h.join(opp, [*by, "opponent"]).withColumn("wp", F.try_divide(F.col("ow") - (F.col("hn") - F.col("hw")), F.nullif(F.col("on") - F.col("hn"), F.lit(0))))
    mean = lambda x: F.sum(F.col(x) * F.col("hn")) / F.sum(F.when(F.col(x).isNotNull(), F.col("hn")))
    owp = pairs.groupBy(*by, "team").agg(mean("wp").alias("owp"))
    second = h2h.join(owp.select(*by, F.col("team").alias("opponent"), F.col("owp").alias("x")), [*by, "opponent"], "left").groupBy(*by, "team").agg(mean("x").alias("oowp"))
    out = rec.select(*by, "team", (F.col("w") / F.col("n")).alias("wp")).join(owp, [*by, "team"]).join(second, [*by, "team"])
    out = out.withColumn("rpi", 0.25 * F.col("wp") + 0.5 * F.col("owp") + 0.25 * F.col("oowp"))
    return ranked(out, by, "rpi", "rpi_rank")


def champions(played: DataFrame, scheduled: DataFrame | None, ratings: DataFrame, by: Sequence[str], conf: str, rating: str) -> DataFrame:
    """The team of each conference with the largest share of wins so far and chances left, ties by rating, then name.

    played and scheduled: two-sided rows of conference games with won, or the chance p.
    """
    rows = played.select(*by, conf, "team", F.col("won").cast("double").alias("x"))
    if scheduled is not None:
        rows = rows.unionByName(scheduled.select(*by, conf, "team", F.col("p").cast("double").alias("x")))
    pct = rows.groupBy(*by, conf, "team").agg(F.avg("x").alias("conf_pct")).join(ratings.select(*by, "team", rating), [*by, "team"], "left")
    w = Window.partitionBy(*by, conf).orderBy(F.desc("conf_pct"), F.desc_nulls_last(rating), "team")
    return pct.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def field(teams: DataFrame, by: Sequence[str], order: str, auto: str, size: int = 64) -> DataFrame:
    """The automatic teams and the best of the others up to size, with overall (their place by order)."""
    at = Window.partitionBy(*by, auto).orderBy(F.desc_nulls_last(order), "team")
    n_auto = F.count_if(F.col(auto)).over(Window.partitionBy(*by))
    rows = teams.withColumn("_n", n_auto).withColumn("_r", F.row_number().over(at)).where(F.col(auto) | (F.col("_r") <= size - F.col("_n")))
    return rows.withColumn("overall", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(order), "team"))).drop("_n", "_r")


# The seeds of a region's eight pairs in bracket order are those of the first line of each pair.
REGION_SEEDS = (1, 16, 8, 9, 5, 12, 4, 13, 6, 11, 3, 14, 7, 10, 2, 15)


def slot(overall: Column) -> Column:
    """Bracket slot 0..63 of a place 1..64: the first 32 in a snake over four regions by seed line, 33 to 64 opposite 32 to 1."""
    seeded = F.when(overall <= 32, overall - 1).otherwise(64 - overall).cast("int")
    line, k = F.floor(seeded / 4).cast("int"), seeded % 4
    region = F.when(line % 2 == 0, k).otherwise(3 - k)
    at = F.array_position(F.array(*map(F.lit, REGION_SEEDS)), line + 1) - 1
    return (region * 16 + at + F.when(overall <= 32, 0).otherwise(1)).cast("long")


def run_summary(runs: DataFrame, by: Sequence[str], rounds: int = 6) -> DataFrame:
    """Shares of runs in which a team is in the field, automatic, a host (overall up to 16), a first seed, and reaches each round."""
    sims = runs.groupBy(*[c for c in by if c != "team"]).agg(F.countDistinct("sim").alias("sims"))
    counts = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("auto")).alias("autos"), F.avg("overall").alias("mean_overall"), F.count_if(F.col("overall") <= 16).alias("hosts"), F.count_if(F.col("seed") == 1).alias("firsts"),
        *[F.count_if(F.col("reached") >= k).alias(f"r{k}") for k in range(1, rounds + 1)],
    )
    joined = counts.join(sims, [c for c in by if c != "team"]) if len(by) > 1 else counts.crossJoin(F.broadcast(sims))
    share = lambda c, name: (F.col(c) / F.col("sims")).alias(name)
    return joined.select(*by, share("n", "p_field"), share("autos", "p_auto"), "mean_overall", share("hosts", "p_host"), share("firsts", "p_1seed"), *[share(f"r{k}", f"p_reached{k}") for k in range(1, rounds + 1)])


