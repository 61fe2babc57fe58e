"""Match chances: logistic fits, validation, scorelines, projections, win distributions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import lerp, sigmoid
from .contests import first_of


@dataclass(frozen=True)
class LogisticModel:
    """A fit: which of the features it uses, and the fold that it does not see (none: it sees all rows)."""

    name: str
    uses: tuple[int, ...]
    held_out: object = None


def logistic_fits(rows: DataFrame, features: Sequence[Column], y: str, models: Sequence[LogisticModel], fold: Column | None = None, rounds: int = 30, tolerance: float = 1e-10) -> list[list[float]]:
    """Weights of 1 and of all features (0 where unused) for each model, by Newton's method.

    One aggregate a round carries gradient and curvature of every model that still moves; each row meets each
    of these, in the task that reads it, and what is shuffled is a row for each model and task. Rows
    without y or without a feature that a model uses are not its own.
    """
    k, width = len(features), len(features) + 1
    data = rows.select(*[c.cast("double").alias(f"x{i + 1}") for i, c in enumerate(features)], F.col(y).cast("double").alias("y"), (fold if fold is not None else F.lit(0)).alias("fold"))
    data = data.where("y is not null").withColumn("x0", F.lit(1.0)).persist()
    beta, moving = np.zeros((len(models), width)), list(range(len(models)))
    try:
        for _ in range(rounds):
            if not moving:
                break
            asked = F.array(*[
                F.struct(F.lit(m).alias("m"), F.lit(models[m].held_out).alias("out"), F.array(*map(F.lit, beta[m].tolist())).alias("b"), F.array(*[F.lit(i in models[m].uses) for i in range(k)]).alias("uses"))
                for m in moving
            ])
            each = data.select("*", F.explode(asked).alias("of"))
            seen = F.lit(True)
            for i in range(k):
                seen = seen & (~F.col("of.uses")[i] | F.col(f"x{i + 1}").isNotNull())
            if fold is not None:
                seen = seen & F.col("fold").isNotNull() & (F.col("of.out").isNull() | (F.col("fold") != F.col("of.out")))
            x = ["x0", *[f"x{i + 1}" for i in range(k)]]
            each = each.where(seen).withColumns({f"x{i + 1}": F.when(F.col("of.uses")[i], F.col(f"x{i + 1}")).otherwise(0.0) for i in range(k)})
            each = each.withColumn("p", sigmoid(sum((F.col("of.b")[i] * F.col(c) for i, c in enumerate(x)), F.lit(0.0)))).withColumn("v", F.col("p") * (1 - F.col("p")))
            sums = each.groupBy("of.m").agg(
                *[F.sum(F.col(c) * (F.col("y") - F.col("p"))).alias(f"g{i}") for i, c in enumerate(x)],
                *[F.sum(F.col(x[i]) * F.col(x[j]) * F.col("v")).alias(f"h{i}_{j}") for i in range(width) for j in range(i, width)],
            ).collect()  # a row for each model
            still = []
            for r in sums:
                m = r["m"]
                own = [0, *[i + 1 for i in models[m].uses]]
                h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in own] for i in own]) + 1e-9 * np.eye(len(own))
                step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in own]))
                beta[m, own] += step
                if np.abs(step).max() >= tolerance:
                    still.append(m)
            moving = sorted(still)
    finally:
        data.unpersist()
    return beta.tolist()


def logistic_fit(rows: DataFrame, features: Sequence[Column], y: str, rounds: int = 30, tolerance: float = 1e-10) -> list[float]:
    """Weights of 1 and the features by Newton's method: one distributed aggregate and one small solve a round."""
    return logistic_fits(rows, features, y, [LogisticModel("all", tuple(range(len(features))))], None, rounds, tolerance)[0]


def chance(features: Sequence[Column], weights: Sequence[float]) -> Column:
    return sigmoid(sum((float(w) * c for w, c in zip(weights[1:], features, strict=True)), F.lit(float(weights[0]))))


def leave_one_out(rows: DataFrame, fold: str, folds: Sequence, specs: dict[str, Sequence[str]], features: dict[str, Column], y: str) -> DataFrame:
    """Rows of every fold, once for each spec, with the chance that the spec gives them when fitted on the other folds: spec, p.

    features: the columns that specs name. All folds and specs are fitted together.
    """
    names = list(features)
    models = [LogisticModel(spec, tuple(names.index(c) for c in used), f) for f in folds for spec, used in specs.items()]
    weights = logistic_fits(rows, list(features.values()), y, models, F.col(fold))
    fitted = F.array(*[F.struct(F.lit(m.held_out).alias("fold"), F.lit(m.name).alias("spec"), F.array(*map(F.lit, w)).alias("w")) for m, w in zip(models, weights, strict=True)])
    own = F.explode(F.filter(fitted, lambda m: m["fold"] == F.col(fold)))
    z = F.col("_of.w")[0] + sum((F.when(F.col("_of.w")[i + 1] != 0, F.col("_of.w")[i + 1] * c).otherwise(0.0) for i, c in enumerate(features.values())), F.lit(0.0))
    return rows.withColumn("_of", own).withColumn("spec", F.col("_of.spec")).withColumn("p", sigmoid(z)).drop("_of")


def prematch_features(matches: DataFrame, elo: DataFrame, weekly: DataFrame, season: str = "season", day: str = "day") -> DataFrame:
    """matches with both sides' ratings from before the match: elo_home, elo_away of a replay's log, and ridge_home, ridge_away as fitted before the match's week.

    A team that the week's fit does not know, as in a season's first week, is average: 0.
    """
    out = matches.join(elo.select("match", "elo_home", "elo_away"), "match").withColumn("week_start", F.date_trunc("week", day).cast("date"))
    for side in ("home", "away"):
        known = weekly.select(season, "week_start", F.col("team").alias(side), F.col("rating_overall").alias(f"ridge_{side}"))
        out = out.join(known, [season, "week_start", side], "left").withColumn(f"ridge_{side}", F.coalesce(f"ridge_{side}", F.lit(0.0)))
    return out.drop("week_start")


SPECS = {"elo": ("elo",), "ridge": ("ridge",), "blend": ("elo", "ridge")}


def rating_gaps() -> dict[str, Column]:
    """The features of SPECS: weights read by 100 points of Elo and by 10 points of the ridge rating."""
    return {"elo": (F.col("elo_home") - F.col("elo_away")) / 100, "ridge": (F.col("ridge_home") - F.col("ridge_away")) / 10}


def scorelines(rows: DataFrame, p: str, home_sets: str, away_sets: str, bin_no: Column, win: int = 3) -> DataFrame:
    """Shares of the six results by bin of the favourite's chance; bin_no is built on column fav."""
    home = F.col(p) >= 0.5
    t = rows.select(F.when(home, F.col(p)).otherwise(1 - F.col(p)).alias("fav"), F.when(home, F.col(home_sets)).otherwise(F.col(away_sets)).alias("fs"), F.when(home, F.col(away_sets)).otherwise(F.col(home_sets)).alias("ds"))
    t = t.where((F.col("fs") == win) | (F.col("ds") == win))
    share = lambda a, b, name: F.avg(((F.col(a) == win) & (F.col(b) == int(name[-1]))).cast("double")).alias(name)
    return t.groupBy(bin_no.alias("bin")).agg(F.avg("fav").alias("p_fav"), F.count(F.lit(1)).alias("n"), *[share("fs", "ds", f"fav_{win}_{k}") for k in range(win)], *[share("ds", "fs", f"dog_{win}_{k}") for k in range(win)])


def pair_scorelines(pairs: DataFrame, table: DataFrame, p: str, columns: Sequence[str]) -> DataFrame:
    """Scorelines of pairs by linear interpolation between the two neighbouring rows of a scoreline table, clamped at its ends.

    The table has a row for each bin (as many as bins, so it is broadcast).
    """
    rows = F.broadcast(table.agg(F.array_sort(F.collect_list(F.struct("p_fav", *columns))).alias("t")))
    fav = F.greatest(F.col(p), 1 - F.col(p))
    at = F.aggregate("t", F.lit(0), lambda n, r: n + (r["p_fav"] <= fav).cast("int"))
    lo, hi = F.get("t", F.greatest(F.lit(0), F.col("_i") - 1)), F.get("t", F.least(F.size("t") - 1, F.col("_i")))
    out = pairs.crossJoin(rows).withColumn("_i", at)  # one row
    return out.select(*pairs.columns, *[lerp(fav, lo["p_fav"], hi["p_fav"], lo[c], hi[c]).alias(c) for c in columns])


LINES = [f"{a}_3_{k}" for a in ("fav", "dog") for k in (0, 1, 2)]


def predicted_pairs(pairs: DataFrame, ratings: DataFrame, models: dict[str, Sequence[float]], table: DataFrame) -> DataFrame:
    """Chances of pairs under several models, with scorelines that add up to them and both sides' projected side-out.

    pairs: a, b and venue (1: a is at home, -1: b is, 0: neither). ratings: team, elo, rating_overall, rating_off, rating_def, league.
    models: name to weights of venue, of 100 points of Elo and of 10 points of the ridge rating, 0 for what it leaves out. table: a
    scoreline table. A row for each pair and model: model, p_a; a_3_0 to b_3_2, the shares of results of favourites as
    large as this one, the favourite's three scaled to its chance and the other's to the rest; five_sets; sideout_a and sideout_b, which
    no model or venue moves. Pairs with a team without one of the ratings have no row.
    """
    known = ratings.dropna(subset=["elo", "rating_overall"])
    of = lambda side: known.select(F.col("team").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("elo", "rating_overall", "rating_off", "rating_def", "league")])
    x = pairs.join(of("a"), "a").join(of("b"), "b")
    weights = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), *[F.lit(float(v)).alias(f"w{i}") for i, v in enumerate(w)]) for name, w in models.items()]))
    z = lambda m: m["w0"] * F.col("venue") + m["w1"] * (F.col("elo_a") - F.col("elo_b")) / 100 + m["w2"] * (F.col("rating_overall_a") - F.col("rating_overall_b")) / 10
    x = x.withColumn("_m", weights).withColumn("p_a", sigmoid(z(F.col("_m")))).withColumn("model", F.col("_m.name")).drop("_m")
    x = pair_scorelines(x, table, "p_a", LINES)
    fav = F.greatest("p_a", 1 - F.col("p_a"))
    share = lambda side, k: F.try_divide(F.col(f"{side}_3_{k}") * (fav if side == "fav" else 1 - fav), sum((F.col(f"{side}_3_{j}") for j in range(3)), F.lit(0.0)))
    ahead = F.col("p_a") >= 0.5
    sets = {f"{team}_3_{k}": F.when(ahead == (team == "a"), share("fav", k)).otherwise(share("dog", k)) for team in ("a", "b") for k in range(3)}
    out = x.withColumns(sets)
    sideout = lambda own, other: F.col(f"league_{own}") + F.col(f"rating_off_{own}") - F.col(f"rating_def_{other}")
    return out.select(*pairs.columns, "model", "p_a", *sets, (F.col("a_3_2") + F.col("b_3_2")).alias("five_sets"), sideout("a", "b").alias("sideout_a"), sideout("b", "a").alias("sideout_b"))


def win_distribution(rows: DataFrame, by: Sequence[str], p: str, order: str) -> DataFrame:
    """Distribution of wins in independent games (Poisson-binomial): dist, mean, q10, q90, win_out.

    A group's games are one array, as a season's games of a team are.
    """
    ps = F.transform(F.array_sort(F.collect_list(F.struct(order, p))), lambda x: x[p])
    add = lambda d, q: F.zip_with(F.concat(F.transform(d, lambda v: v * (1 - q)), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(d, lambda v: v * q)), lambda a, b: a + b)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("games"), F.sum(p).alias("mean"), ps.alias("ps")).withColumn("dist", F.aggregate("ps", F.array(F.lit(1.0)), add))
    below = lambda q: F.aggregate("dist", F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")), lambda s, v: F.struct((s["sum"] + v).alias("sum"), (s["n"] + (s["sum"] + v < q - 1e-12).cast("long")).alias("n")))["n"]
    return out.select(*by, "games", "mean", "dist", below(0.1).alias("q10"), below(0.9).alias("q90"), F.element_at("dist", -1).alias("win_out"))


def project(schedule: DataFrame, played: DataFrame, ratings: DataFrame, values: Sequence[str], last_day: Column, fallback: float = 0.05) -> DataFrame:
    """Unplayed games from last_day on, once each, with both sides' ratings; a missing rating is the fallback quantile of all, flagged where a team has none at all."""
    games = schedule.where(F.col("day") >= last_day).join(played.select("day", "home", "away").distinct(), ["day", "home", "away"], "left_anti").dropDuplicates(["day", "home", "away"])
    low = F.broadcast(ratings.agg(*[F.percentile(v, F.lit(fallback)).alias(f"_low_{v}") for v in values]))  # one row
    out = games.crossJoin(low)
    for side in ("home", "away"):
        known = ratings.select(F.col("team").alias(side), *[F.col(v).alias(f"{v}_{side}") for v in values])
        out = out.join(known, side, "left").withColumn(f"_none_{side}", F.coalesce(*[F.col(f"{v}_{side}").cast("string") for v in values]).isNull())
        out = out.withColumns({f"{v}_{side}": F.coalesce(f"{v}_{side}", f"_low_{v}") for v in values})
    return out.withColumn("fallback", F.col("_none_home") | F.col("_none_away")).drop("_none_home", "_none_away", *[f"_low_{v}" for v in values])


def with_chances(games: DataFrame, weights: Sequence[float], gaps: Sequence[Column]) -> DataFrame:
    """Projected games with p_home, the chance by fitted weights: of the home side, then of each gap."""
    z = F.lit(float(weights[0]))
    for w, gap in zip(weights[1:], gaps, strict=True):
        z = z + w * gap
    return games.withColumn("p_home", 1 / (1 + F.exp(-z)))


def unrated(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """Teams of the games that no rating is known of."""
    teams = games.select(F.explode(F.array("home", "away")).alias("team")).distinct()
    return teams.join(ratings.select("team"), "team", "left_anti")


def forecast_hits(rows: DataFrame, by: Sequence[str], p: str, hit: Column, n: int) -> DataFrame:
    """Of the n likeliest by p in each group, how many are hits; all hits, their mean p, and the Brier skill against the same chance for all of the field.

    rows: in_field tells who could be picked in hindsight.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(p), "team"))
    y = F.coalesce(hit, F.lit(False)).cast("double")
    x = rows.withColumn("_y", y).withColumn("_place", place).withColumn("_size", F.count_if("in_field").over(Window.partitionBy(*by)))
    even = F.when(F.col("in_field"), n / F.col("_size")).otherwise(0.0)
    return x.groupBy(*by).agg(
        F.count_if((F.col("_place") <= n) & (F.col("_y") == 1)).alias("hits"), F.sum("_y").cast("long").alias("of"), F.avg(F.when(F.col("_y") == 1, F.col(p))).alias("mean_p"),
        (1 - F.try_divide(F.sum((F.col(p) - F.col("_y")) ** 2), F.sum((even - F.col("_y")) ** 2))).alias("brier_skill"),
    )


def one_bid_leagues(rows: DataFrame, by: Sequence[str], conf: str, p: str) -> DataFrame:
    """Leagues with one team in the field, and how many of their likeliest champions by p were that team."""
    likeliest = F.max_by("in_field", F.struct(F.col(p), -F.col("team"))).alias("right")
    leagues = rows.groupBy(*by, conf).agg(F.count_if("in_field").alias("bids"), likeliest).where("bids = 1")
    return leagues.groupBy(*by).agg(F.count(F.lit(1)).alias("one_bid_leagues"), F.count_if("right").alias("one_bid_right"))


def title_odds(rows: DataFrame, by: Sequence[str], p_title: str, p_round: str, reached: Column, champion: Column) -> DataFrame:
    """The champion's rank by title odds, and the sum of title odds given the round of those who reached it."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(F.desc(p_title)))
    given = F.when(reached & (F.col(p_round) > 0), F.col(p_title) / F.col(p_round))
    return rows.withColumn("_rank", rank).groupBy(*by).agg(F.min(F.when(champion, F.col("_rank"))).alias("champion_rank"), F.sum(given).alias("title_given_round"))


def once(rows: DataFrame, day: str, a: str, b: str, order: Sequence[str]) -> DataFrame:
    """Matches once by day and unordered pair."""
    keyed = rows.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)})
    return first_of(keyed, [day, "_lo", "_hi"], order).drop("_lo", "_hi")


def persistence(rows: DataFrame, by: Sequence[str], order: Sequence[str], p: str, won: str, least: int = 16) -> DataFrame:
    """Whether the residual of wins over chances carries on: correlation of odd with even games and of halves, sd of z, share beyond 2."""
    from .sequence import alternating

    t = alternating(rows.withColumn("resid", F.col(won) - F.col(p)), by, order)
    part = lambda c, v: F.avg(F.when(F.col(c) == v, F.col("resid")))
    g = t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), part("parity", 1).alias("odd"), part("parity", 0).alias("even"), part("half", 0).alias("h1"), part("half", 1).alias("h2"), F.sum("resid").alias("d"), F.sum(F.col(p) * (1 - F.col(p))).alias("v")).where(F.col("n") >= least)
    z = F.col("d") / F.sqrt("v")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.corr("odd", "even").alias("odd_even"), F.corr("h1", "h2").alias("halves"), F.stddev_samp(z).alias("z_sd"), F.avg((F.abs(z) > 2).cast("double")).alias("beyond_2sd"))
