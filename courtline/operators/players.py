"""Player ratings: identity, opponent effects, percentiles against references, reliability, errors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved_rows, ship
from .sequence import alternating


def majority(rows: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """The value with the largest weight of each group, ties to the least value."""
    sums = rows.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    best = sums.groupBy(*by).agg(F.max("_w").alias("_most"))
    return sums.join(best, list(by)).where("_w = _most").groupBy(*by).agg(F.min(value).alias(value))


def medians(rows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Threshold of each metric by group: its median; few is true below 50 values."""
    each = rows.unpivot(list(by), list(metrics), "metric", "value").where("value is not null")
    return each.groupBy(*by, "metric").agg(F.percentile("value", F.lit(0.5)).alias("threshold"), (F.count(F.lit(1)) < 50).alias("few"))


def split_by_share(rows: DataFrame, by: Sequence[str], value: str, reference: Column, q: float = 0.37, fallback: float = 1.5, least: int = 100) -> DataFrame:
    """high: whether value reaches the group's q-quantile over the reference rows (a fallback if these are fewer than least)."""
    cut = rows.where(reference).groupBy(*by).agg(F.when(F.count(F.lit(1)) >= least, F.percentile(value, F.lit(q))).otherwise(fallback).alias("cut"))
    return rows.join(cut, list(by), "left").withColumn("cut", F.coalesce("cut", F.lit(fallback))).withColumn("high", F.col(value) >= F.col("cut"))


#: Rows of opponents that may be broadcast in a round.
BROADCAST_ROWS = 500_000
#: Pairs of a group whose rounds one task does: about 24 bytes each, and 50 while they arrive.
GROUP_PAIRS = 1 << 23
#: Pairs that are added up at once in such a task.
PAIRS_AT_ONCE = 1 << 18


def effect_pairs(rows: DataFrame, by: Sequence[str], player: str, opponent: str, w: str, y: str, least: int) -> DataFrame:
    """Sums of weight and of weight times rate by group, player and opponent; groups of fewer than least rows are left out."""
    known = rows.where((F.col(w) > 0) & F.col(y).isNotNull())
    pairs = known.groupBy(*by, F.col(player).alias("player"), F.col(opponent).alias("opponent")).agg(F.sum(w).alias("w"), F.sum(F.col(w) * F.col(y)).alias("wy"), F.count(F.lit(1)).alias("n"))
    if not least:
        return pairs.drop("n")
    size = pairs.groupBy(*by).agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return pairs.drop("n").join(size, list(by), "left_semi")


def opponent_effects(rows: DataFrame, by: Sequence[str], player: str, opponent: str, w: str, y: str, ridge_k: float = 0.5, rounds: int = 40, checkpoint_every: int = 5, least: int = 0, tolerance: float = 1e-13) -> tuple[DataFrame, DataFrame]:
    """rate = mu + player - opponent by alternating weighted means; a ridge of ridge_k times the mean opponent weight on opponents.

    Groups of any size: pairs are summed up and written once; a group of at most GROUP_PAIRS of them has all its rounds in one task, the
    groups beyond it go round by round as joins (rounds_by_join). Gives players (adjusted value) and opponents (effect).
    """
    keys = list(by)
    sums = saved_rows(effect_pairs(rows, keys, player, opponent, w, y, least), "pairs")
    large = saved_rows(sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_PAIRS).drop("_n"), "large")
    none_large = large.isEmpty()
    fits = effects_in_tasks(sums if none_large else sums.join(large, keys, "left_anti"), keys, ridge_k, rounds)
    players = fits.where("not against").select(*keys, "player", F.col("value").alias("value_adj"))
    opponents = fits.where("against").select(*keys, "opponent", F.col("value").alias("effect"))
    if none_large:
        return players, opponents
    p, o = rounds_by_join(sums.join(large, keys, "left_semi"), keys, ridge_k, rounds, checkpoint_every, tolerance)
    return players.unionByName(p), opponents.unionByName(o)


def rounds_by_join(sums: DataFrame, keys: list[str], ridge_k: float, rounds: int, checkpoint_every: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The effects of groups of any size from their pair sums, all groups at once.

    Pairs lie by group and player and stay there: a round adds the
    opponents' effects to them (a table of opponents, broadcast while it is small), averages by player in place, and shuffles
    sums by opponent only. Effects are written every few rounds; groups in which none moved by more than tolerance
    (of the largest effect) since then are done and leave the loop.
    """
    mu = sums.groupBy(*keys).agg((F.sum("wy") / F.sum("w")).alias("mu"))
    pairs = saved_rows(sums.join(mu, keys).withColumn("wr", F.col("wy") - F.col("w") * F.col("mu")).drop("wy"), "centred-pairs")
    weight = pairs.groupBy(*keys, "opponent").agg(F.sum("w").alias("ow"))
    ridge = weight.groupBy(*keys).agg((ridge_k * F.avg("ow")).alias("ridge"))
    # o: an opponent's effect; o1: that of the round before, from which the players follow.
    state = saved_rows(weight.join(ridge, keys).select(*keys, "opponent", (F.col("ow") + F.col("ridge")).alias("ow"), F.lit(0.0).alias("o"), F.lit(0.0).alias("o1")), "effects")
    near = F.broadcast if state.count() <= BROADCAST_ROWS else (lambda df: df)
    here = Window.partitionBy(*keys, "player")
    laid, done, n = pairs.repartition(*keys, "player").persist(), [], rounds
    try:
        while n > 0:
            now = state
            for _ in range(min(checkpoint_every, n)):
                each = laid.join(near(now.select(*keys, "opponent", "ow", "o")), [*keys, "opponent"]).withColumn("p", F.sum(F.col("wr") + F.col("w") * F.col("o")).over(here) / F.sum("w").over(here))
                now = each.groupBy(*keys, "opponent").agg(F.first("ow").alias("ow"), (F.sum(F.col("w") * F.col("p") - F.col("wr")) / F.first("ow")).alias("o"), F.first("o").alias("o1"))
            n -= min(checkpoint_every, n)
            state = saved_rows(now, "effects")
            still = saved_rows(state.groupBy(*keys).agg((F.max(F.abs(F.col("o") - F.col("o1"))) <= tolerance * F.max(F.abs("o"))).alias("_still")).where("_still").select(*keys), "still")
            if n and not still.isEmpty():
                done.append(state.join(still, keys, "left_semi"))
                state = saved_rows(state.join(still, keys, "left_anti"), "effects")
                if state.isEmpty():
                    break
                laid.unpersist()
                laid = saved_rows(laid.join(still, keys, "left_anti"), "pairs").repartition(*keys, "player").persist()
    finally:
        laid.unpersist()
    for df in done:
        state = state.unionByName(df)
    players = pairs.join(near(state.select(*keys, "opponent", "o1")), [*keys, "opponent"]).groupBy(*keys, "player").agg((F.first("mu") + F.sum(F.col("wr") + F.col("w") * F.col("o1")) / F.sum("w")).alias("value_adj"))
    return players, state.select(*keys, "opponent", F.col("o").alias("effect"))


def effects_in_tasks(pairs: DataFrame, by: Sequence[str], ridge_k: float, rounds: int) -> DataFrame:
    """Players' values (against is false) and opponents' effects (true) of pair sums, a group's rounds in one task, over arrays of its pairs."""
    ship(pairs.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c) for c in ("player", "opponent", "w", "wy")] for b in batches]
        coded = [pa.chunked_array([x[n] for x in parts]).combine_chunks().dictionary_encode(null_encoding="encode") for n in (0, 1)]
        weight, r = (np.concatenate([x[n].cast(pa.float64()).to_numpy(zero_copy_only=False) for x in parts]) for n in (2, 3))
        del parts
        players, opponents = (c.dictionary for c in coded)
        i, j = (c.indices.to_numpy(zero_copy_only=False) for c in coded)
        some = [slice(lo, lo + PAIRS_AT_ONCE) for lo in range(0, len(i), PAIRS_AT_ONCE)]
        total = lambda at, size, value: sum((np.bincount(at[c], weights=value(c), minlength=size) for c in some), np.zeros(size))
        mu = r.sum() / weight.sum()
        r -= weight * mu
        pw, ow = total(i, len(players), lambda c: weight[c]), total(j, len(opponents), lambda c: weight[c])
        ridge, p, o = ridge_k * ow.mean(), np.zeros(len(players)), np.zeros(len(opponents))
        for _ in range(rounds):
            p = total(i, len(players), lambda c: r[c] + weight[c] * o[j[c]]) / pw
            o = total(j, len(opponents), lambda c: weight[c] * p[i[c]] - r[c]) / (ow + ridge)
        for against, names, values in ((False, players, mu + p), (True, opponents, o)):
            n = len(names)
            own = [names, pa.nulls(n, opponents.type)] if not against else [pa.nulls(n, players.type), names]
            yield pa.RecordBatch.from_arrays([*(pa.repeat(k, n) for k in key), pa.repeat(against, n), *own, pa.array(values)], names=[*by, "against", "player", "opponent", "value"])

    kinds = ", ".join(f"{c} {types[c]}" for c in by)
    return pairs.select(*by, "player", "opponent", "w", "wy").groupBy(*by).applyInArrow(run, f"{kinds}, against boolean, player {types['player']}, opponent {types['opponent']}, value double")


def opponent_effects_grouped(rows: DataFrame, by: Sequence[str], player: str, opponent: str, w: str, y: str, ridge_k: float = 0.5, rounds: int = 40, least: int = 0) -> DataFrame:
    """Adjusted values as by opponent_effects, each group's rounds in one task over its sums by pair; for groups whose pairs fit a task."""
    pairs = effect_pairs(rows, by, player, opponent, w, y, least)
    return effects_in_tasks(pairs, by, ridge_k, rounds).where("not against").select(*by, "player", F.col("value").alias("value_adj"))


def percentile_against(targets: DataFrame, reference: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """pct: 100 times the share of the group's reference values strictly below value; null for null values and groups without references.

    Reference values are counted by distinct value first, so a group's sort is over those.
    """
    refs = reference.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    asked = targets.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")).distinct().withColumn("_n", F.lit(None).cast("long"))
    w = Window.partitionBy(*by).orderBy("_v", F.asc_nulls_first("_n")).rowsBetween(Window.unboundedPreceding, -1)
    steps = refs.unionByName(asked).withColumn("_below", F.coalesce(F.sum("_n").over(w), F.lit(0))).where("_n is null").drop("_n")
    size = refs.groupBy(*by).agg(F.sum("_n").alias("_size"))
    steps = steps.join(size, list(by), "left").select(*by, F.col("_v").alias(value), (100.0 * F.col("_below") / F.col("_size")).alias("pct"))
    return targets.join(steps, [*by, value], "left")


def rating_of(pcts: DataFrame, by: Sequence[str], higher: Column) -> DataFrame:
    """Mean of the percentiles of non-null metrics, turned where lower is better."""
    return pcts.groupBy(*by).agg(F.avg(F.when(higher, F.col("pct")).otherwise(100 - F.col("pct"))).alias("rating"), F.count("pct").alias("n_metrics"))


def with_bonus(rows: DataFrame, group: Column, met: Column, weight: float = 0.10, benchmarks: int = 4) -> DataFrame:
    """A group's rating with a bonus for those who meet a benchmark, rescaled to stay within 100."""
    bonus = round(weight / benchmarks * 100, 2)
    add = F.when(F.coalesce(met, F.lit(False)), bonus).otherwise(0.0)
    return rows.withColumn("rating", F.when(group, (F.col("rating") + add) / (1 + bonus / 100)).otherwise(F.col("rating")))


def halves(rows: DataFrame, entity: Sequence[str], order: Sequence[str], num: str, den: str, floor: float) -> DataFrame:
    """a and b: the rate in even and odd matches of each entity, where both denominators reach floor."""
    t = alternating(rows, entity, order)
    part = lambda c, v: F.sum(F.when(F.col("parity") == v, F.col(c)))
    g = t.groupBy(*entity).agg(*[part(c, v).alias(f"{c[:3]}_{v}") for c in (num, den) for v in (0, 1)])
    rates = [F.when(F.col(f"{den[:3]}_{v}") >= floor, F.col(f"{num[:3]}_{v}") / F.col(f"{den[:3]}_{v}")) for v in (0, 1)]
    return g.select(*entity, rates[0].alias("a"), rates[1].alias("b")).dropna()


def average_rank(value: str, by: Sequence[str]) -> Column:
    """Mean rank of ties."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def reliability(both: DataFrame, by: Sequence[str], least: int = 30) -> DataFrame:
    """Spearman correlation of the two halves and its full-length estimate, for groups of at least `least`."""
    r = both.withColumn("ra", average_rank("a", by)).withColumn("rb", average_rank("b", by))
    out = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("split_half")).where(F.col("n") >= least)
    return out.withColumn("full_estimate", 2 * F.col("split_half") / (1 + F.col("split_half")))


def rating_error(both: DataFrame, bucket: Column) -> DataFrame:
    """Half the sample deviation of the halves' differences, by bucket."""
    return both.groupBy(bucket.alias("bucket")).agg((F.stddev_samp(F.col("a") - F.col("b")) / 2).alias("rating_se"), F.count(F.lit(1)).alias("n"))


def residual_adjusted(rows: DataFrame, by: Sequence[str], y: str, x: str, name: str, least: int = 200) -> DataFrame:
    """y moved along its regression on x to the group's mean x; y itself where a group has fewer than least pairs."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    fit = rows.groupBy(*by).agg(F.regr_slope(F.when(both, F.col(y)), F.when(both, F.col(x))).alias("_b"), F.avg(F.when(both, F.col(x))).alias("_m"), F.count_if(both).alias("_n"))
    moved = F.col(y) - F.col("_b") * (F.col(x) - F.col("_m"))
    return rows.join(fit, list(by), "left").withColumn(name, F.when((F.col("_n") >= least) & moved.isNotNull(), moved).otherwise(F.col(y))).drop("_b", "_m", "_n")


def controlled_slope(rows: DataFrame, by: Sequence[str], y: str, x: str, control: str) -> DataFrame:
    """The coefficient of x in y ~ 1 + x + control, from covariances: one grouping."""
    g = rows.dropna(subset=[y, x, control]).groupBy(*by).agg(
        F.covar_pop(x, y).alias("xy"), F.covar_pop(control, y).alias("cy"), F.covar_pop(x, control).alias("xc"), F.var_pop(x).alias("xx"), F.var_pop(control).alias("cc"), F.avg(x).alias("mean_x"), F.count(F.lit(1)).alias("n"),
    )
    return g.select(*by, "n", "mean_x", F.try_divide(F.col("xy") * F.col("cc") - F.col("cy") * F.col("xc"), F.nullif(F.col("xx") * F.col("cc") - F.col("xc") ** 2, F.lit(0.0))).alias("slope"))


def for_positions(rows: DataFrame, position: str, columns: dict[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """rows with columns that have a value for some positions only: name to (column, positions)."""
    return rows.withColumns({name: F.when(F.col(position).isin(*allowed), F.col(c)) for name, (c, allowed) in columns.items()})


def name_coverage(rows: DataFrame, roster: DataFrame, by: Sequence[str], player: str, weight: str) -> DataFrame:
    """By group: hitters, those that the roster (team, player) does not have, the share of weight of those it has, and whether it has none."""
    known = roster.select("team", player).distinct().withColumn("_known", F.lit(True))
    each = rows.groupBy(*by, player).agg(F.sum(weight).alias("_w")).join(known, ["team", player], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    out = each.groupBy(*by).agg(F.count(F.lit(1)).alias("hitters"), F.count_if(~F.col("_known")).alias("unmatched"), (F.sum(F.when(F.col("_known"), F.col("_w"))) / F.sum("_w")).alias("coverage"))
    return out.withColumn("team_unmatched", F.col("hitters") == F.col("unmatched"))
