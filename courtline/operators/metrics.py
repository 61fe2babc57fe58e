"""Aggregates over matches: records, seasons, baselines, splits, calibration, coverage; and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def records(sides: DataFrame, by: Sequence[str], won: str = "won") -> DataFrame:
    """wins, losses and win_pct."""
    out = sides.groupBy(*by).agg(F.sum(won).cast("long").alias("wins"), F.sum(1 - F.col(won)).cast("long").alias("losses"))
    return out.withColumn("win_pct", F.col("wins") / (F.col("wins") + F.col("losses")))


def season_means(sides: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """n_matches, and mean and sample deviation of each metric."""
    return sides.groupBy(*by).agg(F.count(F.lit(1)).alias("n_matches"), *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_samp(m).alias(f"{m}_sd") for m in metrics])


def long(rows: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric: metric, value."""
    return rows.unpivot(list(ids), list(metrics), "metric", "value")


QUANTILES = {"p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def baselines(rows: DataFrame, by: Sequence[str], metrics: Sequence[str], approximate: bool = False) -> DataFrame:
    """n, mean and quantiles of every metric, in long form. Exact quantiles are linear-interpolated; approximate ones bound memory for groups of any size."""
    q = F.percentile_approx if approximate else F.percentile
    each = long(rows, by, metrics).where("value is not null").groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), q("value", F.array(*map(F.lit, QUANTILES.values()))).alias("q"))
    return each.select(*by, "metric", "n", "mean", *[F.col("q")[i].alias(k) for i, k in enumerate(QUANTILES)])


def split(rows: DataFrame, by: Sequence[str], condition: Column, outcome: str) -> DataFrame:
    """Mean outcome with and without a condition, the numbers, and the swing."""
    yes, no = F.when(condition, F.col(outcome)), F.when(~condition, F.col(outcome))
    out = rows.groupBy(*by) if by else rows.groupBy()
    return out.agg(F.count(yes).alias("n_with"), F.avg(yes).alias("with"), F.count(no).alias("n_without"), F.avg(no).alias("without")).withColumn("swing", F.col("with") - F.col("without"))


def shares(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Counts of value and their share of the group's rows; two groupings, so a group's total is a sum of counts."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("share", F.col("n") / total)


def calibration(rows: DataFrame, bin_no: Column, p: str, y: str) -> DataFrame:
    """n, mean prediction and mean outcome by bin."""
    return rows.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))


def prediction_score(rows: DataFrame, by: Sequence[str], p: str, y: str, clip: float = 1e-6) -> DataFrame:
    """n, accuracy, log loss and Brier score."""
    q = F.least(F.lit(1 - clip), F.greatest(F.lit(clip), F.col(p)))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(((q > 0.5).cast("double") == F.col(y)).cast("double")).alias("accuracy"),
        F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("log_loss"),
        F.avg((q - F.col(y)) ** 2).alias("brier"),
    )


def expected_wins(rows: DataFrame, by: Sequence[str], p: str, won: str) -> DataFrame:
    """Wins, expected wins, variance, upsets won and lost, difference and z."""
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(won).alias("wins"), F.sum(p).alias("x_wins"), F.sum(F.col(p) * (1 - F.col(p))).alias("var"),
        F.count_if((F.col(p) < 0.5) & (F.col(won) == 1)).alias("upset_wins"), F.count_if((F.col(p) > 0.5) & (F.col(won) == 0)).alias("upset_losses"),
    )
    return out.withColumn("diff", F.col("wins") - F.col("x_wins")).withColumn("z", F.try_divide("diff", F.sqrt(F.nullif("var", F.lit(0.0)))))


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """One row with median: the middle value, the upper one of two; from how many rows have each value."""
    sizes = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(value))  # as many rows as different values
    return sizes.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(Window.partitionBy())).where(F.col("_upto") > F.floor(F.col("_all") / 2)).agg(F.min(value).alias("median"))


def coverage(now: DataFrame, before: DataFrame, team: str, match: str) -> DataFrame:
    """Rows of each team now and before, and whether it is thin (fewer than half of the upper median) or missing."""
    n = now.groupBy(team).agg(F.countDistinct(match).alias("n_now"))
    b = before.groupBy(team).agg(F.countDistinct(match).alias("n_before"))
    both = n.join(b, team, "full_outer").crossJoin(F.broadcast(upper_median(n, "n_now")))  # one row
    return both.select(team, F.coalesce("n_now", F.lit(0)).alias("n_now"), F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce(F.col("n_now") * 2 < F.col("median"), F.lit(False)).alias("thin"), F.col("n_now").isNull().alias("missing"))


def coverage_summary(now: DataFrame, before: DataFrame, team: str, match: str, conf: str) -> DataFrame:
    """Teams, and the least, median and most rows of a team now; teams missing, and conferences of which all teams are missing."""
    n = now.groupBy(team).agg(F.countDistinct(match).alias("n_now"))
    lost = before.groupBy(team).agg(F.max(conf).alias(conf)).join(n, team, "left")
    wiped = lost.groupBy(conf).agg(F.count("n_now").alias("kept")).where("kept = 0").agg(F.count(F.lit(1)).alias("conferences_wiped"))
    sizes = n.agg(F.count(F.lit(1)).alias("teams"), F.min("n_now").alias("least"), F.max("n_now").alias("most"))
    return sizes.crossJoin(upper_median(n, "n_now")).crossJoin(lost.agg(F.count_if(F.col("n_now").isNull()).alias("missing"))).crossJoin(wiped)  # one row each


def benchmarks_met(rows: DataFrame, by: Sequence[str], thresholds: DataFrame, higher: dict[str, bool]) -> DataFrame:
    """How many of its position's benchmarks a row meets, and of how many it has a value. rows and thresholds share position and metric."""
    known = rows.join(thresholds.select("position", "metric", "threshold"), ["position", "metric"])
    up = F.create_map(*[F.lit(v) for kv in higher.items() for v in kv])[F.col("metric")]
    met = F.when(up, F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return known.where("value is not null").groupBy(*by).agg(F.count_if(met).alias("met"), F.count(F.lit(1)).alias("of"))


def ranked(rows: DataFrame, by: Sequence[str], value: str, name: str, higher: bool = True, only: Column | None = None) -> DataFrame:
    """Least rank of ties within groups; null where value is null or only is false, which do not count either."""
    kept = F.col(value).isNotNull() if only is None else F.col(value).isNotNull() & only
    order = F.desc if higher else F.asc
    rank = F.rank().over(Window.partitionBy(*by, kept).orderBy(order(value)))
    return rows.withColumn(name, F.when(kept, rank))


def z_scores(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return rows.withColumn(name, (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))


def top(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group in a total order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def rank_band(rows: DataFrame, by: Sequence[str], rating: str, se: str, width: float = 1.645) -> DataFrame:
    """rank_lo and rank_hi: 1 + how many ratings of the group are above rating +/- width * se; a null se becomes the group's median.

    One sort of the union of ratings and bounds, not a join of all pairs.
    """
    mid = rows.groupBy(*by).agg(F.percentile(se, F.lit(0.5)).alias("_mid"))
    rows = rows.join(mid, list(by)).withColumn("_se", F.coalesce(se, "_mid")).drop("_mid")
    points = rows.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(rating) + s * width * F.col("_se")).alias("v")) for k, s in (("own", 0), ("lo", 1), ("hi", -1))])))
    above = Window.partitionBy(*by).orderBy(F.desc("_p.v"), F.desc(F.when(F.col("_p.kind") == "own", 0).otherwise(1))).rowsBetween(Window.unboundedPreceding, -1)
    counted = points.withColumn("_above", F.coalesce(F.count_if(F.col("_p.kind") == "own").over(above), F.lit(0)) + 1)
    names = [c for c in rows.columns if c != "_se"]
    return counted.groupBy(*names).agg(F.max(F.when(F.col("_p.kind") == "lo", F.col("_above"))).alias("rank_lo"), F.max(F.when(F.col("_p.kind") == "hi", F.col("_above"))).alias("rank_hi"))


def auc(rows: DataFrame, by: Sequence[str], score: str, y: str) -> DataFrame:
    """Area under the curve from ranks, ties counted half; distinct scores are counted first, so the sort is over those."""
    counts = rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(y).alias("p"), F.sum(1 - F.col(y)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    each = counts.withColumn("u", F.col("p") * (below + F.col("n") / 2))
    out = each.groupBy(*by) if by else each.groupBy()
    return out.agg((F.sum("u") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auc"))


def best_threshold(rows: DataFrame, metric: str, won: str, at: Sequence[float], least: float = 0.3, most: float = 0.7) -> DataFrame:
    """The threshold, of quantiles of the metric, with the largest lift (win rate when met less win rate when not) whose hit rate is in bounds.

    What lift means is this library's own definition.
    """
    cuts = rows.agg(F.percentile(metric, F.array(*map(F.lit, at))).alias("c")).select(F.explode(F.array_distinct("c")).alias("threshold"))
    counts = rows.where(F.col(metric).isNotNull()).groupBy(metric).agg(F.sum(won).alias("w"), F.count(F.lit(1)).alias("n"))
    met = F.col(metric) >= F.col("threshold")
    each = counts.crossJoin(F.broadcast(cuts)).groupBy("threshold").agg(  # as many rows as quantiles
        (F.sum(F.when(met, F.col("n"))) / F.sum("n")).alias("hit_rate"),
        (F.sum(F.when(met, F.col("w"))) / F.sum(F.when(met, F.col("n"))) - F.sum(F.when(~met, F.col("w"))) / F.sum(F.when(~met, F.col("n")))).alias("lift"),
    )
    return each.where(F.col("hit_rate").between(least, most)).orderBy(F.desc("lift"), "threshold").limit(1)
