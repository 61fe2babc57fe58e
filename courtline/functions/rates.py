"""Column builders for rates, flags, bands and bins. All of them keep nulls and never make NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..specs import Benchmark


def rate(num: Column | str, den: Column | str, floor: float = 0) -> Column:
    """num / den, null where den is 0, null or below floor."""
    num, den = (F.col(c) if isinstance(c, str) else c for c in (num, den))
    return F.when((den >= floor) & (den != 0), num.cast("double") / den)


def match_rates(detail: Column | None = None) -> dict[str, Column]:
    """The rates of a side's match from its counts, by name; a denominator of 0 gives null.

    detail: whether touches are known at all; where they are not, what depends on first balls is
    null, as 0 would be a claim that the data do not make.
    """
    c = F.col
    seen = F.lit(True) if detail is None else F.coalesce(detail, F.lit(False))
    points = c("kill_pts") + c("block_pts") + c("opp_error_pts")
    return {
        "sideout_pct": rate("so_won", "recv_rallies"),
        "fbso_pct": F.when(seen, rate("fbso_won", "recv_rallies")),
        "point_score_pct": rate("ps_won", "serve_rallies"),
        "opp_fbso_allowed": F.when(seen, rate("opp_fbso_won", "serve_rallies")),
        "ace_pct": rate("aces", "serve_rallies"),
        "serve_err_pct": rate("serve_errs", "serve_rallies"),
        "hit_pct": rate(c("kills") - c("att_errors"), "attacks"),
        "kill_pct": rate("kills", "attacks"),
        "att_err_pct": rate("att_errors", "attacks"),
        "rec_err_pct": rate("rec_errors", "ret_att"),
        "blocks_per_set": rate(c("block_solos") + c("block_assists") / 2, "sets"),
        "digs_per_set": rate("digs", "sets"),
        "kill_pt_share": rate(c("kill_pts"), points),
        "rally_win_pct": rate(c("so_won") + c("ps_won"), c("recv_rallies") + c("serve_rallies")),
        "trans_so_pct": F.when(seen, rate(c("so_won") - c("fbso_won"), c("recv_rallies") - c("fbso_won"))),
        "first20_share": rate("sets_first", "sets_played"),
    }


def ratio_or_count(num: Column, den: Column) -> Column:
    """num / den, and num itself where den is 0 or null."""
    return F.coalesce(rate(num, den), num.cast("double"))


def flag(metric: Column, threshold: float, higher: bool = True) -> Column:
    """1.0 if met, 0.0 if not, null if the metric is null."""
    return F.when(metric.isNotNull(), (metric >= threshold if higher else metric <= threshold).cast("double"))


def spec_rows(specs: Sequence[Benchmark], graded: bool = True) -> tuple[list[tuple], str]:
    """Benchmarks as rows and their schema: place, metric, direction, threshold, flag_column, graded."""
    rows = [(i, b.metric, "higher_is_better" if b.higher else "lower_is_better", b.threshold, b.flag, graded) for i, b in enumerate(specs)]
    return rows, "place int, metric string, direction string, threshold double, flag_column string, graded boolean"


def with_benchmarks(rows: DataFrame, specs: Sequence[Benchmark]) -> DataFrame:
    """A flag for each benchmark, grade (their sum, null if all are null) and bench_of (how many are not null)."""
    rows = rows.withColumns({b.flag: flag(F.col(b.metric), b.threshold, b.higher) for b in specs})
    n = sum((F.col(b.flag).isNotNull().cast("long") for b in specs), F.lit(0).cast("long"))
    total = sum((F.coalesce(F.col(b.flag), F.lit(0.0)) for b in specs), F.lit(0.0))
    return rows.withColumn("bench_of", n).withColumn("grade", F.when(F.col("bench_of") > 0, total))


def band(value: Column, bands: Sequence[tuple[str, float, float]], lower_closed: bool = True) -> Column:
    """The label of the first band lo..hi that holds value: [lo, hi], or (lo, hi] if lower_closed is false."""
    out = F.lit(None).cast("string")
    for label, lo, hi in reversed(bands):
        out = F.when((value >= lo if lower_closed else value > lo) & (value <= hi), label).otherwise(out)
    return out


def bin_right(value: Column, width: float, low: float = 0.0) -> Column:
    """Number of the right-closed bin of value; the lowest edge counts to the first bin."""
    return F.greatest(F.lit(0), F.ceil((value - low) / width) - 1).cast("long")


def bin_left(value: Column, width: float, most: int, low: float = 0.0) -> Column:
    """Number of the left-closed bin of value, at most most."""
    return F.least(F.lit(most), F.floor((value - low) / width)).cast("long")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def lerp(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Linear interpolation, clamped to the ends."""
    t = F.when(x1 == x0, 0.0).otherwise((x - x0) / F.nullif(x1 - x0, F.lit(0.0)))
    return y0 + (y1 - y0) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
