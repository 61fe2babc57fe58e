"""Two-sided views of matches and joins between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def team_view(matches: DataFrame, shared: Sequence[str], mirrored: dict[str, tuple[str | Column, str | Column]]) -> DataFrame:
    """Two rows per match in one pass: mirrored maps each column to its home and its away expression; venue tells them apart."""
    side = lambda i, venue: F.struct(*[(F.col(e[i]) if isinstance(e[i], str) else e[i]).alias(c) for c, e in mirrored.items()], F.lit(venue).alias("venue"))
    return matches.select(*shared, F.explode(F.array(side(0, "home"), side(1, "away"))).alias("_side")).select(*shared, "_side.*")


def home_view(sides: DataFrame, shared: Sequence[str], team: str, opponent: str, values: Sequence[str]) -> DataFrame:
    """One row per match, home side up, from a two-row view; matches of a team against itself and rows with nulls go."""
    rows = sides.where((F.col("venue") == "home") & (F.col(team) != F.col(opponent))).dropna(subset=[team, opponent, *values])
    return rows.select(*shared, F.col(team).alias("home"), F.col(opponent).alias("away"), *values)


def mirror(sides: DataFrame, keys: Sequence[str], team: str, values: Sequence[str], prefix: str = "opp_") -> DataFrame:
    """The other team's values of the same match beside each row; rows without exactly one counterpart's match go by the join."""
    other = sides.select(*keys, F.col(team).alias("_other"), *[F.col(v).alias(prefix + v) for v in values])
    return sides.join(other, list(keys)).where(F.col(team) != F.col("_other")).drop("_other")


def unordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("pair_lo"), F.greatest(a, b).alias("pair_hi")


def unique_by(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key no other row has; rows that share a key all go."""
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def unique_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys that are unique on both sides; any other key joins nothing."""
    return unique_by(left, keys).join(unique_by(right, keys), list(keys), how)


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def within_spans(events: DataFrame, spans: DataFrame, entity: str, at: str, first: str, last: str, lanes: int = 3) -> DataFrame:
    """Events of an entity inside its spans, both ends included, with the span's columns.

    A sweep instead of a join: span starts and events lie in one order by entity, and each event takes the span that began
    last, if that has not ended. So no event meets a span that it is not in. An entity's spans may overlap their
    neighbours: they are dealt in turn to `lanes` lanes, and an event is swept in each. If spans of one lane overlap, the query
    fails and says so. Events and spans without an entity or an end are in none.
    """
    own = [c for c in spans.columns if c != entity]
    turn = F.row_number().over(Window.partitionBy(entity).orderBy(first, last)) - 1
    begun = spans.dropna(subset=[entity, first, last]).withColumn("_lane", turn % lanes)
    begun = begun.select(F.col(entity), "_lane", F.col(first).cast(events.schema[at].dataType).alias("_at"), F.struct(*own).alias("_span"))
    seen = events.dropna(subset=[entity, at]).select(F.col(entity), F.col(at).alias("_at"), F.struct(*events.columns).alias("_event"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_lane"))
    both = begun.unionByName(seen, allowMissingColumns=True)
    order = Window.partitionBy(entity, "_lane").orderBy("_at", F.col("_span").isNull(), F.col(f"_span.{last}"))
    before = F.last("_span", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    clash = F.col("_span").isNotNull() & (F.col(f"_open.{last}") >= F.col(f"_span.{first}"))
    swept = both.withColumn("_open", before).where(F.when(clash, F.raise_error(F.lit("too many spans of an entity overlap")).cast("boolean")).otherwise(True))
    return swept.where(F.col("_event").isNotNull() & (F.col("_at") <= F.col(f"_open.{last}"))).select("_event.*", *[F.col(f"_open.{c}").alias(c) for c in own])


def as_of_week(rows: DataFrame, day: str, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the values whose week_start is that of their own week, i.e. made from what is before it: an equi-join."""
    return rows.withColumn("week_start", F.date_trunc("week", day).cast("date")).join(values, [*keys, "week_start"], "left")


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], winner: str) -> DataFrame:
    """Two sources' winners of the same contests: one row with how many both have and how many agree."""
    both = a.select(*keys, F.col(winner).alias("_a")).join(b.select(*keys, F.col(winner).alias("_b")), list(keys))
    return both.agg(F.count(F.lit(1)).alias("n_both"), F.count_if(F.col("_a") == F.col("_b")).alias("n_agree"), F.avg((F.col("_a") != F.col("_b")).cast("double")).alias("disagree_share"))


def filled(universe: DataFrame, facts: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every row of the universe with its facts, 0 where there are none."""
    return universe.join(facts, list(keys), "left").fillna(0, subset=list(values))


def numbered_labels(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: Column) -> DataFrame:
    """label, with ' (game n)' where several rows of a key have the same."""
    rows = rows.withColumn("label", label)
    w = Window.partitionBy(*keys, "label")
    n, of = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    return rows.withColumn("_n", n).withColumn("_of", of).withColumn("label", F.when(F.col("_of") > 1, F.concat("label", F.lit(" (game "), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.col("label"))).drop("_n", "_of")


def match_names(rows: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """The longest known name that an opponent's text begins with, and what else the text tells: matched, away, label, rest.

    A leading @ marks an away match and #n a ranking label. Different texts are matched once, by an
    equi-join on their first word; names are as many as teams.
    """
    text = F.trim(F.col(column))
    bare = F.trim(F.regexp_replace(text, r"^@?\s*(#\d+\s+)?", ""))
    asked = rows.select(F.col(column).alias("_asked"), bare.alias("_bare")).where("_asked is not null").distinct()
    known = names.select(F.col(name).alias("_name")).where("trim(_name) <> ''").distinct()
    word = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    found = asked.join(known, word(F.col("_bare")) == word(F.col("_name"))).where((F.col("_bare") == F.col("_name")) | F.col("_bare").startswith(F.concat("_name", F.lit(" "))))
    best = found.groupBy("_asked").agg(F.max_by("_name", F.length("_name")).alias("matched"))
    out = rows.join(best, F.col(column) == F.col("_asked"), "left").drop("_asked")
    label = F.regexp_extract(text, r"^@?\s*#(\d+)\s", 1).try_cast("int")
    rest = F.trim(F.substr(bare, F.length("matched") + 1))
    return out.withColumns({"away": text.startswith("@"), "label": label, "rest": F.when(F.col("matched").isNotNull(), F.nullif(rest, F.lit("")))})
