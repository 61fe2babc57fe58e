"""Elo ratings: replays of ordered matches under one configuration or a whole grid.

A match's ratings follow from all earlier ones of its two teams, so matches that share no team and
have no unplayed match before them are independent. A replay takes matches layer by layer: a layer
holds those whose two teams have no earlier match left, and is one update of a matrix with a row for
each team and a column for each configuration. Spark sorts each pool's matches and a task streams
them in batches, holding the ratings; what remains serial is the sequence of layers. Where a pool has
more matches than a round, matches are cut along time into rounds, one job after another: a task sorts
a round's matches only, and ratings go from round to round as rows. Pools run side by side;
`components` finds those that a schedule falls into.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_folder, ship, with_checkpoints
from ..specs import EloConfig
from .metrics import ranked

ELO = ["elo_home", "elo_away", "p_home", "elo_home_after", "elo_away_after"]
SCORES = ["right", "log_loss", "brier"]
#: Matches that are cut into layers at once, for each team known so far; the least and the most of them.
MATCHES_PER_TEAM, LEAST_MATCHES, MOST_MATCHES = 4, 64, 1 << 16
#: Matches by configurations of a layer that are updated at once, so that what an update makes stays in a core's cache.
AT_ONCE = 1 << 14
#: Parts of a grid: each part replays all matches, in a task of its own.
GRID_PARTS = 8
#: Matches of a round, about; those of a grid are longer, as more ratings are passed on between them. A round is cut by so many tasks.
ROUND, GRID_ROUND, CUTS = 1 << 21, 1 << 22, 4
#: What a log may have beside its ratings; matches of a task that takes the last of a season, and the least number of such tasks.
SIDES, TASK_MATCHES, LEAST_TASKS = ["season", "day", "home", "away"], 1 << 18, 16
#: A pool's matches are in this order.
ORDER = ["day", "home", "away", "match"]


def layers(home: np.ndarray, away: np.ndarray, n_teams: int) -> Iterator[np.ndarray]:
    """Places of ordered matches, layer by layer: each layer is what is left whose two teams have no earlier match left."""
    left, first = np.arange(len(home)), np.zeros(n_teams, dtype=np.int64)
    while len(left):
        h, a = home[left], away[left]
        place = np.arange(len(left))
        first[np.stack([h, a], axis=1).ravel()[::-1]] = np.repeat(place, 2)[::-1]  # the earliest is written last
        ready = (first[h] == place) & (first[a] == place)
        yield left[ready]
        left = left[~ready]


class EloReplay:
    """Ratings of one pool while its matches come in order: a row for each team, a column for each configuration."""

    def __init__(self, configs: Sequence[EloConfig], margins: Sequence[str] | None = None):
        of = lambda f: np.array([f(c) for c in configs], dtype=float)
        self.k, self.home, self.mean, self.scale, self.carryover = of(lambda c: c.k), of(lambda c: c.home), of(lambda c: c.mean), of(lambda c: c.scale), of(lambda c: c.carryover)
        self.strong, self.weak = of(lambda c: c.damping[0]), of(lambda c: c.damping[1])
        names = margin_columns(configs) if margins is None else list(margins)
        #: The margin that each configuration reads, the one after the last of them for none.
        self.margin = np.array([names.index(c.margin_column) if c.margin else len(names) for c in configs], dtype=np.int64)
        self.names: pa.Array | None = None
        self.room = np.zeros((0, len(configs)))
        self.ratings = self.room
        self.season = None
        self.n_layers = 0

    def teams(self, names: pa.Array) -> np.ndarray:
        """Numbers of teams; new ones start at the mean."""
        if self.names is None:
            self.names = names.slice(0, 0)
        found = pc.index_in(names, value_set=self.names)
        if found.null_count:
            self.names = pa.concat_arrays([self.names, names.filter(found.is_null()).unique()])
            found = pc.index_in(names, value_set=self.names)
        before, n = len(self.ratings), len(self.names)
        if n > len(self.room):  # twice the room, so that each rating is moved a few times only
            self.room = np.empty((max(n, 2 * len(self.room)), len(self.mean)))
            self.room[:before] = self.ratings
        self.room[before:n] = self.mean
        self.ratings = self.room[:n]
        return found.to_numpy()

    def resumes(self, names: pa.Array, season, ratings: np.ndarray) -> None:
        """Ratings of teams as an earlier round left them in a season."""
        at = self.teams(names)
        self.ratings[at] = ratings
        self.season = season

    def starts(self, season) -> None:
        """What a new season keeps of ratings."""
        if season != self.season:
            if self.season is not None:
                self.ratings -= self.mean
                self.ratings *= self.carryover
                self.ratings += self.mean
            self.season = season

    def played(self, home: np.ndarray, away: np.ndarray, won: np.ndarray, margins: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Replays matches of one season: for each layer its places, both ratings before, the home side's chance, and both ratings after, by configuration.

        margins: a column for each margin that configurations read.
        """
        sizes = np.log(np.concatenate([np.maximum(margins, 0), np.zeros((len(home), 1))], axis=1) + 1)
        width = max(1, AT_ONCE // len(self.mean))
        step = min(MOST_MATCHES, max(LEAST_MATCHES, MATCHES_PER_TEAM * len(self.ratings)))
        for lo in range(0, len(home), step):
            for layer in layers(home[lo : lo + step], away[lo : lo + step], len(self.ratings)):
                self.n_layers += 1
                for first in range(0, len(layer), width):
                    at = layer[first : first + width] + lo
                    h, a = self.ratings[home[at]], self.ratings[away[at]]
                    edge = h - a + self.home
                    chance = 1 / (1 + 10 ** (-edge / self.scale))
                    size, win = sizes[at][:, self.margin], won[at][:, None]
                    factor = np.where(size > 0, size * self.strong / (self.weak * np.where(win > 0, edge, -edge) + self.strong), 1.0)
                    change = self.k * factor * (win - chance)
                    self.ratings[home[at]], self.ratings[away[at]] = h + change, a - change
                    yield at, h, a, chance, h + change, a - change


def margin_columns(configs: Sequence[EloConfig]) -> list[str]:
    return sorted({c.margin_column for c in configs if c.margin})


def in_rounds(matches: DataFrame, pool: Sequence[str], margins: Sequence[str], size: int, more: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Matches with what a replay reads of them, without those that lack a side, a day or a result, and the number of their rounds. A null margin counts as none.

    While no pool has more than size matches there is one round. Else all are cut into ranges of their order, whatever their
    pool, and written by elo_round: a round has about size matches, and those of a pool go on in the next one.
    """
    double = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    known = matches.dropna(subset=["day", "home", "away", "home_won"])
    team = known.select(F.coalesce("home", "away").alias("t")).schema["t"].dataType  # both sides' names are of one type
    columns = dict.fromkeys([*pool, *more, "match", "season", "day"])
    rows = known.select(*columns, *[F.col(c).cast(team).alias(c) for c in ("home", "away")], F.col("home_won").cast("double").alias("home_won"), *map(double, margins))
    most, n = known.groupBy(*pool).count().agg(F.max("count"), F.sum("count")).first()
    if (most or 0) <= size:
        return rows, 1
    n_rounds = -(-n // size)
    cut = rows.repartitionByRange(n_rounds * CUTS, *ORDER).withColumn("elo_round", (F.spark_partition_id() / CUTS).cast("int"))
    path = new_folder(matches.sparkSession, "elo-matches")
    cut.sortWithinPartitions("elo_round", *ORDER).write.option("compression", "zstd").partitionBy("elo_round").parquet(path)
    return matches.sparkSession.read.schema(cut.schema).parquet(path), n_rounds


def held_fields(rows: DataFrame) -> list[T.StructField]:
    """What is passed on to the next round: season, team (as home) and its ratings by configuration, eight bytes each: Spark takes long to send arrays of which nearly all are null."""
    return [rows.schema["season"], rows.schema["home"], T.StructField("ratings", T.BinaryType())]


def in_turn(rows: DataFrame, n_rounds: int, keys: Sequence[str], replayed: Callable[[DataFrame, bool], DataFrame], more: Sequence[str] = ()) -> DataFrame:
    """What replayed(rows of a round, whether ratings are passed on) makes of all rounds, one after another.

    A round's rows are preceded by the ratings that the last one left: rows without a day, which sort first.
    """
    if n_rounds == 1:
        return replayed(rows, False)
    spark, held = rows.sparkSession, None
    path = new_folder(spark, "elo-rounds")
    paths = [f"{path}/{k}" for k in range(n_rounds)]
    for k in range(n_rounds):
        some = rows.where(F.col("elo_round") == k).drop("elo_round").withColumn("ratings", F.lit(None).cast("binary"))
        done = replayed(some if held is None else some.unionByName(held, allowMissingColumns=True), k + 1 < n_rounds)
        done.write.option("compression", "zstd").parquet(paths[k])
        held = spark.read.schema(done.schema).parquet(paths[k]).where("ratings is not null").select(*keys, "season", "home", "ratings")
    return spark.read.schema(done.schema).parquet(*paths).where("ratings is null").drop(*(c for c in ("season", "home", "ratings") if c not in more))


def runs(batch: pa.RecordBatch, pool: Sequence[str]) -> Iterator[tuple[tuple, object, bool, pa.RecordBatch]]:
    """Pool, season, whether they are ratings of an earlier round, and rows of the stretches of a batch that are alike in these."""
    starts = np.zeros(len(batch), dtype=bool)
    starts[:1] = True
    columns = [*(batch.column(c) for c in [*pool, "season"]), batch.column("day").is_null()]
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts[1:] |= code[1:] != code[:-1]
    at = np.flatnonzero(starts).tolist()
    for lo, hi in zip(at, [*at[1:], len(batch)], strict=True):
        *key, season, held = (c[lo].as_py() for c in columns)
        yield tuple(key), season, held, batch.slice(lo, hi - lo)


def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to MOST_MATCHES rows or more, as a batch looks its teams up among all of a pool."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += len(batch)
        if n >= MOST_MATCHES:
            yield pa.concat_batches(some)
            some, n = [], 0
    if n:
        yield pa.concat_batches(some)


def made_as(batch: pa.RecordBatch, names: Sequence[str]) -> pa.Schema:
    """Columns of what a replay makes, with the types of the batch it reads where that has them."""
    made = {"config": pa.string(), "n": pa.int64()} | dict.fromkeys([*ELO, *SCORES], pa.float64())
    return pa.schema([(c, batch.schema.field(c).type if c in batch.schema.names else made[c]) for c in names])


def resumed(replay: EloReplay, season, rows: pa.RecordBatch) -> None:
    replay.resumes(rows.column("home"), season, np.frombuffer(b"".join(rows.column("ratings").to_pylist()), "<f8").reshape(len(rows), -1))


def passed_on(replay: EloReplay, key: tuple, keys: Sequence[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A pool's ratings as rows of a schema, null in its other columns."""
    names, width = replay.names, len(replay.mean)
    step = max(1, (1 << 20) // width)
    for lo in range(0, len(names), step):
        some = names.slice(lo, step)
        n = len(some)
        columns = {c: pa.array([v] * n, schema.field(c).type) for c, v in [*zip(keys, key, strict=True), ("season", replay.season)]}
        ends, values = (np.arange(n + 1) * 8 * width).astype(np.int32), replay.ratings[lo : lo + n].astype("<f8")
        columns |= {"home": some, "ratings": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(values)]).cast(schema.field("ratings").type)}
        yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], names=schema.names)


def widened(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """A batch with the columns of a schema, null where it has none."""
    return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in batch.schema.names else pa.nulls(len(batch), f.type) for f in schema], names=schema.names)


def numbers_of(rows: pa.RecordBatch, replay: EloReplay, margins: Sequence[str]) -> tuple[np.ndarray, ...]:
    """Sides, results and margins of a stretch."""
    number = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
    teams = replay.teams(pa.concat_arrays([rows.column("home"), rows.column("away")]))
    return teams[: len(rows)], teams[len(rows) :], number("home_won"), np.stack([number(c) for c in margins], axis=1) if margins else np.zeros((len(rows), 0))


def elo_log(matches: DataFrame, pool: Sequence[str], configs: dict[str, EloConfig] | None = None, more: Sequence[str] = ()) -> DataFrame:
    """Ratings before and after every match and the home side's chance, by pool and configuration; more of season, day, home and away as asked.

    matches: pool columns, match, season, day, home, away, home_won, and the margins that configurations name. They are
    read more than once, so costly ones are written first.
    """
    configs = configs or {"default": EloConfig()}
    names, settings = list(configs), list(configs.values())
    margins = margin_columns(settings)
    ship(matches.sparkSession)
    rows, n_rounds = in_rounds(matches, pool, margins, ROUND)
    fields = [*(rows.schema[c] for c in pool), T.StructField("config", T.StringType()), rows.schema["match"], *(T.StructField(c, T.DoubleType()) for c in ELO), *(rows.schema[c] for c in more)]
    schema = T.StructType(fields + [f for f in held_fields(rows) if f.name not in more] if n_rounds > 1 else fields)

    def run(batches: Iterator[pa.RecordBatch], passes: bool) -> Iterator[pa.RecordBatch]:
        held, replay, arrow = None, None, None
        for batch in larger(batches):
            arrow = made_as(batch, schema.names)
            found = np.empty((len(ELO), len(batch), len(names)))
            at = 0
            for key, season, earlier, some in runs(batch, pool):
                if key != held:
                    if passes and held is not None:
                        yield from passed_on(replay, held, pool, arrow)
                    held, replay = key, EloReplay(settings)
                if earlier:
                    resumed(replay, season, some)
                else:
                    replay.starts(season)
                    for places, *values in replay.played(*numbers_of(some, replay, margins)):
                        for out, v in zip(found, values, strict=True):
                            out[at + places] = v
                at += len(some)
            new = batch.column("day").is_valid()
            batch, found = batch.filter(new), found[:, new.to_numpy(zero_copy_only=False)]
            for j, name in enumerate(names):
                yield widened(pa.RecordBatch.from_arrays([*(batch.column(c) for c in pool), pa.array([name] * len(batch), pa.string()), batch.column("match"), *(pa.array(out[:, j]) for out in found), *(batch.column(c) for c in more)], names=[*pool, "config", "match", *ELO, *more]), arrow)
        if passes and held is not None:
            yield from passed_on(replay, held, pool, arrow)

    def replayed(some: DataFrame, passes: bool) -> DataFrame:
        return some.repartition(*pool).sortWithinPartitions(*pool, *ORDER).mapInArrow(lambda batches: run(batches, passes), schema)

    return in_turn(rows, n_rounds, pool, replayed, more)


def elo_sweep(matches: DataFrame, pool: Sequence[str], configs: dict[str, EloConfig], scored: Column, clip: float = 1e-6) -> DataFrame:
    """n, accuracy, log loss and Brier score of every configuration over the matches where scored holds; all of them are replayed.

    The grid is cut into parts: a task replays a pool's matches, all of them, for the configurations of a part, and
    sends sums by batch, never a row for each match and configuration. Matches are read more than once, as in elo_log.
    """
    named = list(configs.items())
    n_parts = min(GRID_PARTS, len(named))
    parts_of = [dict(named[k::n_parts]) for k in range(n_parts)]
    margins = margin_columns(list(configs.values()))
    ship(matches.sparkSession)
    rows, n_rounds = in_rounds(matches.withColumn("scored", F.coalesce(scored, F.lit(False))), pool, margins, GRID_ROUND, ["scored"])
    keys = [*pool, "part"]
    n_tasks = n_parts * max(1, int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_parts)
    at = F.pmod(F.hash(*pool).cast("long") * n_parts + F.col("part"), F.lit(n_tasks)).cast("int")  # parts of a pool never share a task
    part = T.StructField("part", T.IntegerType())
    fields = [T.StructField("config", T.StringType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in SCORES)]
    schema = T.StructType([*(rows.schema[c] for c in pool), part, *fields, *held_fields(rows)] if n_rounds > 1 else fields)

    def run(batches: Iterator[pa.RecordBatch], passes: bool) -> Iterator[pa.RecordBatch]:
        held, replay, names, sums, n, arrow = None, None, [], None, 0, None
        send = lambda: widened(pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n] * len(names), pa.int64()), *map(pa.array, sums)], names=["config", "n", *SCORES]), arrow)
        for batch in larger(batches):
            arrow = made_as(batch, schema.names)
            for key, season, earlier, some in runs(batch, keys):
                if key != held:
                    if n:
                        yield send()
                    if passes and held is not None:
                        yield from passed_on(replay, held, keys, arrow)
                    own = parts_of[key[-1]]
                    held, replay, names = key, EloReplay(list(own.values()), margins), list(own)
                    sums, n = np.zeros((len(SCORES), len(names))), 0
                if earlier:
                    resumed(replay, season, some)
                    continue
                replay.starts(season)
                home, away, won, margin = numbers_of(some, replay, margins)
                counted = some.column("scored").to_numpy(zero_copy_only=False)
                for at, _, _, chance, _, _ in replay.played(home, away, won, margin):
                    at, chance = at[counted[at]], chance[counted[at]]
                    p, y = np.clip(chance, clip, 1 - clip), won[at][:, None]
                    n += len(at)
                    sums[0] += ((p > 0.5) == (y == 1)).sum(axis=0)
                    sums[1] -= np.log(np.where(y == 1, p, 1 - p)).sum(axis=0)
                    sums[2] += ((p - y) ** 2).sum(axis=0)
            if n:  # sums of a batch, as those of a whole pool would lose digits
                yield send()
                sums, n = np.zeros_like(sums), 0
        if passes and held is not None:
            yield from passed_on(replay, held, keys, arrow)

    def replayed(some: DataFrame, passes: bool) -> DataFrame:
        every = F.sequence(F.lit(0), F.lit(n_parts - 1))
        if "part" in some.columns:  # ratings that are passed on are of one part
            every = F.when(F.col("part").isNull(), every).otherwise(F.array("part"))
        dealt = some.withColumn("part", F.explode(every)).repartitionById(n_tasks, at)
        return dealt.sortWithinPartitions(*keys, *ORDER).mapInArrow(lambda batches: run(batches, passes), schema)

    parts = in_turn(rows, n_rounds, keys, replayed)
    mean = lambda c: (F.try_divide(F.sum(c), F.sum("n")))
    return parts.groupBy("config").agg(F.sum("n").alias("n"), mean("right").alias("accuracy"), mean("log_loss").alias("log_loss"), mean("brier").alias("brier"))


def components(matches: DataFrame) -> DataFrame:
    """team and component (its least team) of the pools that a schedule falls into: teams linked by matches, whatever the number between them.

    Each round takes the least component of the neighbours, then that component's own; rounds grow with the
    logarithm of the longest way between teams. Rows are pairs of teams, not matches.
    """
    with_checkpoints(matches.sparkSession)
    pairs = matches.dropna(subset=["home", "away"]).select("home", "away").distinct()
    edges = pairs.unionByName(pairs.select(F.col("away").alias("home"), F.col("home").alias("away"))).distinct().checkpoint()
    found = edges.select(F.col("home").alias("team")).distinct().withColumn("component", F.col("team")).checkpoint()
    while True:
        near = edges.join(found.withColumnRenamed("team", "away"), "away").groupBy(F.col("home").alias("team")).agg(F.min("component").alias("near"))
        least = found.join(near, "team").withColumn("least", F.least("component", "near"))
        up = found.select(F.col("team").alias("least"), F.col("component").alias("up"))
        new = least.join(up, "least").select("team", F.least("least", "up").alias("component"), (F.least("least", "up") < F.col("component")).alias("moved")).checkpoint()
        found = new.drop("moved")
        if new.where("moved").isEmpty():
            return found


def by_component(matches: DataFrame) -> DataFrame:
    """matches with component: that of its teams, a pool for the replay."""
    return matches.join(components(matches).withColumnRenamed("team", "home"), "home")


def elo_season_ends(matches: DataFrame, log: DataFrame, pool: Sequence[str], least: int = 5) -> DataFrame:
    """Each team's rating after its last match of a season, for teams with enough matches, and its rank. A log that has SIDES needs no join."""
    rows = log if set(SIDES) <= set(log.columns) else matches.join(log, [*pool, "match"])
    n = matches.count() // TASK_MATCHES
    if n >= LEAST_TASKS:  # what a task sorts does not grow with the table
        rows = rows.repartition(n, "match")
    order = F.struct("day", "home", "away", "match")
    both = F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("elo_home_after").alias("elo")), F.struct(F.col("away").alias("team"), F.col("elo_away_after").alias("elo"))))
    out = rows.select(*pool, "season", order.alias("o"), both.alias("t")).groupBy(*pool, "season", F.col("t.team").alias("team")).agg(F.max_by("t.elo", "o").alias("elo"), F.count(F.lit(1)).alias("n_matches"))
    return ranked(out.where(F.col("n_matches") >= least), [*pool, "season"], "elo", "rank_elo")
