"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one stream, cut into blocks of block_words words. A source's target
is its share by weight of all words, stopped at max_epochs times its size (the excess is shared
anew). The mix is a sequence of slots, each holding one block; a source has as many as its target
asks for. How many slots of a source an output shard gets is drawn: each slot falls on one of the
shards by a seeded hash, so a source's counts over the shards are a multinomial draw of its slots,
and the totals meet the targets and do not scatter. Slots of a source are then numbered shard by
shard by these counts; number k takes, in each pass over the source, the block that the pass's own
pseudorandom permutation of block numbers maps k to (swap-or-not rounds, which permute any number of
blocks), and slots and blocks are joined by (source, block).

Nothing sorts or gathers a whole source: streams are numbered in parts of about part_rows rows,
running sums go over runs first and then within each, and counts are drawn in runs that are dealt
out before they are unfolded. A source may hold all rows. Up to FEW_SOURCES sources, a row each, are
ordered by one task; more of them in ranges, with the same result.

Nulls: a null text has size 0 and is never taken; a null source is a source of its own, ordered
last; a null doc_id is a document like others. Repeated rows are separate documents. Texts are read
whole, however long. An empty table gives an empty result. Only the columns doc_id, text and source
are read, and n_chars follows the text; others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, saved, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
PART_ROWS = 4096
SLOT_RUN = 65536
#: Up to so many sources are ordered by one task.
FEW_SOURCES = 1_000_000
ROUNDS = 16
#: Primes below 2^30 and a number below them: no product in a round exceeds 2^62.
PRIMES = (1073741789, 1073741783)
SHIFT = 29773456


def long(x: int) -> Column:
    return F.lit(x).cast("long")


def drawn(x: Column, key: Column, n: Column) -> Column:
    """A pseudorandom number from 0 to n - 1: 60 bits of a digest of x and key, modulo n."""
    digest = F.md5(F.concat(x.cast("string"), F.lit(":"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n


def round_keys(n: Column, key: Column) -> Column:
    """The key of each round of a permutation of 0..n-1."""
    return F.transform(F.sequence(long(1), long(ROUNDS)), lambda r: drawn(r, key, n))


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """A permutation of 0..n-1: in each round x and its mirror at the key change places, or not, by a hash of the larger one."""

    def step(at: Column, key: Column) -> Column:
        other = F.when(key >= at, key - at).otherwise(key - at + n)
        larger = F.greatest(at, other) % long(PRIMES[0])
        swap = ((larger + key % long(PRIMES[0])) * (larger + long(SHIFT))) % long(PRIMES[1]) % 2 == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(keys, x, step)


def running(rows: DataFrame, order: list[str], sums: list[str], few: bool) -> DataFrame:
    """rows with, for each column of sums, c_before: its sum over earlier rows of a total order. Where rows are not few, ranges of the order are summed first."""
    if few:
        window = Window.orderBy(*map(F.asc_nulls_last, order))
        return rows.select("*", *[(F.sum(c).over(window) - F.col(c)).alias(f"{c}_before") for c in sums])
    part = free(rows, "_part")
    ranged = saved(rows.repartitionByRange(*map(F.asc_nulls_last, order)).withColumn(part, F.spark_partition_id()), "ranges")
    within = Window.partitionBy(part).orderBy(*map(F.asc_nulls_last, order))
    totals = ranged.groupBy(part).agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_offset") for c in sums])  # a row for each range
    placed = ranged.join(F.broadcast(offsets), part)
    return placed.select(*rows.columns, *[(F.col(f"{c}_offset") + F.sum(c).over(within) - F.col(c)).alias(f"{c}_before") for c in sums])


def running_within(rows: DataFrame, key: str, number: str, value: str, run: int = 1024) -> DataFrame:
    """rows with before: the sum of value over rows of the same key with a smaller number. Runs of numbers are summed first."""
    in_runs = rows.withColumn("run", F.floor(F.col(number) / run).cast("long"))
    earlier = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = in_runs.groupBy(key, "run").agg(F.sum(value).alias("of_run")).select(key, "run", F.coalesce(F.sum("of_run").over(earlier), long(0)).alias("run_before"))
    within = Window.partitionBy(key, "run").orderBy(number)
    return in_runs.join(runs, [key, "run"]).withColumn("before", F.col("run_before") + F.sum(value).over(within) - F.col(value)).drop("run", "run_before")


def text_digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def document_key() -> Column:
    """What tells documents apart: doc_id, text and source."""
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_digest(), F.col("text").isNull().cast("string"), source).cast("binary")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, text_hash, doc_key (of these) and same (the number of the row among rows that are equal in these)."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.conv(F.substring(text_digest(), 1, 15), 16, 10).cast("long").alias("text_hash"), document_key().alias("doc_key"))
    counted = rows.groupBy("doc_key").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size", "text_hash")], F.count(F.lit(1)).alias("rows"))
    return counted.select("doc_id", "source", "size", "text_hash", "doc_key", F.explode(F.sequence(long(1), F.col("rows"))).alias("same"))


def source_plan(parts: DataFrame, weights: tuple[int, ...], max_epochs: int, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """One row per source: source_key, source_no, source_size, target, blocks, passes, slots, shards. parts: source_key, source, words."""
    totals = saved(parts.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("words").alias("source_size")), "sources").withColumn("one", long(1))
    n_sources, all_words = totals.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    few = n_sources <= FEW_SOURCES
    numbered = running(totals, ["source"], ["one"], few).withColumn("source_no", F.col("one_before") + 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")).cast("long")
    plan = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs).withColumn("by_cap", F.col("source_size") / F.col("weight"))
    # Sources that stop come first in order of cap / weight: the level of the others follows from what is left.
    plan = running(plan.select("source_key", "source_no", "source_size", "weight", "cap", "by_cap"), ["by_cap", "source_no"], ["weight", "cap"], few)
    all_weights = sum(weights[k % len(weights)] for k in range(n_sources % len(weights))) + n_sources // len(weights) * sum(weights)
    level = (F.lit(all_words or 0) - F.col("cap_before")) / (F.lit(all_weights) - F.col("weight_before"))
    final = plan.select("weight", "cap", "weight_before", level.alias("level")).where(F.col("level") * F.col("weight") < F.col("cap")).agg(F.min_by("level", "weight_before")).first()[0]
    cap = F.col("cap").cast("double")
    target = cap if final is None else F.least(cap, F.lit(final) * F.col("weight"))
    plan = (
        plan.withColumn("target", F.round(target, 6))
        .withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
        .withColumn("take", F.round("target").cast("long"))
        .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("take") - F.col("full") * F.col("source_size"))
        .withColumn("n_slots", F.col("full") * F.col("n_blocks") + F.ceil(F.col("rest") / block_words))
    )
    keys = F.transform(F.sequence(long(0), F.col("full")), lambda p: round_keys(F.greatest(F.col("n_blocks"), long(1)), F.col("source_no") * 31 + p + seed))
    plan = saved(plan.select("source_key", "source_no", "source_size", "target", "n_blocks", "full", "rest", "n_slots", keys.alias("keys")), "plan")
    n_slots = plan.agg(F.sum("n_slots")).first()[0] or 0
    return plan.withColumn("n_shards", long(max(1, -(-n_slots // shard_slots))))


def shard_counts(plan: DataFrame, seed: int) -> DataFrame:
    """source_key, source_no, shard and n: how many slots of each source each shard gets, drawn slot by slot."""
    runs = (
        plan.where("n_slots > 0")
        .select("source_key", "source_no", "n_slots", "n_shards", F.explode(F.sequence(long(0), F.floor((F.col("n_slots") - 1) / SLOT_RUN).cast("long"))).alias("run"))
        .repartition("source_key", "run")
    )
    k = F.explode(F.sequence(F.col("run") * SLOT_RUN, F.least(F.col("n_slots"), (F.col("run") + 1) * SLOT_RUN) - 1))
    each = runs.select("source_key", "source_no", "n_shards", k.alias("k"))
    return each.select("source_key", "source_no", drawn(F.col("k"), F.col("source_no") * 1009 + seed, F.col("n_shards")).alias("shard")).groupBy("source_key", "source_no", "shard").agg(F.count(F.lit(1)).alias("n"))


def slots(plan: DataFrame, block_words: int, seed: int) -> DataFrame:
    """One row per slot: source_key, block, pass_no, most (words it takes from the block's start), shard."""
    counts = running_within(saved(shard_counts(plan, seed), "shard-counts"), "source_no", "shard", "n")
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = counts.drop("source_no").join(plan, "source_key").repartition(parts, "source_key", "shard")  # few rows, which unfold here
    each = each.select("source_key", "shard", "n_blocks", "full", "rest", "n_slots", "keys", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("k"))
    each = each.withColumn("pass_no", F.floor(F.col("k") / F.col("n_blocks")).cast("long"))
    step = F.col("k") - F.col("pass_no") * F.col("n_blocks")
    last = (F.col("pass_no") == F.col("full")) & (F.col("k") == F.col("n_slots") - 1)
    block = permuted(step, F.col("n_blocks"), F.element_at("keys", (F.col("pass_no") + 1).cast("int")))
    return each.select("source_key", block.alias("block"), "pass_no", F.when(last, F.col("rest") - step * block_words).otherwise(block_words).cast("long").alias("most"), "shard")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs=MAX_EPOCHS, block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, part_rows=PART_ROWS, seed=17) -> DataFrame:
    """The mix, one row per document and slot that takes words of it: doc_id, size, doc_key, same, source_size, target, first_word, words, pass_no, shard.

    A document without words has one row with null slot columns; so has each block that no slot takes.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    rows = saved(sized(docs), "sizes")
    n_parts = rows.count() // part_rows + 1
    part = drawn(F.coalesce(F.col("doc_id"), F.lit(0)), F.col("text_hash") + F.col("same"), long(n_parts))  # equal rows lie in different parts
    rows = rows.withColumn("source_key", key).withColumn("part", part)
    parts = rows.groupBy("source_key", "part").agg(F.min("source").alias("source"), F.sum("size").alias("words"))
    plan = source_plan(parts, weights, max_epochs, block_words, shard_slots, seed)
    starts = running_within(parts, "source_key", "part", "words").join(plan.select("source_key", "source_size", "target"), "source_key").select("source_key", "part", F.col("before").alias("part_start"), "source_size", "target")

    in_part = Window.partitionBy("source_key", "part").orderBy("doc_id", "size", "text_hash", "doc_key", "same")
    start = F.col("part_start") + F.sum("size").over(in_part) - F.col("size")
    placed = rows.join(starts, ["source_key", "part"]).withColumn("start", start)
    of_block = F.explode(F.sequence(F.floor(F.col("start") / block_words).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long"))).alias("block")
    columns = ["doc_id", "size", "doc_key", "same", "source_size", "target"]
    pieces = placed.where("size > 0").select(*columns, "source_key", "start", of_block)
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.coalesce(F.col("most"), F.lit(0)))
    taken = (
        pieces.join(slots(plan, block_words, seed).hint("merge"), ["source_key", "block"], "left")  # slots unfold after their size is estimated
        .withColumn("words", F.greatest(long(0), end - begin))
        .select(*columns, (begin - F.col("start")).alias("first_word"), F.coalesce("words", F.lit(0)).alias("words"), "pass_no", "shard")
    )
    none = placed.where("size = 0")  # in no block
    return taken.unionByName(none.select(*columns, long(0).alias("first_word"), long(0).alias("words"), F.lit(None).cast("long").alias("pass_no"), F.lit(None).cast("long").alias("shard")))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, first_shard (null if none of its words is taken)."""
    return (
        mix(docs, **options)
        .groupBy("doc_key", "same")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("shard"))).alias("first_shard"))
        .select("doc_id", "size", "source_size", "target", "taken", "first_shard")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of docs: one row per document and pass that takes words of it.

    A document taken whole keeps its text; one taken in part keeps the words taken, joined by one
    space. n_chars, if there, follows the text. Rows equal in doc_id, source and text are told apart
    by a number only.
    """
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    own = {c: free(docs, f"_{c}") for c in ("parts", "taken", "list", "key", "row", "same", "doc_key")}
    parts = F.array_sort(F.collect_list(F.struct("first_word", "words")))
    taken = mix(docs, **options).where("words > 0").groupBy("doc_key", "same", "pass_no").agg(parts.alias(own["parts"]), F.sum("words").alias(own["taken"]))
    taken = taken.select(F.col("doc_key").alias(own["doc_key"]), F.col("same").alias(own["same"]), own["parts"], own["taken"])
    keyed = docs.withColumn(own["key"], document_key())
    numbered = keyed.withColumn(own["row"], F.row_number().over(Window.partitionBy(own["key"]).orderBy(F.lit(0))).cast("long"))
    joined = numbered.join(taken, (F.col(own["key"]) == F.col(own["doc_key"])) & (F.col(own["row"]) == F.col(own["same"])))
    # The list is used twice below, so that Catalyst keeps it a column of its own and words are found once for each text.
    joined = joined.withColumn(own["list"], words)
    kept = F.array_join(F.flatten(F.transform(own["parts"], lambda p: F.slice(own["list"], (p["first_word"] + 1).cast("int"), p["words"].cast("int")))), " ")
    text = F.when(F.col(own["taken"]) == F.size(own["list"]), F.col("text")).otherwise(kept)
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[e.alias(c) for c, e in columns.items()])
