"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import all_columns, free_names, quoted, save

#: Weights of the sources in order, from the first again after the last.
WEIGHTS = (5.0, 2.0, 1.0)
#: Most copies of a document.
MOST = 3
#: Units that one step of the reduction tree resolves to a single open one.
FAN = 32
#: Words, as `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """units (source, size, m: how many) -> source, n, source_size, target: one row per source.

    Sources in code point order, null last, get the weights in turn. A target is
    level * weight, but no more than MOST times its source: sources ordered by
    how soon they are full are filled up, and the first level that the next one
    can bear is the level of all that follow.
    """
    sizes = units.groupBy("source").agg(F.sum("m").alias("n"), F.sum(F.col("size") * F.col("m")).alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    full = F.col("full")
    by_full = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_full.rowsBetween(Window.unboundedPreceding, -1), by_full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("full", (F.lit(float(MOST)) * F.col("source_size")))
        .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("bears", F.col("level") * F.col("weight") <= full)
    )
    level = F.min(F.when(F.col("bears"), F.struct(full / F.col("weight"), F.col("level")))).over(everything)["level"]
    return filled.withColumn("common", level).select(
        "source", "n", "source_size", F.coalesce(F.least(F.col("common") * F.col("weight"), full), full).alias("target")
    )


def _uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _pair(open_: Column, unit: Column, seed: int) -> Column:
    """Two units -> struct(done, open): mass moves at random until one is 0 or 1.

    Moving `down` from the open one or `up` to it, with odds that keep each
    expectation, leaves size * p of both together as it was.
    """
    mine, theirs = open_["size"] * open_["p"], unit["size"] * unit["p"]
    down = F.least(mine, unit["size"] * (1 - unit["p"]))
    up = F.least(theirs, open_["size"] * (1 - open_["p"]))
    goes_down = _uniform(open_["key"], open_["i"], unit["key"], unit["i"], F.lit(seed)) * (down + up) <= up

    def ends(done: Column, take: int, left: Column, mass: Column) -> Column:
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mass / left["size"]))
        return F.struct(
            F.struct(done["key"].alias("key"), done["i"].alias("i"), done["size"].alias("size"), F.lit(take).alias("take")).alias("done"),
            F.struct(left["key"].alias("key"), left["i"].alias("i"), left["size"].alias("size"), p.alias("p")).alias("open"),
        )

    return F.when(goes_down, F.when(mine <= down, ends(open_, 0, unit, theirs + mine)).otherwise(ends(unit, 1, open_, mine - down))).otherwise(
        F.when(theirs <= up, ends(unit, 0, open_, mine + theirs)).otherwise(ends(open_, 1, unit, theirs - up))
    )


def _reduce(units: Column, kind: str, seed: int) -> Column:
    """An array of units -> struct(done array, open): pairs the open one with each unit in turn."""
    first = F.struct(F.lit(None).cast(f"array<struct<key:{kind},i:bigint,size:bigint,take:int>>").alias("done"), F.element_at(units, 1).alias("open"))
    first = first.withField("done", F.array().cast(f"array<struct<key:{kind},i:bigint,size:bigint,take:int>>"))

    def step(state: Column, unit: Column) -> Column:
        both = F.transform(F.array(_pair(state["open"], unit, seed)), lambda x: F.struct(F.concat(state["done"], F.array(x["done"])).alias("done"), x["open"].alias("open")))
        return F.element_at(both, 1)

    return F.aggregate(F.slice(units, 2, F.size(units)), first, step)


def copies(units: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """units (key struct, source, size) -> key, i, size, source, source_size, target, copies.

    One row per unit; units alike in key, source and size are told apart by i from
    1. Each expects target / source_size copies. The whole part is certain; the
    fractions go through a reduction tree: FAN units of a source are paired one
    after the other until all but one are decided, and the open ones form the next
    level, so the words that a source gives change in the last step alone, where
    its one open unit is rounded to the nearer side: by half a document at most.
    Larger units go first, so that this tends to be a small one. Random numbers are
    hashes of keys, so reruns agree. Units of size 0 and whole expectations need
    no tree. No group has more than a few times
    FAN units, however large its source.
    """
    alike = save(units.groupBy("key", "source", "size").agg(F.count("*").alias("m")), "alike")
    goals = save(targets(alike, weights), "targets")
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    rows = (
        alike.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))).alias("i"))
        .alias("u")
        .join(goals.withColumnRenamed("source", "of").alias("g"), F.col("source").eqNullSafe(F.col("of")))
        .select("key", "i", "size", "source", "n", "source_size", "target", F.floor(share + 1e-12).cast("int").alias("base"), share.alias("share"))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("share") - F.col("base")))
    )
    rows = save(rows, "units")
    fractional = (F.col("p") > 1e-12) & (F.col("size") > 0)
    kind = rows.schema["key"].dataType.simpleString()
    level = rows.where(fractional).select(
        "source", F.ceil(F.col("n") / FAN).alias("buckets"), F.struct("key", "i", "size", "p").alias("unit"), F.xxhash64("key", "i").alias("order")
    ).withColumn("bucket", F.pmod("order", "buckets")).withColumn("order", F.struct(-F.col("unit.size"), F.col("order")))
    most = goals.agg(F.max("n")).first()[0] or 0
    decided, seed = [], 1
    while True:
        most = -(-most // FAN)
        done = save(
            level.groupBy("source", "bucket")
            .agg(F.first("buckets").alias("buckets"), F.array_sort(F.collect_list(F.struct("order", "unit"))).alias("units"))
            .select("source", "bucket", "buckets", _reduce(F.col("units")["unit"], kind, seed).alias("r")),
            "level",
        )
        decided.append(done.select("source", F.explode("r.done").alias("x")).select("source", "x.*"))
        if most <= 1:
            break
        level = done.select(
            "source", F.ceil(F.col("buckets") / FAN).alias("buckets"), F.col("r.open").alias("unit"), F.struct(-F.col("r.open.size"), F.xxhash64("r.open.key", "r.open.i", F.lit(seed))).alias("order"),
            F.floor(F.col("bucket") / FAN).alias("bucket"),
        )
        seed += 1
    last = F.col("r.open.p") >= 0.5
    decided.append(done.select("source", "r.open.key", "r.open.i", "r.open.size", last.cast("int").alias("take")))
    taken = decided[0]
    for part in decided[1:]:
        taken = taken.unionByName(part)
    facts = goals.select(F.col("source").alias("of"), "source_size", "target", F.floor(share + 1e-12).cast("int").alias("base"))
    out = ["key", "i", "size", "source", "source_size", "target", "copies"]
    drawn = taken.join(facts, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", F.col("base") + F.col("take"))
    return rows.where(~fractional).withColumn("copies", F.when(F.col("size") > 0, F.col("base")).otherwise(0)).select(*out).unionByName(drawn.select(*out))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, size, source_size, target, taken, copies; one row per row.

    Null texts have size 0 and are never taken; a null source is a source; rows
    without an id are told apart by source, size and number; other columns are not
    read; an empty table gives an empty result.
    """
    units = docs.select(F.struct("doc_id").alias("key"), "source", n_words().alias("size"))
    return copies(units, weights).select(
        "key.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "copies"
    )


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs.

    Rows equal in doc_id, text and source share their copies out evenly. Other
    columns, of any name, are left as they are.
    """
    own, nth, id_, text, source, n, m, copy = free_names(docs, "own", "nth", "id", "th", "of", "n", "m", "copy")
    keyed = docs.select(*all_columns(docs), F.xxhash64("text").alias(own))
    units = keyed.select(F.struct("doc_id", quoted(own).alias("text")).alias("key"), "source", n_words().alias("size"))
    total = copies(units, weights).groupBy("key", "source").agg(F.sum("copies").alias("n"), F.count("*").alias("m")).where("n > 0")
    total = total.select(F.col("key.doc_id").alias(id_), F.col("key.text").alias(text), F.col("source").alias(source), F.col("n").alias(n), F.col("m").alias(m))
    numbered = keyed.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", quoted(own), "source").orderBy(F.lit(0))))
    same = F.col("doc_id").eqNullSafe(quoted(id_)) & quoted(own).eqNullSafe(quoted(text)) & F.col("source").eqNullSafe(quoted(source))
    each = (quoted(n) / quoted(m)).cast("int") + (quoted(nth) <= quoted(n) % quoted(m)).cast("int")
    return numbered.join(total, same).select(*all_columns(docs), F.explode(F.array_repeat(F.lit(1), each)).alias(copy)).select(*all_columns(docs))
