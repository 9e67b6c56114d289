"""Joins on containment, as equality joins on character grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the grams that candidates must share.
GRAM = 3
#: Bits (a power of two) that the needles' grams are hashed to; grams of the hay without theirs go before the shuffle.
BITS = 1 << 16


def shuffled(df: DataFrame) -> DataFrame:
    """df, never broadcast in a join: sizes of derived texts are guessed from the columns they come from, or known compressed, both far too low."""
    return df.hint("merge")


def _spot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS)).cast("int")


def _bits_of(wanted: DataFrame) -> DataFrame:
    """One row with bits, an array of numbers that hold a bit for each spot of a gram of wanted."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _spot(F.col("gram")).bitwiseAND(F.lit(63)))
    words = wanted.groupBy(F.shiftright(_spot(F.col("gram")), 6).alias("w")).agg(F.bit_or(bit).alias("b"))
    found = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("found"))
    return found.select(F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("found", w), F.lit(0).cast("bigint"))).alias("bits"))


def contains_join(hay: DataFrame, hay_column: str, needles: DataFrame, needle_column: str) -> DataFrame:
    """Pairs of distinct (hay, needle) where hay contains needle; an empty needle is in all.

    A needle of GRAM characters or more is looked up by its last GRAM ones among
    the grams of the hay; a shorter one by itself among the grams of its length, of
    which there are three kinds at most. So no side is compared with all of the other,
    and of the hay's grams only those go on that may be a needle's.
    """
    hay = hay.select(F.col(hay_column).alias("hay")).where("hay is not null").distinct()
    needles = needles.select(F.col(needle_column).alias("needle")).where("needle is not null").distinct()
    n = F.length("hay")

    def of(size: int):
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(F.col("hay"), i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    grams = F.concat(F.array(F.lit("")), *(of(size) for size in range(1, GRAM + 1)))
    size = F.length("needle")
    wanted = needles.select("needle", F.when(size <= GRAM, F.col("needle")).otherwise(F.substring(F.col("needle"), size - GRAM + 1, F.lit(GRAM))).alias("gram"))
    held = lambda g: F.call_function("shiftright", F.get("bits", F.shiftright(_spot(g), 6)), _spot(g).bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint")) == 1
    keyed = hay.crossJoin(F.broadcast(_bits_of(wanted))).select("hay", F.explode(F.array_distinct(F.filter(grams, held))).alias("gram"))
    return keyed.join(shuffled(wanted), "gram").where(F.contains("hay", "needle")).select("hay", "needle").distinct()
