"""Joins of names with the texts that contain them, by an inverted index of grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of grams; a needle is looked up by grams of the largest that it is long enough for.
SIZES = (1, 2, 4, 8, 16)


def grams(text: Column, size: Column | int) -> Column:
    """Distinct substrings of ``size`` characters; none of a shorter text."""
    n = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, n)))


def containing(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """``needle, hay``: pairs of distinct texts of which the second contains the first.

    Each needle is looked up by the one of its grams that the fewest hay texts hold, and what is found is verified; so the join is on equal grams, and a common
    word in every needle costs nothing where something else in it is rare. Grams grow with the needle: of a fixed size there are only so many, and each would be
    held by ever more texts. Joins are by sorted partitions, as the tables of grams grow with the input and nothing of them belongs in the driver. Both
    sides are made distinct first. Null and empty needles are in no pair: they would be in all.
    """
    n = needles.select(F.col(needles.columns[0]).alias("needle")).where("needle != ''").distinct()
    h = hay.select(F.col(hay.columns[0]).alias("hay")).where("hay != ''").distinct()
    held = h.select("hay", F.explode(F.flatten(F.array(*[grams(F.col("hay"), s) for s in SIZES]))).alias("gram"))
    size = F.lit(SIZES[0])
    for s in SIZES[1:]:
        size = F.when(F.length("needle") >= s, s).otherwise(size)
    asked = n.select("needle", F.explode(grams(F.col("needle"), size)).alias("gram"))
    wanted = asked.select("gram").distinct()
    counts = held.join(wanted.hint("merge"), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts.hint("merge"), "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    keyed = rarest.where("least.n > 0").select("needle", F.col("least.gram").alias("gram"))
    return held.join(keyed.hint("merge"), "gram").where(F.contains("hay", "needle")).select("needle", "hay")
