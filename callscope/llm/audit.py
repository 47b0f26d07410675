"""Audit of how text filters interact (operator 11) by a Walsh-Hadamard transform.

Each row fails some of ``k`` filters, which makes a mask of ``k`` bits. For each part (a source) and each label the rows are
summed under all ``2 ** k`` signs ``(-1) ** popcount(mask & s)``: partial sums in each task, then one row a part. The
transform is its own inverse but for a factor of ``2 ** k``, so the counts of all masks come back from the parity sums exactly, in
integers. What any order of filters keeps and removes is a sum over masks; what a filter removes over all ``k!`` orders is in closed form:
of the filters a row fails, each comes first in ``k! / failures`` of the orders.

Equal texts are told by their SHA-256. Rows are first summed for each id and then for each text, part and label, so a text that a
third of all rows hold meets its other rows as one sum from each task; only then the smallest id of each text is found. No text is shuffled.

Defined results: a null or empty text has no words and no characters; a null part is the empty string; no id is
smaller than a null one, so its row is never a copy, and it has no label; rows with one id and text all count, and
aren't copies of each other; a document with several label rows has a label if one of them has; a text of any length is taken whole; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import words_of

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")


def failures(text: Column) -> Column:
    """Bits of the filters that look at one text: few words, few different words, capitals, marks."""
    t = F.coalesce(text, F.lit(""))
    words = words_of(t)
    n = F.size(words)
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * F.length(t), t.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0)).cast("int")


def cells(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """``part, good, toxic, mask, n``: rows by text and part, each with the mask of the filters it fails; a mask may stand in many rows."""
    rows = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
        failures(F.col(text)).alias("own"),
    )
    # rows without an id are dealt by their text, so that they don't meet in one task
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest", "part")).otherwise(0))
    rows = rows.groupBy("id", "salt", "part", "digest", "own").agg(F.count(F.lit(1)).alias("m"))
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    rows = rows.join(told, ["id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "m")))  # an id stands once with a text, a part and its labels
    held = rows.groupBy("digest", "part", "good", "toxic", "own").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("m")).otherwise(0)).alias("unnamed"), least.alias("least"))
    of_text = Window.partitionBy("digest")
    held = held.withColumn("first", F.min("least.id").over(of_text))
    held = held.withColumn("alone", F.col("unnamed") + F.when(F.col("least.id") == F.col("first"), F.col("least.m")).otherwise(0))
    by = [F.struct(F.col("own").alias("mask"), F.col("alone").alias("n")), F.struct((F.col("own") + COPY).alias("mask"), (F.col("n") - F.col("alone")).alias("n"))]
    return held.select("part", "good", "toxic", F.explode(F.array(*by)).alias("cell")).select("part", "good", "toxic", "cell.mask", "cell.n")


def parity_sums(cells: DataFrame, k: int = len(FILTERS)) -> DataFrame:
    """A row a part, with the signed sums of all, good and toxic rows as arrays of ``2 ** k``."""

    def sums(counted: Column) -> Column:
        signed = [F.sum(F.when(F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2 == 0, counted).otherwise(-counted)) for s in range(1 << k)]
        return F.array(*signed)

    n = F.col("n")
    return cells.groupBy("part").agg(*[sums(F.when(of, n).otherwise(0)).alias(name) for name, of in (("every", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))])


def inverted(sums: Column, k: int = len(FILTERS)) -> Column:
    """Counts of all masks from their parity sums, exact."""
    every = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    at = lambda m: F.aggregate(F.zip_with(every, sums, lambda s, x: F.when(F.bit_count(s.bitwiseAND(m)) % 2 == 0, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(every, lambda m: F.shiftright(at(m), k))


def total(counts: Column, of: Column, k: int = len(FILTERS)) -> Column:
    """Sum of the counts of the masks for which ``of`` (an array of booleans by mask) holds."""
    return F.aggregate(F.zip_with(counts, of, lambda c, x: F.when(x, c).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)


def audit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step, with what the step keeps, removes and shares."""
    k = len(FILTERS)
    counts = parity_sums(cells(docs, labels, text=text, key=key, part=part), k)
    counts = counts.select("part", *[inverted(F.col(c), k).alias(c) for c in ("every", "good", "toxic")])
    every = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    # what a filter removes over all orders: of the filters that a row fails each is first equally often
    share = lambda bit: F.aggregate(F.zip_with(every, F.col("every"), lambda m, c: F.when(m.bitwiseAND(bit) != 0, c * (F.lit(factorial(k)) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    counts = counts.withColumn("shares", F.array(*[share(F.lit(1 << i)) for i in range(k)]))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bit_of = lambda letter: F.pow(F.lit(2), F.ascii(letter) - ord("A")).cast("int")
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    steps = steps.withColumn("bit", bit_of(letter))
    before = F.aggregate(F.slice(F.split("filter_order", ""), 1, F.col("step") - 1), F.lit(0), lambda a, x: a + bit_of(x))
    steps = steps.withColumn("before", before)
    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = F.transform(every, lambda m: fails(m) & ~earlier(m))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(F.col("every"), F.transform(every, lambda m: ~fails(m) & ~earlier(m))).alias("kept"),
        total(F.col("every"), removed).alias("removed"),
        total(F.col("every"), F.transform(every, lambda m: fails(m) & earlier(m))).alias("redundant"),
        F.element_at("every", F.col("bit") + 1).alias("unique_fails"),
        total(F.col("good"), removed).alias("good_lost"),
        total(F.col("toxic"), removed).alias("toxic_lost"),
        F.element_at("shares", F.ascii(letter) - ord("A") + 1).alias("shapley"),
    )
