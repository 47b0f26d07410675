"""Mixing sources to target weights (operator 6), with DataFrame functions only.

Iterative proportional fitting within bounds: documents are first summed to cells (source, language, topic), whose
drawn tokens are raked in turn to each marginal's target until all three agree to ``tolerance``. No cell gives more than it has: one that
reaches its tokens stays there (probability 1) while the others of its group are raked on to what the target still lacks, and is
released where its group has too much; none is drawn at less than ``LEAST`` of ``keep``, so goals that contradict each other don't empty a cell. Each cell's drawn tokens over its tokens are a calibrated sampling probability, and a
document stays if a hash of its id, taken as a uniform number, is below it.

Targets are given for each dimension as shares of its groups (``targets``; made to sum to 1, groups that aren't named get
what their tokens stand for). A dimension without targets takes its token shares to the power ``alpha``, made to sum to 1:
below 1 flattens them, 0 makes them uniform, 1 keeps them.

``keep`` is the share of all tokens to draw. A group that is asked for more than it holds is drawn whole, and what it lacks is spread over the
other groups of its dimension in proportion to their targets, so a rare group costs no volume. ``reached`` tells which targets that changes.

The cells, some thousands of rows, are raked in one partition up to ``MOST_CELLS``, where windows need no shuffle, and in shuffled windows beyond. The documents
themselves are only summed once and joined once with the cells, map-side where the cells are small.

Defined results: null source or language is a group of its own; null and empty texts weigh one token;
repeated rows share one decision; an empty table gives no rows; all columns of the input are kept, and
clashing names don't matter, since helper columns carry a prefix of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from callscope.llm.common import materialize

DIMENSIONS = ("source", "lang", "topic")
ALPHAS = {"source": 0.7, "lang": 0.8, "topic": 1.0}
P = "__mix_"
LEAST = 0.01  # of ``keep`` is drawn of any cell
MOST_CELLS = 100_000  # that are raked in one partition, or broadcast


def tokens_of(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from plain marks of a text: licence, code, table, brief or prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.lower(t).contains("licen"), "licence")
        .when(t.contains("{") | t.contains("</"), "code")
        .when(t.contains(" | "), "table")
        .when(F.length(t) < 400, "brief")
        .otherwise("prose")
    )


def uniform_of(key: Column, salt: str = "mix") -> Column:
    """A number in [0, 1) from an id, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def target_shares(cells: DataFrame, dimension: str, alpha: float, given: dict[str | None, float] | None) -> DataFrame:
    """``group_, target``: the share of each group of a dimension."""
    sums = cells.groupBy(F.col(dimension).alias("group_")).agg(F.sum("tokens").cast("double").alias("tokens"))
    if given:
        named = cells.sparkSession.createDataFrame([(g, float(w)) for g, w in given.items()], f"name {dict(cells.dtypes)[dimension]}, share double")
        whole = sums.agg(F.sum("tokens")).first()[0] or 1.0
        sums = sums.join(F.broadcast(named), F.col("group_").eqNullSafe(F.col("name")), "left").select("group_", F.coalesce("share", F.col("tokens") / whole).alias("mass"))  # as many as the caller names
    else:
        sums = sums.select("group_", F.pow("tokens", alpha).alias("mass"))
    total = sums.agg(F.sum("mass")).first()[0] or 1.0
    return sums.select("group_", (F.col("mass") / total).alias(f"target_{dimension}"))


def attainable(cells: DataFrame, dimension: str, alpha: float, given: dict[str | None, float] | None, volume: float) -> DataFrame:
    """``group_, target, goal``: each group's share, and the tokens to draw of it, which are no more than it holds.

    Goals are ``least(held, factor * target)``. With groups in the order of held tokens to target, the factor if all groups before one are drawn whole is
    largest at the first group that isn't.
    """
    held = cells.groupBy(F.col(dimension).alias("group_")).agg(F.sum("tokens").cast("double").alias("held"))
    asked = target_shares(cells, dimension, alpha, given).withColumnRenamed("group_", "name")
    out = held.join(asked, held["group_"].eqNullSafe(asked["name"]))  # a row a group
    t = F.col(f"target_{dimension}")
    order = Window.orderBy(F.expr(f"try_divide(held, target_{dimension})").asc_nulls_last(), "group_")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    factor = (F.lit(volume) - F.coalesce(F.sum("held").over(before), F.lit(0.0))) / F.nullif(F.sum(t).over(rest), F.lit(0.0))
    out = out.withColumn("factor", factor).withColumn("factor", F.max("factor").over(Window.partitionBy()))
    return out.select("group_", t, F.least("held", F.col("factor") * t).alias(f"goal_{dimension}"))


def raked(cells: DataFrame, alphas: dict[str, float], targets: dict[str, dict[str | None, float]], keep: float, tolerance: float, most_rounds: int, together: int = 10) -> DataFrame:
    """``cells`` (dimensions, tokens) with the drawn tokens fitted to every marginal's goal, and the target shares."""
    n, total = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    volume = keep * (total or 0)
    if n <= MOST_CELLS:
        cells = cells.coalesce(1)
    out = cells.withColumn("drawn", F.col("tokens") * F.lit(float(keep)))
    for d in DIMENSIONS:
        goal = attainable(cells, d, alphas[d], targets.get(d), volume)
        out = out.join(goal, out[d].eqNullSafe(goal["group_"]), "left").drop("group_")
    out = materialize(out.coalesce(1) if n <= MOST_CELLS else out, "mix-goals")
    for _ in range(0, most_rounds, together):  # so many rounds are one job
        if n <= MOST_CELLS:
            out = out.coalesce(1)
        for k in range(together):
            for d in DIMENSIONS:
                group, goal, full = Window.partitionBy(d), F.col(f"goal_{d}"), F.col("drawn") >= F.col("tokens")
                out = out.withColumns({"all_": F.sum("drawn").over(group), "full": F.sum(F.when(full, F.col("drawn")).otherwise(0.0)).over(group)})
                fewer = F.when(F.col("all_") > 0, goal / F.col("all_")).otherwise(1.0)
                more = F.when(full | (F.col("all_") <= F.col("full")), 1.0).otherwise((goal - F.col("full")) / (F.col("all_") - F.col("full")))
                if k == together - 1:
                    out = out.withColumn(f"off_{d}", F.abs(F.col("all_") - goal) / F.greatest(goal, F.lit(1e-9)))
                out = out.withColumn("drawn", F.greatest(F.lit(LEAST * keep) * F.col("tokens"), F.least(F.col("tokens").cast("double"), F.col("drawn") * F.when(F.col("all_") > goal, fewer).otherwise(more))))
        off = F.greatest(*[F.col(f"off_{d}") for d in DIMENSIONS])
        seen = Observation()
        out = materialize(out.observe(seen, F.max(off).alias("off")), "mix-raked").drop("all_", "full", *[f"off_{d}" for d in DIMENSIONS])
        if (seen.get["off"] or 0.0) <= tolerance:
            break
    return out


def calibrated(docs: DataFrame, *, keep: float, alphas: dict[str, float] | None = None, targets: dict[str, dict[str | None, float]] | None = None, tolerance: float = 1e-9, most_rounds: int = 200, text: str = "text", topic: Column | None = None) -> DataFrame:
    """Cells with ``tokens``, ``n_docs``, raked ``weight`` (their share of what is drawn), the sampling probability, and the targets and goals of their groups."""
    per_doc = docs.select(F.col("source"), F.col("lang"), (topic_of(F.col(text)) if topic is None else topic).alias("topic"), tokens_of(F.col(text)).alias("tokens"))
    cells = materialize(per_doc.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "mix-cells")
    fitted = raked(cells, alphas or ALPHAS, targets or {}, keep, tolerance, most_rounds)
    drawn = fitted.agg(F.sum("drawn")).first()[0] or 1.0
    ends = [f"{x}_{d}" for d in DIMENSIONS for x in ("target", "goal")]
    return fitted.select(*DIMENSIONS, "tokens", "n_docs", (F.col("drawn") / drawn).alias("weight"), (F.col("drawn") / F.col("tokens")).alias("probability"), *ends)


def reached(cells: DataFrame) -> DataFrame:
    """``dimension, group, tokens, target, reached``: the share asked for and the share drawn of each group of ``calibrated`` cells."""
    out = None
    for d in DIMENSIONS:
        one = cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("group")).agg(F.sum("tokens").alias("tokens"), F.first(f"target_{d}").alias("target"), F.sum("weight").alias("reached"))
        out = one if out is None else out.unionByName(one)
    return out


def mix(docs: DataFrame, *, keep: float = 0.7, alphas: dict[str, float] | None = None, targets: dict[str, dict[str | None, float]] | None = None, text: str = "text", key: str = "doc_id", topic: Column | None = None, tolerance: float = 1e-9) -> DataFrame:
    """The sampled documents, with all their columns and ``__mix_probability``; ``topic`` is a column of ``docs``, by default a coarse one made of the text."""
    cells = materialize(calibrated(docs, keep=keep, alphas=alphas, targets=targets, text=text, topic=topic, tolerance=tolerance), "mix-fitted")
    c = cells.select(*[F.col(d).alias(P + d) for d in DIMENSIONS], F.col("probability").alias(P + "probability"))
    d = docs.withColumn(P + "t", topic_of(F.col(text)) if topic is None else topic)
    on = d["source"].eqNullSafe(c[P + "source"]) & d["lang"].eqNullSafe(c[P + "lang"]) & d[P + "t"].eqNullSafe(c[P + "topic"])
    if cells.count() <= MOST_CELLS:  # a checked bound on what is broadcast; beyond it a shuffled join, which AQE splits where a cell is hot
        c = F.broadcast(c)
    out = d.join(c, on).where(uniform_of(F.col(key)) < F.col(P + "probability"))
    return out.select(*docs.columns, P + "probability")
