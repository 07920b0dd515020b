"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule, a piecewise-linear function over training time 0 to 1. Its integral, scaled to the
source's target, is the cumulative demand for that source's words. A source's documents stand in a fixed pseudo-random
order (passes after each other when the target exceeds what there is); the words before a document, put into the
inverse of the cumulative demand, give its position in training. Documents are then range-sorted by position.

Defined cases: a null text or one of white space has size 0 and is never taken; a null source is a source of its own,
last in order; null ids are ids like others; rows that are repeated are separate documents, next to each other in their
source's order; an empty table gives an empty
mix; extra columns are not read (`mix`) or pass through (`mixed_rows`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base

#: Fixed weights, dealt to the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: Knots of the schedules, dealt likewise: (time, relative weight), linear in between.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
#: Slices of a source's order: each has its own task for the running sum, so that a hot source is spread.
SLICES = 1024


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per source: source, rank, source_size, target.

    The shares are share * (all sizes) by weight; a source stops at cap times its size and the excess goes to the
    others by weight. All sources below their cap then stand at one level times their weight, so sorting by
    cap * size / weight finds the level with two running sums. Windows run over the sources, not the documents.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(every)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", n).withColumn(
        "w", F.element_at(F.lit([float(w) for w in weights]), (F.pmod(n - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    by = W.orderBy((F.col("top") / F.col("w")), "rank").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        ranked.withColumn("top", cap * F.col("source_size"))
        .withColumn("whole", share * F.sum("source_size").over(whole.partitionBy()))
        .withColumn("rest", F.col("whole") - F.coalesce(F.sum("top").over(by), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(whole.partitionBy()) - F.coalesce(F.sum("w").over(by), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("rest_w"))
        .withColumn("reached", F.max(F.when(F.col("level") * F.col("w") <= F.col("top"), F.col("level"))).over(whole.partitionBy()))
    )
    return level.select("source", "rank", "source_size", F.least(F.coalesce("reached", F.lit(float("inf"))) * F.col("w"), F.col("top")).alias("target"))


def _segments(knots: tuple) -> list[tuple[float, float, float, float, float]]:
    """(start time, length, weight at start, slope, share of demand before), the weights scaled to integral 1."""
    area = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))
    out, before = [], 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        out.append((t0, t1 - t0, a / area, (b - a) / area / (t1 - t0), before))
        before += (t1 - t0) * (a + b) / 2 / area
    return out


def position(fraction: Column, rank: Column, schedules: tuple = SCHEDULES) -> Column:
    """Training time at which a source has had this fraction of its demand: the inverse of the integrated schedule."""
    out = None
    for k, knots in enumerate(schedules):
        one = None
        for t0, length, w, slope, before in reversed(_segments(knots)):
            d = fraction - before
            x = 2 * d / (w + F.sqrt(F.greatest(F.lit(w * w) + 2 * slope * d, F.lit(0.0))))
            x = F.lit(t0) + F.least(F.lit(length), x)
            one = x if one is None else F.when(fraction >= nxt, one).otherwise(x)  # noqa: F821
            nxt = before  # noqa: F841
        hit = F.pmod(rank - 1, F.lit(len(schedules))) == k
        out = F.when(hit, one) if out is None else out.when(hit, one)
    return out


def _placed(sizes: DataFrame, share: float, cap: float, weights: tuple, schedules: tuple) -> DataFrame:
    """sizes (source, size, place, tie, ...) with rank, source_size, target and before (words of the source ahead)."""
    goal = targets(sizes, share, cap, weights).withColumnRenamed("source", "goal_source")
    within = W.partitionBy("source", "slice").orderBy("place", "tie", "size")
    sliced = sizes.withColumn("slice", F.conv(F.substring("place", 1, 5), 16, 10).cast("long") % SLICES)
    ahead = (
        sliced.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
        .withColumn("slice_before", F.sum("slice_size").over(W.partitionBy("source").orderBy("slice")) - F.col("slice_size"))
        .join(goal.hint("shuffle_hash"), F.col("source").eqNullSafe(F.col("goal_source")))
        .select(F.col("source").alias("slice_source"), F.col("slice").alias("slice_no"), "slice_before", "rank", "source_size", "target")
    )
    run = F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return (
        sliced.withColumn("run", run)
        .join(ahead.hint("merge"), F.col("source").eqNullSafe(F.col("slice_source")) & (F.col("slice") == F.col("slice_no")))
        .withColumn("before", F.col("run") + F.col("slice_before"))
        .drop("slice_source", "slice_no", "slice_before", "run")
    )


def _passes() -> Column:
    """Passes in which a document is taken: its middle lies before the target when the passes stand one after another."""
    middle = F.col("before") + F.col("size") / 2
    n = F.floor((F.col("target") - middle) / F.col("source_size")) + 1
    return F.when(F.col("size") > 0, F.greatest(F.lit(0), n)).otherwise(0).cast("int")


def _sizes(docs: DataFrame) -> DataFrame:
    text = base.text_of()
    return docs.select(
        "doc_id", "source", base.n_words_of(text).alias("size"),
        # By id and text, so that rows of one id, or of none, are spread over the slices by their texts.
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary")).alias("place"), F.xxhash64("text").alias("tie"),
    )


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, passes, taken, position (of the first pass; null if none).

    Text is read once and dropped at the scan; what moves is a few numbers per document. The rows are range-sorted by
    position, those that are not taken last.
    """
    sizes = base.saved(_sizes(docs), "mix-sizes")
    placed = _placed(sizes, share, cap, weights, schedules)
    out = placed.withColumn("passes", _passes()).select(
        "doc_id", "source", "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"),
        F.when(F.col("passes") > 0, position(F.col("before") / F.col("target"), F.col("rank"), schedules)).alias("position"),
    )
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mixed_rows(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES) -> DataFrame:
    """The mix itself: the columns of docs, a row for every pass of every taken document, range-sorted by position.

    Documents and positions meet on (doc_id, hash of the text); rows equal in both are in the mix as one size each.
    """
    sizes = base.saved(_sizes(docs), "mix-sizes")
    placed = _placed(sizes, share, cap, weights, schedules).withColumn("passes", _passes()).filter("passes > 0")
    # Of rows with the same id and text each is placed by itself; numbering both sides pairs them one to one.
    own, key, no, at = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), ["doc_id", "source", "tie"], "nth", "positions"
    plan = placed.withColumn(no, F.row_number().over(W.partitionBy(*key).orderBy("before"))).select(
        *key, no,
        F.transform(
            F.sequence(F.lit(0), F.col("passes") - 1),
            lambda p: position(F.least(F.lit(1.0), (F.col("before") + p * F.col("source_size")) / F.col("target")), F.col("rank"), schedules),
        ).alias(at),
    )
    # The caller's columns are one struct, so that no name of theirs meets one of these.
    rows = docs.select(own.alias("row"), *(F.col(c).alias(f"row_{c}") for c in key[:2]), F.xxhash64("text").alias("row_tie"))
    rows = rows.withColumn("row_nth", F.row_number().over(W.partitionBy("row_doc_id", "row_source", "row_tie").orderBy("row_doc_id")))
    met = [F.col(f"row_{c}").eqNullSafe(F.col(c)) for c in key[:2]] + [F.col(f"row_{c}") == F.col(c) for c in ("tie", no)]
    taken = rows.join(plan.hint("merge"), met).select("row", F.explode(at).alias("position"))
    return taken.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(base.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "passes", F.round("position", 9).alias("position"))


def _position_sql() -> str:
    cases = []
    for k, knots in enumerate(SCHEDULES):
        one = ""
        for t0, length, w, slope, before in reversed(_segments(knots)):
            x = f"({t0!r}::double + least({length!r}::double, 2 * (f - {before!r}::double) / ({w!r}::double + sqrt(greatest({w * w!r}::double + {2 * slope!r}::double * (f - {before!r}::double), 0.0::double)))))"
            one = x if not one else f"CASE WHEN f >= {nxt!r}::double THEN {one} ELSE {x} END"  # noqa: F821
            nxt = before  # noqa: F841
        cases.append(f"WHEN (rank - 1) % {len(SCHEDULES)} = {k} THEN {one}")
    return f"CASE {' '.join(cases)} END"


ORACLE = {
    "op1_mix": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank, 2.0::double * source_size AS top FROM s),
w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1]::double AS w, 1.5::double * sum(source_size) OVER () AS whole FROM r),
l AS (SELECT *, (whole - coalesce(sum(top) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level FROM w
      WINDOW p AS (ORDER BY top / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(CASE WHEN level * w <= top THEN level END) OVER () AS reached FROM l),
t AS (SELECT source, rank, source_size, least(coalesce(reached, 'infinity'::double) * w, top) AS target FROM m),
b AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY CAST('0x' || substr(place, 1, 5) AS BIGINT) % {SLICES}, place, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before FROM d),
p AS (SELECT doc_id, b.source, size, source_size, target, before / target AS f, rank,
             CAST(CASE WHEN size > 0 THEN greatest(0, floor((target - (before + size / 2.0::double)) / source_size) + 1) ELSE 0 END AS INTEGER) AS passes
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * passes AS taken, source, passes,
       round(CASE WHEN passes > 0 THEN {_position_sql()} END, 9) AS position FROM p
""",
}
QUERIES = {"op1_mix": op1_mix}
