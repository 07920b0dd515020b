"""Exact quantiles by refinement.

A group's wanted ranks each lie in an interval of values, at first all of the group's. A pass counts the interval's rows
in bins, map-side, and keeps the bin that the rank falls into, until an interval has few rows or one value. Only those
rows are then put in order. No task holds a group, nor all its distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.sources import io

BINS = 1024
#: Rows of an interval that are put in order by one task.
FEW = 10_000


def exact_quantiles(df: DataFrame, key: list[str], col: str, at: list[float], bins: int = BINS, few: int = FEW, written: bool = False) -> DataFrame:
    """key and q: for each fraction in `at` the value at that place of the group's order, linear between neighbours.

    Null and NaN count as missing; a group without values has no row. written: df is a written table, which is read again
    in every pass as it is.
    """
    rows = df.select(*key, F.col(col).cast("double").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = rows if written else io.saved(rows, "quantile-values")
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    # The two ranks (from 0) around each place; a rank that several places share is looked for once.
    places = F.array(*[F.lit(float(q)) * (F.col("n") - 1) for q in at])
    ranks = F.array_distinct(F.concat(F.transform(places, lambda p: F.floor(p)), F.transform(places, lambda p: F.ceil(p))))
    known = io.saved(groups.withColumn("places", places), "quantile-groups")
    # rank within the interval, rows in it, its lowest and highest value.
    wanted = io.saved(known.select(*key, F.explode(ranks).alias("rank"), F.col("n").alias("here"), "low", "high").withColumn("inside", F.col("rank")), "quantile-ranks")
    while True:
        wide = wanted.filter((F.col("here") > few) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            break
        intervals = io.saved(wide.select(*key, "low", "high").distinct(), "quantile-intervals")
        met = _met(rows, intervals, key)
        # Halves first: the width of an interval may be beyond what a double holds.
        share = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        counted = met.withColumn("bin", F.least(F.lit(bins - 1), F.floor(share * bins))).groupBy(*key, "low", "high", "bin").agg(
            F.count(F.lit(1)).alias("rows"), F.min("value").alias("bin_low"), F.max("value").alias("bin_high"))
        # `bins` rows per interval at most.
        ahead = F.sum("rows").over(W.partitionBy(*key, "low", "high").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
        placed = counted.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
        same = [wide[c].eqNullSafe(placed[c]) for c in (*key, "low", "high")]
        inside = (wide["inside"] >= placed["ahead"]) & (wide["inside"] < placed["ahead"] + placed["rows"])
        narrowed = wide.join(placed.hint("merge"), [*same, inside]).select(
            *[wide[c] for c in (*key, "rank")], F.col("rows").alias("here"), F.col("bin_low").alias("low"), F.col("bin_high").alias("high"), (F.col("inside") - F.col("ahead")).alias("inside"))
        wanted = io.saved(wanted.filter((F.col("here") <= few) | (F.col("low") == F.col("high"))).unionByName(narrowed), "quantile-ranks")
    single = wanted.filter("low = high").select(*key, "rank", F.col("low").alias("value"))
    open_ = wanted.filter("low < high")
    intervals = io.saved(open_.select(*key, "low", "high").distinct(), "quantile-intervals")
    ordered = _met(rows, intervals, key).withColumn("inside", F.row_number().over(W.partitionBy(*key, "low", "high").orderBy("value")) - 1)
    same = [open_[c].eqNullSafe(ordered[c]) for c in (*key, "low", "high")] + [open_["inside"] == ordered["inside"]]
    found = single.unionByName(open_.join(ordered.hint("merge"), same).select(*[open_[c] for c in (*key, "rank")], "value"))
    by_rank = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("by_rank"))
    same = [known[c].eqNullSafe(by_rank[c]) for c in key]
    value_at = lambda p: (lambda a, b: F.when(a == b, a).otherwise(a + (b - a) * (p - F.floor(p))))(F.col("by_rank")[F.floor(p)], F.col("by_rank")[F.ceil(p)])
    return known.join(by_rank.hint("merge"), same).select(*[known[c] for c in key], F.transform("places", value_at).alias("q"))


def _met(rows: DataFrame, intervals: DataFrame, key: list[str]) -> DataFrame:
    """Rows of each interval (key, low, high). Both are written tables, and a group has a few intervals: a hot group's rows can be split."""
    right = intervals.select(*[F.col(c).alias(f"{c}_of_interval") for c in key], "low", "high")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of_interval")) for c in key]
    return rows.join(right.hint("merge"), [*same, F.col("value") >= F.col("low"), F.col("value") <= F.col("high")]).select(*key, "value", "low", "high")
