"""k-means by key: several starts at once, seeded by weighted draws, the one with the lowest cost kept.

Points are first added up to distinct values with weights, so that a million pixels of a few hundred colours are a few
hundred rows. The state is one row per key: its starts, each with its centres. Every step is one job over all keys and
starts: values meet their key's state in a merge join of two written tables, which can be split where a key is hot, and
are added up per (key, start, centre) before anything is shuffled.

A weighted draw is a race: of all values the one with the least -ln(u) / weight wins, with u from a hash of the value,
the start and the step. It is a minimum, so it needs no running sums, and it depends on no partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.sources import io

STARTS, ROUNDS, SEED = 10, 100, 42


def _gap(at: Column, centre: Column, n: int) -> Column:
    """Squared distance of two arrays of n numbers."""
    return sum((at[i] - centre[i]) * (at[i] - centre[i]) for i in range(n))


def _nearest(at: Column, centres: Column, n: int) -> Column:
    """(d, i): squared distance to the nearest centre and its place, the first on ties."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(_gap(at, c, n).alias("d"), i.alias("i"))))


def _by_start(values: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """Values beside each start of their key: start, still, centres."""
    return values.join(state.hint("merge"), key).select(*key, "at", "w", F.inline("starts"))


def seeded(values: DataFrame, key: list[str], n: int, k: int, starts: int, seed: int) -> DataFrame:
    """key, starts (array of start, still, centres): k-means++ draws among values (key, at, w), fewer where fewer are distinct."""
    none = F.array().cast("array<array<double>>")
    first = F.transform(F.sequence(F.lit(0), F.lit(starts - 1)), lambda s: F.struct(s.alias("start"), F.lit(False).alias("still"), none.alias("centres")))
    state = io.saved(values.select(*key).distinct().withColumn("starts", first), "kmeans-seeds")
    for step in range(k):
        met = _by_start(values, state, key)
        # The first draw is by weight, later ones by weight times squared distance to the nearest centre.
        d = F.when(F.size("centres") == 0, F.col("w")).otherwise(F.col("w") * _nearest(F.col("at"), F.col("centres"), n)["d"])
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "start", *key, "at"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        raced = met.withColumn("d", d).withColumn("race", F.when(F.col("d") > 0, -F.log(u) / F.col("d")))
        drawn = raced.groupBy(*key, "start").agg(F.min(F.when(F.col("race").isNotNull(), F.struct("race", "at"))).alias("best"))
        listed = drawn.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("start", F.col("best.at").alias("at")))).alias("won"))
        grown = F.transform("starts", lambda s: F.struct(
            s["start"].alias("start"), s["still"].alias("still"),
            F.when(F.col("won")[s["start"]].isNull(), s["centres"]).otherwise(F.array_append(s["centres"], F.col("won")[s["start"]])).alias("centres")))
        state = io.saved(state.join(listed.hint("merge"), key).select(*key, grown.alias("starts")), "kmeans-seeds")
    return state


def advanced(values: DataFrame, state: DataFrame, key: list[str], n: int, eps: float) -> DataFrame:
    """The next state: centres of every start at the weighted mean of their values; one whose centres move by at most eps stands still."""
    moving = state.filter(F.exists("starts", lambda s: ~s["still"]))
    near = _by_start(values, moving, key).filter("NOT still").select(*key, "start", "at", "w", _nearest(F.col("at"), F.col("centres"), n)["i"].alias("i"))
    sums = near.groupBy(*key, "start", "i").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col("at")[f]).alias(f"s{f}") for f in range(n)])
    # Rounding makes the means of equal sets equal.
    means = sums.select(*key, "start", "i", F.array(*[F.round(F.col(f"s{f}") / F.col("w"), 9) for f in range(n)]).alias("mean"))
    listed = means.groupBy(*key).agg(F.collect_list(F.struct("start", "i", "mean")).alias("means"))

    def moved(s: Column) -> Column:
        own = F.filter("means", lambda m: m["start"] == s["start"])
        by = F.map_from_entries(F.transform(own, lambda m: F.struct(m["i"], m["mean"])))
        # A centre that has lost all its values stays where it is.
        new = F.transform(s["centres"], lambda c, i: F.coalesce(by[i], c))
        gap = F.array_max(F.zip_with(s["centres"], new, lambda a, b: _gap(a, b, n)))
        return F.when(s["still"], s).otherwise(F.struct(s["start"].alias("start"), (gap <= eps * eps).alias("still"), new.alias("centres")))

    return state.join(listed.hint("merge"), key, "left").select(*key, F.when(F.col("means").isNull(), F.col("starts")).otherwise(F.transform("starts", moved)).alias("starts"))


def kmeans(points: DataFrame, key: list[str], features: list[str], k: int, weight: str | None = None, starts: int = STARTS, rounds: int = ROUNDS, eps: float = 0.0, seed: int = SEED) -> DataFrame:
    """points with `cluster` (0, 1, ... by centre) per key, `n_points` (the cluster's weight) and centre columns c_<feature>.

    Of `starts` starts the one with the lowest weighted sum of squared distances is kept, the first on ties. A key with
    fewer than k distinct points has as many clusters as those. Rows without a weight or a feature take no part.
    """
    n = len(features)
    points = io.saved((points.filter(F.col(weight) > 0) if weight else points).dropna(subset=features), "kmeans-points")
    at = F.array(*[F.col(f).cast("double") for f in features])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = points.select(*key, *features, w.alias("w"))
    values = io.saved(known.groupBy(*key, *features).agg(F.sum("w").alias("w")).select(*key, at.alias("at"), "w"), "kmeans-values")
    state = seeded(values, key, n, k, starts, seed)
    for _ in range(rounds):
        state = io.saved(advanced(values, state, key, n, eps), "kmeans-state")
        if state.filter(F.exists("starts", lambda s: ~s["still"])).isEmpty():
            break
    cost = _by_start(values, state, key).groupBy(*key, "start").agg(F.sum(F.col("w") * _nearest(F.col("at"), F.col("centres"), n)["d"]).alias("cost"))
    # Costs are compared to nine digits: starts that end alike are ties, whatever the order of their sums.
    best = cost.groupBy(*key).agg(F.min(F.struct(F.round("cost", 9), "start")).alias("best")).select(*key, F.col("best.start").alias("start"))
    chosen = io.saved(state.join(best.hint("merge"), key).select(*key, F.filter("starts", lambda s: s["start"] == F.col("start"))[0]["centres"].alias("centres")), "kmeans-centres")
    own = points.join(chosen.hint("merge"), key).withColumn("nearest", _nearest(at, F.col("centres"), n)["i"]).drop("centres")
    out = io.saved(own, "kmeans-nearest")
    total = out.withColumn("w", w).groupBy(*key, "nearest").agg(
        *[(F.sum(F.col(f) * F.col("w")) / F.sum("w")).alias(f"c_{f}") for f in features], F.sum("w").cast("long").alias("n_points"))
    named = total.withColumn("cluster", F.row_number().over(W.partitionBy(*key).orderBy(*[f"c_{f}" for f in features])) - 1)
    return out.join(io.saved(named, "kmeans-named").hint("merge"), [*key, "nearest"]).drop("nearest")
