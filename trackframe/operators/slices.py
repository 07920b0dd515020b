"""Orders that no single task has to hold: ranks, row numbers and windows over keys of any length.

Rows are range-sorted by key and order and written with their part and their place in it; a small table of counts per
(key, part) gives what lies before each part. Windows over neighbours run per slice of so many rows, to which the rows
next to its borders are copied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.sources import io

#: Rows of a key in a slice.
SLICE = 65_536


def free(taken: list[str], name: str) -> str:
    """name, or with underscores after it, so that no column is called like that."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def row_numbers(df: DataFrame, key: list[str], by: list[str], row: str = "row", n: str | None = "n", parts: int | None = None) -> DataFrame:
    """df with `row`, the place (from 1) in its key's order, and `n`, the rows of the key.

    A part of the range sort has its rows in order, so a row's place in its key is its place in the part, less that of the
    key's first row there, plus the key's rows in earlier parts. The window runs over (key, part), a row each.
    """
    part, place, first, ahead = (free([*df.columns, row, n or row], x) for x in ("part", "place", "first_place", "ahead"))
    cols = [F.col(c) for c in (*key, *by)]
    dealt = df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)
    # monotonically_increasing_id counts a part's rows in order; written once, so that all readers see the same parts.
    sorted_ = io.saved(dealt.sortWithinPartitions(*cols).withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}), "sorted")
    counts = sorted_.groupBy(*key, part).agg(F.min(place).alias(first), F.count(F.lit(1)).alias("rows_here"))
    whole = W.partitionBy(*key)
    before = F.coalesce(F.sum("rows_here").over(whole.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = {ahead: before} | ({n: F.sum("rows_here").over(whole)} if n else {})
    known = io.saved(counts.withColumns(out).drop("rows_here"), "counts")
    # Null keys and null places in the order are values like others.
    right = {c: f"{c}_of_part" for c in (*key, part)}
    same = [F.col(c).eqNullSafe(F.col(r)) for c, r in right.items()]
    met = sorted_.join(known.select(*[F.col(c).alias(r) for c, r in right.items()], first, ahead, *([n] if n else [])).hint("merge"), same)
    return met.withColumn(row, F.col(place) - F.col(first) + F.col(ahead) + 1).select(*df.columns, row, *([n] if n else []))


def dense_rank(df: DataFrame, key: list[str], by: list[str], rank: str = "rank", parts: int | None = None) -> DataFrame:
    """df with the dense rank of `by` within the key: the distinct values are numbered and joined back."""
    values = row_numbers(df.select(*key, *by).distinct(), key, by, rank, None, parts)
    right = {c: f"{c}_of_rank" for c in (*key, *by)}
    same = [F.col(c).eqNullSafe(F.col(r)) for c, r in right.items()]
    ranked = io.saved(values.select(*[F.col(c).alias(r) for c, r in right.items()], rank), "ranks")
    return io.saved(df, "ranked-rows").join(ranked.hint("merge"), same).select(*df.columns, rank)


def slice_of(row: Column, size: int) -> Column:
    return F.floor((row - 1) / size)


def over_slices(df: DataFrame, key: list[str], before: int, after: int, columns: Callable[[W], dict[str, Column]], size: int | None = None) -> DataFrame:
    """df (with row and n) and the columns that `columns(window)` makes of windows over its order.

    The windows reach at most `before` rows back and `after` rows ahead. Each slice gets copies of as many rows from
    beyond its borders, so its windows see what those over the whole key would; copies are dropped afterwards.
    """
    size = size or SLICE
    own = free(df.columns, "slice")
    last = slice_of(F.col("n"), size)
    # A row is copied to the slices whose rows can see it.
    into = F.sequence(F.greatest(F.lit(0), slice_of(F.col("row") - after, size)), F.least(last, slice_of(F.col("row") + before, size)))
    copied = df.withColumn(own, F.explode(into))
    window = W.partitionBy(*key, own).orderBy("row")
    return copied.withColumns(columns(window)).filter(F.col(own) == slice_of(F.col("row"), size)).drop(own)
