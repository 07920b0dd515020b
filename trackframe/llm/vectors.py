"""What the searches over embeddings share: whole-number vectors, packed segments and blocks, bounded runs of the best.

Rows become segments of at most `SEGMENT` vectors each, packed into one row with a number of its own; queries become
blocks of at most `BLOCK`. A query set meets all rows in blocks: each block is sent to every group of segments, and a
group's task keeps the best of each query over its segments. Memory follows the sizes of a segment and a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base

#: Vectors in a segment and in a block of queries.
SEGMENT, BLOCK = 4096, 512
#: Segments that one task sees at least; more tasks mean more copies of the queries.
GROUP = 2
#: Whole numbers up to here are exact in float64.
EXACT = 2.0**53

PACKED = "n int, dim int, ids binary, labels binary, values binary, lists binary"


def points(df: DataFrame, scale: int, *more: Column) -> DataFrame:
    """vec_id, values (array of floor(scale * component)) and more, of the rows whose vectors are whole and finite."""
    x = F.col("embedding")
    finite = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.filter(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))).alias("values"), *more)


def matrix(lists, dim: int):
    """A matrix of a list array; shorter vectors end in zeros."""
    import numpy as np

    ends = lists.offsets.to_numpy().astype(np.int64)
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(ends)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _pack(size: int, lists: bool, by: bool):
    """Packs a partition's rows (vec_id, values, label) by size rows. Lists: per component, the row numbers by ascending value."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def packed(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            ids, values, labels = (t.column(k).combine_chunks() for k in (0, 1, 2))
            dim = max(1, int(np.diff(values.offsets.to_numpy()).max(initial=0)))
            x = matrix(values, dim)
            order = np.argsort(x, axis=0, kind="stable").astype("<u2") if lists else np.zeros(0, dtype="<u2")
            # A null id comes last among ties; no label is null where labels matter.
            known = ids.fill_null(np.iinfo(np.int64).max).to_numpy().astype("<i8"), labels.fill_null(0).to_numpy().astype("<i8")
            null_ids = np.asarray(ids.is_null()).astype(bool)
            cells = [known[0].tobytes() + np.packbits(null_ids).tobytes(), known[1].tobytes(), x.astype("<i8").tobytes(), order.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names=["n", "dim", "ids", "labels", "values", "lists"])

        held, n = [], 0
        number = None
        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - n)
                if by:
                    numbers = part.column(3).to_numpy(zero_copy_only=False)
                    if n and numbers[0] != number:
                        yield packed(held)
                        held, n = [], 0
                        continue
                    number = numbers[0]
                    part = part.slice(0, int(np.searchsorted(numbers, number, side="right")))
                b = b.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == size:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    return run


def packed(rows: DataFrame, name: str, size: int, lists: bool = False, by: str | None = None, each: int = 1) -> DataFrame:
    """rows (vec_id, values, label) as packed rows of at most size vectors, numbered by `seg`, written and read back.

    by: a column of small whole numbers below `each`, of which a packed row has one; rows of one number are still dealt to
    several tasks where they are many. Without it rows are dealt evenly.
    """
    taken = rows.select("vec_id", "values", "label", *([by] if by else []))
    n = taken.count()
    if by:
        # Split by a hash, too, so that a hot number is packed by several tasks.
        parts = max(1, min(each, math.ceil(n / 64)), math.ceil(n / size))
        dealt = taken.repartitionByRange(parts, by, F.xxhash64("vec_id", "values")).sortWithinPartitions(by)
    else:
        parts = max(1, math.ceil(n / size), min(base.cores(rows.sparkSession), math.ceil(n / 256)))
        dealt = taken.repartition(parts)
    out = dealt.mapInArrow(_pack(size, lists, bool(by)), PACKED)
    return base.saved(out.withColumn("seg", F.monotonically_increasing_id()), name)


class Pack:
    """A packed row as arrays: ids, null_ids, labels, values (n x dim) and, for segments with lists, order (n x dim)."""

    def __init__(self, n: int, dim: int, ids: bytes, labels: bytes, values: bytes, lists: bytes):
        import numpy as np

        self.n, self.dim = n, dim
        self.ids = np.frombuffer(ids, dtype="<i8", count=n)
        self.null_ids = np.unpackbits(np.frombuffer(ids, dtype=np.uint8, offset=8 * n), count=n).astype(bool)
        self.labels = np.frombuffer(labels, dtype="<i8")
        self.values = np.frombuffer(values, dtype="<i8").reshape(n, dim)
        self.order = np.frombuffer(lists, dtype="<u2").reshape(n, dim) if lists else None


def aligned(a, b):
    """Two matrices with equally many columns; missing components are zero."""
    import numpy as np

    d = max(a.shape[1], b.shape[1])
    pad = lambda x: x if x.shape[1] == d else np.pad(x, ((0, 0), (0, d - x.shape[1])))
    return pad(a), pad(b)


def fits(a, b) -> bool:
    """Whether every inner product of the two is exact in float64."""
    big = lambda x: float(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    return big(a) * big(b) * max(1, a.shape[1]) < EXACT


def products(a, b):
    """Exact inner products as int64. Beyond float64 they are taken in Python's integers; one that a long cannot hold is an error."""
    import numpy as np

    if fits(a, b):
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    out = a.astype(object) @ b.astype(object).T
    if out.size and max(abs(int(out.max())), abs(int(out.min()))) >= 2**63:
        raise OverflowError("a score does not fit a long")
    return out.astype(np.int64)


def best(scores, ids, k: int):
    """Places of the k best: highest score first, then lowest id."""
    import numpy as np

    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def pairs(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every segment (s_ columns) beside every block (b_ columns): a group of segments to a task, its segments in a row for each block.

    Blocks go out once per group; a segment is shuffled once. Both sides are packed rows read from written tables, and a
    merge join holds no more than the segments of one group.
    """
    group = F.floor(F.shiftright("seg", 33) / GROUP)
    groups = (segments.agg(F.max(group)).first()[0] or 0) + 1
    s = segments.select(group.cast("long").alias("group"), *(F.col(c).alias(f"s_{c}") for c in segments.columns)).repartition(groups, "group")
    b = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), *(F.col(c).alias(f"b_{c}") for c in blocks.columns)).repartition(groups, "group")
    return b.join(s.hint("merge"), "group")


def pack_of(row: dict, side: str) -> Pack:
    return Pack(*(row[f"{side}_{c}"] for c in ("n", "dim", "ids", "labels", "values", "lists")))


def rows_of(batches) -> Iterator[dict]:
    """Rows as dicts, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def first_rows(df: DataFrame, keys: list[str], k: int, score: str, item: str) -> DataFrame:
    """The k best rows of each key, with `rank`. Tasks have cut their own before; the window cuts again before it shuffles."""
    order = W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(item).asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
