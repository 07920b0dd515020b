"""Exact top-k by inner product with sorted lists and no random access.

Vectors are kept in segments with one sorted list per component. A query reads the lists of its segment from the end
that suits the sign of its weight, all to the same depth, deeper by rounds. What it has read of a row is a part of the
row's score; each component not yet read lies between the last value read from its list and the list's other end,
which gives the row a lower and an upper bound. The k-th best lower bound, or what the task's earlier segments have
reached, is the threshold: rows whose upper bound is below it are outsiders that cannot qualify. Reading stops when few
others are left, and their final scores are resolved from the whole vectors. The k best of a task's segments go into
one exact ranking per query.

Defined cases: vectors that are null or hold null or non-finite components take no part; missing components of shorter
vectors are zero; a query does not meet rows of its own id; queries that repeat with id and vector are asked once, and
rows that repeat are candidates as often as they occur; a null id is no query and comes last among ties; with fewer than
k candidates all are returned; an empty table gives no row; other columns are not read. Scores that a long cannot hold
are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, vectors

#: Parts of a list that are read before bounds are compared again.
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 3 / 4)
#: A query stops reading when this part of a segment, or a few times k rows, can still qualify.
LEFT = 1 / 64
#: Queries that read a segment together.
TOGETHER = 128
FOUND = "block long, place int, query_id long, vec_id long, score long"


def survivors(q, values, order, own, floor, k: int):
    """For each query (rows of q), which rows of a segment can still be among its k best, by reading its lists.

    q, values: float matrices; order: row numbers by ascending value, per component; own: mask of pairs that do not count;
    floor: the score that a row has to reach.
    """
    import numpy as np

    n, dim = values.shape
    rank = np.empty((n, dim), dtype=np.int32)
    np.put_along_axis(rank, order.astype(np.int64), np.arange(n, dtype=np.int32)[:, None], axis=0)
    ascending = np.take_along_axis(values, order.astype(np.int64), axis=0)
    low, high = ascending[0], ascending[-1]
    out = np.ones((len(q), n), dtype=bool)
    out[own] = False
    reading = np.arange(len(q))
    for part in DEPTHS:
        if not len(reading) or n <= 4 * k:
            break
        depth = max(1, int(n * part))
        top, bottom = rank >= n - depth, rank < depth
        # Positive weights read from the top, negative ones from the bottom.
        w = np.concatenate([np.maximum(q[reading], 0), np.minimum(q[reading], 0)], axis=1)
        read = np.concatenate([values * top, values * bottom], axis=1)
        unread = np.concatenate([~top, ~bottom], axis=1).astype(np.float64)
        known = w @ read.T
        upper = known + (w * np.concatenate([ascending[n - depth], ascending[depth - 1]])) @ unread.T
        lower = known + (w * np.concatenate([low, high])) @ unread.T
        lower[own[reading]] = -np.inf
        floor[reading] = np.maximum(floor[reading], np.partition(lower, n - k, axis=1)[:, n - k])
        out[reading] &= upper >= floor[reading][:, None]
        reading = reading[out[reading].sum(axis=1) > max(4 * k, n * LEFT)]
    return out


def _search(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def told(key, block, held):
            rows = [(i, *x) for i, found in enumerate(held) for x in zip(*found, strict=True)]
            place, score, ids, null = ([r[c] for r in rows] for c in range(4))
            return pa.RecordBatch.from_arrays(
                [pa.array([key[1]] * len(rows), pa.int64()), pa.array(place, pa.int32()), pa.array([int(block.ids[i]) for i in place], pa.int64()),
                 pa.array([None if x else int(v) for x, v in zip(null, ids, strict=True)], pa.int64()), pa.array([int(x) for x in score], pa.int64())],
                names=["block", "place", "query_id", "vec_id", "score"],
            )

        key = block = held = None
        for row in vectors.rows_of(batches):
            if (row["group"], row["b_seg"]) != key:
                if held is not None:
                    yield told(key, block, held)
                key, block = (row["group"], row["b_seg"]), vectors.pack_of(row, "b")
                # Of each query: scores, ids and null ids of its best so far.
                held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * block.n
            seg = vectors.pack_of(row, "s")
            queries, values = vectors.aligned(block.values, seg.values)
            order = seg.order
            if values.shape[1] > order.shape[1]:
                # Components that no row of the segment has: lists of zeros, in any order.
                order = np.concatenate([order, np.repeat(np.arange(seg.n, dtype="<u2")[:, None], values.shape[1] - order.shape[1], axis=1)], axis=1)
            exact = vectors.fits(queries, values)
            for at in range(0, block.n, TOGETHER):
                q = queries[at : at + TOGETHER]
                own = (block.ids[at : at + TOGETHER, None] == seg.ids[None, :]) & ~seg.null_ids[None, :]
                if exact:
                    floor = np.array([float(h[0][-1]) if len(h[0]) == k else -np.inf for h in held[at : at + TOGETHER]])
                    left = survivors(q.astype(np.float64), values.astype(np.float64), order, own, floor, k)
                else:
                    left = ~own
                for i in range(len(q)):
                    rows = np.flatnonzero(left[i])
                    if not len(rows):
                        continue
                    scores, ids, null = (np.concatenate(x) for x in zip(held[at + i], (vectors.products(q[i : i + 1], values[rows])[0], seg.ids[rows], seg.null_ids[rows]), strict=True))
                    some = vectors.best(scores, ids, k)
                    held[at + i] = scores[some], ids[some], null[some]
        if held is not None:
            yield told(key, block, held)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query. Both have vec_id and values (arrays of long)."""
    asked = queries.filter(F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "values"]).withColumn("label", F.lit(0))
    blocks = vectors.packed(asked, "query-blocks", vectors.BLOCK)
    segments = vectors.packed(candidates.withColumn("label", F.lit(0)), "list-segments", vectors.SEGMENT, lists=True)
    found = base.saved(vectors.pairs(segments, blocks).mapInArrow(_search(k), FOUND), "found")
    return vectors.first_rows(found, ["query_id", "block", "place"], k, "score", "vec_id").select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.points(base.table(spark, sf_dir, "embeddings"), 1024)
    return top_k(rows.filter(F.col("vec_id") % 100 == 0), rows)


ORACLE = {
    "op11_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
QUERIES = {"op11_topk": op11_topk}
