"""Hard negatives from lists that clusters of anchors share.

Anchors are clustered by direction. For a cluster with centre c whose members lie within the angle t of c, no member's
score with a row x can exceed its own length times |x| cos(max(0, angle(x, c) - t)): the angular upper bound. For each
cluster the rows of a segment are sorted by that bound once, and every member walks this one list from its head, taking
exact scores, until its k-th best score is above the bound of what follows: a certified end. Members that have ended leave
the walk; a task's later segments begin with what its earlier ones have found.

Two walks: the positives (best rows of the anchor's label), then, with the positives' scores, the best rows of other
labels whose score lies in a window that each positive sets.

Defined cases: rows without a label or a vector, or with null or non-finite components, take no part; missing components
of shorter vectors are zero; rows of an anchor's own id are neither its positives nor its negatives; anchors that repeat with id, label and
vector count once, other rows as often as they occur; a null id is no anchor and comes last among ties; an anchor without
positives, a positive with a negative score (its window is empty) and a pair without negatives give no row; an empty table
gives none; other columns are not read. Scores that a long cannot hold are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, vectors

#: The centres are fitted on at most so many anchors, those whose ids hash lowest.
SAMPLE = 4096
#: Anchors to a cluster on the average, and the most clusters.
MEMBERS, CLUSTERS = 16, 256
ROUNDS = 8
#: Rows of a list that are walked at once.
STEP = 1024
#: Percent of the positive's score between which a negative's has to lie.
LOW, HIGH = 30, 90
POSITIVES = "block long, place int, anchor_id long, positive_id long, positive_score long"
NEGATIVES = "block long, place int, nth int, anchor_id long, negative_id long, negative_score long"


def directions(x):
    """Rows of length one; zero rows stay."""
    import numpy as np

    x = x.astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0), size[:, 0]


def centres(anchors: DataFrame, n_anchors: int) -> list[list[float]]:
    """Directions of cluster centres, fitted on a bounded sample of the anchors (vec_id, values)."""
    import numpy as np

    rows = [r.values for r in anchors.orderBy(F.xxhash64("vec_id", "values")).limit(SAMPLE).select("values").collect()]
    if not rows:
        return [[0.0]]
    dim = max(1, max(map(len, rows)))
    x, _ = directions(np.array([[*r, *[0] * (dim - len(r))] for r in rows], dtype=np.float64))
    c = x[np.linspace(0, len(x) - 1, min(len(x), max(1, min(CLUSTERS, n_anchors // MEMBERS)))).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        moved, size = directions(sums)
        c = np.where(size[:, None] > 0, moved, c)
    return c.tolist()


def clustered(anchors: DataFrame, centre_rows: list[list[float]]) -> DataFrame:
    """anchors with `cluster`, the place of the nearest centre."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(centre_rows)
        for b in batches:
            lists = b.column("values")
            dim = max(c.shape[1], int(np.diff(lists.offsets.to_numpy()).max(initial=0)))
            x, c_ = vectors.aligned(vectors.matrix(lists, dim), c)
            yield b.append_column("cluster", pa.array((directions(x)[0] @ c_.T).argmax(axis=1), pa.int32()))

    return anchors.select("vec_id", "values", "label").mapInArrow(run, "vec_id long, values array<long>, label long, cluster int")


class Walk:
    """A block's anchors on their way through lists: per anchor and slot (a positive's window, or one slot) the best so far."""

    def __init__(self, block: vectors.Pack, slots: int, k: int):
        import numpy as np

        self.block, self.k = block, k
        unit, self.sizes = directions(block.values)
        centre, _ = directions(unit.sum(axis=0, keepdims=True))
        self.centre = centre[0]
        # The widest angle between the centre and a member, a little widened for rounding.
        self.width = float(np.arccos(np.clip(unit @ self.centre, -1, 1)).max(initial=0)) + 1e-6
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        self.best = [[empty] * slots for _ in range(block.n)]
        self.least = np.full((block.n, slots), -np.inf)

    def segment(self, seg: vectors.Pack, same: bool, low, high) -> None:
        """Walks a segment's list. same: rows of the anchor's label (count, else those of other labels, none of the anchor's own id. low, high: windows per anchor and slot."""
        import numpy as np

        values, queries = vectors.aligned(seg.values, self.block.values)
        unit, sizes = directions(values)
        centre = np.pad(self.centre, (0, values.shape[1] - len(self.centre)))
        angle = np.arccos(np.clip(unit @ centre, -1, 1))
        bound = sizes * np.cos(np.clip(angle - self.width, 0, None))
        # A row opposite to everything has a bound below zero, which a short member reaches least.
        order = np.argsort(-bound, kind="stable")
        exact = vectors.fits(queries, values)
        on = np.arange(self.block.n)
        for at in range(0, seg.n, STEP):
            head = float(bound[order[at]])
            # Ended: full and above all that follows, or nothing that follows reaches the window.
            most = self.sizes * head * (1 + 1e-9) + 1e-6 if head >= 0 else self.sizes * head * (1 - 1e-9) + 1e-6
            need = np.where(np.isfinite(self.least), np.maximum(self.least, low), low)
            on = on[(most[on, None] >= need[on]).any(axis=1)] if exact else on
            if not len(on):
                return
            rows = order[at : at + STEP]
            scores = vectors.products(queries[on], values[rows])
            alike = self.block.labels[on][:, None] == seg.labels[rows][None, :]
            own = (self.block.ids[on][:, None] == seg.ids[rows][None, :]) & ~seg.null_ids[rows][None, :]
            counts = (alike if same else ~alike) & ~own
            for slot in range(self.least.shape[1]):
                hit = counts & (scores >= np.maximum(self.least[on, slot], low[on, slot])[:, None]) & (scores <= high[on, slot][:, None])
                for i in np.flatnonzero(hit.any(axis=1)):
                    some = np.flatnonzero(hit[i])
                    s, ids, null = (np.concatenate(x) for x in zip(self.best[on[i]][slot], (scores[i, some], seg.ids[rows[some]], seg.null_ids[rows[some]]), strict=True))
                    some = vectors.best(s, ids, self.k)
                    self.best[on[i]][slot] = s[some], ids[some], null[some]
                    if len(some) == self.k:
                        self.least[on[i], slot] = s[some[-1]]

    def found(self):
        """(place, slot, anchor_id, id, score) of all that the walk holds."""
        for i, slots in enumerate(self.best):
            for j, (s, ids, null) in enumerate(slots):
                for x, v, z in zip(s.tolist(), ids.tolist(), null.tolist(), strict=True):
                    yield i, j, int(self.block.ids[i]), None if z else v, x


def _walks(same: bool, slots: int, k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def told(key, walk):
            rows = list(walk.found())
            columns = [pa.array([key[1]] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), *([] if same else [pa.array([r[1] for r in rows], pa.int32())])]
            columns += [pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4)]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in (POSITIVES if same else NEGATIVES).split(", ")])

        key = walk = low = high = None
        for row in vectors.rows_of(batches):
            if (row["group"], row["b_seg"]) != key:
                if walk is not None:
                    yield told(key, walk)
                key, walk = (row["group"], row["b_seg"]), Walk(vectors.pack_of(row, "b"), slots, k)
                low, high = (np.full((walk.block.n, slots), x) for x in (-np.inf, np.inf)) if same else _windows(walk.block.n, slots, row["b_windows"])
            walk.segment(vectors.pack_of(row, "s"), same, low, high)
        if walk is not None:
            yield told(key, walk)

    return run


def _windows(n: int, slots: int, rows: list):
    """Lowest and highest score that each anchor's positives allow, as whole numbers; an empty window where there is no such positive."""
    import numpy as np

    low, high = np.full((n, slots), np.inf), np.full((n, slots), -np.inf)
    for r in rows or []:
        p = r["score"]
        low[r["place"], r["nth"]], high[r["place"], r["nth"]] = -(-LOW * p // 100), HIGH * p // 100
    return low, high


def hard_negatives(anchors: DataFrame, rows: DataFrame, n_positives: int = 5, k: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Both tables have vec_id, values (arrays of long) and label (long)."""
    spark = rows.sparkSession
    asked = base.saved(anchors.filter(F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "label", "values"]), "anchors")
    with_cluster = base.saved(clustered(asked, centres(asked, asked.count())), "clustered-anchors")
    blocks = vectors.packed(with_cluster, "anchor-blocks", vectors.BLOCK, by="cluster", each=CLUSTERS)
    segments = vectors.packed(rows, "shared-segments", vectors.SEGMENT)

    keys = ["anchor_id", "block", "place"]
    met = base.saved(vectors.pairs(segments, blocks).mapInArrow(_walks(True, 1, n_positives), POSITIVES), "positives-found")
    first = vectors.first_rows(met, keys, n_positives, "positive_score", "positive_id").withColumn("nth", F.col("rank") - 1).drop("rank")
    positives = base.saved(first, "positives")
    # A window per positive; a block has at most BLOCK anchors.
    windows = positives.groupBy("block").agg(F.collect_list(F.struct("place", "nth", F.col("positive_score").alias("score"))).alias("windows")).withColumnRenamed("block", "seg")
    told = base.saved(blocks.join(windows.hint("merge"), "seg", "left"), "blocks-with-windows")
    met = base.saved(vectors.pairs(segments, told).mapInArrow(_walks(False, n_positives, k), NEGATIVES), "negatives-found")
    ranked = vectors.first_rows(met, [*keys, "nth"], k, "negative_score", "negative_id")
    return ranked.join(positives.hint("merge"), [*keys, "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    own = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label")
    rows = vectors.points(base.table(spark, sf_dir, "embeddings").filter(F.col("label").isNotNull()), 256, own)
    return hard_negatives(rows.filter(F.col("vec_id") % 100 == 0), rows)


ORACLE = {
    "op13_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
}
QUERIES = {"op13_negatives": op13_negatives}
