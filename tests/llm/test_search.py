"""Top-k, hard negatives and fill-in-middle against brute force; hot keys of the other operators."""

import collections
import hashlib
import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from trackframe.llm import base, infill, licenses, mixing, negatives, registry, sharding, topk, vectors, warc

DIR = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int, extra string"


def odd_vectors(seed=1, n=400, dim=6):
    """Clusters, ties, copies, zero and negative vectors, nulls of every kind, short vectors, large components."""
    r, rows = random.Random(seed), []
    heads = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    for i in range(n):
        v = [x + r.gauss(0, 0.4) for x in heads[i % 4]] if i % 3 else [r.gauss(0, 1) for _ in range(dim)]
        rows.append((i, v, i % 5, "x"))
    rows += [(900 + i, rows[7][1], 2, "x") for i in range(12)]
    rows += [(1000, rows[3][1], 3, "x"), (1000, rows[3][1], 3, "x"), (1100, [0.0] * dim, 1, "x"), (1200, [-x for x in heads[0]], 0, "x"), (1300, [0.5, -0.25], 1, "x"), (1301, [], 1, "x")]
    rows += [(None, rows[9][1], 4, "x"), (1400, None, 1, "x"), (1500, [1.0, None, 2.0], 1, "x"), (1600, [float("nan")] * dim, 1, "x"), (1700, [float("inf")] * dim, 1, "x"), (1800, rows[5][1], None, "x"), (-100, rows[6][1], 1, "x")]
    r.shuffle(rows)
    return rows


def whole(rows, scale):
    import numpy as np

    out = []
    for i, v, label, _ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def order(score, i):
    return (-score, i is None, i or 0)


@pytest.mark.parametrize("segment", [4096, 64, 16])
def test_top_k_is_that_of_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(vectors, "SEGMENT", segment)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rows = odd_vectors()
    points = vectors.points(spark.createDataFrame(rows, VEC), 1024)
    got = collections.defaultdict(list)
    for r in topk.top_k(points.filter(F.col("vec_id") % 100 == 0), points).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    known = whole(rows, 1024)
    asked = {i: v for i, v, _ in known if i is not None and i % 100 == 0}
    assert got.keys() == asked.keys()
    for i, q in asked.items():
        found = sorted(((product(q, v), j) for j, v, _ in known if j != i), key=lambda x: order(*x))[:10]
        assert sorted(got[i]) == [(k, j, s) for k, (s, j) in enumerate(found, 1)], i


def test_lists_leave_outsiders_out(spark):
    """On clustered vectors most rows are told to be outsiders before the lists are at their end, and never one of the best."""
    import numpy as np

    r = np.random.default_rng(4)
    heads = r.normal(size=(8, 16))
    x = np.floor(256 * (heads[r.integers(0, 8, 3000)] + 0.2 * r.normal(size=(3000, 16))))
    q, order_ = x[:5], np.argsort(x, axis=0, kind="stable")
    own = np.zeros((5, 3000), dtype=bool)
    own[np.arange(5), np.arange(5)] = True
    left = topk.survivors(q, x, order_, own, np.full(5, -np.inf), 10)
    scores = q @ x.T
    scores[own] = -np.inf
    assert all(left[i, np.argsort(-scores[i], kind="stable")[:10]].all() for i in range(5))
    assert left.sum(axis=1).max() < 600
    assert not left[own].any()


def test_scores_beyond_floats(spark):
    """Products beyond 2^53 are exact; a score that no long holds is an error."""
    big = 2_000_001.0
    rows = [(0, [big, 1.0], 1, ""), (1, [big, 2.0], 1, ""), (2, [big, 3.0], 2, ""), (3, [big - 2, 5.0], 2, "")]
    points = vectors.points(spark.createDataFrame([(i, [float(x) for x in v], label, e) for i, v, label, e in rows], VEC.replace("float", "double")), 1024)
    got = {r.vec_id: r.score for r in topk.top_k(points.filter("vec_id = 0"), points).collect()}
    assert got == {i: int(1024 * big) * int(1024 * v[0]) + 1024 * int(1024 * v[1]) for i, v, _, _ in rows[1:]}
    huge = vectors.points(spark.createDataFrame([(0, [1e12], 1, ""), (1, [1e12], 1, "")], VEC.replace("float", "double")), 1024)
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(huge.filter("vec_id = 0"), huge).collect()


def plain_negatives(known):
    out = set()
    for i, a, label in {(i, tuple(v), label) for i, v, label in known if i is not None and i % 100 == 0}:
        met = sorted(((product(a, v), j, other) for j, v, other in known if j != i), key=lambda x: order(*x[:2]))
        for p, j, _ in [x for x in met if x[2] == label][:5]:
            some = [x for x in met if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p][:10]
            out |= {(i, j, k, n, p, s) for k, (s, n, _) in enumerate(some, 1)}
    return out


@pytest.mark.parametrize(("segment", "step"), [(4096, 1024), (50, 8)])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, segment, step):
    monkeypatch.setattr(vectors, "SEGMENT", segment)
    monkeypatch.setattr(vectors, "BLOCK", 3)
    monkeypatch.setattr(negatives, "STEP", step)
    rows = odd_vectors(2)
    df = spark.createDataFrame(rows, VEC)
    points = vectors.points(df.filter("label IS NOT NULL"), 256, F.col("label").cast("long").alias("label"))
    got = negatives.hard_negatives(points.filter(F.col("vec_id") % 100 == 0), points)
    want = plain_negatives([x for x in whole(rows, 256) if x[2] is not None])
    assert {tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()} == want
    assert len(want) > 100


def test_walks_end_early(monkeypatch):
    """In a tight cluster most of the list is never scored, and the result is that of the whole list."""
    import numpy as np

    r = np.random.default_rng(7)
    heads = r.normal(size=(20, 16)) * 300
    x = np.rint(np.repeat(heads, 200, axis=0) + 10 * r.normal(size=(4000, 16))).astype("<i8")
    pack = lambda rows, labels, ids: vectors.Pack(len(rows), 16, ids.astype("<i8").tobytes() + np.packbits(np.zeros(len(rows), dtype=bool)).tobytes(), labels.astype("<i8").tobytes(), rows.tobytes(), b"")
    labels = np.zeros(4000)
    walk = negatives.Walk(pack(x[:6], labels[:6], np.arange(6)), 1, 5)
    seen, exact = [], vectors.products
    monkeypatch.setattr(vectors, "products", lambda a, b: seen.append(len(a) * len(b)) or exact(a, b))
    monkeypatch.setattr(negatives, "STEP", 100)
    walk.segment(pack(x, labels, np.arange(4000)), True, np.full((6, 1), -np.inf), np.full((6, 1), np.inf))
    scores = x[:6] @ x.T
    scores[np.arange(6), np.arange(6)] = -(2**40)
    for i in range(6):
        want = sorted(range(4000), key=lambda j: (-scores[i, j], j))[:5]
        assert walk.best[i][0][1].tolist() == want
    assert sum(seen) < 0.2 * 6 * 4000


def test_searches_of_empty_tables(spark):
    none = spark.createDataFrame([], VEC)
    points = vectors.points(none, 256, F.col("label").cast("long").alias("label"))
    assert topk.top_k(points, points).collect() == []
    assert negatives.hard_negatives(points, points).collect() == []
    some = vectors.points(spark.createDataFrame([(0, [1.0], 1, "")], VEC), 256, F.col("label").cast("long").alias("label"))
    assert topk.top_k(some, some).collect() == []
    assert negatives.hard_negatives(some, some).collect() == []


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_infill_is_that_of_plain_slicing(spark, odd):
    r = random.Random(5)
    letters = ["a", "ü", "😀", " ", "\n", "\t", " ", "<", "$1", "\\", "İ", "\x0b", " "]
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 60)))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate(["see <P> here", "<S>", "a<M>", "<<P", "P> <M <S", "  ", "x", " x ", "w " * 50_000, "w" * 200_000, " " * 100_000] * 4)]
    df = spark.createDataFrame([(i, t, "mine", "mine") for i, t in rows], "doc_id long, text string, row string, output string").unionByName(odd.select("doc_id", "text", F.lit("mine").alias("row"), F.lit("mine").alias("output")))
    out = infill.transformed(df)
    got = collections.Counter((x.doc_id, x.text, x.row, x.n, x.form, x.output, x.prefix_chars, x.middle_chars) for x in out.collect())
    want = collections.Counter((x.doc_id, x.text, "mine", *plain_infill(x.doc_id, x.text)) for x in df.collect())
    assert got == want
    assert {k[4] for k in want} == {"plain", "psm", "spm"}
    assert out.filter(infill.restored(F.col("form"), F.col("output")) != base.text_of()).count() == 0
    assert infill.transformed(df.limit(0)).collect() == []


def test_sentinels_must_be_told_apart(spark):
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aXa", "<S>", "<M>"), ("<P", "P>", "<M>"), ("<PS>", "PS", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            infill.checked(dict(zip(("prefix", "suffix", "middle"), marks, strict=True)))
    own = {"prefix": "$P\\", "suffix": "$S\\", "middle": "|M"}
    df = spark.createDataFrame([(i, f"some {i} words to cut") for i in range(60)], "doc_id long, text string")
    out = infill.transformed(df, fim_rate=100, sentinels=own)
    assert out.filter(infill.restored(F.col("form"), F.col("output"), own) == F.col("text")).count() == 60
    assert {r.form for r in out.collect()} == {"psm", "spm"}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(DIR):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    a, b = registry.QUERIES[name](spark, DIR).toPandas(), duck.execute(registry.ORACLE[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) > 0
    for c in cols:
        assert (a[c].eq(b[c]) | (a[c].isna() & b[c].isna())).all(), c


# ---- a third of the rows under one key ----------------------------------------------------------------------------


def hot(n=3000):
    """Rows of which a third are one row, and a third have no id."""
    return [(1, "the same text in every copy", "a") if i % 3 == 0 else (None, f"text {i} of no id", "a") if i % 3 == 1 else (i, f"text {i} of its own " + "w " * (i % 9), "b") for i in range(n)]


def test_repeated_rows_keep_the_law(docs):
    """Shards stay within one percent and slots without gaps, though a third of the rows are one row."""
    d = docs(hot(6000))
    out = sharding.shard(d, 8).collect()
    size, at = collections.Counter(), collections.defaultdict(list)
    for r in out:
        size[r.shard] += r.size
        at[r.shard].append(r.slot)
    assert len(out) == 6000
    assert max(size.values()) <= 1.01 * sum(size.values()) / 8
    assert all(sorted(v) == list(range(len(v))) for v in at.values())
    copies = collections.Counter(r.vslot for r in out if r.doc_id == 1)
    assert max(copies.values()) < 12
    alone = {r.vslot for r in sharding.shard(docs(hot(6000)[:1]), 8).collect()}
    assert alone <= copies.keys()


def test_written_shards_are_those_of_the_map(docs, tmp_path):
    """write_shards puts as many copies of a row into each slot as `shard` has counted."""
    d, path = docs(hot(900)), str(tmp_path / "m")
    spark = d.sparkSession
    want = collections.Counter((r.doc_id, r.text_crc32, r.shard) for r in sharding.shard(d, 5, map_path=path).collect())
    mapping = sharding.read_map(spark, path, sharding.load_map(spark, path)[0])
    column = sharding.write_shards(d, mapping, f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), column)
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_a_map_is_written_once(spark, tmp_path):
    sharding.store_map(spark, {0: 0}, f"{tmp_path}/m", 1)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sharding.store_map(spark, {0: 1}, f"{tmp_path}/m", 1)
    (tmp_path / "m" / "v=2").mkdir()
    assert sharding.load_map(spark, f"{tmp_path}/m") == (1, {0: 0})
    assert sharding.load_map(spark, f"{tmp_path}/none") == (0, {})


def test_rows_without_id_are_spread_over_slices(docs):
    sizes = mixing._sizes(docs([(None, f"text {i}", "a") for i in range(4000)]))
    placed = mixing._placed(sizes, 1.5, 2.0, mixing.WEIGHTS, mixing.SCHEDULES)
    most = max(r["count"] for r in placed.groupBy("slice").count().collect())
    assert most < 20


def skewed(df):
    """The final plan of df with joins that count as skewed early."""
    spark = df.sparkSession
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_hot_payload_is_split(spark):
    r = random.Random(6)
    # Long, as shuffled copies of one page are compressed.
    noise = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    page = noise(8000)
    rows = [(i, "u", page if i % 3 == 0 else noise(110)) for i in range(3000)] + [(5000, "u", "again " * 30), (5001, "u", "again " * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    assert "skew=true" in skewed(warc.marked(pages, broadcast_rows=0))
    plan = warc.marked(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    first = {x.page_id: x.first_id for x in warc.marked(pages, broadcast_rows=0).collect()}
    assert first == {i: 0 if i % 3 == 0 and 0 < i < 5000 else 5000 if i == 5001 else None for i, _, _ in rows}


def test_a_hot_license_key_is_split(docs):
    text = licenses.TEMPLATES[0][1]
    rows = [(None, None, "a") if i % 3 else (i, f"{text} {i}", "a") for i in range(3000)]
    assert "skew=true" in skewed(licenses.scan(docs(rows).repartition(8)))
