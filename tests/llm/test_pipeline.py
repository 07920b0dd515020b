import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackframe.llm import base, decontamination

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = base.table(spark, DIR, "documents")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = base.saved(stage(spark, docs, DIR), "stage")
        assert docs.columns == base.table(spark, DIR, "documents").columns
        seen.append(docs.count())
        if "decontamination" in name:
            assert decontamination.overlaps(docs, base.table(spark, DIR, "benchmark")).count() == 0
    assert seen[0] > seen[1] >= seen[2] >= seen[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert out.count() == seen[4]
    assert {r.shard for r in out.collect()} <= set(range(40))


def tables(spark, tmp_path, docs, labels, bench):
    """A folder with these tables."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


LABELS = [(1, 1, 0), (None, 0, 0), (6, None, None)]
BENCH = [(1, "one two three four five six seven"), (None, None), (2, "")]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_of_a_stage(spark, odd, tmp_path, name):
    extra = odd.withColumns({c: F.lit("mine") for c in ("size", "row", "key", "root", "shard", "slot", "position", "text_key", "nth")})
    d = tables(spark, tmp_path, extra, LABELS, BENCH)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == extra.columns
    rows = out.collect()
    assert len(rows) <= (2 if name == "mixing sources" else 1) * odd.count()
    assert all(r.root == "mine" for r in rows if "root" in r.asDict())
    none = stage(spark, spark.read.parquet(f"{d}/documents.parquet").limit(0), d)
    assert none.count() == 0
    assert none.columns == out.columns


def test_decisions_take_effect(spark, docs, tmp_path):
    """What each stage should drop is planted; the rest stays and is dealt out."""
    r = random.Random(3)
    prose = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randint(0, 9999)}" for _ in range(n))
    good = [(i, prose(120), "ab"[i % 2]) for i in range(60)]
    item = prose(30)
    rows = [
        *good, (100, "short text", "a"), (101, None, "a"), (102, good[0][1] + " end", "a"), (103, good[1][1], "b"), (None, good[2][1] + " more", "a"),
        (104, f"{prose(80)} {item} {prose(80)}", "a"), (59, good[59][1], "b"), (None, prose(90), None),
    ]
    d = tables(spark, tmp_path, docs(rows), [(i, 1, 0) for i in range(20)], [(7, item)])
    out = corpus_pipeline.run(spark, d).collect()
    kept = {r.doc_id for r in out}
    # The mix takes one and a half times all words, so every document that is left may come once or twice.
    assert not kept & {100, 101, 102, 103, 104}
    assert len(kept & set(range(60))) >= 55
    assert {r.shard for r in out} <= set(range(40))
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
