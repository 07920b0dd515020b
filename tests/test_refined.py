"""Operators that work in rounds or at the edge of files, against plain Python."""

import collections
import csv
import glob
import gzip
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackframe.operators import events, quantiles, reports, teams
from trackframe.sources import catalogue, io, runs

EVENT = "match_id long, frame_idx long, ts_s double, confidence double, region string"


# ---- windows of events ---------------------------------------------------------------------------------------------


def plain_best(rows, seconds):
    out = []
    for match in {r[0] for r in rows}:
        own, i = sorted((r for r in rows if r[0] == match), key=lambda r: (r[2], r[1])), 0
        while i < len(own):
            j, best = i + 1, own[i]
            while j < len(own) and own[j][2] - own[i][2] <= seconds:
                best = own[j] if own[j][3] > best[3] else best
                j += 1
            out.append(best)
            i = j
    return sorted(out, key=str)


def event_rows(seed):
    """Dense and sparse matches, times on a grid (so that windows end exactly at events), ties of time and confidence, pauses, one event, no match."""
    r, rows = random.Random(seed), []
    for match, n, step in ((1, 400, 1), (2, 300, 40), (3, 1, 1), (4, 60, 125), (5, 50, 0), (None, 30, 25), (6, 200, 3)):
        f = r.randint(0, 50)
        for i in range(n):
            rows.append((match, f, f / 25, r.choice([0.5, 0.6, 0.7, r.random()]), f"e{i}"))
            f += r.choice([step, step, 2 * step, 10 * step if i % 50 == 0 else step]) or 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seconds", [5.0, 0.7])
@pytest.mark.parametrize(("fold", "size"), [(1000, None), (0, None), (0, 7), (100, 64)])
def test_best_of_windows(spark, seconds, fold, size):
    """Folded, followed by pointers, and mixed: the same rows as one pass in order."""
    rows = event_rows(4)
    got = events.dedup_events(spark.createDataFrame(rows, EVENT), seconds, fold, size)
    assert got.columns == [c.split()[0] for c in EVENT.split(", ")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_best(rows, seconds)


def test_windows_run_without_python(spark):
    df = spark.createDataFrame(event_rows(5)[:50], EVENT)
    for fold in (0, 1000):
        plan = events.dedup_events(df, 5.0, fold)._jdf.queryExecution().toString()
        assert "Python" not in plan
        assert "Arrow" not in plan
    assert events.dedup_events(df.limit(0)).collect() == []


# ---- quantiles -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("bins", "few"), [(4, 3), (16, 50), (1024, 10_000)])
def test_quantiles_are_exact(spark, bins, few):
    """Skewed, constant, repeated, tiny and huge values, groups of one and of none, a null group; many passes with few bins."""
    r = random.Random(6)
    groups = {
        1: [r.random() ** 8 for _ in range(700)], 2: [3.5] * 200, 3: [r.choice([0.1, 0.2, 0.3]) for _ in range(300)], 4: [7.0], 5: [1e308, -1e308, 0.0, 5e-324, 1.0, 2.0], None: [float(i) for i in range(101)],
        6: [None, None], 7: [float("nan"), 1.0, None, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    r.shuffle(rows)
    at = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {x.k: x.q for x in quantiles.exact_quantiles(spark.createDataFrame(rows, "k long, v double"), ["k"], "v", at, bins, few).collect()}
    assert got.keys() == groups.keys() - {6}
    for k, q in got.items():
        own = np.array([v for v in groups[k] if v is not None and v == v])
        want = [np.partition(own, int(p * (len(own) - 1)))[int(p * (len(own) - 1))] if k == 5 else np.quantile(own, p) for p in at]
        assert [x for i, x in enumerate(q) if k != 5 or float(at[i] * 5).is_integer()] == pytest.approx([x for i, x in enumerate(want) if k != 5 or float(at[i] * 5).is_integer()], rel=1e-12)


def test_reports_with_refined_quantiles(spark, monkeypatch):
    """The reports give the same when every interval has to be refined, and no percentile buffer is left in their plans."""
    monkeypatch.setattr(quantiles.exact_quantiles, "__defaults__", (4, 3, False))
    r = random.Random(7)
    rows = [(m, f, r.choice(["player", "ball", None]), r.random()) for m in (1, 2) for f in range(40) for _ in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, object_type string, confidence double")
    pdf = pd.DataFrame(rows, columns=["match_id", "frame_idx", "object_type", "confidence"])
    out = reports.describe_by(df)
    assert "percentile" not in out._jdf.queryExecution().toString()
    want = {(m, None if pd.isna(k) else k): g.describe() for (m, k), g in pdf.groupby(["match_id", "object_type"], dropna=False)["confidence"]}
    got = {(x.match_id, x.object_type): x for x in out.collect()}
    assert got.keys() == want.keys()
    for k, x in got.items():
        assert [x.n, x.mean, x.std, x.lowest, x.p25, x.p50, x.p75, x.highest] == pytest.approx(want[k].tolist())
    frames = pdf.groupby(["match_id", "frame_idx"]).size().groupby("match_id")
    assert {x.match_id: (x.mean_rows, x.median_rows) for x in reports.per_frame_stats(df).collect()} == {m: (pytest.approx(g.mean()), g.median()) for m, g in frames}


def test_samples_are_cut_before_they_are_shuffled(spark):
    df = spark.createDataFrame([(m, t, f) for m in (1, None) for t in range(5) for f in range(60)], "match_id long, track_id long, frame_idx long")
    out = reports.sample_tracks(df, 50)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    got = collections.Counter((r.match_id, r.total) for r in out.collect())
    assert got == {(1, 300): 50, (None, 300): 50}


# ---- the caller's Python -------------------------------------------------------------------------------------------


def test_own_python_over_pixels(spark):
    """A grouped aggregate of the caller gets all pixels of a box, and a box beyond the bound ends the job."""
    r = random.Random(8)
    pixels = [(0, x, y, r.randint(0, 255), r.randint(0, 255), r.randint(0, 255)) for x in range(12) for y in range(12)]
    areas = [(1, 0, 0, 0, 5, 4), (2, 0, 3, 3, 12, 12), (3, 0, 6, 6, 6, 9)]

    def trimmed(v: pd.Series) -> float:
        return float(v.sort_values().iloc[len(v) // 4 : len(v) - len(v) // 4].mean())

    own = F.pandas_udf(trimmed, "double")
    p = spark.createDataFrame(pixels, "frame_idx long, x long, y long, b long, g long, r long")
    a = spark.createDataFrame(areas, "box_id long, frame_idx long, x1 long, y1 long, x2 long, y2 long")
    extract = lambda b, g, r: {"b": own(b), "g": own(g), "r": own(r)}
    got = {x.box_id: (x.b, x.g, x.r) for x in teams.region_mean_color(p, a, extract, most=81).collect()}
    for box, _, x1, y1, x2, y2 in areas[:2]:
        inside = [q[3:] for q in pixels if x1 <= q[1] < x2 and y1 <= q[2] < y2]
        assert got.pop(box) == pytest.approx([trimmed(pd.Series([q[c] for q in inside])) for c in range(3)])
    assert not got
    with pytest.raises(Exception, match="box 2 has more than 80 pixels"):
        teams.region_mean_color(p, a, extract, most=80).collect()


# ---- the catalogue of runs -----------------------------------------------------------------------------------------


@pytest.fixture
def saved_runs(tmp_path):
    """Runs in the layout of single files and of part files; one whose files cannot be read as what they are."""
    for name in ("one", "two", "torn"):
        (tmp_path / name).mkdir()
    event = lambda f, kind: json.dumps({"event_type": kind, "frame_idx": f, "timestamp": f / 25, "confidence": 1, "location": [1, 2.5], "metadata": {"speed": 3, "target_goal": "top"}})
    (tmp_path / "one" / "events.jsonl").write_text("\n".join([event(1, "shot"), event(2, "goal"), "", event(3, None), event(4, "pass")]) + "\n")
    (tmp_path / "one" / "video_metadata.json").write_text('{\n  "fps": 25,\n  "total_frames": 9,\n  "width": 1280,\n  "height": 720,\n  "duration": 1\n}')
    (tmp_path / "one" / "notes.txt").write_text("no run file")
    parts = tmp_path / "two" / "events.jsonl"
    parts.mkdir()
    for k in range(3):
        (parts / f"part-{k}.json").write_text("\n".join(event(10 * k + i, "shot") for i in range(4)))
    (parts / "_SUCCESS").write_text("")
    (parts / ".part-0.json.crc").write_bytes(b"\xff\xfe")
    (tmp_path / "torn" / "events.jsonl").write_bytes(b"\xff\xfe not json")
    (tmp_path / "torn" / "video_metadata.json").write_bytes(b"\xff not json")
    return str(tmp_path)


def test_one_run_opens_no_file_of_another(spark, saved_runs):
    got = runs.run_events(spark, saved_runs, "one")
    assert sorted((r.frame_idx, r.event_type, r.n_events, r.confidence, r.location, r.metadata.speed) for r in got.collect())[0] == (1, "shot", 4, 1.0, [1.0, 2.5], 3.0)
    assert got.count() == 4
    assert runs.run_events(spark, saved_runs, "two").count() == 12
    assert runs.run_events(spark, saved_runs, "none").count() == 0
    (meta,) = runs.run_metadata(spark, saved_runs, "one").collect()
    assert (meta.video_metadata.fps, meta.video_metadata.duration, meta.manifest, meta.teams) == (25.0, 1.0, None, None)
    with pytest.raises(Exception, match="torn|decode|JSON|codec"):
        runs.run_events(spark, saved_runs, "torn").collect()


def test_a_partition_per_run(spark, saved_runs):
    names = catalogue.read_runs(spark, saved_runs)
    assert names.rdd.getNumPartitions() == 3
    assert {(r.run, r.file) for r in names.collect()} == {("one", "events.jsonl"), ("one", "video_metadata.json"), ("one", "notes.txt"), ("two", "events.jsonl"), ("torn", "events.jsonl"), ("torn", "video_metadata.json")}
    assert catalogue.read_runs(spark, saved_runs, "events.jsonl", io.EVENTS, "two").rdd.getNumPartitions() == 1
    assert catalogue.read_runs(spark, f"{saved_runs}/nowhere").count() == 0


def test_large_files_of_a_run_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """Every record once, wherever a range ends: in a line, at its end, within one longer than ranges, at blank lines and at bare or full returns."""
    r, records = random.Random(9), []
    for name, n in (("a", 300), ("b", 3)):
        parts = tmp_path / name / "events.jsonl"
        parts.mkdir(parents=True)
        for k in range(2):
            text = ""
            for i in range(n):
                own = {"event_type": r.choice(["shot", "goal", "ü\u2028\x0c"]) + "x" * r.choice([0, 0, 5, 900 if i == 7 else 1]), "frame_idx": 1000 * k + i, "confidence": 1}
                records.append((name, own["event_type"], own["frame_idx"], 1.0))
                text += json.dumps(own, ensure_ascii=i % 2 == 0) + r.choice(["\n", "\n", "\r\n", "\r", "\n\n", "\n \n"])
            (parts / f"part-{k}.json").write_bytes(text.encode() if k else text.rstrip().encode())
    (tmp_path / "b" / "events.jsonl" / "part-2.json.gz").write_bytes(gzip.compress(b'{"event_type": "goal", "frame_idx": 9, "confidence": 1}\n' * 50))
    records += [("b", "goal", 9, 1.0)] * 50
    want = collections.Counter(records)
    for split in (97, 256, 4096):
        monkeypatch.setattr(catalogue, "SPLIT", split)
        reader = catalogue.RunReader(StructType.fromDDL("run string, event_type string, frame_idx long, confidence double"), {"root": str(tmp_path), "file": "events.jsonl"})
        parts = reader.partitions()
        assert sum(p.run == "a" for p in parts) > 30_000 / split
        got = [tuple(x.values()) for p in parts for b in reader.read(p) for x in b.to_pylist()]
        assert collections.Counter(got) == want
        count = catalogue.RunReader(StructType.fromDDL("run string"), {"root": str(tmp_path), "file": "events.jsonl"})
        assert sum(b.num_rows for p in count.partitions() for b in count.read(p)) == len(records)
    monkeypatch.undo()
    assert runs.run_events(spark, str(tmp_path), "b").filter("n_events = 56").count() == 56


def test_filters_choose_partitions(spark, saved_runs):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        every = catalogue.read_runs(spark, saved_runs, "events.jsonl", io.EVENTS)
        assert every.filter(F.col("run").isin("one", "two") & (F.col("event_type") == "shot")).count() == 13
        assert every.filter("run = 'two' AND frame_idx >= 10").count() == 8
        assert every.filter("run = 'two'").rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_list_of_runs(spark, saved_runs, tmp_path):
    for f in (tmp_path / "torn").iterdir():
        f.unlink()
    got = {r.run: r for r in runs.list_runs(spark, saved_runs).collect()}
    assert got.keys() == {"one", "two"}
    # An event without a type is an other one; one of an unknown type is none of the three.
    assert [(r.n_shot, r.n_goal, r.n_other, r.has_events, r.has_timeline, r.fps) for r in (got["one"], got["two"])] == [(1, 1, 1, True, False, 25.0), (12, 0, 0, True, False, None)]


# ---- files ---------------------------------------------------------------------------------------------------------


def header(path):
    every = set()
    for name in glob.glob(f"{path}/part-*.csv"):
        with open(name, newline="") as f:
            every.update(tuple(row) for row in list(csv.reader(f))[:1])
    (one,) = every
    return list(one)


def test_headers_are_those_of_files(spark, tmp_path):
    det = spark.createDataFrame([(1, 2, 0.5, 0, "ball", 32, 1.0, 2.0, 4.0, 8.0, 0.9)], "match_id long, frame_idx long, ts_s double, slot long, object_type string, class_id int, x1 double, y1 double, x2 double, y2 double, confidence double")
    io.export_csv(reports.frame_summary(det), f"{tmp_path}/frames")
    assert header(f"{tmp_path}/frames") == ["match_id", "frame_idx", "object_type", "timestamp", "confidence"]
    io.write_table(io.packed(det), f"{tmp_path}/detections")
    (r,) = io.read_table(spark, f"{tmp_path}/detections", io.DETECTIONS).collect()
    assert (r.bbox, r.center, r.width, r.height, r.area, r.det_idx, r.timestamp) == ([1.0, 2.0, 4.0, 8.0], [2.5, 5.0], 3.0, 6.0, 18.0, 0, 0.5)
    (back,) = io.read_detections(spark, f"{tmp_path}/detections").collect()
    assert (back.x1, back.y2, back.width, back.area, back.slot, back.ts_s) == (1.0, 8.0, 3.0, 18.0, 0, 0.5)
    shots = spark.createDataFrame([(1, "shot", 2, 0.5, 0.9, 3.0, 4.0, "top")], "match_id long, event_type string, frame_idx long, ts_s double, confidence double, x double, y double, target_goal string")
    io.export_csv(reports.event_timeline(shots), f"{tmp_path}/timeline")
    assert header(f"{tmp_path}/timeline") == ["match_id", "event_type", "timestamp", "confidence", "frame_idx"]
    io.export_csv(io.packed_events(shots), f"{tmp_path}/shots")
    assert header(f"{tmp_path}/shots")[:6] == ["match_id", "event_type", "frame_idx", "timestamp", "confidence", "speed"]


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_folders_are_not_written_by_every_task(spark, tmp_path, fmt):
    """Sixteen tasks hold rows of each of five matches: a folder has one file, not sixteen; a null key has its folder, too."""
    rows = [(None if i % 5 == 4 else i % 5, i) for i in range(800)]
    io.write_table(spark.createDataFrame(rows, "match_id long, frame_idx long").repartition(16), f"{tmp_path}/out", fmt, ("match_id",))
    assert collections.Counter(f.rsplit("/", 2)[1] for f in glob.glob(f"{tmp_path}/out/*/part-*")) == {f"match_id={m}": 1 for m in (0, 1, 2, 3, "__HIVE_DEFAULT_PARTITION__")}
    if fmt != "csv":
        assert sorted(map(str, (tuple(r) for r in io.read_table(spark, f"{tmp_path}/out", "match_id long, frame_idx long", fmt).select("match_id", "frame_idx").collect()))) == sorted(map(str, rows))


def test_what_is_written_on_the_way_goes(spark):
    df = io.saved(spark.range(5), "some")
    at = io.scratch_dir(spark)
    assert df.count() == 5
    assert io.scratch(spark, "x").startswith(at + "/")
    io.clear_scratch(spark)
    store, path = io._hadoop(spark, at)
    assert not store.exists(path)
    assert io.saved(spark.range(3), "more").count() == 3
