"""A catalogue of saved runs as a data source: partitions are of one run each, so that what is asked of one run opens no file of another.

`spark.read.format("match_runs")` with the options
- root: the folder of the runs, in any store that pyarrow's file systems know;
- file: the kind of file to read (`events.jsonl`: a record per line; other names: a document per file), or `*` for the
  names alone (run, file), for which no file is opened;
- run: one run's name, else all runs that have the file;
- pushdown: `true` where `spark.sql.python.filterPushdown.enabled` is set (`read_runs` looks): filters on `run` choose the
  partitions, too.
A file may also be a folder of part files, as Spark writes it. Records per line are dealt over partitions by bytes: small
files of a run share one, a large file is cut into ranges, of which each has the lines that begin in it. The schema is the
caller's, with `run` in it; fields a record lacks are null. With `run` alone, lines are counted and not parsed.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Records to a batch, and bytes of records per line to a partition.
BATCH, SPLIT = 4096, 8 << 20


def _store(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(url))


class RunPartition(InputPartition):
    """files: names, or (path, start, end) with the end null for whole files."""

    def __init__(self, run: str, files: list):
        self.run, self.files = run, files


def _ranges(files: list) -> Iterator[list[tuple]]:
    """Files of records per line as lists of (path, start, end), each of SPLIT bytes at most or one file that cannot be cut."""
    from pyarrow import Codec

    own, held = [], 0
    for f in files:
        try:
            Codec.detect(f.path)
            cuts = [(f.path, 0, None)]
        except (TypeError, ValueError):
            # Not compressed, by its name.
            cuts = [(f.path, at, min(at + SPLIT, f.size)) for at in range(0, f.size, SPLIT)] if f.size > SPLIT else [(f.path, 0, None)]
        for path, start, end in cuts:
            size = f.size if end is None else end - start
            if own and held + size > SPLIT:
                yield own
                own, held = [], 0
            own.append((path, start, end))
            held += size
    if own:
        yield own


class RunReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.root, self.file = schema, options["root"], options.get("file", "*")
        self.runs = {options["run"]} if "run" in options else None

    def partitions(self) -> list[RunPartition]:
        """Folders are listed, no file is opened. A run asked for by name costs one listing, whatever the number of runs."""
        from pyarrow import fs

        store, root = _store(self.root)
        listed = lambda at: sorted(store.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda x: x.path)
        runs = sorted(self.runs) if self.runs is not None else [x.base_name for x in listed(root) if x.type == fs.FileType.Directory]
        out = []
        for run in runs:
            files = [x for x in listed(f"{root}/{run}") if not x.base_name.startswith((".", "_"))]
            if self.file == "*":
                out.append(RunPartition(run, [x.base_name for x in files]))
                continue
            paths = []
            for x in files:
                if x.base_name == self.file:
                    paths += [x] if x.type == fs.FileType.File else [y for y in listed(x.path) if not y.base_name.startswith((".", "_"))]
            out += [RunPartition(run, p) for p in (_ranges(paths) if self.file.endswith("l") else [[(x.path, 0, None) for x in paths]] if paths else [])]
        return out or [RunPartition("", [])]

    def read(self, partition: RunPartition) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(self.schema), []
        for row in self._records(partition):
            rows.append(row)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, partition: RunPartition) -> Iterator[dict]:
        if self.file == "*":
            yield from ({"run": partition.run, "file": name} for name in partition.files)
            return
        store, _ = _store(self.root)
        kinds = {f.name: f.dataType.simpleString() for f in self.schema.fields if f.name != "run"}
        for path, start, end in partition.files:
            if self.file.endswith("l"):
                for line in _lines(store, path, start, end):
                    if line.strip():
                        yield _row(json.loads(line), kinds, partition.run) if kinds else {"run": partition.run}
            else:
                with store.open_input_stream(path) as stream:
                    text = stream.read().decode().strip()
                if text:
                    yield _row(json.loads(text), kinds, partition.run)


def _lines(store, path: str, start: int, end: int | None) -> Iterator[str]:
    """The lines that begin in [start, end) of a file, the last one whole."""
    import io

    if end is None:
        with store.open_input_stream(path) as stream:
            yield from io.TextIOWrapper(stream, "utf-8")
        return
    with store.open_input_file(path) as f:
        # The byte before tells whether a line begins at start.
        f.seek(max(start - 1, 0))
        parts = [f.read(end - max(start - 1, 0))]
        while not parts[-1].endswith(b"\n") and (more := f.read(1 << 16)):
            line, mark, _ = more.partition(b"\n")
            parts.append(line + mark)
    data = b"".join(parts)
    first = data.find(b"\n") + 1 if start else 0
    if first or not start:
        for line in io.BytesIO(data[first:]):
            yield from (x.decode() for x in line.splitlines())


def _row(record: dict, kinds: dict[str, str], run: str) -> dict:
    """The record's own fields; one that the schema holds as text and the file as an object is its JSON text."""
    out: dict = {"run": run}
    for n, kind in kinds.items():
        value = record.get(n)
        out[n] = value if value is None else json.dumps(value) if kind == "string" and isinstance(value, (dict, list)) else _fitted(value, kind)
    return out


def _fitted(value, kind: str):
    """Whole numbers in floating columns, and maps as pairs."""
    if kind == "double" and isinstance(value, int):
        return float(value)
    if kind.startswith("map<") and isinstance(value, dict):
        inner = kind[4:-1].partition(",")[2]
        return [(k, _fitted(v if inner != "string" or v is None else str(v), inner)) for k, v in value.items()]
    if kind.startswith("array<double>") and isinstance(value, list):
        return [float(x) if isinstance(x, int) else x for x in value]
    return value


class FilteredRunReader(RunReader):
    """Spark refuses a reader with this method where its setting is off, so the reader without it is the rule."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if asked is None or f.attribute != ("run",):
                yield f
            else:
                self.runs = asked if self.runs is None else self.runs & asked


class RunSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "match_runs"

    def schema(self) -> str:
        return "run string, file string"

    def reader(self, schema: StructType) -> RunReader:
        return (FilteredRunReader if self.options.get("pushdown") == "true" else RunReader)(schema, self.options)


def read_runs(spark: SparkSession, root: str, file: str = "*", schema: str = "file STRING", run: str | None = None) -> DataFrame:
    """run and the columns of schema (none: a row a record), of all runs that have the file or of one."""
    spark.dataSource.register(RunSource)
    reader = spark.read.format("match_runs").schema(f"run STRING, {schema}" if schema else "run STRING").option("root", root).option("file", file)
    reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader if run is None else reader.option("run", run)).load()
