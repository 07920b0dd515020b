"""What the training-data operators share: tables, scratch space, words, size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.sources.io import exists, remove, saved, scratch, shared_dir  # noqa: F401  also for the modules of this folder

#: White space as the contracts define it; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
#: A broadcast side holds at most this many rows of a few numbers each (about 64 MB); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(taken: list[str], name: str) -> str:
    """name, or with underscores after it, so that no column is called like that."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def once(value: Column) -> Column:
    """value as a generated column: it is computed once per row, and no filter or projection above copies it."""
    return F.explode(F.array(value))


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def semi(df: DataFrame, keys: DataFrame, on: list[str], n_keys: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is among n_keys distinct keys: broadcast while n_keys is within the limit, shuffled beyond."""
    return df.join(F.broadcast(keys) if n_keys <= limit else keys.hint("shuffle_hash"), on, "left_semi")
