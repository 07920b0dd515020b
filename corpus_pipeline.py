"""A training corpus from `documents`: quality rules, near-duplicates, benchmark leaks, mixing, sharding.

Defined cases, in every stage: a null text is the empty one, which the quality rules reject (fewer than 50 words), as
they do any short one; null ids are ids like others, and rows with a null id and different texts are different rows; rows
repeated with the same id and text are one after the near-duplicates; a null source is a source of its own; an empty
table gives an empty result; columns beyond those that a stage reads pass through whatever their names are, up to the
mix; a label or an item without an id or a text counts for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackframe.llm import base, decontamination, mixing, neardup, quality, sharding


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what base rules and the learned list reject. The list is learned from the labelled rows of these documents."""
    rules = quality.learn(quality.labelled(docs, base.table(spark, sf_dir, "labels")))
    return quality.kept_rows(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the lowest id of every class of near-duplicates."""
    return neardup.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item."""
    return decontamination.clean_rows(docs, base.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every pass of every document that the mix takes, in training order."""
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot."""
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", mix_sources),
    ("sharding", shards),
]
#: Near-duplicates and overlaps are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written to the shared folder and read by the next."""
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = base.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
