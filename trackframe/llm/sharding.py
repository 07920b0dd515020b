"""Sharding through fixed virtual slots.

A record's key is hashed into one of thousands of virtual slots, for good. Bytes are added up per slot, and a small
versioned map says which shard has which slot. Rebalancing edits the map: slots move, records never change their slot.

Rows that repeat with id and text would pile up in one slot and break the law of even bytes. They are numbered, without
any task holding all rows of one, and from the second on the number takes part in the hash.

Defined cases: a null text has no bytes and the checksum of the empty text; null ids hash like any other value; rows
that repeat are spread over the slots and have places of their own (which of them gets which is open, they are equal);
an empty table gives an empty result; columns beyond doc_id and text are not read (`shard`) or pass through
(`write_shards`).
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.operators import slices

from . import base

N_SLOTS = 4096
#: The map is edited when a shard has more than so many times its part of the bytes.
UNEVEN = 1.001
MAP_SCHEMA = "version int, vslot int, shard int"


def vslot_of(doc_id: Column, text_key: Column, copy: Column, n_slots: int = N_SLOTS) -> Column:
    """Virtual slot of a record: by id and text, and for a repeated row by its number among its equals, from the second on."""
    once, again = F.xxhash64(doc_id, text_key), F.xxhash64(doc_id, text_key, copy)
    return F.pmod(F.when(copy > 1, again).otherwise(once), F.lit(n_slots)).cast("int")


def slotted(rows: DataFrame, text_key: Column, n_slots: int = N_SLOTS) -> DataFrame:
    """row (the columns of rows as a struct) and vslot. rows has doc_id; text_key: a hash of the text."""
    keyed = rows.select(F.struct("*").alias("row"), F.col("doc_id").alias("slot_id"), text_key.alias("slot_text"))
    vslot = vslot_of(F.col("slot_id"), F.col("slot_text"), F.col("copy"), n_slots).alias("vslot")
    repeated = base.saved(
        keyed.groupBy("slot_id", "slot_text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("slot_id").alias("again_id"), F.col("slot_text").alias("again_text")), "shard-repeated")
    n = repeated.count()
    if not n:
        return keyed.withColumn("copy", F.lit(1)).select("row", vslot)
    side = F.broadcast(repeated) if n <= base.BROADCAST_ROWS else repeated.hint("merge")
    same = F.col("slot_id").eqNullSafe(F.col("again_id")) & (F.col("slot_text") == F.col("again_text"))
    single = keyed.join(side, same, "left_anti").withColumn("copy", F.lit(1).cast("long"))
    # `tie` parts rows that are equal in all else, so that the range sort can split them; it is written before it is sorted by.
    several = base.saved(keyed.join(side, same, "left_semi").withColumn("tie", F.monotonically_increasing_id()), "shard-copies")
    numbered = slices.row_numbers(several, ["slot_id", "slot_text"], ["tie"], "copy", None).drop("tie")
    return single.unionByName(numbered).select("row", vslot)


def slot_stats(records: DataFrame) -> DataFrame:
    """vslot, n_rows, n_bytes of records (vslot, size): one row per virtual slot at most."""
    return records.groupBy("vslot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))


def first_map(weights: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Version 1: the heaviest slot first, each to the shard with the fewest bytes so far."""
    loads = [(0, s) for s in range(n_shards)]
    out = {}
    for slot in sorted(range(n_slots), key=lambda s: (-weights.get(s, 0), s)):
        load, shard = heapq.heappop(loads)
        out[slot] = shard
        heapq.heappush(loads, (load + weights.get(slot, 0), shard))
    return out


def rebalanced(old: dict[int, int], weights: dict[int, int], n_shards: int) -> dict[int, int]:
    """The next version for n_shards shards: slots leave shards that are gone or hold more than their part, nothing else moves."""
    fair = sum(weights.values()) / n_shards
    own: dict[int, list[int]] = {s: [] for s in range(n_shards)}
    loose = [v for v, s in old.items() if s >= n_shards]
    for v, s in old.items():
        if s < n_shards:
            own[s].append(v)
    for slots in own.values():
        load = sum(weights.get(v, 0) for v in slots)
        for v in sorted(slots, key=lambda v: (-weights.get(v, 0), v)):
            if weights.get(v, 0) and load - weights.get(v, 0) >= fair:
                load -= weights.get(v, 0)
                loose.append(v)
    gone = set(loose)
    loads = [(sum(weights.get(v, 0) for v in slots if v not in gone), s) for s, slots in own.items()]
    heapq.heapify(loads)
    out = dict(old)
    for v in sorted(loose, key=lambda v: (-weights.get(v, 0), v)):
        load, s = heapq.heappop(loads)
        out[v] = s
        heapq.heappush(loads, (load + weights.get(v, 0), s))
    return out


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are whole in the folder of the map, whatever store it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    found = [x.getPath() for x in store.listStatus(at)]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().partition("=")[2]) for p in found if p.getName().startswith("v=") and store.exists(done(p, "_SUCCESS")))


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v={version}")


def store_map(spark: SparkSession, mapping: dict[int, int], path: str, version: int) -> DataFrame:
    """Writes a version of the map (n_slots rows) to a folder of its own and returns it as read back. Of two callers that write the same one, the second fails."""
    rows = spark.createDataFrame([(version, v, s) for v, s in sorted(mapping.items())], MAP_SCHEMA)
    rows.coalesce(1).write.mode("error").parquet(f"{path}/v={version}")
    return read_map(spark, path, version)


def load_map(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """(version, map) of the newest version at path; version 0 and nothing where there is none. A map that cannot be read is an error."""
    newest = max(_versions(spark, path), default=0)
    return newest, {r.vslot: r.shard for r in read_map(spark, path, newest).collect()} if newest else {}


def current_map(spark: SparkSession, path: str, weights: dict[int, int], n_shards: int, n_slots: int = N_SLOTS, uneven: float = UNEVEN) -> DataFrame:
    """The map in force: the newest version, edited and stored as the next one where it does not fit n_shards or the bytes any more.

    The very first version is dealt before anything is known of the bytes; it is edited at once where they ask for it.
    """
    version, mapping = load_map(spark, path)
    if not version:
        version, mapping = 1, first_map({}, n_shards, n_slots)
        store_map(spark, mapping, path, version)
    loads = dict.fromkeys(range(n_shards), 0)
    for v, w in weights.items():
        loads[mapping[v]] = loads.get(mapping[v], 0) + w
    if len(loads) > n_shards or set(mapping.values()) != set(range(n_shards)) or max(loads.values()) > uneven * sum(loads.values()) / n_shards:
        edited = rebalanced(mapping, weights, n_shards)
        if edited != mapping:
            return store_map(spark, edited, path, version + 1)
    return read_map(spark, path, version)


def weights_of(records: DataFrame) -> dict[int, int]:
    """Bytes per slot on the driver: n_slots numbers, whatever the number of records."""
    return {r.vslot: r.n_bytes for r in slot_stats(records).collect()}


def text_key() -> Column:
    return F.xxhash64("text")


def _records(docs: DataFrame, n_slots: int) -> DataFrame:
    text = base.text_of()
    narrow = base.saved(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key().alias("text_key")), "shard-rows")
    return slotted(narrow, F.col("text_key"), n_slots).select("row.doc_id", "row.size", "row.text_crc32", "vslot")


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard and slot, the row's place in its shard (0, 1, ... without gaps).

    map_path: where the versions of the slot map are kept. A later call goes on from the newest one and edits it.

    Text is dropped at the scan. Rows are numbered within their virtual slot; the rows of the shard's slots before it
    come from the table of slot counts, so that no task sees a whole shard.
    """
    spark = docs.sparkSession
    records = base.saved(_records(docs, n_slots), "shard-records")
    stats = {r.vslot: r for r in slot_stats(records).collect()}
    weights = {v: r.n_bytes for v, r in stats.items()}
    current = current_map(spark, map_path or base.scratch(spark, "slot-map"), weights, n_shards, n_slots)
    count = spark.createDataFrame([(v, r.n_rows) for v, r in stats.items()], "vslot int, n_rows long")
    ahead = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    placed = current.join(F.broadcast(count), "vslot").withColumn("first", F.coalesce(F.sum("n_rows").over(ahead), F.lit(0))).drop("version", "n_rows")
    # n_slots rows at most on the broadcast side
    row = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return records.withColumn("row", row).join(F.broadcast(placed), "vslot").select(
        "doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("row")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, mapping: DataFrame, path: str, n_slots: int = N_SLOTS) -> str:
    """Writes docs partitioned by shard (mapping: vslot, shard; n_slots rows) and returns the name of that column. Each shard's files come from many tasks."""
    shard_no = base.free(docs.columns, "shard_no")
    placed = slotted(docs, text_key(), n_slots).join(F.broadcast(mapping.select("vslot", F.col("shard").alias("to_shard"))), "vslot")
    placed.repartition("to_shard", "vslot").select("row.*", F.col("to_shard").alias(shard_no)).write.partitionBy(shard_no).parquet(path)
    return shard_no


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(base.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )


ORACLE: dict[str, str] = {}
QUERIES = {"op7_shard": op7_shard}
