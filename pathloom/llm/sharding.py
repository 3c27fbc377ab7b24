"""Sharding by fixed virtual slots.

Every record hashes into one of a few thousand slots. Bytes are summed per slot, and a versioned table maps slots to
shards so that the shards' bytes come out nearly equal. Rebalancing edits that table: whole slots move, records never
rehash. Only DataFrame functions are used; the one global step sees a row per slot, so its size is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.common import Scratch

#: Virtual slots, and parts of a slot whose rows are numbered on their own.
N_SLOTS, PARTS = 4096, 16


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row.

    size is the UTF-8 length plus 1. A null text counts as an empty one (size 1, CRC 0). The slot comes from doc_id and
    the text's CRC, so that rows that repeat one doc_id, or have none, spread as long as their texts differ; rows equal
    in both share a slot.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_bytes(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) of every slot, empty ones with zeros: n_slots rows whatever the input."""
    spark = rows.sparkSession
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = spark.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(sums), "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def build_map(slots: DataFrame, n_shards: int = 8, version: int = 1) -> DataFrame:
    """(version, virtual_slot, shard): largest slot first, each to the shard that has the fewest bytes so far.

    The shards' bytes differ by less than the largest slot. Ties go to the smaller slot and shard.
    """
    ordered = slots.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("s"))
    # loads: bytes per shard so far; out: the shard of each slot, in order
    folded = ordered.select("s", F.expr(f"""
        aggregate(s,
          struct(array_repeat(0L, {n_shards}) AS loads, CAST(array() AS array<int>) AS out),
          (a, x) -> struct(
            transform(a.loads, (v, i) -> v + IF(i = array_position(a.loads, array_min(a.loads)) - 1, -x.less, 0L)) AS loads,
            concat(a.out, array(CAST(array_position(a.loads, array_min(a.loads)) - 1 AS int))) AS out),
          a -> a.out)""").alias("out"))
    return folded.select(F.posexplode(F.arrays_zip("s", "out")).alias("pos", "z")).select(F.lit(version).alias("version"), F.col("z.s.virtual_slot").alias("virtual_slot"), F.col("z.out").alias("shard"))


def add_shard(old: DataFrame, slots: DataFrame, n_shards: int) -> DataFrame:
    """The map's next version with shard number n_shards added: each old shard gives slots to it and to no other.

    Slots leave a shard in the order of their hash until the shard is down to its new fair share.
    """
    sized = old.join(F.broadcast(slots), "virtual_slot")
    by = Window.partitionBy("shard")
    before = F.coalesce(F.sum("bytes").over(by.orderBy(F.xxhash64("virtual_slot"), "virtual_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.sum("bytes").over(by) / F.lit(n_shards + 1)
    moves = (before + F.col("bytes") <= share) & (F.col("bytes") > 0)
    return sized.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(moves, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def write_map(slot_map: DataFrame, path: str) -> None:
    """Appends one version to the stored history of the map."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map; the latest if none is named."""
    history = spark.read.parquet(path)
    wanted = F.lit(version) if version is not None else history.agg(F.max("version")).first()[0]
    return history.where(F.col("version") == wanted).select("version", "virtual_slot", "shard")


def has_map(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Puts every row of docs (doc_id, text) into a shard of nearly equal bytes.

    Returns doc_id, size, text_crc32, shard, slot (the row's place in its shard, from 0 without gaps), virtual_slot and
    map_version, one row for each row of docs. Null ids and texts, repeated rows and empty tables are allowed (see
    with_slots); other columns are ignored. A shard can't be split below a slot, nor a slot below a row.

    map_path names the stored map. If it is not there yet, version 1 is built from docs and stored there; if it is, its
    latest version is used as it is, so that records stay where they are until rebalance() edits it. Without map_path a
    map is built and stored for this table alone.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    rows = scratch.save(with_slots(docs, n_slots), "rows")  # narrow; the texts are read once
    slots = scratch.save(slot_bytes(rows, n_slots), "slots")
    path = map_path or f"{scratch.root}/map"
    if not has_map(spark, path):
        write_map(build_map(slots, n_shards), path)
    # a slot's rows are numbered in parts, each after those before it in its shard
    numbered = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("part")), F.lit(PARTS)).cast("int"))
    parts = numbered.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("rows"))  # n_slots * PARTS rows at most
    by = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(F.broadcast(read_map(spark, path)), "virtual_slot").select("virtual_slot", "part", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("rows").over(by), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size"))
    found = numbered.withColumn("n", within).join(F.broadcast(placed), ["virtual_slot", "part"])
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("n") - 1).cast("long").alias("slot"), "virtual_slot", "map_version")


def rebalance(docs: DataFrame, map_path: str, n_slots: int = N_SLOTS) -> int:
    """Adds a shard to the stored map by the bytes that docs has in each slot now; returns the new version's number."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "rebalance")
    slots = scratch.save(slot_bytes(with_slots(docs, n_slots), n_slots), "slots")
    old = scratch.save(read_map(spark, map_path), "old")
    last = old.agg(F.max("shard").alias("shard"), F.max("version").alias("version")).first()
    write_map(add_shard(old, slots, last["shard"] + 1), map_path)
    scratch.drop(slots, old)
    return last["version"] + 1
