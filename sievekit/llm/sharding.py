"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots (thousands, far more than shards).
Bytes are summed per slot, and a small versioned table says which shard owns
each slot. Rows never hash to shards directly, so a rebalance only edits the
table: whole slots move, and every other row stays where it is.

The map has one row per slot (``slots`` rows whatever the size of the data),
so building it in one task and broadcasting it are both bounded.

Edge cases: a null text weighs one byte; null ids hash like any value; repeated
rows share a slot and get neighbouring positions; an empty table gives no rows
(its map still lists every slot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


def slot_of(*cols: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, from a stable 64-bit hash of its columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(slots)).cast("int")


def slot_loads(rows: DataFrame, size: str, slot: str = "vslot") -> DataFrame:
    """Bytes and rows of each slot: (vslot, slot_bytes, slot_rows)."""
    return rows.groupBy(F.col(slot).alias("vslot")).agg(
        F.sum(size).alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows")
    )


def build_map(loads: DataFrame, shards: int, slots: int = SLOTS, version: int = 1) -> DataFrame:
    """First map: heaviest slot first, each to the shard with the fewest bytes so far.

    Returns (version, vslot, shard, slot_bytes, slot_rows), one row per slot.
    """
    every = loads.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    full = every.join(F.broadcast(loads), "vslot", "left").na.fill(0, ["slot_bytes", "slot_rows"])
    heaviest = F.array_sort(F.collect_list(F.struct((-F.col("slot_bytes")).alias("neg"), "vslot", "slot_rows")))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("load"),
        F.array().cast("array<int>").alias("picked"),
    )

    def give(state: Column, slot: Column) -> Column:
        least = (F.array_position(state["load"], F.array_min(state["load"])) - 1).cast("int")
        return F.struct(
            F.transform(state["load"], lambda v, i: F.when(i == least, v - slot["neg"]).otherwise(v)).alias("load"),
            F.array_append(state["picked"], least).alias("picked"),
        )

    one = full.agg(heaviest.alias("order"))
    dealt = one.select("order", F.aggregate("order", start, give)["picked"].alias("picked"))
    pair = dealt.select(F.explode(F.arrays_zip("order", "picked")).alias("x"))
    return pair.select(
        F.lit(version).alias("version"),
        F.col("x.order.vslot").alias("vslot"),
        F.col("x.picked").alias("shard"),
        (-F.col("x.order.neg")).alias("slot_bytes"),
        F.col("x.order.slot_rows").alias("slot_rows"),
    )


def grow_map(current: DataFrame, shards: int) -> DataFrame:
    """Next version with one more shard (number ``shards``): each old shard hands over slots, in an
    order of their own, as long as it keeps its share of shards + 1. A slot too heavy for what is
    left is passed over for the next; no other slot moves."""
    total = current.agg(F.sum("slot_bytes").alias("all_bytes"))
    slot = F.struct(F.xxhash64("vslot").alias("at"), "vslot", "slot_bytes", "slot_rows")
    held = current.groupBy("version", "shard").agg(F.sort_array(F.collect_list(slot)).alias("held"), F.sum("slot_bytes").alias("bytes"))
    held = held.join(F.broadcast(total)).withColumn("surplus", F.col("bytes") - F.col("all_bytes") / (shards + 1))
    start = F.struct(F.lit(0).cast("long").alias("given"), F.array().cast("array<int>").alias("picked"))

    def give(state: Column, x: Column) -> Column:
        fits = state["given"] + x["slot_bytes"] <= F.col("surplus")
        return F.struct(
            F.when(fits, state["given"] + x["slot_bytes"]).otherwise(state["given"]).alias("given"),
            F.when(fits, F.array_append(state["picked"], x["vslot"])).otherwise(state["picked"]).alias("picked"),
        )

    moved = held.withColumn("picked", F.aggregate("held", start, give, lambda s: s["picked"]))
    each = moved.select("version", "shard", "picked", F.explode("held").alias("x"))
    return each.select(
        (F.col("version") + 1).alias("version"),
        F.col("x.vslot").alias("vslot"),
        F.when(F.array_contains("picked", F.col("x.vslot")), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
        F.col("x.slot_bytes").alias("slot_bytes"),
        F.col("x.slot_rows").alias("slot_rows"),
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Writes a version, in place of one of the same number; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def assign(rows: DataFrame, slot_map: DataFrame, order: list[str], slot: str = "vslot") -> DataFrame:
    """Adds ``shard`` and ``position`` (gapless from 0 within the shard) to every row.

    A position is the number of rows in the shard's earlier slots, from the map,
    plus the rank inside the row's own slot, so no task sorts a whole shard.
    """
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.select(
        F.col("vslot").alias("_slot"),
        "shard",
        F.coalesce(F.sum("slot_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(slot).orderBy(*order)
    return (
        rows.drop("shard", "position")
        .withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(places), F.col(slot) == F.col("_slot"))
        .withColumn("position", F.col("_before") + F.col("_rank") - 1)
        .drop("_slot", "_before", "_rank")
    )
