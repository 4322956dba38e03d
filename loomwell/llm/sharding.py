"""Sharding through a lookup table that the shards fill in turns.

Each shard has its own preference order of the table's slots, a permutation (offset + j * skip)
modulo the table's prime size. In turns, every shard claims the next free slot of its order, until
none is free. So shares differ by one slot at most, and a shard that leaves moves few other keys.
The table depends on the shards and its size only, never on data, and is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.runtime import free_name

SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(256))


def _number(name: str, what: str) -> int:
    return int.from_bytes(hashlib.md5(f"{what}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The place in ``shards`` of each slot's owner. ``slots`` must be prime, names distinct."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, one at least and no more than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: md5 of its text, null as a text of its own, modulo the table's size."""
    text = F.when(key.isNull(), "null").otherwise(F.concat(F.lit("="), key.cast("string")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % slots).cast("int")


def table_frame(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The lookup table as (slot, shard): ``slots`` rows, whatever the data's size."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    names = F.array(*map(F.lit, shards))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner")).select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def place(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, out: str = "shard") -> DataFrame:
    """Add ``out``, the shard of each row by its ``key``; a column of that name is replaced.

    No row is moved or dropped: null keys have a slot of their own, equal keys share one. The table
    of ``slots`` rows is broadcast; its size is fixed by the parameters.
    """
    slot, owner = free_name(df, "_slot_of_key"), free_name(df, "_owner_of_slot")
    table = table_frame(df.sparkSession, shards, slots).select(F.col("slot").alias(slot), F.col("shard").alias(owner))
    return df.drop(out).withColumn(slot, slot_of(F.col(key), slots)).join(F.broadcast(table), slot).drop(slot).withColumnRenamed(owner, out)
