"""Sharding by weighted rendezvous hashing.

Every shard draws an exponential race time for a record from the hash of (record key, shard), divided by
the shard's weight; the least time wins. A record's race times do not depend on how many shards there are,
so a new shard only ever takes records for itself, and a removed shard only gives its own away.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import uniform

#: Blocks in which the rows of a shard are numbered; shards x blocks is all that is broadcast.
SLOT_BLOCKS = 64
#: Largest shards x blocks table that is broadcast; above it the offsets are joined by a shuffle.
BROADCAST_ROWS = 200_000


def rendezvous_shard(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard (int, from 0) of a record key under the given shard weights.

    A null key is a key like any other: all such rows share a shard. A weight of 0 keeps a shard empty.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights: one positive number at least, none negative")
    stem = F.xxhash64(F.lit(seed), F.coalesce(key.cast("string"), F.lit("\x00null")))
    race = [F.struct((-F.ln(uniform(stem, F.lit(s))) / F.lit(float(w))).alias("t"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return (F.least(*race) if len(race) > 1 else race[0])["shard"].cast("int")


def number_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", blocks: int = SLOT_BLOCKS, n_shards: int | None = None) -> DataFrame:
    """Add `slot`: 0, 1, 2, ... without gaps within each shard; a column of that name is replaced.

    A shard's rows are dealt into blocks, by a hash of `order`, that are numbered apart and put behind one another
    by a running sum of block counts, so no task sorts a whole shard. Rows that are equal in `order` share a
    block and get slots of their own.
    """
    block = F.pmod(F.xxhash64(F.lit("slot"), *[F.col(c) for c in order]), F.lit(blocks)).cast("int")
    rows = df.withColumn("__block", block)
    before = Window.partitionBy(shard).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(shard, "__block").agg(F.count("*").alias("__n")).select(shard, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    if n_shards is not None and n_shards * blocks <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    place = Window.partitionBy(shard, "__block").orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(place)).join(offsets, [shard, "__block"]).withColumn(slot, F.col("__rank") - 1 + F.col("__offset")).drop("__block", "__rank", "__offset")


def shard_records(df: DataFrame, key: str, weights: Sequence[float], grown_weights: Sequence[float] | None = None, seed: int = 0) -> DataFrame:
    """Add `shard`, `slot` and, with `grown_weights`, `grown_shard` to every row of `df`.

    The key alone decides on shards; equal texts under different keys may part. Null keys share one shard. Slots
    go by all columns that can be hashed, so the rows of one key, or without one, are dealt to many blocks unless
    they are equal as a whole. An empty table gives an empty result. Columns of the three names are replaced,
    other columns pass through.
    """
    df = df.drop("shard", "slot", "grown_shard")
    spread = [c for c, kind in df.dtypes if c != key and not kind.startswith(("map", "variant"))]
    out = df.withColumn("shard", rendezvous_shard(F.col(key), weights, seed))
    if grown_weights is not None:
        out = out.withColumn("grown_shard", rendezvous_shard(F.col(key), grown_weights, seed))
    return number_slots(out, "shard", [key, *spread], n_shards=len(weights))
