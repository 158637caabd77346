"""Sharding by a permutation-filled lookup table: constant-time placement that moves few keys when shards change."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import free_name

#: Slots of the table, a prime; a table of 4-byte entries stays at 256 KB whatever the data's size.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
#: Bytes that a writer of shards gets, as Spark expects them, and writers of one shard at most.
FILE_BYTES, MOST_FILES = 1 << 30, 10_000


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Shard index of each slot. Shards take turns, each claiming the first free slot of its own order of preference.

    A shard's order is offset, offset + skip, offset + 2 skip, ... modulo the prime size, so it reaches every slot.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and no more than there are slots")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key (null counts as the empty key): 60 bits of its MD5, modulo the table's size."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with slot and shard, by a broadcast of the table (its size is fixed by ``slots``).

    Equal keys share a shard, so repeated rows stay together; columns slot and shard of the input are replaced.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, shards[x]) for i, x in enumerate(fill_table(shards, slots))], "slot long, shard string")
    placed = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return placed.join(F.broadcast(table), "slot", "left").select(*[c for c in rows.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(rows: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, files: int | None = None) -> None:
    """Write ``rows`` as Parquet, one folder for each shard, each split over ``files`` writers.

    Without ``files`` their number follows from the size that Spark expects of ``rows``, so that a writer gets about
    FILE_BYTES. Rows are dealt to writers by a hash of all their columns, so rows of one key may share a shard and not a
    task. An empty table writes no shard.
    """
    if files is None:
        expected = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        files = max(1, min(MOST_FILES, -(-expected // (FILE_BYTES * len(shards)))))
    placed, part = place(rows, key, shards), free_name("part", rows)
    whole = F.xxhash64(*[F.to_json(F.struct(c)) if k.startswith(("map", "variant")) else F.col(f"`{c}`") for c, k in placed.dtypes])
    placed.withColumn(part, F.pmod(whole, F.lit(files))).repartition(len(shards) * files, "shard", part).drop(part).write.partitionBy("shard").parquet(path)
