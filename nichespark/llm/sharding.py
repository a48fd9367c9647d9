"""Sharding by a permutation-filled lookup table.

Every shard walks its own permutation of the slots of a prime-sized table; shards take turns, and
each turn claims the first slot on the walk that is still free. A key's slot is its hash modulo the
table size, so placement is one lookup in a broadcast table whose size is a parameter, nothing is
shuffled, and adding or removing a shard moves few keys besides its own.

Cases: a null key is placed as the empty key; equal keys share a shard; an empty table gives an
empty result; existing columns named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

TABLE_SIZE = 65_537
#: The lookup table is broadcast (16 bytes a slot), so its size is bounded.
MAX_TABLE = 4_194_301


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


@lru_cache(maxsize=16)
def lookup_table(shards: tuple[str, ...], size: int = TABLE_SIZE) -> tuple[int, ...]:
    """For each slot the position of its shard in `shards`."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"the table size must be a prime from {len(shards)} to {MAX_TABLE}")
    at = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 if size > 1 else 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return tuple(table)


def slot_of(key: Column, size: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(size)).cast("int")


def assign_shards(df: DataFrame, shards: tuple[str, ...], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """df plus slot (int) and shard (its name)."""
    table = lookup_table(tuple(shards), size)
    slots = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], "slot int, shard string")
    return without(df.withColumn("__slot", slot_of(F.col(f"`{key}`"), size)), "slot", "shard").withColumnRenamed("__slot", "slot").join(F.broadcast(slots), "slot")


def write_shards(df: DataFrame, path: str, shards: tuple[str, ...], key: str = "doc_id", size: int = TABLE_SIZE) -> None:
    """Write df as Parquet, one folder for each shard."""
    assign_shards(df, shards, key, size).drop("slot").write.partitionBy("shard").parquet(path)
