"""Placement of keys on shards by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a prime-sized table: ``(offset + i * skip) mod size``. The shards take turns; at
its turn a shard claims the first slot of its order that is still free, until the table is full. Every shard then owns nearly the
same number of slots, and when a shard is added or removed few slots change hands. A key's slot is a hash modulo the size, so placement is
one look-up in a broadcast table whose length is the ``size`` parameter, whatever the data.

Edges: a null key is placed like the text ``null``; equal keys always share a shard; an empty table gives an empty result; extra columns
are kept by ``place`` unless they are named like the columns it adds, which it replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, over 500 times the shards of the query, so that shares differ by less than a fifth of a percent.
SIZE = 8209
#: Hexadecimal digits of an MD5 sum that make a hash; 15 fit a bigint.
DIGITS = 15


def text_hash(text: str) -> int:
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:DIGITS], 16)


def lookup_table(shards: Sequence[str], size: int = SIZE) -> list[int]:
    """The shard's number for each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if size < len(shards) or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime no smaller than the number of shards")
    at = [text_hash(f"offset {s}") % size for s in shards]
    skip = [text_hash(f"skip {s}") % (size - 1) + 1 for s in shards]
    owner: list[int] = [-1] * size
    left = size
    while left:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % size
            owner[at[shard]] = shard
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, size: int = SIZE) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("bigint"), F.lit(size).cast("bigint"))


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = SIZE) -> DataFrame:
    """(slot, shard) rows; ``size`` of them."""
    return spark.createDataFrame([(slot, shards[s]) for slot, s in enumerate(lookup_table(shards, size))], "slot bigint, shard string")


def place(rows: DataFrame, key: str, shards: Sequence[str], size: int = SIZE) -> DataFrame:
    """``rows`` with (slot, shard); the broadcast table has ``size`` rows."""
    table = table_frame(rows.sparkSession, shards, size)
    return rows.drop("shard").withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(table), "slot", "left")
