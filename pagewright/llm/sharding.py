"""Sharding by a permutation-filled lookup table (operator 4), with SQL functions only.

Eisenbud et al., "Maglev": every shard has its own order of preference over the
slots of a prime-sized table; shards take turns, each claiming its first slot
still free. Shards get equal numbers of slots (one more or less), and adding or
removing a shard moves few of the others' slots. A row's key hashes to a slot;
the table is broadcast, and its size is a parameter, whatever the data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TABLE = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:15], 16)


def table_size(shards: int) -> int:
    """The first prime of a hundred times the shards or more: then loads differ by about 1 percent."""
    n = 100 * shards
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def lookup_table(names: list[str], size: int) -> list[int]:
    """Of each slot: the index of the shard that claimed it."""
    if not 0 < len(set(names)) == len(names) <= size <= MAX_TABLE:
        raise ValueError("shard names must differ, and be no more than slots")
    place = [_number(f"{n}/offset") % size for n in names]
    step = [_number(f"{n}/skip") % (size - 1) + 1 if size > 1 else 1 for n in names]
    owner = [-1] * size
    for turn in range(size):
        k = turn % len(names)
        while owner[place[k]] >= 0:
            place[k] = (place[k] + step[k]) % size
        owner[place[k]] = k
    return owner


def slot_of(key: Column, size: int) -> Column:
    """A slot by the md5 of the key as text; null is the empty key."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: str, names: list[str], size: int | None = None) -> DataFrame:
    """df with slot (int) and shard (a name); columns of these names are replaced.

    Rows of equal key share a shard. Null keys go where the empty key goes. An
    empty table stays empty.
    """
    size = size or table_size(len(names))
    owners = lookup_table(names, size)
    text = ",".join(map(str, owners))
    shards = ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names)
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "k"))
    table = table.select("slot", F.expr(f"element_at(array({shards}), cast(k AS int) + 1)").alias("shard"))
    df = df.drop("slot", "shard")
    return df.withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(table), "slot").select(*df.columns, "slot", "shard")


def write_shards(df: DataFrame, key: str, names: list[str], path: str, files: int = 8) -> None:
    """df as one Parquet folder a shard; each shard is split over files tasks, so that a heavy one has no single writer."""
    placed = place(df, key, names)
    salt = F.pmod(F.xxhash64(*placed.columns), F.lit(files))
    placed.repartition(len(names) * files, "shard", salt).write.partitionBy("shard").parquet(path)
