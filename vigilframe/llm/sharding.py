"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, given by an offset and a step; shards take turns
claiming the next free slot of their permutation until the table is full. A document's slot is a hash of its key modulo
the table size, and the broadcast table answers its shard in constant time. The table has SLOTS rows whatever the input,
so its broadcast is bounded. Taking a shard away moves hardly any key between the shards that stay.

Defined results: rows with the same key, null included, go to the same slot and shard; an empty table gives an empty
result; other columns are never read by `place`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:04d}" for i in range(64))


def _number(name: str, what: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{what}:{name}".encode(), digest_size=8).digest(), "big")


def fill(shards=SHARDS, slots: int = SLOTS) -> np.ndarray:
    """The shard index of each slot."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    at = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    table, left = np.full(slots, -1, np.int32), slots
    while left:
        for i in range(len(at)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def place(df: DataFrame, key: str = "doc_id", shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """The key, slot and shard of each row."""
    p = "__shard_"
    lookup = pd.DataFrame({p + "at": np.arange(slots, dtype=np.int64), "shard": np.array(shards)[fill(shards, slots)]})
    lookup = df.sparkSession.createDataFrame(lookup)
    out = df.select(key, F.pmod(F.xxhash64(key), F.lit(slots)).alias("slot"))
    return out.join(F.broadcast(lookup), F.col("slot") == F.col(p + "at")).select(key, "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards=SHARDS, slots: int = SLOTS, files_per_shard: int = 1) -> None:
    """Write df as one folder shard=... for each shard, of about files_per_shard files. Rows with a null key all go to one
    shard. The folder's name is the shard; a column of df's own called shard, whatever its case, is written as
    shard_of_row, and so is every further column that would clash, with one more underscore each."""
    p, taken = "__shard_", {c.lower() for c in df.columns}
    own = df
    for c in df.columns:
        if c.lower() == "shard":
            new = "shard_of_row"
            while new in taken:
                new += "_"
            taken.add(new)
            own, key = own.withColumnRenamed(c, new), new if c == key else key
    lookup = pd.DataFrame({p + "at": np.arange(slots, dtype=np.int64), p + "name": np.array(shards)[fill(shards, slots)]})
    lookup = df.sparkSession.createDataFrame(lookup)
    out = own.withColumn(p + "slot", F.pmod(F.xxhash64(key), F.lit(slots))).join(F.broadcast(lookup), F.col(p + "slot") == F.col(p + "at"))
    salt = F.pmod(F.xxhash64(F.lit("file"), key), F.lit(files_per_shard))
    out = out.repartition(len(shards) * files_per_shard, p + "name", salt).drop(p + "slot", p + "at")
    out.withColumnRenamed(p + "name", "shard").write.partitionBy("shard").parquet(path)
