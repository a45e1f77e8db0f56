"""Permutation-filled lookup table: shards take turns claiming slots of a prime-sized table by preference order.

Each shard walks the slots by an offset and a skip of its own, both from hashes of its name; as the size is prime, the
walk visits every slot. In turn each shard claims the next free slot on its walk (a shard of weight w claims w slots a
turn), so the slots are dealt evenly, and adding or dropping a shard moves few others. The table's size is a parameter
and not the data's, so it is broadcast, and a row's shard is one look-up by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime; 65,537 slots keep the shares of 64 shards within a few per cent.
SLOTS = 65_537


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] | Mapping[str, int], slots: int = SLOTS) -> np.ndarray:
    """slot -> index of its shard, in the order of ``shards``."""
    names, weights = list(shards), [shards[s] for s in shards] if isinstance(shards, Mapping) else [1] * len(shards)
    if not names or len(set(names)) < len(names) or min(weights) < 1:
        raise ValueError("shards need distinct names and weights of 1 or more")
    if not is_prime(slots) or slots < len(names):
        raise ValueError("the table needs a prime size, no smaller than the number of shards")
    place = [_hash(n, "offset") % slots for n in names]
    skip = [_hash(n, "skip") % (slots - 1) + 1 for n in names]
    table, left = [-1] * slots, slots
    while True:
        for i, weight in enumerate(weights):
            for _ in range(weight):
                at = place[i]
                while table[at] >= 0:
                    at = (at + skip[i]) % slots
                table[at] = i
                place[i] = (at + skip[i]) % slots
                left -= 1
                if not left:
                    return np.array(table, np.int32)


def place_rows(df: DataFrame, key: str, shards: Sequence[str] | Mapping[str, int], slots: int = SLOTS) -> DataFrame:
    """``df`` with slot (long) and shard (string).

    The slot is the first 15 hex digits of the key's md5 modulo the table's size; keys are hashed as text, a null key
    as a text of its own (a zero byte). Equal keys go together; each row keeps its other columns, and columns named slot or shard
    are replaced. Rows need no shuffle: the table (slots rows, whatever the data) is broadcast.
    """
    spark = df.sparkSession
    names = list(shards)
    table = spark.createDataFrame([(i, names[s]) for i, s in enumerate(lookup_table(shards, slots).tolist())], "slot bigint, shard string")
    text = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    slot = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % slots
    kept = df.drop(*[c for c in ("slot", "shard") if c != key])
    return kept.withColumn("slot", slot).join(F.broadcast(table), "slot")
