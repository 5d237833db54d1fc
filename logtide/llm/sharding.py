"""Sharding by jump consistent hashing (Lamping and Veach).

The shard follows from the key and the number of shards alone; appending a
shard moves rows only into the new one. DataFrame functions only.

Defined results
    * the key is an integral column, read as an unsigned 64-bit number (any
      other type is hashed to one by ``xxhash64``); null counts as key 0.
    * ``size``: UTF-8 bytes of the text plus 1 (null text: 1);
      ``text_crc32``: of the UTF-8 bytes (null text: of no bytes, 0).
    * ``slot``: 0, 1, 2, ... in the shard, by key, size and checksum; rows
      equal in all three are interchangeable.
    * empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gapless_rank

#: Fixed values of the published algorithm: multiplier of the 64-bit linear
#: congruential generator, and the numerator of its jump.
LCG = 2862933555777941757
JUMP = float(1 << 31)


def unsigned_key(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if not isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        c = F.when(c.isNotNull(), F.xxhash64(c))
    key = F.coalesce(c.cast("long"), F.lit(0).cast("long")).cast("decimal(20,0)")
    return F.when(key < 0, key + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(key).cast("decimal(20,0)")


def jump_hash(key: Column, shards: int) -> Column:
    """Shard in [0, shards) of an unsigned 64-bit ``key`` (decimal(20,0)).

    64-bit products wrap around, so they are formed in decimals: the largest
    is under 5.4e37 and fits 38 digits. A key jumps about ln(shards) times;
    the loop allows ``40 + 10 ln(shards)`` turns (at most ``shards``, which
    always suffices) and raises if a key should need more.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    turns = min(shards, 40 + 10 * math.ceil(math.log(shards + 1)))
    modulus = F.lit(str(1 << 64)).cast("decimal(38,0)")
    begin = F.struct(key.alias("key"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def turn(acc: Column, _: Column) -> Column:
        nxt = ((acc["key"].cast("decimal(20,0)") * F.lit(str(LCG)).cast("decimal(19,0)")
                + F.lit(1).cast("decimal(1,0)")).cast("decimal(38,0)") % modulus).cast("decimal(20,0)")
        high = F.call_function("div", nxt, F.lit(str(1 << 33)).cast("decimal(10,0)"))
        jump = ((acc["j"] + 1) * (F.lit(JUMP) / (high + 1).cast("double"))).cast("long")
        stepped = F.struct(nxt.alias("key"), acc["j"].alias("b"), jump.alias("j"))
        return F.when(acc["j"] < shards, stepped).otherwise(acc)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(turns)), begin, turn)
    return F.when(end["j"] >= shards, end["b"]).otherwise(
        F.raise_error(F.lit("jump hash did not end")).cast("long")).cast("int")


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row.

    One pass computes the small columns; the slots come from a range
    partitioning of those (see ``gapless_rank``), never from one task a shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body).cast("long") + 1).alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), unsigned_key(docs, key).alias("hashed"))
    rows = rows.select("key", "size", "text_crc32", jump_hash(F.col("hashed"), shards).alias("shard"),
                       jump_hash(F.col("hashed"), shards + 1).alias("grown_shard"))
    ranked = gapless_rank(rows, ["shard"], ["key", "size", "text_crc32"], "slot")
    return ranked.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                         "grown_shard")
