"""Rendezvous sharding: every record goes to the shard with the best weighted score.

A shard's score for a key is -ln(u) / weight, u being a hash of (key, shard) in (0, 1); the lowest score
wins. Scores of different shards are independent, so one more shard takes its share of rows into itself
and moves no other row, and shards fill in proportion to their weights. The md5 hash is stable over
engines and releases.

A null key is hashed as its own value. Rows with equal keys land in one shard and take neighbouring slots
in an order that depends on their contents alone. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.llm.shared import table

#: Slots are dealt in so many parts of a shard, so that no task numbers a whole shard. The table of part
#: sizes has shards * SLOT_PARTS rows at most, whatever the input, which makes it safe to broadcast.
SLOT_PARTS = 512
HASH_BITS = 52


def unit_hash(text: Column) -> Column:
    """A number in (0, 1) from 52 bits of md5."""
    bits = F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**HASH_BITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that wins the key; on equal scores the lower number."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [
        F.struct((-F.log(unit_hash(F.concat(text, F.lit(f":{i}")))) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return F.least(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def assign_shards(rows: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """rows and the shard of each; no shuffle."""
    return rows.withColumn(out, rendezvous(F.col(key), weights))


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """A number from 0 without gaps for each row of a shard.

    Rows are dealt to parts by a hash of the order columns and numbered inside a part; a part's first
    number is the size of the parts before it.
    """
    part = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(SLOT_PARTS))
    dealt = rows.withColumn("__part", part)
    sizes = dealt.groupBy(F.col(shard).alias("__shard"), F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("__shard", "__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(shard, "__part").orderBy(*order)
    return (
        dealt.withColumn("__k", F.row_number().over(inside) - 1)
        .join(F.broadcast(first), (F.col(shard) == F.col("__shard")) & (F.col("__part") == F.col("__of")))
        .withColumn(out, F.col("__first") + F.col("__k"))
        .drop("__part", "__k", "__shard", "__of", "__first")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    sharded = docs.withColumn("shard", rendezvous(F.col("doc_id"), [1.0] * 16)).withColumn("grown_shard", rendezvous(F.col("doc_id"), [1.0] * 17))
    return with_slots(sharded, "shard", ["doc_id", "text_crc32", "size"])

