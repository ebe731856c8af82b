"""Streams of touches and notes that keep the activity and item tables up to date.

A kept table lies in hash partitions of its key. A batch writes those partitions that it changes, whole, into a folder of its own, and
then commits a version that says which batch has the current files of each partition (sources.versions). Readers see the last committed version;
a batch that is lost half-way, or runs again, changes nothing. Files that neither the current version nor the one before names are removed.
The folder belongs to one stream checkpoint, whose batch numbers it keeps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notelake.sources import versions
from notelake.sources.tables import written

#: Hash partitions of a kept table; a table keeps the number that it was begun with.
PARTS = 32
VERSION = "parts map<string,long>, n_parts int, columns string"

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _at(folder: str, batch: int, part: str) -> str:
    return f"{folder}/data/{batch}/part={part}"


def _read(spark: SparkSession, folder: str, version, parts: list[str] | None = None) -> DataFrame:
    paths = [_at(folder, b, p) for p, b in version.parts.items() if parts is None or p in parts]
    reader = spark.read.schema(version.columns)
    return reader.parquet(*paths) if paths else spark.createDataFrame([], version.columns)


def read_kept(spark: SparkSession, folder: str, columns: str) -> DataFrame:
    """The current version of a kept table; empty where no batch was committed."""
    now = versions.current(spark, folder, VERSION)
    return spark.createDataFrame([], columns) if now is None else _read(spark, folder, now)


def upsert(folder: str, number: int, key: str, batch: DataFrame, merge: Merge, n_parts: int = PARTS) -> None:
    """Merges batch into the kept table: merge(rows of the touched partitions, batch) are their new rows.

    A batch whose number is not above the committed one was merged before and is left alone.
    """
    spark = batch.sparkSession
    now = versions.current(spark, folder, VERSION)
    if now is not None and number <= now.number:
        return
    batch = written(batch, "stream-batch")  # read twice
    n = now.n_parts if now is not None else n_parts
    part = F.pmod(F.xxhash64(key), F.lit(n)).cast("string")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    touched = sorted(r.part for r in batch.select(part.alias("part")).distinct().collect())  # n rows at most
    before = _read(spark, folder, now, touched) if now is not None else batch.limit(0)
    # A partition may have a third of all rows' keys only if the hash is bad; its rows are dealt by key once more.
    merge(before, batch).withColumn("part", part).repartition("part", F.xxhash64(key) % 8).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/data/{number}")
    parts = {**(now.parts if now is not None else {}), **dict.fromkeys(touched, number)}
    versions.commit(spark, folder, VERSION, number, parts, n, columns)
    if now is not None:
        earlier = versions.versions(spark, folder, VERSION).filter(F.col("number") < now.number).orderBy(F.desc("number")).first()
        for p, b in (earlier.parts if earlier is not None else {}).items():
            if b not in (now.parts.get(p), parts.get(p)):
                versions.remove(spark, _at(folder, b, p))


TOUCH_COUNTS = "item_key string, access_count bigint, last_accessed_at timestamp"


def touch_counts(touches: DataFrame) -> DataFrame:
    """Per key the number of touches and the last one. A late touch still counts, so there is no watermark; the state is one row a key."""
    return touches.groupBy("item_key").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_accessed_at"))


def replace_rows(before: DataFrame, batch: DataFrame) -> DataFrame:
    return before.join(batch.select("item_key"), "item_key", "left_anti").unionByName(batch)


def run_touch_stream(spark: SparkSession, source: str, folder: str, checkpoint: str) -> DataFrame:
    """Counts all touches that lie in the source folder of Parquet files, and returns the counts as committed, also when no file was new."""
    touches = spark.readStream.schema("item_key string, ts timestamp").parquet(source)
    merge = lambda changed, number: upsert(folder, number, "item_key", changed, replace_rows)
    touch_counts(touches).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_kept(spark, folder, TOUCH_COUNTS)


def merge_items(current: DataFrame, batch: DataFrame) -> DataFrame:
    """current and batch item rows by item_key: the row of the last path wins, the created_at of the first path stays."""
    rows = current.unionByName(batch)
    kept = [c for c in rows.columns if c not in ("item_key", "created_at", "first_path")]
    merged = rows.groupBy("item_key").agg(F.max_by(F.struct(*kept), "obsidian_path").alias("last"), F.min_by("created_at", "first_path").alias("created_at"), F.min("first_path").alias("first_path"))
    return merged.select("item_key", "last.*", "created_at", "first_path").select(*rows.columns)


def run_item_stream(spark: SparkSession, source: str, folder: str, checkpoint: str, to_items) -> StreamingQuery:
    """Merges items of new note files (Parquet of path, text), a file a batch, into the kept table in folder, which read_kept reads.

    to_items turns a batch of notes into item rows. A file has few row groups; its notes are dealt out over all cores before they are parsed.
    """
    notes = spark.readStream.schema("path string, text string").option("maxFilesPerTrigger", 1).parquet(source)
    merge = lambda batch, number: upsert(folder, number, "item_key", to_items(batch.repartition(PARTS, "path")), merge_items)
    return notes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
