"""Kept tables under streams: restarts, replays, and what a batch writes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from notelake.sources import versions
from notelake.streaming import incremental as K


def touches(spark, rows):
    return spark.createDataFrame(rows, "item_key string, t string").select("item_key", F.to_timestamp("t").alias("ts"))


def plain(df):
    return sorted(map(tuple, df.collect()))


def test_touches_survive_a_restart_without_new_files(spark, tmp_path):
    run = lambda: K.run_touch_stream(spark, f"{tmp_path}/in", f"{tmp_path}/counts", f"{tmp_path}/state")
    first = touches(spark, [("a", "2024-01-02"), ("a", "2024-01-01"), ("b", "2024-01-03")])
    first.write.parquet(f"{tmp_path}/in")
    once = plain(run())
    assert once == plain(K.touch_counts(first))
    assert plain(run()) == once
    touches(spark, [("a", "2023-12-31"), ("c", "2024-01-09")]).write.mode("append").parquet(f"{tmp_path}/in")
    assert plain(run()) == plain(K.touch_counts(spark.read.parquet(f"{tmp_path}/in")))


def test_a_batch_writes_what_it_touches_and_a_replay_nothing(spark, tmp_path):
    folder = f"{tmp_path}/kept"
    rows = lambda *keys, n=1: spark.createDataFrame([(k, n, None) for k in keys], "item_key string, access_count long, last_accessed_at timestamp")
    K.upsert(folder, 0, "item_key", rows(*[f"k{i}" for i in range(200)]), K.replace_rows)
    K.upsert(folder, 1, "item_key", rows("k5", "new", n=7), K.replace_rows)
    written_parts = lambda batch: {p.name for p in Path(f"{folder}/data/{batch}").glob("part=*")}
    assert len(written_parts(0)) > 20 and len(written_parts(1)) <= 2
    state = lambda: {r.item_key: r.access_count for r in K.read_kept(spark, folder, K.TOUCH_COUNTS).collect()}
    assert state() == {f"k{i}": 1 for i in range(200)} | {"k5": 7, "new": 7}
    K.upsert(folder, 1, "item_key", rows("k6", n=9), K.replace_rows)
    assert state()["k6"] == 1 and versions.current(spark, folder, K.VERSION).number == 1
    for n in (2, 3):
        K.upsert(folder, n, "item_key", rows(*[f"k{i}" for i in range(200)], n=n), K.replace_rows)
    assert state()["k5"] == 3 and written_parts(0) == set()


def test_notes_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    rows = [(f"n{i}.md", f"text {i}") for i in range(200)]
    spark.createDataFrame(rows, "path string, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    parts = []

    def to_items(notes):
        parts.append(notes.select(F.spark_partition_id()).distinct().count())
        return notes.select(F.col("path").alias("item_key"), "text", F.col("path").alias("obsidian_path"), F.lit("x").alias("created_at"), F.col("path").alias("first_path"))

    K.run_item_stream(spark, f"{tmp_path}/in", f"{tmp_path}/items", f"{tmp_path}/state", to_items).awaitTermination()
    assert len(parts) == 1 and parts[0] > 20
    kept = K.read_kept(spark, f"{tmp_path}/items", "item_key string")
    assert sorted((r.item_key, r.text) for r in kept.collect()) == sorted(rows)


def test_a_batch_lost_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/kept"
    rows = spark.createDataFrame([("a", 1, None)], "item_key string, access_count long, last_accessed_at timestamp")
    K.upsert(folder, 0, "item_key", rows, K.replace_rows)

    def lost(*args):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(versions, "commit", lost)
    more = rows.withColumn("access_count", F.lit(5).cast("long"))
    with pytest.raises(RuntimeError):
        K.upsert(folder, 1, "item_key", more, K.replace_rows)
    monkeypatch.undo()
    assert [r.access_count for r in K.read_kept(spark, folder, K.TOUCH_COUNTS).collect()] == [1]
    K.upsert(folder, 1, "item_key", more, K.replace_rows)
    assert [r.access_count for r in K.read_kept(spark, folder, K.TOUCH_COUNTS).collect()] == [5]
    assert K.read_kept(spark, f"{tmp_path}/none", K.TOUCH_COUNTS).count() == 0
