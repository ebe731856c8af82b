"""Readers of note folders, queues and registries; writers of indexes, change sets and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses of a change set.
CREATED, UPDATED, UNCHANGED, SKIPPED = "created", "updated", "unchanged", "skipped"


def read_notes(spark: SparkSession, root: str, roots: Sequence[str] | None = None) -> DataFrame:
    """(path, text) of every .md file below root, paths relative to it; roots keeps some of its folders only.

    Folders named .obsidian are left out. Run once over many small files and keep the result as a table.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    raw = F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")
    full = F.regexp_replace(F.url_decode(raw), r"\A\w+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/" if ":" in root else root.rstrip("/") + "/"
    notes = files.select(full.alias("full"), F.col("value").alias("text")).withColumn("path", F.substring_index("full", base, -1)).filter(~F.concat(F.lit("/"), F.col("path")).contains("/.obsidian/"))
    if roots is not None:
        keep = F.lit(False)
        for r in roots:
            keep = keep | F.col("path").startswith(r.rstrip("/") + "/")
        notes = notes.filter(keep)
    return notes.select("path", "text")


def read_candidates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per object of the document's candidates array, with its position."""
    docs = spark.read.json(path, multiLine=True, schema=f"candidates array<struct<{schema}>>")
    return docs.select(F.posexplode("candidates").alias("pos", "c")).select("pos", "c.*")


def read_registry(spark: SparkSession, path: str, array: str, schema: str) -> DataFrame:
    """One row per entry of a registry file's array: relation types, note types or key policies."""
    docs = spark.read.json(path, multiLine=True, schema=f"{array} array<struct<{schema}>>")
    return docs.select(F.explode(array).alias("e")).select("e.*")


def registry_issues(entries: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """(code, entry, field): missing required fields and ids stated twice."""
    missing = [F.when(F.col(f).isNull(), F.struct(F.lit("missing_field").alias("code"), F.col(key).cast("string").alias("entry"), F.lit(f).alias("field"))) for f in required]
    gaps = entries.select(F.explode(F.array_compact(F.array(*missing))).alias("i")).select("i.*")
    twice = entries.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1")
    return gaps.unionByName(twice.select(F.lit("duplicate_id").alias("code"), F.col(key).cast("string").alias("entry"), F.lit(key).alias("field")))


def write_index(tables: dict[str, DataFrame], folder: str) -> None:
    """Replaces every table; items are partitioned by type and language."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("type", "language") if name == "items" else writer).parquet(f"{folder}/{name}")


def replace_partitions(items: DataFrame, folder: str) -> None:
    """Replaces those partitions of a written index's items that have rows in items; all others stay as they are."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("type", "language").parquet(f"{folder}/items")


def change_set(before: DataFrame, after: DataFrame, dry_run: bool = True) -> DataFrame:
    """(path, old_text, new_text, status) for notes before and after a job; a note missing afterwards is skipped."""
    rows = before.select("path", F.col("text").alias("old_text")).join(after.select("path", F.col("text").alias("new_text")), "path", "full")
    prefix = "would_" if dry_run else ""
    verb = {CREATED: "would_create", UPDATED: "would_update"} if prefix else {CREATED: CREATED, UPDATED: UPDATED}
    status = F.when(F.col("new_text").isNull(), SKIPPED).when(F.col("old_text").isNull(), verb[CREATED]).when(F.col("old_text") == F.col("new_text"), UNCHANGED).otherwise(verb[UPDATED])
    return rows.withColumn("status", status)


def write_changes(changes: DataFrame, folder: str, dry_run: bool = True) -> None:
    """Writes the changed notes unless it is a dry run."""
    if not dry_run:
        changes.filter(F.col("status").isin(CREATED, UPDATED)).select("path", F.col("new_text").alias("text")).write.mode("overwrite").parquet(folder)


def run_summary(changes: DataFrame) -> DataFrame:
    """(status, n), and the number scanned."""
    by = changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(changes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("scanned").alias("status"), "n"))


def write_report(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)
