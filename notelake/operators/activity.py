"""Access activity of items, its report views, and its way back into notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import strip
from notelake.operators.notes import fm_lines, with_front_matter

#: Fixed default of the data model.
STALE_DAYS = 14
VIEWS = ("never-accessed", "least-accessed", "oldest-accessed", "recently-accessed", "high-seen-low-access", "stale-learning")


def review_status(count: Column, last: Column, status: Column, stale_days: Column, as_of: Column) -> Column:
    """ignored, unreviewed, stale (whole elapsed days reach the limit) or active."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(last)) / 86400)
    return (
        F.when(F.lower(F.trim(status)).isin("ignored", "archived"), "ignored").when((count <= 0) | last.isNull(), "unreviewed")
        .when(days >= stale_days, "stale").otherwise("active")
    )


def build_activity(touches: DataFrame, items: DataFrame) -> DataFrame:
    """item_activity of touches(item_key, ts): counts, the last time, and the status right after the last touch."""
    counts = touches.groupBy("item_key").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_accessed_at"))
    known = items.select("item_key", "status")
    rows = counts.join(known, "item_key")
    stale = F.lit(STALE_DAYS)
    return rows.select(
        "item_key", "access_count", "last_accessed_at", review_status(F.col("access_count"), F.col("last_accessed_at"), F.col("status"), stale, F.col("last_accessed_at")).alias("review_status"),
        F.lit("normal").alias("review_priority"), stale.alias("stale_after_days"),
    )


def item_activity_view(items: DataFrame, activity: DataFrame) -> DataFrame:
    """Every item with its activity, or the defaults of one never touched."""
    rows = items.select("item_key", "type", "language", "text", "status", "seen_count", "obsidian_path").join(activity, "item_key", "left")
    fill = {"access_count": F.lit(0).cast("long"), "review_status": F.lit("unreviewed"), "review_priority": F.lit("normal"), "stale_after_days": F.lit(STALE_DAYS)}
    return rows.withColumns({c: F.coalesce(c, v) for c, v in fill.items()})


def activity_report(view: DataFrame, name: str, as_of: str, n: int = 20, language: str | None = None, kind: str | None = None) -> DataFrame:
    """The first n items of a report view; ties go by item_key."""
    rows = view
    if language:
        rows = rows.filter(F.col("language") == language)
    if kind:
        rows = rows.filter(F.col("type") == kind)
    count, last, seen = F.col("access_count"), F.col("last_accessed_at"), F.col("seen_count")
    cutoff = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {STALE_DAYS} DAYS")
    keep, order = {
        "never-accessed": (count == 0, [seen.desc(), F.asc("text")]),
        "least-accessed": (F.lit(True), [count.asc(), seen.desc(), F.asc("text")]),
        "oldest-accessed": (last.isNotNull(), [last.asc()]),
        "recently-accessed": (last.isNotNull(), [last.desc()]),
        "high-seen-low-access": ((seen >= 2) & (count <= 1), [seen.desc(), count.asc()]),
        "stale-learning": ((F.col("status") == "learning") & (last.isNull() | (last <= cutoff)), [last.asc_nulls_first(), seen.desc()]),
    }[name]
    return rows.filter(keep).orderBy(*order, "item_key").limit(n)


#: Properties of a note that activity keeps up to date, in the order in which missing ones are appended.
SYNCED = ("access_count", "last_accessed_at", "last_reviewed_at", "review_status", "review_priority", "stale_after_days")


def sync_activity(parsed: DataFrame, view: DataFrame, only_active: bool = True) -> DataFrame:
    """(path, n_changed, text) of notes whose front matter differs: synced properties replaced in place, missing ones appended.

    view may lack last_reviewed_at, which no touch sets; it is then empty.
    """
    rows = view.filter("access_count > 0") if only_active else view
    time = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    shown = {k: time(k) if k.endswith("_at") and k in view.columns else F.col(k).cast("string") if k in view.columns else F.lit("") for k in SYNCED}
    wanted = rows.select(F.col("obsidian_path").alias("path"), F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in shown.items()]).alias("wanted"))
    notes = parsed.filter("has_fm").join(wanted, "path").withColumn("lines", fm_lines())
    key = lambda line: F.regexp_extract(line, r"\A\s*([A-Za-z0-9_]+)\s*:", 1)
    said = lambda indent, w: F.concat(indent, w["key"], F.when(w["value"] == "", ":").otherwise(F.concat(F.lit(": "), w["value"])))
    mine = lambda line: F.filter("wanted", lambda w: w["key"] == key(line))[0]
    value = lambda line: strip(F.regexp_replace(line, r"\A\s*[A-Za-z0-9_]+\s*:", ""))
    replaced = F.transform("lines", lambda line: F.when(key(line).isin(*SYNCED), said(F.regexp_extract(line, r"\A(\s*)", 1), mine(line))).otherwise(line))
    present = F.transform("lines", key)
    missing = F.filter("wanted", lambda w: ~F.array_contains(present, w["key"]))
    other = F.filter("lines", lambda line: key(line).isin(*SYNCED) & (value(line) != mine(line)["value"]))
    changed = notes.withColumns({"n_changed": F.size(missing) + F.size(other), "new_lines": F.concat(replaced, F.transform(missing, lambda w: said(F.lit(""), w)))})
    return changed.filter("n_changed > 0").select("path", "n_changed", with_front_matter(F.array_join("new_lines", "\n")).alias("text"))
