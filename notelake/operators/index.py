"""The item index: classification of notes, keyed upsert, tag bridges, search documents and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import basename, clean_body, item_key, let, norm_db, note_link, safe_tag, stem, strip, without_md
from notelake.operators.notes import prop, prop_list

#: Fixed values of the data model.
TYPE_ALIASES = {
    "listening_transcript": "transcript", "transcript": "transcript", "tts_audio": "tts_audio", "vocabulary": "vocabulary",
    "sentence": "sentence", "grammar": "grammar", "writing_error": "writing_error",
}
TYPE_FOLDERS = (
    ("/vocabulary/", "vocabulary"), ("/sentences/", "sentence"), ("/grammar/", "grammar"), ("/listening/transcripts/", "transcript"),
    ("/speaking/tts/", "tts_audio"), ("/writing/", "writing_error"),
)
LANGUAGE_ALIASES = {
    "en": "english", "eng": "english", "english": "english", "de": "german", "deu": "german", "ger": "german", "german": "german",
    "mixed": "mixed", "unknown": "unknown", "auto": "unknown",
}
TEXT_FIELDS = {
    "vocabulary": "term", "sentence": "sentence", "grammar": "title", "transcript": "source_file", "tts_audio": "audio_file", "writing_error": "title",
}
DEFAULTS = {
    # type: (status, topics, skills, source type)
    "vocabulary": ("learning", ["vocabulary"], ["vocabulary"], "manual"),
    "sentence": ("learning", ["daily_life"], ["speaking", "listening"], "manual"),
    "grammar": ("learning", ["grammar"], ["grammar"], "manual"),
    "transcript": ("raw_transcript", ["listening"], ["listening"], "stt"),
    "tts_audio": ("generated", ["speaking"], ["speaking", "listening"], "tts"),
    "writing_error": ("learning", ["writing_errors"], ["writing"], "writing"),
}
AGGREGATE_NOTES = ("Vocabulary Inbox.md", "Sentence Bank.md", "Writing Error Log.md", "Writing Practice.md")


def looked_up(value: Column, table: dict[str, str]) -> Column:
    """table's entry for value, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def filled(value: Column, other: Column) -> Column:
    """value, or other where it is empty."""
    return let(value, lambda v: F.when(v == "", other).otherwise(v))


def item_type() -> Column:
    """The type's alias, else the type that the folder stands for."""

    def by_folder(path: Column) -> Column:
        out = F.lit("unknown")
        for folder, kind in reversed(TYPE_FOLDERS):
            out = F.when(path.contains(folder), kind).otherwise(out)
        return out

    return F.coalesce(looked_up(F.lower(strip(prop("type"))), TYPE_ALIASES), let(F.lower(F.concat(F.lit("/"), F.col("path"))), by_folder))


def item_language() -> Column:
    """The first of three properties that names a language, else the folder's."""
    path = F.lower(F.concat(F.lit("/"), F.col("path")))
    named = [let(F.lower(strip(prop(name))), lambda v: F.nullif(F.coalesce(looked_up(v, LANGUAGE_ALIASES), F.nullif(v, F.lit(""))), F.lit("unknown"))) for name in ("language", "language_setting", "detected_language")]
    return F.coalesce(*named, F.when(path.contains("/german/"), "german").when(path.contains("/english/"), "english"), F.lit("unknown"))


def item_text(kind: Column) -> Column:
    """The type's own field, else a file name, else the first level-1 heading, else the note's name."""
    field = looked_up(kind, TEXT_FIELDS)
    own = strip(F.coalesce(F.get(F.try_element_at(F.col("props"), field), 0), F.lit("")))
    file = F.when(kind == "transcript", basename(strip(prop("source_path")))).when(kind == "tts_audio", basename(strip(prop("audio_path"))))
    heading = F.when(F.col("body").rlike(r"(?m)^[ \t]*# "), strip(F.regexp_extract("body", r"(?m)^[ \t]*# (.*)$", 1)))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(file, F.lit("")), heading, stem(F.col("path")))


def with_default(kind: Column, place: int, empty: Column) -> Column:
    entries = [x for k, row in DEFAULTS.items() for x in (F.lit(k), F.lit(row[place]))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), kind), empty)


def note_items(parsed: DataFrame) -> DataFrame:
    """One row per note: its item's columns, and skip_reason (null for notes that count)."""
    base = parsed.select(
        "path", "has_fm", "body", item_type().alias("type"), item_language().alias("language"), F.lower(strip(prop("status"))).alias("__status"),
        F.lower(strip(prop("anki_status"))).alias("__anki"), prop("anki_note_id").alias("anki_note_id"), prop_list("topic").alias("__topic"), prop_list("skill").alias("__skill"),
        F.lower(strip(prop("source_type"))).alias("__source_type"), filled(prop("source"), prop("source_file")).alias("source"),
        F.coalesce(prop("seen_count").try_cast("int"), F.lit(0)).alias("seen_count"),
        *[prop(c).alias(c) for c in ("first_seen", "last_seen", "created_at", "updated_at")],
        *[filled(prop(c), F.lit("unknown")).alias(c) for c in ("level", "difficulty", "confidence")],
        "props",
    )
    kind = F.col("type")
    texts = base.withColumn("text", item_text(kind)).drop("props")
    none = F.array().cast("array<string>")
    normal = texts.withColumn("normalized", norm_db(F.col("text")))
    return normal.select(
        "path", "type", "language", "text", "normalized",
        F.when(F.col("__status") != "", F.col("__status")).otherwise(with_default(kind, 0, F.lit("unknown"))).alias("status"),
        F.when(F.col("__anki") != "", F.col("__anki")).otherwise("none").alias("anki_status"), "anki_note_id",
        F.when(F.size("__topic") > 0, F.col("__topic")).otherwise(with_default(kind, 1, none)).alias("topic"),
        F.when(F.size("__skill") > 0, F.col("__skill")).otherwise(with_default(kind, 2, none)).alias("skill"),
        F.when(F.col("__source_type") != "", F.col("__source_type")).otherwise(with_default(kind, 3, F.lit("manual"))).alias("source_type"),
        "source", "level", "seen_count", "first_seen", "last_seen", "difficulty", "confidence", "created_at", "updated_at",
        F.col("path").alias("obsidian_path"), note_link(F.col("path"), F.col("text")).alias("obsidian_link"), "body",
        F.when(basename(F.col("path")).isin(*AGGREGATE_NOTES), "aggregate_note").when(~F.col("has_fm"), "missing_frontmatter")
        .when(kind == "unknown", "unknown_type").when(F.col("normalized") == "", "empty_text").alias("skip_reason"),
    )


def counted_notes(parsed: DataFrame) -> DataFrame:
    """note_items of the notes that count. The row number keeps the filter above what it reads: below, the notes would be read into items twice, once to judge them."""
    return note_items(parsed).withColumn("__row", F.monotonically_increasing_id()).filter("skip_reason IS NULL AND __row >= 0").drop("skip_reason", "__row")


def classify_notes(parsed: DataFrame) -> DataFrame:
    """(path, skip_reason): null for notes that become items."""
    return note_items(parsed).select("path", "skip_reason")


def build_items(parsed: DataFrame, as_of: str) -> DataFrame:
    """Items by (type, language, normalized): the last note in path order wins, created_at is the first note's."""
    counted = counted_notes(parsed).drop("body")
    filled = counted.withColumns({c: F.when(F.col(c) == "", as_of).otherwise(F.col(c)) for c in ("created_at", "updated_at")})
    key = ["type", "language", "normalized"]
    rows = filled.groupBy(*key).agg(F.max_by(F.struct(*[c for c in filled.columns if c not in (*key, "path", "created_at")]), "path").alias("last"), F.min_by("created_at", "path").alias("created_at"), F.min("path").alias("first_path"))
    return rows.select(*key, "last.*", "created_at", "first_path").withColumn("item_key", item_key(F.col("type"), F.col("language"), F.col("normalized")))


def item_tags(items: DataFrame, column: str) -> DataFrame:
    """(item_key, name) bridge of topics or skills."""
    return items.select("item_key", F.explode(F.array_distinct(column)).alias("name"))


def with_tags(items: DataFrame) -> DataFrame:
    """(item_key, topics, skills), sorted, from the bridges."""
    listed = [item_tags(items, c).groupBy("item_key").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias(out)) for c, out in (("topic", "topics"), ("skill", "skills"))]
    rows = items.select("item_key")
    for df in listed:
        rows = rows.join(df, "item_key", "left")
    return rows.select("item_key", *[F.coalesce(c, F.lit("")).alias(c) for c in ("topics", "skills")])


def build_search_docs(parsed: DataFrame) -> DataFrame:
    """One search document per counted note."""
    return counted_notes(parsed).select("path", item_key(F.col("type"), F.col("language"), F.col("normalized")).alias("item_key"), F.col("type").alias("doc_type"), "language", "status", F.col("text").alias("title"), clean_body(F.col("body")).alias("body"), F.col("obsidian_link").alias("link"))


def index_summary(parsed: DataFrame) -> DataFrame:
    """(dim, value, n) over notes: totals by outcome, and counted notes by four columns."""
    rows = note_items(parsed).select("skip_reason", "type", "language", "status", "anki_status")
    outcome = rows.groupBy(F.when(F.col("skip_reason").isNull(), "indexed").otherwise("skipped").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("outcome").alias("dim"), "value", "n")
    dims = ("type", "language", "status", "anki_status")
    counted = rows.filter("skip_reason IS NULL").select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims])).alias("x"))
    return outcome.unionByName(counted.groupBy("x.dim", "x.value").agg(F.count(F.lit(1)).alias("n")))


#: Tag prefix, property and default; an empty property without default gives no tag.
TAG_FIELDS = (
    ("los", "type", ""), ("lang", "language", ""), ("status", "status", ""), ("anki", "anki_status", "none"), ("review", "review_status", "unreviewed"),
    ("priority", "review_priority", "normal"), ("level", "level", ""), ("source", "source_type", ""),
)


def metadata_tags(parsed: DataFrame) -> DataFrame:
    """(path, tags): sorted distinct tags of a note's properties, topics and skills."""

    def tag(prefix: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{prefix}/"), safe_tag(value)))

    def tagger(prefix: str):
        return lambda x: tag(prefix, x)

    single = [tag(p, F.when(prop(name) == "", default).otherwise(strip(prop(name)))) for p, name, default in TAG_FIELDS]
    lists = [F.transform(prop_list(name), tagger(name)) for name in ("topic", "skill")]
    tags = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*single), *lists))))
    return parsed.select("path", tags.alias("tags"))


def link_path(c: Column) -> Column:
    """A link target as a note's lower-case path without .md."""
    return F.lower(F.regexp_replace(without_md(F.regexp_replace(strip(c), r"\\", "/")), r"\A/+|/+\z", ""))
