"""Queries over front matter, normal forms and the item index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import index as I
from notelake.operators import notes as N
from notelake.plans import oracle as O
from notelake.plans.oracle import PRELUDE
from notelake.plans.views import AS_OF, NOTES, view
from notelake.sources.tables import kept, kept_once, written

ITEM_COLUMNS = [
    "type", "language", "text", "normalized", "status", "anki_status", "level", "source_type", "source", "seen_count", "difficulty", "confidence", "obsidian_path", "obsidian_link",
    "created_at", "updated_at",
]


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.parse_frontmatter(view(spark, sf_dir, NOTES))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed notes as a table: later plans, of other queries too, start from plain columns and parse no note twice."""
    return kept_once(spark, sf_dir, "parsed-notes", lambda: parsed(spark, sf_dir))


def notes_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed notes for a plan that reads them once: the table if it is kept already, else parsed on the way and not written."""
    found = kept(spark, sf_dir, "parsed-notes")
    return parsed(spark, sf_dir) if found is None else found


def items_of(notes: DataFrame) -> DataFrame:
    return written(I.build_items(notes, AS_OF), "items")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build_items(stored(spark, sf_dir), AS_OF)


def b1_split_frontmatter(spark, sf_dir):
    return N.split_frontmatter(view(spark, sf_dir, NOTES)).select("path", "has_fm", "raw_fm", "body")


def b3_frontmatter_long(spark, sf_dir):
    return N.frontmatter_long(parsed(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


def b4_sections(spark, sf_dir):
    return N.sections(parsed(spark, sf_dir)).filter("level > 0").select("path", "level", "heading", F.length("content").alias("n"), F.md5(F.col("content").cast("binary")).alias("digest"))


def b5_named_section(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", T.section(F.col("body"), "meaning").alias("content"))


def b6_wikilinks(spark, sf_dir):
    return N.wikilinks(parsed(spark, sf_dir), "body", dedupe=True).select("path", "target", "display")


def b7_clean_body(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", T.clean_body(F.col("body")).alias("body"))


def b10_item_type(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", I.item_type().alias("type"))


def b11_item_language(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", I.item_language().alias("language"))


def b12_defaults(spark, sf_dir):
    rows = I.note_items(parsed(spark, sf_dir))
    return rows.select("path", "status", "anki_status", "source_type", "source", "level", "difficulty", "confidence", F.array_join("topic", ",").alias("topics"), F.array_join("skill", ",").alias("skills"))


def b13_item_text(spark, sf_dir):
    return I.note_items(parsed(spark, sf_dir)).select("path", "text")


def b14_normalizers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    c = F.col("text")
    return docs.select("doc_id", T.norm_db(c).alias("norm_db"), T.norm_ext(c).alias("norm_ext"), T.norm_low(c).alias("norm_low"), T.norm_cell(c).alias("norm_cell"))


def b16_item_keys(spark, sf_dir):
    keyed = I.note_items(parsed(spark, sf_dir)).select("path", T.item_key(F.col("type"), F.col("language"), F.col("normalized")).alias("item_key"))
    return keyed.select("path", "item_key", T.parse_key(F.col("item_key")).alias("k")).select("path", "item_key", "k.*")


def b18_preview(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", T.preview(F.col("body")).alias("preview"))


def b19_metadata_tags(spark, sf_dir):
    return I.metadata_tags(parsed(spark, sf_dir)).select("path", F.array_join("tags", " ").alias("tags"))


def b24_note_link(spark, sf_dir):
    return I.note_items(parsed(spark, sf_dir)).select("path", "obsidian_link")


def b25_classify_notes(spark, sf_dir):
    return I.classify_notes(parsed(spark, sf_dir))


def c1_items(spark, sf_dir):
    return items(spark, sf_dir).select(*ITEM_COLUMNS)


def c2_item_topics(spark, sf_dir):
    return I.item_tags(items(spark, sf_dir), "topic")


def c2_item_skills(spark, sf_dir):
    return I.item_tags(items(spark, sf_dir), "skill")


def c3_search_docs(spark, sf_dir):
    return I.build_search_docs(stored(spark, sf_dir))


def c4_index_summary(spark, sf_dir):
    return I.index_summary(stored(spark, sf_dir))


def c5_with_tags(spark, sf_dir):
    return I.with_tags(items(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per type and language after key dedupe."""
    return items(spark, sf_dir).groupBy("type", "language").agg(F.count(F.lit(1)).alias("n_items"))


QUERIES = {
    f.__name__: f
    for f in (
        b1_split_frontmatter, b3_frontmatter_long, b4_sections, b5_named_section, b6_wikilinks, b7_clean_body, b10_item_type, b11_item_language, b12_defaults, b13_item_text, b14_normalizers,
        b16_item_keys, b18_preview, b19_metadata_tags, b24_note_link, b25_classify_notes, c1_items, c2_item_topics, c2_item_skills, c3_search_docs, c4_index_summary, c5_with_tags,
    )
} | {"items_by_type_and_language": flagship}

_tag = lambda x: f"""coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower({O.strip(x)}), '{O.S}+', '_', 'g'), '+', 'plus'), '[^a-z0-9_/-]', '', 'g'), '_+', '_', 'g'), '^[_/-]+|[_/-]+$', '', 'g'), ''), 'unknown')"""
_tags = ", ".join(f"CASE WHEN coalesce(nullif(p_{n}, ''), '{d}') <> '' THEN '{p}/' || {_tag(f'coalesce(nullif(p_{n}, {chr(39) * 2}), {chr(39)}{d}{chr(39)})')} END" for p, n, d in I.TAG_FIELDS)

ORACLE = {
    "b1_split_frontmatter": PRELUDE + "SELECT path, has_fm, raw_fm, body FROM cut",
    "b3_frontmatter_long": PRELUDE + "SELECT path, key, pos, value FROM fm",
    "b4_sections": PRELUDE
    + f"""SELECT path, length(marks) AS level, heading, length(content) AS n, md5(content) AS digest FROM (
        SELECT path, regexp_extract(piece, '^(#+)', 1) AS marks, {O.strip("regexp_replace(regexp_extract(piece, '^[^\\n]*'), '^#+', '')")} AS heading, {O.strip("regexp_replace(piece, '^[^\\n]*', '')")} AS content
        FROM (SELECT path, unnest(string_split(regexp_replace(chr(10) || body, '\\n(#{{1,6}}[ \\t\\n])', chr(10) || chr(1) || '\\1', 'g'), chr(10) || chr(1))) AS piece FROM cut)
        WHERE regexp_matches(piece, '^#{{1,6}}[ \\t\\n]'))""",
    "b5_named_section": PRELUDE
    + f"""SELECT path, coalesce({O.strip("regexp_extract(array_to_string(string_split(regexp_replace(chr(10) || body, '(?i)\\n##[ \\t]+meaning[ \\t]*\\n', chr(1)), chr(1))[2:], chr(1)), '(?s)^(.*?)(?:(?m)^##[ \\t]|\\z)', 1)")}, '') AS content FROM cut""",
    "b6_wikilinks": PRELUDE
    + f""", found AS (
        SELECT path, unnest(regexp_extract_all(body, '\\[\\[([^\\]|#]+)(?:#[^\\]|]+)?(?:\\|[^\\]]+)?\\]\\]', 0)) AS link, unnest(range(len(regexp_extract_all(body, '\\[\\[([^\\]|#]+)(?:#[^\\]|]+)?(?:\\|[^\\]]+)?\\]\\]', 0)))) AS pos FROM cut
    ), parts AS (
        SELECT path, pos, {O.strip("regexp_extract(link, '^\\[\\[([^\\]|#]+)', 1)")} AS target, {O.strip("regexp_extract(link, '\\|([^\\]]+)\\]\\]$', 1)")} AS shown FROM found
    )
    SELECT path, target, CASE WHEN shown = '' THEN {O.stem('target')} ELSE shown END AS display FROM parts WHERE target <> '' AND upper(target) <> 'TODO'
    QUALIFY row_number() OVER (PARTITION BY path, regexp_replace(lower(target), '\\.md$', '') ORDER BY pos) = 1""",
    "b7_clean_body": PRELUDE + f"SELECT path, {O.clean_body('body')} AS body FROM cut",
    "b10_item_type": PRELUDE + "SELECT path, type FROM typed",
    "b11_item_language": PRELUDE + "SELECT path, language FROM typed",
    "b12_defaults": PRELUDE + "SELECT path, status, anki_status, source_type, source, level, difficulty, confidence, array_to_string(topic, ',') AS topics, array_to_string(skill, ',') AS skills FROM note_items",
    "b13_item_text": PRELUDE + "SELECT path, text FROM note_items",
    "b14_normalizers": f"SELECT doc_id, {O.norm_db('text')} AS norm_db, {O.norm_ext('text')} AS norm_ext, lower({O.collapse(O.strip('text'))}) AS norm_low, {O.collapse(O.strip('text'))} AS norm_cell FROM documents",
    "b16_item_keys": PRELUDE + "SELECT path, type || '|' || language || '|' || normalized AS item_key, type AS item_type, language, normalized FROM note_items",
    "b18_preview": PRELUDE + f"SELECT path, CASE WHEN length(b) > 180 THEN substr(b, 1, 177) || '...' ELSE b END AS preview FROM (SELECT path, {O.collapse(O.strip('body'))} AS b FROM cut)",
    "b19_metadata_tags": PRELUDE
    + f"""SELECT path, array_to_string(list_sort(list_distinct(list_filter(list_concat([{_tags}], list_concat(list_transform(p_topic, lambda x: 'topic/' || {_tag('x')}), list_transform(p_skill, lambda x: 'skill/' || {_tag('x')}))), lambda x: x IS NOT NULL))), ' ') AS tags FROM props""",
    "b24_note_link": PRELUDE + "SELECT path, obsidian_link FROM note_items",
    "b25_classify_notes": PRELUDE + "SELECT path, skip_reason FROM note_items",
    "c1_items": PRELUDE + f"SELECT {', '.join(ITEM_COLUMNS)} FROM items",
    "c2_item_topics": PRELUDE + "SELECT DISTINCT item_key, name FROM (SELECT item_key, unnest(topic) AS name FROM items)",
    "c2_item_skills": PRELUDE + "SELECT DISTINCT item_key, name FROM (SELECT item_key, unnest(skill) AS name FROM items)",
    "c3_search_docs": PRELUDE + f"SELECT path, item_key, type AS doc_type, language, status, text AS title, {O.clean_body('body')} AS body, obsidian_link AS link FROM counted",
    "c4_index_summary": PRELUDE
    + """SELECT 'outcome' AS dim, CASE WHEN skip_reason IS NULL THEN 'indexed' ELSE 'skipped' END AS value, count(*) AS n FROM note_items GROUP BY 2
    UNION ALL SELECT 'type', type, count(*) FROM counted GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM counted GROUP BY 2
    UNION ALL SELECT 'status', status, count(*) FROM counted GROUP BY 2 UNION ALL SELECT 'anki_status', anki_status, count(*) FROM counted GROUP BY 2""",
    "c5_with_tags": PRELUDE + "SELECT item_key, array_to_string(list_sort(list_distinct(topic)), ',') AS topics, array_to_string(list_sort(list_distinct(skill)), ',') AS skills FROM items",
    "items_by_type_and_language": PRELUDE + "SELECT type, language, count(*) AS n_items FROM items GROUP BY type, language",
}
