"""Deterministic note, table, touch and candidate views over the driver tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01 00:00:00"

NOTES = """
SELECT path,
       CASE WHEN doc_id % 11 = 10 THEN text
            ELSE '---' || chr(10) || 'type: ' || CASE kind WHEN 3 THEN 'listening_transcript' WHEN 2 THEN 'grammar' WHEN 1 THEN 'vocabulary' ELSE 'sentence' END
              || chr(10) || 'language: ' || lang || chr(10)
              || CASE kind WHEN 0 THEN 'sentence: "' || flat || '"' WHEN 1 THEN 'term: ' || word WHEN 2 THEN 'title: Rule ' || word ELSE 'source_file: rec_' || id || '.mp3' END
              || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'status: Learning' || chr(10) END
              || 'topic:' || chr(10) || '  - ' || source || chr(10) || '  - daily life' || chr(10)
              || 'seen_count: ' || CAST(doc_id % 7 AS STRING) || chr(10) || '---' || chr(10) || chr(10) || '# doc ' || id || chr(10) || chr(10)
              || CASE kind
                   WHEN 0 THEN '## Meaning' || chr(10) || chr(10) || CASE WHEN doc_id % 8 = 0 THEN 'TODO' ELSE text END || chr(10) || chr(10)
                     || '## Relations' || chr(10) || chr(10) || '### Contains Vocabulary' || chr(10) || chr(10) || 'relation_type: `contains_vocabulary`' || chr(10) || chr(10)
                     || '- [[Vocabulary/' || folder || '/doc_' || nxt || '|v]]' || chr(10) || chr(10)
                     || '### Similar To' || chr(10) || chr(10) || '- [[doc_' || CAST(doc_id + 4 AS STRING) || ']]' || chr(10) || '- [[doc_' || CAST(doc_id - 4 AS STRING) || '#x|y]]' || chr(10)
                   WHEN 1 THEN '## Meaning' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Related Grammar' || chr(10) || chr(10) || '- [[Grammar/' || folder || '/doc_' || nxt || '|g]]' || chr(10)
                   WHEN 2 THEN '## Explanation' || chr(10) || chr(10) || text || chr(10)
                   ELSE '## Raw Transcript' || chr(10) || chr(10) || '- `[00:00:00 - 00:00:05]` ' || text || chr(10) || chr(10) || '## Notes' || chr(10)
                 END
       END AS text
FROM (
  SELECT doc_id, text, lang, source, doc_id % 4 AS kind, CAST(doc_id AS STRING) AS id,
         CASE WHEN doc_id % 20 IN (0, 1) THEN 'missing' ELSE CAST(doc_id + 1 AS STRING) END AS nxt,
         replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '"', ' ') AS flat,
         regexp_extract(text, '[a-z]{5,}', 0) AS word,
         CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'Other' END AS folder,
         CASE doc_id % 4
           WHEN 3 THEN 'Listening/Transcripts/doc_' || CAST(doc_id AS STRING) || '.md'
           ELSE CASE doc_id % 4 WHEN 0 THEN 'Sentences/' WHEN 1 THEN 'Vocabulary/' ELSE 'Grammar/' END
                || CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'Other' END || '/doc_' || CAST(doc_id AS STRING) || '.md'
         END AS path
  FROM documents
) d
"""

TOUCHES = """
SELECT 'doc_' || CAST(user_id AS STRING) AS title, ts FROM events WHERE event_type IN ('view', 'click')
"""

CANDIDATES = """
SELECT item_id AS pos, CASE WHEN item_id % 2 = 0 THEN 'english' ELSE 'german' END AS language,
       CASE WHEN item_id % 9 = 8 THEN ' ' ELSE upper(substr(regexp_extract(text, '[a-z]{4,}', 0), 1, 4)) END AS word_or_phrase,
       text AS example_sentence, CASE WHEN item_id % 10 = 9 THEN 'approved' ELSE 'pending_review' END AS status
FROM benchmark
"""

TABLE_NOTES = """
SELECT 'Vocabulary/list_' || CAST(p_partkey AS STRING) || '.md' AS path,
       '## ' || CASE WHEN p_partkey % 2 = 0 THEN 'English' ELSE 'German' END || chr(10) || chr(10)
       || '| Word / Phrase | Meaning | Example Sentence | Source |' || chr(10) || '|---|:--|---|---|' || chr(10)
       || '| ' || p_name || ' | ' || p_type || ' |  | ' || p_brand || ' |' || chr(10) || '| ragged | row |' || chr(10) AS text
FROM part
"""

#: A vocabulary note for every part name that has one of two brands, as it may stand after earlier runs.
WORD_NOTES = """
SELECT 'Vocabulary/English/' || p_name || '.md' AS path,
       '---' || chr(10) || 'type: vocabulary' || chr(10) || 'seen_count: ' || CAST(count(*) AS STRING) || chr(10) || 'last_seen: 2024-01-01' || chr(10) || 'updated_at: 2024-01-01' || chr(10) || '---' || chr(10) || chr(10)
       || '# ' || p_name || chr(10) || chr(10) || '🔁 Seen: ' || CAST(count(*) AS STRING) || chr(10) || chr(10) || CASE WHEN length(p_name) % 3 = 0 THEN '' ELSE '## Contexts' || chr(10) || chr(10) || '- old' || chr(10) || '  - ' || min(p_type) || chr(10) || chr(10) END
       || CASE WHEN length(p_name) % 5 = 0 THEN '' ELSE '## Example Sentences' || chr(10) || chr(10) || '- ' || max(p_type) || ' of ' || min(p_brand) || chr(10) || chr(10) END || '## Related' || chr(10) || chr(10) || '- ' || chr(10) AS text
FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#13') GROUP BY p_name
"""

#: The tables that the views read.
SOURCES = {NOTES: "documents", TOUCHES: "events", CANDIDATES: "benchmark", TABLE_NOTES: "part", WORD_NOTES: "part"}


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view as a DataFrame; nothing is registered in the session."""
    name = SOURCES[sql]
    escaped = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(escaped, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})
