"""DuckDB SQL that states the operators a second time, from lines and windows instead of maps and folds."""

from __future__ import annotations

from notelake.operators import index
from notelake.plans.views import AS_OF, NOTES

#: Python's white space for RE2.
S = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{S}+', ' ', 'g')"


def norm_db(x: str) -> str:
    bare = f"regexp_replace({collapse(f'lower({strip(x)})')}, '[“”\"''`]', '', 'g')"
    return strip(f"regexp_replace({bare}, '[.!?。！？]+$', '')")


def norm_ext(x: str) -> str:
    return strip(f"regexp_replace({collapse(f'lower({strip(x)})')}, '[“”\"''`]', '', 'g')")


def stem(x: str) -> str:
    return f"regexp_replace(regexp_extract({x}, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1')"


def clean_body(x: str) -> str:
    a = f"regexp_replace({x}, '\\[\\[([^\\]|]+)\\|([^\\]]+)\\]\\]', '\\2', 'g')"
    b = f"regexp_replace({a}, '\\[\\[([^\\]]+)\\]\\]', '\\1', 'g')"
    return collapse(strip(f"regexp_replace({b}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"))


def cases(value: str, table: dict, other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


def quoted(x) -> str:
    return "[" + ", ".join(f"'{v}'" for v in x) + "]" if isinstance(x, list) else f"'{x}'"


def default(place: int, empty: str) -> str:
    return cases("type", {k: quoted(v[place]) for k, v in index.DEFAULTS.items()}, empty)


SCALARS = (
    "type", "language", "language_setting", "detected_language", "status", "anki_status", "anki_note_id", "source_type", "source", "source_file", "source_path", "audio_file",
    "audio_path", "seen_count", "first_seen", "last_seen", "created_at", "updated_at", "level", "difficulty", "confidence", "term", "sentence", "title", "normalized",
    "review_status", "review_priority", "review_count", "access_count", "last_accessed_at", "last_reviewed_at", "schema_version",
)

_folder = "CASE " + " ".join(f"WHEN lower('/' || path) LIKE '%{f}%' THEN '{k}'" for f, k in index.TYPE_FOLDERS) + " ELSE 'unknown' END"
_language = lambda c: f"CASE WHEN lower({strip('p_' + c)}) = '' THEN 'unknown' ELSE {cases(f'lower({strip(chr(112) + chr(95) + c)})', {k: quoted(v) for k, v in index.LANGUAGE_ALIASES.items()}, f'lower({strip(chr(112) + chr(95) + c)})')} END"
_own = cases("type", {k: strip(f"p_{v}") for k, v in index.TEXT_FIELDS.items()}, "''")

#: Common tables; a query's own SELECT follows.
PRELUDE = f"""
WITH notes AS ({NOTES}),
cut AS (
    SELECT path, text, starts_with(text, '---') AND len(string_split(text, '---')) >= 3 AS has_fm,
           CASE WHEN starts_with(text, '---') AND len(string_split(text, '---')) >= 3 THEN string_split(text, '---')[2] END AS raw_fm,
           CASE WHEN starts_with(text, '---') AND len(string_split(text, '---')) >= 3 THEN regexp_replace(array_to_string(string_split(text, '---')[3:], '---'), '^\\n+', '') ELSE text END AS body
    FROM notes
),
fm_raw AS (SELECT path, unnest(string_split(raw_fm, chr(10))) AS raw, generate_subscripts(string_split(raw_fm, chr(10)), 1) AS n FROM cut WHERE has_fm),
fm_lines AS (SELECT path, n, {strip('raw')} AS line FROM fm_raw WHERE {strip('raw')} <> ''),
fm_kind AS (
    SELECT *, starts_with(line, '- ') AS is_item, strpos(line, ':') AS colon,
           {strip("substr(line, 1, strpos(line, ':') - 1)")} AS key, {strip("substr(line, strpos(line, ':') + 1)")} AS val
    FROM fm_lines
),
fm_open AS (
    SELECT *, last_value(CASE WHEN is_item AND colon = 0 THEN NULL WHEN is_item THEN NULL WHEN colon > 0 AND val = '' THEN 'L' || key ELSE 'X' END IGNORE NULLS)
              OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state
    FROM fm_kind
),
fm_rows AS (
    SELECT path, n, CASE WHEN is_item AND starts_with(state, 'L') THEN substr(state, 2) ELSE key END AS key,
           CASE WHEN is_item AND starts_with(state, 'L') THEN {strip('substr(line, 3)')} ELSE val END AS val,
           is_item AND starts_with(coalesce(state, 'X'), 'L') AS item
    FROM fm_open WHERE colon > 0 OR (is_item AND starts_with(coalesce(state, 'X'), 'L'))
),
fm_head AS (SELECT path, key, max(n) AS head FROM fm_rows WHERE NOT item GROUP BY path, key),
fm AS (
    SELECT r.path, r.key, row_number() OVER (PARTITION BY r.path, r.key ORDER BY r.n) - 1 AS pos,
           CASE WHEN r.val IN ('', 'null', 'None') THEN '' WHEN length(r.val) > 1 AND (regexp_matches(r.val, '^".*"$') OR regexp_matches(r.val, '^''.*''$')) THEN substr(r.val, 2, length(r.val) - 2) ELSE r.val END AS value
    FROM fm_rows r JOIN fm_head h ON r.path = h.path AND r.key = h.key AND r.n >= h.head WHERE r.item OR r.val <> ''
),
props AS (
    SELECT c.path, c.has_fm, c.body, c.text AS note_text, {', '.join(f"coalesce(max(value) FILTER (key = '{k}' AND pos = 0), '') AS p_{k}" for k in SCALARS)},
           coalesce(list({strip('value')} ORDER BY pos) FILTER (key = 'topic' AND {strip('value')} <> ''), []) AS p_topic,
           coalesce(list({strip('value')} ORDER BY pos) FILTER (key = 'skill' AND {strip('value')} <> ''), []) AS p_skill
    FROM cut c LEFT JOIN fm ON fm.path = c.path GROUP BY c.path, c.has_fm, c.body, c.text
),
typed AS (
    SELECT *, {cases(f"lower({strip('p_type')})", {k: quoted(v) for k, v in index.TYPE_ALIASES.items()}, _folder)} AS type,
           coalesce(nullif({_language('language')}, 'unknown'), nullif({_language('language_setting')}, 'unknown'), nullif({_language('detected_language')}, 'unknown'),
                    CASE WHEN lower('/' || path) LIKE '%/german/%' THEN 'german' WHEN lower('/' || path) LIKE '%/english/%' THEN 'english' ELSE 'unknown' END) AS language
    FROM props
),
texted AS (
    SELECT *, coalesce(nullif({_own}, ''),
                       CASE WHEN type = 'transcript' THEN nullif(regexp_extract({strip('p_source_path')}, '[^/]*$'), '') WHEN type = 'tts_audio' THEN nullif(regexp_extract({strip('p_audio_path')}, '[^/]*$'), '') END,
                       CASE WHEN regexp_matches(body, '(?m)^[ \\t]*# ') THEN {strip("regexp_extract(body, '(?m)^[ \\t]*# ([^\\n]*)$', 1)")} END, {stem('path')}) AS text
    FROM typed
),
note_items AS (
    SELECT path, body, type, language, text, {norm_db('text')} AS normalized,
           coalesce(nullif(lower({strip('p_status')}), ''), {default(0, "'unknown'")}) AS status, coalesce(nullif(lower({strip('p_anki_status')}), ''), 'none') AS anki_status, p_anki_note_id AS anki_note_id,
           CASE WHEN len(p_topic) > 0 THEN p_topic ELSE {default(1, '[]')} END AS topic, CASE WHEN len(p_skill) > 0 THEN p_skill ELSE {default(2, '[]')} END AS skill,
           coalesce(nullif(lower({strip('p_source_type')}), ''), {default(3, "'manual'")}) AS source_type, coalesce(nullif(p_source, ''), p_source_file) AS source,
           coalesce(try_cast(p_seen_count AS INTEGER), 0) AS seen_count, p_first_seen AS first_seen, p_last_seen AS last_seen, p_created_at AS created_at, p_updated_at AS updated_at,
           coalesce(nullif(p_level, ''), 'unknown') AS level, coalesce(nullif(p_difficulty, ''), 'unknown') AS difficulty, coalesce(nullif(p_confidence, ''), 'unknown') AS confidence,
           '[[' || regexp_replace(path, '\\.md$', '') || '|' || text || ']]' AS obsidian_link,
           CASE WHEN regexp_extract(path, '[^/]*$') IN ({', '.join(f"'{n}'" for n in index.AGGREGATE_NOTES)}) THEN 'aggregate_note' WHEN NOT has_fm THEN 'missing_frontmatter'
                WHEN type = 'unknown' THEN 'unknown_type' WHEN {norm_db('text')} = '' THEN 'empty_text' END AS skip_reason
    FROM texted
),
counted AS (SELECT *, type || '|' || language || '|' || normalized AS item_key FROM note_items WHERE skip_reason IS NULL),
items AS (
    SELECT * EXCLUDE (k, first_created, created_at, updated_at), first_created AS created_at, coalesce(nullif(updated_at, ''), '{AS_OF}') AS updated_at, path AS obsidian_path
    FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY path DESC) AS k,
                 coalesce(nullif(first_value(created_at) OVER (PARTITION BY item_key ORDER BY path), ''), '{AS_OF}') AS first_created FROM counted)
    WHERE k = 1
)
"""
