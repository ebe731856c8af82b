"""Queries of relation sections in notes, and of queues, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions.text import norm_db, source_type
from notelake.operators import enrich as E
from notelake.operators import notes as N
from notelake.operators import quality as H
from notelake.operators import queues as U
from notelake.operators import relation_notes as R
from notelake.plans import oracle as O
from notelake.plans.index_queries import stored
from notelake.plans.oracle import PRELUDE
from notelake.plans.product_queries import SPOKEN, _fold, _folders, _name, _required
from notelake.plans.views import AS_OF, CANDIDATES, NOTES, view
from notelake.sources.tables import written

#: The notes view, some notes without a meaning and some with a Relations section that nobody has filled in.
ODD_SECTIONS = f"""SELECT path, CASE WHEN path LIKE '%1.md' OR path LIKE '%8.md' THEN replace(text, '## Meaning', '## Gloss')
    WHEN path LIKE '%4.md' THEN replace(text, '## Relations', '## Relations' || chr(10) || chr(10) || '### Similar To' || chr(10) || chr(10) || '- TODO' || chr(10) || chr(10) || '## Old Relations') ELSE text END AS text FROM ({NOTES}) n"""
#: The notes view with keys of their own: stated, in three fields, or in part.
ODD_KEYS = f"""SELECT path, CASE WHEN path LIKE '%1.md' THEN replace(text, 'topic:', 'id: one' || chr(10) || 'key: v | english |a|b ' || chr(10) || 'topic:')
    WHEN path LIKE '%2.md' THEN replace(text, 'topic:', 'normalized_text: ' || path || chr(10) || 'topic:') WHEN path LIKE '%3.md' THEN replace(text, 'topic:', 'item_key: a|b|c' || chr(10) || 'topic:') ELSE text END AS text FROM ({NOTES}) n"""
#: The notes view with stated normal forms and languages; some notes lose their type.
ODD_NOTES = f"""SELECT path, CASE WHEN path LIKE '%2.md' THEN replace(text, 'topic:', 'normalized: Two  WORDS! ' || chr(10) || 'schema_version: note_v1' || chr(10) || 'language: english' || chr(10) || 'topic:')
    WHEN path LIKE '%5.md' THEN replace(text, 'topic:', 'normalized: haus' || chr(10) || 'language: German' || chr(10) || 'topic:') WHEN path LIKE '%0.md' THEN replace(text, 'topic:', 'normalized: haus!' || chr(10) || 'language: german' || chr(10) || 'topic:')
    WHEN path LIKE '%7.md' THEN replace(text, 'type:', 'kind:') WHEN path LIKE '%4.md' THEN replace(text, 'topic:', 'language: ' || chr(10) || 'topic:') ELSE text END AS text FROM ({NOTES}) n"""
ERRORS = """SELECT item_id AS pos, CASE WHEN item_id % 7 = 6 THEN ' ' WHEN item_id % 3 = 1 THEN text ELSE regexp_extract(text, '[a-z]{5,}', 0) END AS wrong, CASE WHEN item_id % 2 = 0 THEN 'An' ELSE ' an ' END AS correct,
       CASE WHEN item_id % 10 = 9 THEN 'approved' ELSE 'pending_review' END AS status FROM benchmark"""


def over(spark, sf_dir, sql, name="documents"):
    escaped = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(escaped, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})


def h1_validate_odd_notes(spark, sf_dir):
    """Typed notes alone, by a registry that has no folder for German vocabulary."""
    types = H.note_types(spark).withColumn("folders", F.map_filter("folders", lambda k, _: (F.col("name") != "vocabulary") | (k != "german")))
    return H.validate_notes(written(N.parse_frontmatter(over(spark, sf_dir, ODD_NOTES)), "odd-notes"), types, untyped=False)


def h7_relations_template(spark, sf_dir):
    return R.relations_template(written(N.parse_frontmatter(over(spark, sf_dir, ODD_SECTIONS)), "odd-sections"))


def h8_backfill_relations(spark, sf_dir):
    return R.backfill_relations(stored(spark, sf_dir))


def b17_extract_key(spark, sf_dir):
    return H.extract_key(written(N.parse_frontmatter(over(spark, sf_dir, ODD_KEYS)), "odd-keys"))


def b22_source_type(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", source_type(F.col("text")).alias("source_type"))


def i2_approve_errors(spark, sf_dir):
    """Words and whole passages, against every word of every text as the known errors."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", " ", -1)).alias("wrong"), F.lit("AN ").alias("correct"))
    return U.approve_errors(over(spark, sf_dir, ERRORS, "benchmark"), known).select("pos", "wrong", "correct", "new_status")


def i4_dedupe_cards(spark, sf_dir):
    """Every candidate is looked up among the cards that the documents make: one deck a language, the first word in front."""
    word = lambda c: F.regexp_extract(c, "[a-z]{4,}", 0)
    cards = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.when(F.col("lang") == "de", "german").otherwise("english").alias("deck"), word("text").alias("front"), F.col("doc_id").alias("note_id"))
    asked = view(spark, sf_dir, CANDIDATES).select("pos", F.col("language").alias("deck"), word("example_sentence").alias("front"))
    return U.dedupe_cards(asked, cards).select("pos", "is_duplicate", "n_held", "note_id")


def i6_sync_card_status(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit(" "), "text").alias("sentence"), F.when(F.col("doc_id") % 3 == 0, " no ").when(F.col("doc_id") % 3 == 1, "Yes").otherwise("").alias("status"))
    sent = rows.select(F.col("doc_id").alias("pos"), "sentence", F.element_at(F.array(*[F.lit(s) for s in ("approved", "duplicate", "error", "pending_review")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("status"))
    return U.sync_card_status(rows, sent).select("doc_id", "new_status")


def second_run(spark, sf_dir):
    """The notes, with sentence notes that an earlier extraction made: every other one, each with its first context."""
    notes = stored(spark, sf_dir)
    first = written(E.contexts(notes), "contexts").filter(F.length("name") % 2 == 0).groupBy("language", "name").agg(F.min("line").alias("line"))
    text = F.concat(F.lit("---\ntype: sentence\nfirst_seen: 2024-01-01\nlanguage: "), "language", F.lit("\n---\n\n## Contexts\n\n"), "line", F.lit("\n\n## Related\n\n- \n"))
    made = N.parse_frontmatter(first.select(F.concat(F.lit("Sentences/"), F.initcap("language"), F.lit("/"), "name").alias("path"), text.alias("text")))
    return written(notes.unionByName(made), "second-run")


def g2_second_run(spark, sf_dir):
    return E.extract_sentences(second_run(spark, sf_dir), AS_OF).select("language", "name", "seen_count", "first_seen", "last_seen", "action")


def g3_extract_totals(spark, sf_dir):
    return E.extract_totals(written(E.contexts(second_run(spark, sf_dir)), "contexts"))


def g4_annotated_sentences(spark, sf_dir):
    """Against the sentences that an extraction made, of several statuses."""
    notes = stored(spark, sf_dir)
    made = E.extract_sentences(notes, AS_OF).groupBy("language", norm_db(F.col("sentence")).alias("normalized")).agg(F.min("name").alias("name")).filter(F.length("name") % 2 == 0)
    statuses = F.array(*[F.lit(s) for s in ("new", "Learning", "learned", "generated", "raw_transcript", "other")])
    items = made.select(F.lit("sentence").alias("type"), "language", "normalized", F.get(statuses, F.length("name") % 6).alias("status"), F.when(F.length("name") % 8 == 0, "added").otherwise("none").alias("anki_status"), F.concat(F.lit("Sentences/"), "name").alias("obsidian_path"))
    return E.annotated_sentences(notes, items).drop("ord")


QUERIES = {f.__name__: f for f in (h1_validate_odd_notes, h7_relations_template, h8_backfill_relations, b17_extract_key, b22_source_type, i2_approve_errors, i4_dedupe_cards, i6_sync_card_status, g2_second_run, g3_extract_totals, g4_annotated_sentences)}

_labels = {
    "vocabulary": "Uses Grammar, Example Of, Similar To, Opposite Of, Contrast With, Confusable With, Translation Of, Translation Variant Of, Formal Variant Of, Informal Variant Of, Slang Variant Of, Register Variant Of",
    "sentence": "Contains Vocabulary, Uses Grammar, Derived From, Similar To, Opposite Of, Contrast With, Confusable With, Negative Counterpart, Translation Of, Translation Variant Of",
    "grammar": "Similar To, Contrast With, Confusable With, Grammar Contrast With",
}
_scaffolds = f"""scaffolds AS (
    SELECT kind, '## Relations' || e'\\n\\nAdd Obsidian links under the relevant relation type.\\nUse the `relation_type` line as the machine-readable id.\\n\\n'
           || array_to_string(list_transform(string_split(labels, ', '), lambda x: '### ' || x || e'\\n\\nrelation_type: `' || replace(lower(x), ' ', '_') || e'`\\n\\n- TODO'), e'\\n\\n') AS scaffold
    FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _labels.items())}) v(kind, labels)
), shaped AS (
    SELECT c.path, c.text, s.kind, s.scaffold, regexp_replace(c.raw_fm, '^\\n+|\\n+$', '', 'g') AS fm_text, regexp_replace(c.body, '{O.S}+$', '') AS r FROM cut c JOIN props p USING (path) LEFT JOIN scaffolds s ON c.has_fm AND s.kind = lower({O.strip('p.p_type')})
)"""
_senses = """CASE kind WHEN 'vocabulary' THEN e'\\n\\n## Meanings / Senses\\n\\n### Sense 1 — main usage\\n\\nMain meaning:\\n- TODO\\n\\nUsage:\\n- TODO\\n\\nExamples:\\n- TODO'
    WHEN 'sentence' THEN e'\\n\\n## Meaning Variants\\n\\n### Variant 1 — main interpretation\\n\\nMain meaning:\\n- TODO\\n\\nAlternative translations:\\n- TODO\\n\\nUsage note:\\n- TODO' ELSE '' END"""
_own = lambda *names: "coalesce(" + ", ".join(f"nullif(max({O.strip('value')}) FILTER (key = '{n}' AND pos = 0), '')" for n in names) + ")"
_pair = lambda a, b: f"lower({O.collapse(O.strip(a))}) || ' -> ' || lower({O.collapse(O.strip(b))})"
ORACLE = {
    "h7_relations_template": PRELUDE.replace(f"WITH notes AS ({NOTES})", f"WITH notes AS ({ODD_SECTIONS})")
    + f""", {_scaffolds}, sensed AS (SELECT *, CASE WHEN kind <> 'grammar' AND NOT regexp_matches(r, '(?im)^##\\s+(meaning|meanings / senses|meaning variants)\\s*$') THEN r || {_senses} ELSE r END AS b FROM shaped)
    SELECT path, CASE WHEN kind IS NULL THEN text ELSE e'---\\n' || fm_text || e'\\nrelations_template_version: 1.1\\n---\\n\\n' || CASE WHEN NOT regexp_matches(b, '(?im)^##\\s+relations\\s*$') THEN b || e'\\n\\n' || scaffold
        ELSE replace(b, e'## Relations\\n\\n### Similar To\\n\\n- TODO', scaffold) END || e'\\n' END AS text FROM sensed""",
    "h1_validate_odd_notes": PRELUDE.replace(f"WITH notes AS ({NOTES})", f"WITH notes AS ({ODD_NOTES})")
    + f""", required(kind, field) AS (VALUES {_required}), every_folder(kind, lang, folder) AS (VALUES {_folders}), folders AS (SELECT * FROM every_folder WHERE NOT (kind = 'vocabulary' AND lang = 'german')),
    checked AS (SELECT path, lower({O.strip('p_type')}) AS kind, lower({O.strip('p_language')}) AS lang, {O.strip('p_normalized')} AS norm FROM props),
    known AS (
        SELECT *, CASE WHEN kind = 'sentence' THEN {O.strip("regexp_replace(folded, '[.!?。！？]+$', '')")} ELSE folded END AS want
        FROM (SELECT *, {_fold(O.collapse(O.strip('norm')))} AS folded FROM checked WHERE kind IN (SELECT kind FROM required))
    )
    SELECT path, 'error' AS severity, 'unknown_note_type' AS code, 'type' AS field FROM checked WHERE kind <> '' AND kind NOT IN (SELECT kind FROM required)
    UNION ALL SELECT path, 'error', 'missing_required_frontmatter', r.field FROM known k JOIN required r USING (kind) WHERE NOT EXISTS (SELECT 1 FROM fm WHERE fm.path = k.path AND fm.key = r.field AND {O.strip('fm.value')} <> '')
    UNION ALL SELECT path, 'error', 'missing_language', 'language' FROM known k WHERE lang = '' AND EXISTS (SELECT 1 FROM required r WHERE r.kind = k.kind AND r.field = 'language')
    UNION ALL SELECT path, 'error', 'unsupported_language', 'language' FROM known WHERE lang NOT IN ('', 'english', 'german')
    UNION ALL SELECT path, 'warning', 'missing_default_folder_for_language', 'language' FROM known k WHERE lang IN ('english', 'german') AND NOT EXISTS (SELECT 1 FROM folders f WHERE f.kind = k.kind AND f.lang = k.lang)
    UNION ALL SELECT path, 'error', 'normalized_key_mismatch', 'normalized' FROM known WHERE lang <> '' AND norm <> '' AND norm <> want
    UNION ALL SELECT path, 'warning', 'folder_mismatch', 'path' FROM known k JOIN folders f ON f.kind = k.kind AND f.lang = k.lang WHERE NOT starts_with(k.path, f.folder || '/')""",
    "h8_backfill_relations": PRELUDE
    + f""", {_scaffolds}, old_links AS (SELECT *, regexp_extract(r, '(?m)^## Related Grammar\\n\\n- (\\[\\[[^\\n]*\\]\\])$', 1) AS link FROM shaped)
    SELECT path, CASE WHEN kind = 'vocabulary' AND link <> '' THEN e'---\\n' || fm_text || e'\\nrelation_backfill_version: 1.0\\n---\\n\\n' || r || e'\\n\\n' || replace(scaffold, e'`uses_grammar`\\n\\n- TODO', e'`uses_grammar`\\n\\n- ' || link) || e'\\n' ELSE text END AS text FROM old_links""",
    "b17_extract_key": PRELUDE.replace(f"WITH notes AS ({NOTES})", f"WITH notes AS ({ODD_KEYS})")
    + f""", stated AS (SELECT path, {_own('item_key', 'key', 'id')} AS k, {_own('type', 'item_type', 'note_type')} AS t, {_own('language', 'lang')} AS l, {_own('normalized', 'normalized_text', 'canonical')} AS n FROM fm GROUP BY path),
    chosen AS (SELECT *, regexp_matches(k, '^[^|]*\\|[^|]*\\|') AS whole FROM stated)
    SELECT path, CASE WHEN whole THEN {O.strip("string_split(k, '|')[1]")} ELSE t END AS item_type, CASE WHEN whole THEN {O.strip("string_split(k, '|')[2]")} ELSE l END AS language,
           CASE WHEN whole THEN {O.strip("regexp_replace(k, '^[^|]*\\|[^|]*\\|', '')")} ELSE n END AS normalized FROM chosen WHERE whole OR (t IS NOT NULL AND l IS NOT NULL AND n IS NOT NULL)""",
    "b22_source_type": """SELECT doc_id, CASE WHEN text ILIKE '%stt%' OR text ILIKE '%transcript%' THEN 'stt' WHEN text ILIKE '%tts%' THEN 'tts' WHEN text ILIKE '%writing%' THEN 'writing' WHEN text ILIKE '%dictionary%' THEN 'dictionary'
    WHEN text ILIKE '%reading%' THEN 'reading' ELSE 'manual' END AS source_type FROM documents""",
    "i2_approve_errors": f"""WITH cand AS ({ERRORS}), known AS (SELECT DISTINCT {_pair("w", "'AN '")} AS key FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents)),
    keyed AS (SELECT *, {_pair('wrong', 'correct')} AS key, status = 'pending_review' AND {O.strip('wrong')} <> '' AND {O.strip('correct')} <> '' AS ready FROM cand)
    SELECT pos, wrong, correct, CASE WHEN status <> 'pending_review' THEN status WHEN NOT ready THEN 'error' WHEN key IN (SELECT key FROM known) OR row_number() OVER (PARTITION BY key, ready ORDER BY pos) > 1 THEN 'duplicate' ELSE 'approved' END AS new_status FROM keyed""",
    "i4_dedupe_cards": f"""WITH asked AS (SELECT pos, language AS deck, regexp_extract(example_sentence, '[a-z]{{4,}}') AS front FROM ({CANDIDATES}))
    SELECT pos, d.doc_id IS NOT NULL AS is_duplicate, count(d.doc_id) OVER (PARTITION BY pos) AS n_held, d.doc_id AS note_id
    FROM asked a LEFT JOIN documents d ON CASE WHEN d.lang = 'de' THEN 'german' ELSE 'english' END = a.deck AND regexp_extract(d.text, '[a-z]{{4,}}') = a.front""",
    "i6_sync_card_status": f"""WITH keyed AS (SELECT doc_id, {O.collapse(O.strip('text'))} AS k FROM documents), last_of AS (SELECT k, max(doc_id) % 4 AS s FROM keyed GROUP BY k)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' no ' WHEN s IN (0, 1) THEN 'Added' WHEN s = 2 THEN 'Error' WHEN doc_id % 3 = 1 THEN 'Yes' ELSE '' END AS new_status FROM keyed JOIN last_of USING (k)""",
}

_again = SPOKEN + f""", found AS (
    SELECT s.path, p.language, s.sentence, {_name('s.sentence')} AS name, '- [[' || regexp_replace(s.path, '\\.md$', '') || '|' || coalesce(nullif(r.p_source_file, ''), {O.stem('s.path')}) || ']] — ' || s.sentence AS line
    FROM said s JOIN spoken p USING (path) JOIN props r USING (path) WHERE p.language IN ('english', 'german')
), held AS (SELECT language, name, min(line) AS line FROM found WHERE length(name) % 2 = 0 GROUP BY language, name),
occurred AS (SELECT f.*, h.line IS NOT NULL AS old, CASE WHEN h.line IS NULL THEN 'created' WHEN h.line = f.line THEN 'unchanged' ELSE 'updated' END AS action FROM found f LEFT JOIN held h USING (language, name))
"""
ORACLE |= {
    "g2_second_run": _again
    + f"""SELECT language, name, count(DISTINCT line) AS seen_count, CASE WHEN bool_or(old) THEN '2024-01-01' ELSE '{AS_OF[:10]}' END AS first_seen, CASE WHEN bool_and(action = 'unchanged') THEN '' ELSE '{AS_OF[:10]}' END AS last_seen,
    CASE WHEN NOT bool_or(old) THEN 'created' WHEN bool_and(action = 'unchanged') THEN 'unchanged' ELSE 'updated' END AS action FROM occurred GROUP BY language, name""",
    "g3_extract_totals": _again
    + """SELECT path, count(*) AS n_sentences, count(*) FILTER (action = 'created') AS n_created, count(*) FILTER (action = 'updated') AS n_updated, count(*) FILTER (action = 'unchanged') AS n_unchanged FROM occurred GROUP BY GROUPING SETS ((path), ())""",
    "g4_annotated_sentences": _again
    + f""", firsts AS (SELECT language, name, arg_min(sentence, path || lpad(CAST(ord AS VARCHAR), 9, '0')) AS sentence FROM (SELECT s.*, p.language, {_name('s.sentence')} AS name FROM said s JOIN spoken p USING (path)) WHERE language IN ('english', 'german') GROUP BY language, name),
    known AS (SELECT language, {O.norm_db('sentence')} AS normalized, min(name) AS name FROM firsts GROUP BY 1, 2 HAVING length(min(name)) % 2 = 0)
    SELECT h.path, h.sentence, k.name IS NOT NULL AS found, ['new', 'Learning', 'learned', 'generated', 'raw_transcript', 'other'][length(k.name) % 6 + 1] AS status, CASE WHEN k.name IS NOT NULL THEN length(k.name) % 8 = 0 END AS has_card,
           CASE WHEN k.name IS NULL THEN '<span class="los-new">● ' || replace(replace(replace(h.sentence, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</span>'
                ELSE CASE length(k.name) % 6 WHEN 0 THEN '🔴' WHEN 1 THEN '🟡' WHEN 2 THEN '✅' WHEN 3 THEN '🔊' WHEN 4 THEN '🎧' ELSE '❔' END || CASE WHEN length(k.name) % 8 = 0 THEN ' 📌' ELSE '' END || ' [[Sentences/' || regexp_replace(k.name, '\\.md$', '') || '|' || h.sentence || ']]' END AS shown
    FROM heard h JOIN spoken p USING (path) LEFT JOIN known k ON k.language = p.language AND k.normalized = h.normalized WHERE p.language <> 'unknown'""",
}
