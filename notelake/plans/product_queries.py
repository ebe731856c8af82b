"""Queries of tables in notes, quality, queues, study and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from notelake.functions.text import fix_path
from notelake.operators import activity as A
from notelake.operators import enrich as E
from notelake.operators import graph as G
from notelake.operators import index as I
from notelake.operators import notes as N
from notelake.operators import quality as H
from notelake.operators import queues as U
from notelake.operators import search as S
from notelake.operators import study as Y
from notelake.plans import oracle as O
from notelake.plans.graph_queries import GRAPH, relations_of
from notelake.plans.index_queries import ITEM_COLUMNS, items_of, parsed, stored
from notelake.plans.index_queries import ORACLE as INDEX_ORACLE
from notelake.plans.oracle import PRELUDE
from notelake.plans.search_queries import ORACLE as SEARCH_ORACLE
from notelake.plans.search_queries import _act, _sentences, activity_view, lookup_items_of, search_docs, terms, touched
from notelake.plans.views import AS_OF, CANDIDATES, NOTES, TABLE_NOTES, WORD_NOTES, view
from notelake.sources import files
from notelake.sources.markdown import markdown_tables
from notelake.sources.tables import shared_folder, written
from notelake.streaming import incremental


def a4_markdown_tables(spark, sf_dir):
    rows = markdown_tables(view(spark, sf_dir, TABLE_NOTES))
    return rows.select("path", "section", F.col("cells")["Word / Phrase"].alias("word"), F.col("cells")["Meaning"].alias("meaning"), F.col("cells")["Source"].alias("source"))


def a5_replaced_partitions(spark, sf_dir):
    """A written index of items, older ones among the vocabulary, whose partitions are then replaced."""
    folder = f"{shared_folder(spark).rstrip('/')}/item-index-{uuid.uuid4().hex}"
    found, words = items_of(stored(spark, sf_dir)), F.col("type") == "vocabulary"
    files.write_index({"items": found.withColumn("status", F.when(words, "older").otherwise(F.col("status")))}, folder)
    files.replace_partitions(found.filter(words), folder)
    return spark.read.parquet(f"{folder}/items").select(*ITEM_COLUMNS)


def a7_written_report(spark, sf_dir):
    """The index summary as it is read back from a report."""
    folder, rows = f"{shared_folder(spark).rstrip('/')}/report-{uuid.uuid4().hex}", I.index_summary(stored(spark, sf_dir))
    files.write_report(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


def b8_transcript_text(spark, sf_dir):
    return parsed(spark, sf_dir).filter("has_fm").select("path", F.md5(N.transcript_text(F.col("body")).cast("binary")).alias("digest"))


def b9_clean_display(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", N.clean_display(F.col("text")).alias("shown"))


def keys_of(notes):
    rows = I.note_items(notes).filter("skip_reason IS NULL")
    return rows.select("path", F.col("type").alias("item_type"), "language", F.col("text").alias("normalized"))


def h1_validate_notes(spark, sf_dir):
    return H.validate_notes(stored(spark, sf_dir), H.note_types(spark))


def h2_validation_summary(spark, sf_dir):
    notes = stored(spark, sf_dir)
    return H.validation_summary(notes, written(H.validate_notes(notes, H.note_types(spark)), "note-issues"))


def h3_audit_keys(spark, sf_dir):
    return H.audit_keys(keys_of(stored(spark, sf_dir)))


def h4_plan_key_migration(spark, sf_dir):
    return H.plan_key_migration(written(H.audit_keys(keys_of(stored(spark, sf_dir))), "key-audit"))


def h6_backfill_schema_version(spark, sf_dir):
    return H.backfill_schema_version(stored(spark, sf_dir), "note_v1")


def h8_backfill_links(spark, sf_dir):
    return G.backfill_links(stored(spark, sf_dir))


def h9_sync_tags(spark, sf_dir):
    notes = stored(spark, sf_dir)
    return H.sync_tags(notes, I.metadata_tags(notes))


#: The notes view with a path to mend in every transcript.
ODD_PATHS = f"SELECT path, replace(text, 'source_file: rec_', 'source_path: D:/' || '/audio' || chr(92) || chr(92) || 'rec_') AS text FROM ({NOTES}) n"


def h5_migrate_keys(spark, sf_dir):
    """Key changes carried out in notes that name their own key at the end."""
    notes = stored(spark, sf_dir)
    keys = written(H.audit_keys(keys_of(notes)), "key-audit")
    named = notes.join(keys.select("path", "old_key"), "path", "left").withColumn("text", F.concat("text", F.coalesce(F.concat(F.lit("\n\n<"), "old_key", F.lit(">\n")), F.lit("")))).drop("old_key")
    return H.migrate_keys(N.split_frontmatter(named), keys)


def h10_fix_paths(spark, sf_dir):
    notes = spark.sql(ODD_PATHS.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return H.fix_paths(N.split_frontmatter(notes))


def h11_run_summary(spark, sf_dir):
    notes = stored(spark, sf_dir)
    return files.run_summary(files.change_set(notes, H.backfill_schema_version(notes, "note_v1")))


def h12_quality_gate(spark, sf_dir):
    notes = stored(spark, sf_dir)
    q = terms(spark, sf_dir)
    expected = q.select(F.concat(F.lit("lookup "), F.col("qid").cast("string")).alias("check"), "qid", F.concat_ws("|", F.lit("vocabulary"), F.coalesce("language", F.lit("english")), "text").alias("item_key"))
    # A search document has its item's key and its parts, so the notes' items are made once for all checks.
    docs = search_docs(spark, sf_dir)
    items = lookup_items_of(docs)
    keys = docs.select("path", F.col("doc_type").alias("item_type"), "language", F.col("title").alias("normalized"))
    relation_issues = G.audit_relations(relations_of(notes, spark), items.select("item_key"), G.taxonomy(spark))
    return H.quality_gate(H.validate_notes(notes, H.note_types(spark)), H.audit_keys(keys), relation_issues, H.smoke_lookups(S.index_for_grades(items), q, expected))


def i1_approve_vocabulary(spark, sf_dir):
    words = a4_markdown_tables(spark, sf_dir).select("word")
    return U.approve_vocabulary(view(spark, sf_dir, CANDIDATES), words).select("pos", "word_or_phrase", "target_language", "new_status")


def i3_card_candidates(spark, sf_dir):
    rows, cell = markdown_tables(view(spark, sf_dir, TABLE_NOTES)), F.col("cells")
    return U.card_candidates(rows, cell["Word / Phrase"], cell["Meaning"], cell["Source"], cell["Example Sentence"], F.col("section")).drop("line_no").withColumn("tags", F.array_join("tags", " "))


def i7_upsert_vocabulary(spark, sf_dir):
    rows = markdown_tables(view(spark, sf_dir, TABLE_NOTES)).select(F.col("cells")["Word / Phrase"].alias("word"), F.col("section").alias("language"), "line_no")
    return U.upsert_vocabulary(rows, items_of(stored(spark, sf_dir)).select(F.col("obsidian_path").alias("path"), "seen_count"), AS_OF).drop("term")


def i7_merge_examples(spark, sf_dir):
    """Every part's type and brand as an example of its name, merged into the notes of names."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.col("p_name").alias("word"), F.lit("English").alias("language"), F.col("p_partkey").cast("int").alias("line_no"), F.concat_ws(" of ", "p_type", "p_brand").alias("example"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("source"))
    return U.merge_examples(rows, view(spark, sf_dir, WORD_NOTES), AS_OF)


def i5_mark_candidates(spark, sf_dir):
    return U.mark_candidates(stored(spark, sf_dir))


def cards_and_views(spark, sf_dir, text=None):
    notes = stored(spark, sf_dir)
    views = G.relation_views(relations_of(notes, spark))  # columns of a table that is kept
    return Y.build_deck(notes, views, text), views


def j1_build_deck(spark, sf_dir):
    return cards_and_views(spark, sf_dir)[0]


def j1_deck_search(spark, sf_dir):
    """Cards that hold a text, or whose relations do; this one stands in the labels of some relations and in some texts."""
    return cards_and_views(spark, sf_dir, " Contains ")[0].select("path", "item_key")


def j1_card_relations(spark, sf_dir):
    return Y.card_relations(*cards_and_views(spark, sf_dir))


def j2_deck_summary(spark, sf_dir):
    return Y.deck_summary(cards_and_views(spark, sf_dir)[0])


def k1_touch_stream(spark, sf_dir):
    """The touches as a stream of files; the result is the table after the last of them."""
    folder = f"{shared_folder(spark).rstrip('/')}/touch-stream-{uuid.uuid4().hex}"
    touched(spark, sf_dir, items_of(stored(spark, sf_dir))).write.parquet(f"{folder}/in")
    return incremental.run_touch_stream(spark, f"{folder}/in", f"{folder}/counts", f"{folder}/state")


def k2_item_stream(spark, sf_dir):
    """The notes as a stream of four files; the result is the item table after the last of them. A batch is parsed once, not for every property that is read."""
    folder = f"{shared_folder(spark).rstrip('/')}/item-stream-{uuid.uuid4().hex}"
    view(spark, sf_dir, NOTES).repartition(4, "path").write.parquet(f"{folder}/in")
    incremental.run_item_stream(spark, f"{folder}/in", f"{folder}/items", f"{folder}/state", lambda notes: I.build_items(written(N.parse_frontmatter(notes), "batch-notes"), AS_OF)).awaitTermination()
    return incremental.read_kept(spark, f"{folder}/items", ", ".join(f"{c} string" for c in ITEM_COLUMNS)).select(*ITEM_COLUMNS)


def b20_safe_name(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", E.safe_name(F.col("text")).alias("name"))


def b21_fix_path(spark, sf_dir):
    """Values with backslashes, and quotes that match, do not match, or come twice, by the length of the path."""
    back, n = F.concat(F.lit("C:"), F.lit("\\" * 2), F.regexp_replace("path", "/", r"\\\\\\\\")), F.length("path") % 4
    quoted = lambda a, b: F.concat(F.lit(a), back, F.lit(b))
    odd = F.when(n == 0, quoted('"', '" ')).when(n == 1, quoted("'", "")).when(n == 2, quoted("\"'", "'\"")).otherwise(quoted('""', '""'))
    return view(spark, sf_dir, NOTES).select("path", fix_path(odd).alias("fixed"))


def b23_review_status(spark, sf_dir):
    rows = activity_view(spark, sf_dir)
    as_of = F.to_timestamp(F.lit(AS_OF))
    return rows.select("item_key", A.review_status(F.col("access_count"), F.col("last_accessed_at"), F.col("status"), F.col("stale_after_days"), as_of).alias("review_status"))


QUERIES = {
    f.__name__: f
    for f in (
        a4_markdown_tables, a5_replaced_partitions, a7_written_report, b8_transcript_text, b9_clean_display, h1_validate_notes, h2_validation_summary, h3_audit_keys, h4_plan_key_migration, h5_migrate_keys, h6_backfill_schema_version, h8_backfill_links, h9_sync_tags,
        h10_fix_paths, h11_run_summary, h12_quality_gate, i1_approve_vocabulary, i5_mark_candidates, j1_build_deck, j1_deck_search, j1_card_relations, j2_deck_summary, k1_touch_stream,
        k2_item_stream, i3_card_candidates, i7_upsert_vocabulary, i7_merge_examples, b20_safe_name, b21_fix_path, b23_review_status,
    )
}

_tables = f"""tables AS ({TABLE_NOTES}), rows_of AS (
    SELECT path, regexp_extract(text, '^## ([^\\n]*)', 1) AS section, string_split(trim(line, '| '), ' | ') AS c, line FROM (SELECT path, text, unnest(string_split(text, chr(10))) AS line FROM tables) WHERE starts_with(line, '| ')
), words AS (SELECT path, section, trim(string_split(line, '|')[2]) AS word, trim(string_split(line, '|')[3]) AS meaning, trim(string_split(line, '|')[5]) AS source FROM rows_of WHERE len(string_split(line, '|')) = 6 AND NOT contains(line, 'Word / Phrase'))"""
_low = lambda x: f"lower({O.collapse(O.strip(x))})"
_fold = lambda x: f"replace(lower(nfc_normalize({x})), 'ß', 'ss')"
_required = ", ".join(f"('{n}', '{f}')" for n, _, _, fs in H.NOTE_TYPES for f in fs)
_folders = ", ".join(f"('{n}', '{lang}', '{f}')" for n, _, fs, _ in H.NOTE_TYPES for lang, f in fs.items())
_issues = f""", required(kind, field) AS (VALUES {_required}), folders(kind, lang, folder) AS (VALUES {_folders}),
checked AS (SELECT path, has_fm, lower({O.strip('p_type')}) AS kind, lower({O.strip('p_language')}) AS lang, {O.strip('p_normalized')} AS norm FROM props),
known AS (SELECT * FROM checked WHERE has_fm AND kind IN (SELECT kind FROM required)),
note_issues AS (
    SELECT path, 'error' AS severity, 'missing_frontmatter' AS code, NULL AS field FROM checked WHERE NOT has_fm
    UNION ALL SELECT path, 'error', 'missing_note_type', 'type' FROM checked WHERE has_fm AND kind = ''
    UNION ALL SELECT path, 'error', 'unknown_note_type', 'type' FROM checked WHERE has_fm AND kind <> '' AND kind NOT IN (SELECT kind FROM required)
    UNION ALL SELECT k.path, 'error', 'missing_required_frontmatter', r.field FROM known k JOIN required r USING (kind) WHERE NOT EXISTS (SELECT 1 FROM fm WHERE fm.path = k.path AND fm.key = r.field AND {O.strip('fm.value')} <> '')
    UNION ALL SELECT path, 'error', 'missing_language', 'language' FROM known k WHERE lang = '' AND EXISTS (SELECT 1 FROM required r WHERE r.kind = k.kind AND r.field = 'language')
    UNION ALL SELECT path, 'error', 'unsupported_language', 'language' FROM known WHERE lang <> '' AND lang NOT IN ('english', 'german')
    UNION ALL SELECT path, 'warning', 'folder_mismatch', 'path' FROM known k JOIN folders f ON f.kind = k.kind AND f.lang = k.lang WHERE NOT starts_with(k.path, f.folder || '/')
)"""
_audit = f""", key_audit AS (
    SELECT path, type || '|' || language || '|' || text AS old_key, type || '|' || language || '|' || CASE WHEN type = 'sentence' THEN {O.strip("regexp_replace(folded, '[.!?。！？]+$', '')")} ELSE folded END AS new_key,
           text, {O.strip('text')} AS s1, {O.collapse(O.strip('text'))} AS s2, folded, CASE WHEN type = 'sentence' THEN {O.strip("regexp_replace(folded, '[.!?。！？]+$', '')")} ELSE folded END AS s4
    FROM (SELECT *, {_fold(O.collapse(O.strip('text')))} AS folded FROM counted)
)"""
_shown = lambda x: f"regexp_replace(regexp_replace({x}, '!?\\[\\[[^\\]|]+\\|{O.S}*([^\\]]*?){O.S}*\\]\\]', '\\1', 'g'), '!?\\[\\[(?:[^\\]|]*[/\\\\])?{O.S}*([^\\]|/\\\\]*?){O.S}*\\]\\]', '\\1', 'g')"
_without_fm = lambda x: f"regexp_replace({O.strip(x)}, '\\A---[ \\t]*\\n(?:(?s:.*?)\\n)??[ \\t]*---[ \\t]*(?:\\n|\\z)', '')"
_display = lambda x: O.strip(f"regexp_replace(regexp_replace({_shown(_without_fm(x))}, '(?m)^[ \\t]*#{{1,6}}[ \\t]+([^\\s][^\\n]*?)[ \\t]*$', '**\\1**', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
_deck = f""", pieces AS (
    SELECT path, unnest(string_split(regexp_replace(chr(10) || body, '\\n(#{{1,6}}[ \\t\\n])', chr(10) || chr(1) || '\\1', 'g'), chr(10) || chr(1))) AS piece,
           generate_subscripts(string_split(regexp_replace(chr(10) || body, '\\n(#{{1,6}}[ \\t\\n])', chr(10) || chr(1) || '\\1', 'g'), chr(10) || chr(1)), 1) AS n FROM cut
), parts AS (
    SELECT path, key, string_agg(content, chr(10) || chr(10) ORDER BY n) AS content FROM (
        SELECT path, n, regexp_replace(lower({O.strip("regexp_replace(regexp_extract(piece, '^[^\\n]*'), '^#+|#+$', '', 'g')")}), '{O.S}+', '_', 'g') AS key, {O.strip("regexp_replace(piece, '^[^\\n]*', '')")} AS content
        FROM pieces WHERE regexp_matches(piece, '^#{{1,6}}[ \\t\\n]')
    ) WHERE content <> '' GROUP BY path, key
), sides AS (SELECT path, map_from_entries(list((key, content))) AS m FROM parts GROUP BY path), cards AS (
    SELECT c.path, c.item_key, c.type, c.language, {O.collapse(O.strip(f"regexp_replace({_shown(f"coalesce(nullif({O.strip('p_term')}, ''), nullif({O.strip('p_sentence')}, ''), nullif({O.strip('p_title')}, ''), c.normalized)")}, '`([^`]+)`', '\\1', 'g')"))} AS front,
           CASE c.type WHEN 'vocabulary' THEN 'Vocabulary item' WHEN 'sentence' THEN 'Sentence card' ELSE 'Grammar concept' END AS subtitle,
           {_display("coalesce(m['meaning'], m['explanation'], m['definition'], m['pattern'], m['notes'], 'No Meaning/Explanation found yet.')")} AS back, {_display("coalesce(m['examples'], m['example'], m['sentences'], '')")} AS examples,
           {_display("coalesce(m['notes'], m['usage'], m['grammar_notes'], m['pattern'], '')")} AS notes, coalesce(v.n, 0) AS n_relations
    FROM counted c JOIN props USING (path) LEFT JOIN sides USING (path) LEFT JOIN (SELECT item_key, count(*) AS n FROM views GROUP BY item_key) v ON v.item_key = c.item_key WHERE c.type IN ('vocabulary', 'sentence', 'grammar')
), named AS (SELECT item_key, direction, CASE relation_type WHEN 'contains_vocabulary' THEN 'Contains Vocabulary' WHEN 'uses_grammar' THEN 'Uses Grammar' WHEN 'similar_to' THEN 'Similar to' END AS label, array_to_string(string_split(other_key, '|')[3:], '|') AS other_text FROM views)"""
_version = "CASE WHEN has_fm AND p_type <> '' AND p_schema_version = '' THEN '---' || chr(10) || 'schema_version: note_v1' || chr(10) || regexp_replace(substr(note_text, 4), '^\\n', '') ELSE note_text END"
ORACLE = {
    "a5_replaced_partitions": PRELUDE + f"SELECT {', '.join(ITEM_COLUMNS)} FROM items",
    "a7_written_report": INDEX_ORACLE["c4_index_summary"],
    "a4_markdown_tables": f"WITH {_tables} SELECT path, section, word, meaning, source FROM words",
    "h1_validate_notes": PRELUDE + _issues + " SELECT * FROM note_issues",
    "h2_validation_summary": PRELUDE
    + _issues
    + """ SELECT 'notes' AS dim, 'checked' AS value, count(*) AS n FROM cut UNION ALL SELECT 'notes', 'valid', count(*) FROM cut WHERE path NOT IN (SELECT path FROM note_issues WHERE severity = 'error')
    UNION ALL SELECT 'severity', severity, count(*) FROM note_issues GROUP BY 2 UNION ALL SELECT 'code', code, count(*) FROM note_issues GROUP BY 2""",
    "h3_audit_keys": PRELUDE
    + _audit
    + """ SELECT path, old_key, new_key, old_key <> new_key AS changed, array_to_string(list_filter([CASE WHEN s1 <> text THEN 'trim' END, CASE WHEN s2 <> s1 THEN 'collapse_whitespace' END, CASE WHEN folded <> s2 THEN 'casefold' END, CASE WHEN s4 <> folded THEN 'strip_terminal_punctuation' END], lambda x: x IS NOT NULL), ',') AS operations FROM key_audit""",
    "h4_plan_key_migration": PRELUDE
    + _audit
    + """ SELECT 'duplicate_key' AS code, old_key AS key, count(*) AS n FROM key_audit GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'merged_keys', new_key, count(*) FROM key_audit WHERE old_key <> new_key GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'collision', new_key, count(*) FROM key_audit WHERE old_key <> new_key AND new_key IN (SELECT old_key FROM key_audit WHERE old_key = new_key) GROUP BY 2""",
    "h5_migrate_keys": PRELUDE
    + _audit
    + """, moved AS (SELECT old_key, min(new_key) AS new_key FROM key_audit WHERE old_key <> new_key GROUP BY old_key),
    named AS (SELECT n.path, n.text, k.old_key FROM notes n LEFT JOIN key_audit k USING (path)),
    best AS (
        SELECT n.path, m.old_key, m.new_key FROM named n JOIN moved m ON starts_with(n.old_key, m.old_key) AND NOT regexp_matches(substr(n.old_key || '>', length(m.old_key) + 1, 1), '[\\p{L}\\p{N}]')
        QUALIFY row_number() OVER (PARTITION BY n.path ORDER BY length(m.old_key) DESC) = 1
    )
    SELECT n.path, n.text || CASE WHEN n.old_key IS NULL THEN '' ELSE chr(10) || chr(10) || '<' || CASE WHEN b.path IS NULL THEN n.old_key ELSE b.new_key || substr(n.old_key, length(b.old_key) + 1) END || '>' || chr(10) END AS text,
           CASE WHEN b.path IS NULL THEN 0 ELSE 1 END AS n_replaced FROM named n LEFT JOIN best b ON b.path = n.path""",
    "h6_backfill_schema_version": PRELUDE + f"SELECT path, {_version} AS text FROM props",
    "h8_backfill_links": GRAPH
    + """, bare AS (SELECT *, regexp_replace(lower(target), '\\.md$', '') AS b FROM cands) SELECT path, relation_type, target FROM bare o WHERE origin = 1
    AND NOT EXISTS (SELECT 1 FROM bare g WHERE g.origin = 0 AND g.path = o.path AND g.relation_type = o.relation_type AND g.b = o.b) QUALIFY row_number() OVER (PARTITION BY path, relation_type, b ORDER BY ord, pos) = 1""",
    "h11_run_summary": PRELUDE + f", changes AS (SELECT CASE WHEN {_version} = note_text THEN 'unchanged' ELSE 'would_update' END AS status FROM props) SELECT status, count(*) AS n FROM changes GROUP BY 1 UNION ALL SELECT 'scanned', count(*) FROM changes",
    "h12_quality_gate": "SELECT * FROM ("
    + GRAPH
    + _issues
    + _audit
    + """ SELECT 'validation' AS "check", count(*) AS found, count(*) = 0 AS passed, '' AS missing FROM note_issues WHERE severity = 'error' UNION ALL SELECT 'keys', count(*), count(*) = 0, '' FROM key_audit WHERE old_key <> new_key
    UNION ALL SELECT 'relations', count(*), count(*) = 0, '' FROM issues WHERE severity = 'error') UNION ALL
    SELECT 'lookup ' || b.item_id, CASE WHEN h.qid IS NULL THEN 1 ELSE 0 END, h.qid IS NOT NULL, CASE WHEN h.qid IS NULL THEN wanted ELSE '' END FROM (
        SELECT item_id, 'vocabulary|english|' || regexp_extract(text, '[a-z]{5,}', 0) AS wanted FROM benchmark
    ) b LEFT JOIN ("""
    + SEARCH_ORACLE["e5_graded_lookup"]
    + ") h ON h.qid = b.item_id AND h.item_key = b.wanted",
    "i1_approve_vocabulary": f"""WITH {_tables}, cand AS ({CANDIDATES}), keyed AS (SELECT *, {_low('word_or_phrase')} AS key, status = 'pending_review' AND {O.strip('word_or_phrase')} <> '' AS ready FROM cand)
    SELECT pos, word_or_phrase, CASE WHEN language IN ('english', 'german') THEN language ELSE 'english' END AS target_language,
           CASE WHEN status <> 'pending_review' THEN status WHEN NOT ready THEN 'error' WHEN key IN (SELECT {_low('word')} FROM words) OR row_number() OVER (PARTITION BY key, ready ORDER BY pos) > 1 THEN 'duplicate' ELSE 'approved' END AS new_status FROM keyed""",
    "i5_mark_candidates": GRAPH
    + f""", seen AS (
        SELECT p.path, lower({O.strip('p_type')}) AS kind, lower({O.strip('p_anki_status')}) AS anki, lower({O.strip('p_status')}) AS status, coalesce({O.strip('m.content')}, '') AS meaning, coalesce(try_cast(p_seen_count AS INTEGER), 0) AS n
        FROM props p LEFT JOIN (SELECT path, string_agg(line, chr(10) ORDER BY n) AS content FROM l2_lines WHERE heading = 'meaning' GROUP BY path) m ON m.path = p.path WHERE has_fm
    ), why AS (SELECT *, CASE WHEN kind <> 'sentence' THEN 'not sentence type: ' || kind WHEN anki NOT IN ('', 'none') THEN 'anki_status already ' || anki WHEN status IN ('ignored', 'archived') THEN 'sentence status is ' || status
        WHEN meaning IN ({', '.join(f"'{x}'" for x in U.EMPTY_MEANINGS)}) THEN 'meaning is empty or TODO' END AS reason FROM seen)
    SELECT path, reason IS NULL AND n >= 2 AS marked, coalesce(reason, 'seen_count ' || n || CASE WHEN n < 2 THEN ' < ' ELSE ' >= ' END || 'min_seen 2') AS reason FROM why""",
    "j1_build_deck": GRAPH + _deck + " SELECT * FROM cards",
    "j1_deck_search": GRAPH + _deck + """ SELECT path, item_key FROM cards c WHERE contains(lower(concat_ws(chr(10), item_key, type, language, front, subtitle, back, examples, notes, path)), 'contains')
    OR EXISTS (SELECT 1 FROM named n WHERE n.item_key = c.item_key AND contains(lower(label || ' ' || other_text), 'contains'))""",
    "j1_card_relations": GRAPH + _deck + " SELECT path, item_key, direction, label, other_text FROM cards JOIN named USING (item_key)",
    "j2_deck_summary": GRAPH + _deck + " SELECT type, language, count(*) AS n FROM cards GROUP BY GROUPING SETS ((type), (language), ())",
    "k1_touch_stream": PRELUDE + _act + " SELECT item_key, access_count, last_accessed_at FROM act",
}

_name = lambda x: f"""coalesce(nullif(rtrim(substr(regexp_replace({O.collapse(f"regexp_replace({O.strip(x)}, '[\\\\/:*?\"<>|]', ' ', 'g')")}, '^[ .]+|[ .]+$', '', 'g'), 1, 80)), ''), 'Untitled Sentence') || '.md'"""
_pick = "coalesce(" + ", ".join(f"nullif((SELECT {O.strip('content')} FROM sec WHERE sec.path = t.path AND sec.heading = '{h}'), '')" for h in ("raw transcript", "full transcript", "timestamped transcript")) + ", body)"
_stamp = "`?\\[[0-9]{2}:[0-9]{2}(:[0-9]{2})?\\s*-\\s*[0-9]{2}:[0-9]{2}(:[0-9]{2})?\\]`?"
_plain = f"regexp_replace(regexp_replace(regexp_replace({_pick}, '{_stamp}', ' ', 'g'), '(?m)^#+\\s+[^\\n]*$', ' ', 'g'), '(?m)^\\s*-\\s+', '', 'g')"
_spoken = f"regexp_replace(regexp_replace({_plain}, '\\[\\[([^\\]|]+)\\|([^\\]]+)\\]\\]', '\\2', 'g'), '\\[\\[([^\\]]+)\\]\\]', '\\1', 'g')"
#: Transcripts, and their sentences by the two rules.
SPOKEN = GRAPH + f""", sec AS (SELECT path, heading, string_agg(line, chr(10) ORDER BY n) AS content FROM l2_lines GROUP BY path, heading),
spoken AS (SELECT path, language, {O.collapse(O.strip(_spoken))} AS text FROM typed t WHERE has_fm AND type = 'transcript'),
said AS ({_sentences('spoken', O.norm_ext, True)}), heard AS ({_sentences('spoken', O.norm_db, False)}),
extracted AS (
    SELECT language, name, arg_min(sentence, path || lpad(CAST(ord AS VARCHAR), 9, '0')) AS sentence, count(DISTINCT (path, sentence)) AS seen_count, '{AS_OF[:10]}' AS first_seen, '{AS_OF[:10]}' AS last_seen FROM (SELECT s.*, p.language, {_name('sentence')} AS name FROM said s JOIN spoken p USING (path))
    WHERE language IN ('english', 'german') GROUP BY language, name
),
old AS (SELECT DISTINCT language, {O.stem('path')} || '.md' AS name FROM typed WHERE has_fm AND type = 'sentence'),
acted AS (SELECT e.*, CASE WHEN o.name IS NULL THEN 'created' ELSE 'updated' END AS action FROM extracted e LEFT JOIN old o USING (language, name)),
vocab AS (SELECT path, {O.norm_db(f"coalesce(nullif({O.strip('p_term')}, ''), {O.stem('path')})")} AS term, coalesce(nullif(lower({O.strip('p_language')}), ''), 'unknown') AS lang FROM props WHERE has_fm AND lower({O.strip('p_type')}) = 'vocabulary' AND starts_with(path, 'Vocabulary/')),
phrases AS (SELECT path, {O.norm_db(f"coalesce(nullif({O.strip('p_sentence')}, ''), {O.stem('path')})")} AS phrase, coalesce(nullif(lower({O.strip('p_language')}), ''), 'unknown') AS lang FROM props WHERE has_fm AND lower({O.strip('p_type')}) = 'sentence')
"""
ORACLE |= {
    "i3_card_candidates": f"WITH {_tables} SELECT path, word AS front, meaning || chr(10) || chr(10) || source AS back, CASE WHEN contains(section, 'German') THEN 'german' ELSE 'english' END AS language, CASE WHEN contains(section, 'German') THEN 'german' ELSE 'english' END || ' sentence candidate' AS tags FROM words",
    "i7_upsert_vocabulary": f"WITH {_tables} SELECT 'Vocabulary/' || section || '/' || word || '.md' AS path, 1 AS seen_count, '{AS_OF[:10]}' AS last_seen, 'created' AS action FROM words GROUP BY 1",
    "i7_merge_examples": f"""WITH notes AS ({WORD_NOTES}), rows_of AS (SELECT 'Vocabulary/English/' || p_name || '.md' AS path, p_partkey AS k, p_type || ' of ' || p_brand AS example, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Vocabulary Inbox' END AS source FROM part),
    once AS (SELECT path, example, min(k) AS k, arg_min(source, k) AS source FROM rows_of GROUP BY path, example),
    new AS (SELECT path, example, k, source FROM once JOIN notes USING (path) WHERE NOT contains(text, example)),
    kept AS (SELECT path, k, example, source FROM new n WHERE NOT EXISTS (SELECT 1 FROM new m WHERE m.path = n.path AND m.k < n.k AND contains(m.example, n.example))),
    lists AS (SELECT path, count(*) AS n, string_agg(chr(10) || '- ' || source || chr(10) || '  - ' || example || chr(10) || chr(10), '' ORDER BY k) AS contexts, string_agg('- ' || example || chr(10) || chr(10), '' ORDER BY k) AS lines FROM kept GROUP BY path),
    placed AS (SELECT path, text, contains(text, '## Example Sentences') AS has_examples, coalesce(contexts, '') AS contexts, coalesce(lines, '') AS lines, coalesce(n, 0) AS n, contains(text, '## Contexts') AS has_contexts FROM notes LEFT JOIN lists USING (path) WHERE path IN (SELECT path FROM rows_of)),
    merged AS (SELECT *, CASE WHEN has_examples THEN n ELSE 0 END AS added, CASE WHEN has_examples THEN replace(CASE WHEN has_contexts THEN replace(text, '## Example Sentences', contexts || '## Example Sentences') ELSE text END, '## Related', lines || '## Related') ELSE text END AS grown FROM placed)
    SELECT path, added AS n_added, CASE WHEN added > 0 THEN 'updated' ELSE 'unchanged' END AS action, CASE WHEN added = 0 THEN text ELSE
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(grown, 'seen_count: [0-9]+', 'seen_count: ' || (CAST(regexp_extract(text, 'seen_count: ([0-9]+)', 1) AS BIGINT) + added)), 'last_seen: [^\n]*', 'last_seen: {AS_OF[:10]}'), 'updated_at: [^\n]*', 'updated_at: {AS_OF[:10]}'),
            '🔁 Seen: [0-9]+', '🔁 Seen: ' || (CAST(regexp_extract(text, 'seen_count: ([0-9]+)', 1) AS BIGINT) + added)) END AS text FROM merged""",
    "k2_item_stream": PRELUDE + f"SELECT {', '.join(ITEM_COLUMNS)} FROM items",
    "b8_transcript_text": SPOKEN.replace("WHERE has_fm AND type = 'transcript'", "WHERE has_fm") + "SELECT path, md5(text) AS digest FROM spoken",
    "b20_safe_name": f"SELECT doc_id, {_name('text')} AS name FROM documents",
    "b21_fix_path": f"WITH notes AS ({NOTES}) SELECT path, CASE length(path) % 4 WHEN 1 THEN chr(39) || 'C:/' || path WHEN 3 THEN chr(34) || 'C:/' || path || chr(34) ELSE 'C:/' || path END AS fixed FROM notes",
    "b23_review_status": PRELUDE
    + _act
    + f""" SELECT item_key, CASE WHEN status IN ('ignored', 'archived') THEN 'ignored' WHEN access_count = 0 THEN 'unreviewed' WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', last_accessed_at)) >= 86400 * stale_after_days THEN 'stale' ELSE 'active' END AS review_status FROM act_view""",
    "g2_extract_sentences": SPOKEN + "SELECT * FROM acted",
    "g3_extract_summary": SPOKEN + "SELECT language, action, count(*) AS n, sum(seen_count)::BIGINT AS n_contexts FROM acted GROUP BY GROUPING SETS ((language, action), (action))",
    "g4_annotate": SPOKEN
    + "SELECT path, count(*) AS n_sentences, count(i.item_key) AS n_found, count(*) - count(i.item_key) AS n_new FROM heard h JOIN spoken USING (path) LEFT JOIN items i ON i.type = 'sentence' AND i.language = spoken.language AND i.normalized = h.normalized WHERE spoken.language <> 'unknown' GROUP BY path",
    "g5_match_terms": SPOKEN
    + """SELECT s.path AS sentence_path, v.path AS term_path FROM phrases s JOIN vocab v ON v.lang = s.lang AND length(v.term) >= 3 AND contains(s.phrase, v.term)
    WHERE contains(v.term, ' ') OR regexp_matches(' ' || s.phrase || ' ', '[^A-Za-z0-9_ÄÖÜäöüß]' || regexp_escape(v.term) || '[^A-Za-z0-9_ÄÖÜäöüß]')""",
}

#: Display text from lines and regular expressions of another dialect.
_bare = f"regexp_replace({O.strip('text')}, '\\A---[ \\t]*\\n(?:(?s:.*?)\\n)??[ \\t]*---[ \\t]*(?:\\n|\\z)', '')"
_linked = f"regexp_replace(regexp_replace({_bare}, '!?\\[\\[[^\\]|]+\\|{O.S}*([^\\]]*?){O.S}*\\]\\]', '\\1', 'g'), '!?\\[\\[(?:[^\\]|]*[/\\\\])?{O.S}*([^\\]|/\\\\]*?){O.S}*\\]\\]', '\\1', 'g')"
_bold = f"regexp_replace({_linked}, '(?m)^[ \\t]*#{{1,6}}[ \\t]+([^\\s][^\\n]*?)[ \\t]*$', '**\\1**', 'g')"
_mended = """list_transform(string_split(regexp_replace(raw_fm, '^\\n+|\\n+$', '', 'g'), chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\\s*(source_path|audio_path|video_path)\\s*:')
    THEN regexp_extract(x, '^\\s*[A-Za-z0-9_]+\\s*:\\s*') || regexp_replace(regexp_replace(regexp_replace(x, '^\\s*[A-Za-z0-9_]+\\s*:\\s*', ''), '\\\\+', '/', 'g'), '/+', '/', 'g') ELSE x END)"""
ORACLE |= {
    "b9_clean_display": PRELUDE + f"SELECT path, {O.strip(f"regexp_replace({_bold}, '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS shown FROM notes",
    "h10_fix_paths": PRELUDE.replace(f"WITH notes AS ({NOTES})", f"WITH notes AS ({ODD_PATHS})")
    + f"SELECT path, CASE WHEN has_fm AND contains(raw_fm, 'source_path:') THEN '---' || chr(10) || array_to_string({_mended}, chr(10)) || chr(10) || '---' || chr(10) || chr(10) || body ELSE text END AS text FROM cut",
    "h9_sync_tags": f"WITH tagged AS ({INDEX_ORACLE['b19_metadata_tags']}), notes AS ({NOTES}), " + """fenced AS (SELECT path, text, CASE WHEN starts_with(text, '---') AND len(string_split(text, '---')) >= 3 THEN string_split(text, '---')[2] END AS raw_fm FROM notes)
    SELECT path, CASE WHEN raw_fm IS NULL THEN text ELSE '---' || raw_fm || 'tags:' || chr(10) || array_to_string(list_transform(string_split(tags, ' '), lambda t: '  - ' || t || chr(10)), '') || '---' || substr(text, length(raw_fm) + 7) END AS text FROM fenced LEFT JOIN tagged USING (path)""",
}
