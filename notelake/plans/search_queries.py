"""Queries of lookup, full-text search, activity and enrichment, with their SQL."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from notelake.functions.text import norm_db, stem, tokens
from notelake.operators import activity as A
from notelake.operators import enrich as E
from notelake.operators import fulltext as X
from notelake.operators import graph as G
from notelake.operators import index as I
from notelake.operators import search as S
from notelake.plans import oracle as O
from notelake.plans.graph_queries import GRAPH, relations_of
from notelake.plans.index_queries import items, items_of, notes_once, stored
from notelake.plans.oracle import PRELUDE
from notelake.plans.views import AS_OF, TOUCHES, view
from notelake.sources.tables import kept, kept_once, shared_folder, written


def passages(spark, sf_dir):
    """Queries: every benchmark text as a whole, and one word of each, so that some queries have very many hits."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    none = F.lit(None).cast("string")
    asked = bench.select(F.col("item_id").alias("qid"), "text").unionByName(bench.select((-1 - F.col("item_id")).alias("qid"), F.regexp_extract("text", "[a-z]{5,}", 0).alias("text")))
    return asked.select("qid", "text", none.alias("language"), none.alias("type"))


def terms(spark, sf_dir):
    """Queries: the terms of candidate words, in English or German, of any type."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    none = F.lit(None).cast("string")
    return bench.select(F.col("item_id").alias("qid"), F.regexp_extract("text", "[a-z]{5,}", 0).alias("text"), F.when(F.col("item_id") % 2 == 0, "english").alias("language"), none.alias("type"))


def doc_words(spark, sf_dir):
    """Queries: a word of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("qid"), F.regexp_extract("text", "[a-z]{5,}", 0).alias("text"), F.when(F.col("lang") == "en", "english").alias("language"), none.alias("type"))


def docs_of(notes):
    return written(I.build_search_docs(notes), "search-docs")


def search_docs(spark, sf_dir):
    return kept_once(spark, sf_dir, "search-docs", lambda: I.build_search_docs(notes_once(spark, sf_dir)))


def e1_exact_lookup(spark, sf_dir):
    return S.exact_lookup(items(spark, sf_dir), doc_words(spark, sf_dir))


def e2_find_items(spark, sf_dir):
    return S.find_items(items_of(stored(spark, sf_dir)), terms(spark, sf_dir))


def e3_fuzzy_lookup(spark, sf_dir):
    return S.fuzzy_lookup(items(spark, sf_dir), terms(spark, sf_dir))


def e3_levenshtein_lookup(spark, sf_dir):
    return S.levenshtein_lookup(items(spark, sf_dir), terms(spark, sf_dir))


def e4_lookup(spark, sf_dir):
    return S.lookup(items_of(stored(spark, sf_dir)), terms(spark, sf_dir))


def lookup_items_of(docs):
    return written(S.consolidate(S.lookup_items(docs)), "lookup-items")


def lookup_table(notes):
    return lookup_items_of(docs_of(notes))


def e5_graded_lookup(spark, sf_dir):
    return S.graded_lookup(lookup_table(stored(spark, sf_dir)), terms(spark, sf_dir))


def e6_consolidate(spark, sf_dir):
    notes = stored(spark, sf_dir)
    keys = G.relation_keys(notes).select("item_key", F.col("item_type").alias("type"), "language", "normalized", F.lit(None).cast("string").alias("title"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("text_preview"))
    return S.consolidate(S.lookup_items(docs_of(notes)), keys)


def e7_with_relations(spark, sf_dir):
    notes = stored(spark, sf_dir)
    matches = S.exact_lookup(items_of(notes), doc_words(spark, sf_dir)).select("qid", "item_key")
    return S.with_relations(matches, G.relation_views(relations_of(notes, spark)))


def e8_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def e9_postings(spark, sf_dir):
    rows = S.build_postings(search_docs(spark, sf_dir))
    return rows.select("term", "path", "col", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def text_index(spark, sf_dir):
    """The kept full-text index of all search documents. It is all that a search reads, so they are made and put into it in one pass, unless they are kept already."""
    folder = f"{shared_folder(spark).rstrip('/')}/text-index-{uuid.uuid4().hex}"
    docs = kept(spark, sf_dir, "search-docs")
    if docs is None:
        docs = I.build_search_docs(notes_once(spark, sf_dir))
    X.add_documents(folder, docs, expected=spark.read.parquet(f"{sf_dir}/documents.parquet").count())
    return X.read_index(spark, folder)


def e9_extended_index(spark, sf_dir):
    """The index after a first batch with other texts, a second one that replaces some, and a third that strikes some out and brings them back."""
    docs = search_docs(spark, sf_dir)
    folder = f"{shared_folder(spark).rstrip('/')}/text-index-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("path"), F.lit(3))
    X.add_documents(folder, docs.filter(part < 2).withColumn("body", F.when(part == 1, F.concat("title", F.lit(" older text"))).otherwise(F.col("body"))))
    X.add_documents(folder, docs.filter(part > 0), gone=docs.filter(part == 0).select("path"))
    X.add_documents(folder, docs.filter(part == 0))
    index = X.read_index(spark, folder)
    rows = None
    for p in index.postings:
        rows = p if rows is None else rows.unionByName(p)
    return rows.join(index.counts, "term").select("term", "path", "col", "tf", "df", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def e10_phrase_match(spark, sf_dir):
    return X.phrase_match(text_index(spark, sf_dir), passages(spark, sf_dir))


def e11_all_terms_match(spark, sf_dir):
    return X.all_terms_match(text_index(spark, sf_dir), passages(spark, sf_dir))


def e12_bm25(spark, sf_dir):
    index, q = text_index(spark, sf_dir), passages(spark, sf_dir)
    return X.bm25(index, X.query_weights(index, q), pairs=X.all_terms_match(index, q))


def e13_text_search(spark, sf_dir):
    return X.text_search(text_index(spark, sf_dir), passages(spark, sf_dir))


def e13_top_documents(spark, sf_dir):
    """The best documents with all terms, by block bounds."""
    return X.top_documents(text_index(spark, sf_dir), passages(spark, sf_dir))[0]


def split_word_queries(spark, sf_dir):
    """Queries: a word and two that a _ joins of every 50th document, and every benchmark text with its words joined in pairs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 50 = 0")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    none = F.lit(None).cast("string")
    pair = F.translate(F.regexp_extract("text", "[a-z]+ [a-z]+", 0), " ", "_")
    some = docs.select(F.col("doc_id").alias("qid"), F.concat_ws(" ", F.regexp_extract("text", "[a-z]{5,}", 0), pair).alias("text"))
    whole = bench.select((-1 - F.col("item_id")).alias("qid"), F.regexp_replace("text", "([a-z]+) ([a-z]+)", "$1_$2").alias("text"))
    return some.unionByName(whole).select("qid", "text", none.alias("language"), none.alias("type"))


def e13_split_words(spark, sf_dir):
    return X.text_search(text_index(spark, sf_dir), split_word_queries(spark, sf_dir))


def e14_snippet(spark, sf_dir):
    index, q = text_index(spark, sf_dir), passages(spark, sf_dir)
    return X.snippets(index, q, X.text_search(index, q))


def touched(spark, sf_dir, found):
    names = found.select("item_key", stem(F.col("obsidian_path")).alias("title"))
    return view(spark, sf_dir, TOUCHES).join(names, "title").select("item_key", "ts")


def activity_of(spark, sf_dir):
    found = items_of(stored(spark, sf_dir))
    return A.build_activity(touched(spark, sf_dir, found), found), found


def f1_build_activity(spark, sf_dir):
    return activity_of(spark, sf_dir)[0]


def activity_view(spark, sf_dir):
    act, found = activity_of(spark, sf_dir)
    return A.item_activity_view(found, act)


def f2_item_activity_view(spark, sf_dir):
    return activity_view(spark, sf_dir)


def f3_report(name, spark, sf_dir):
    return A.activity_report(activity_view(spark, sf_dir), name, AS_OF).select("item_key", "access_count", "last_accessed_at", "seen_count")


def f4_sync_activity(spark, sf_dir):
    notes = stored(spark, sf_dir)
    found = items_of(notes)
    return A.sync_activity(notes, A.item_activity_view(found, A.build_activity(touched(spark, sf_dir, found), found)))


def g1_sentences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    return E.sentences(docs).select("path", "sentence", "normalized")


def g2_extract_sentences(spark, sf_dir):
    return E.extract_sentences(stored(spark, sf_dir), AS_OF)


def g3_extract_summary(spark, sf_dir):
    return E.extract_summary(written(E.extract_sentences(stored(spark, sf_dir), AS_OF), "sentences"))


def g4_annotate(spark, sf_dir):
    notes = stored(spark, sf_dir)
    return E.annotate(notes, items_of(notes))


def g5_match_terms(spark, sf_dir):
    notes = stored(spark, sf_dir)
    return E.match_terms(E.vocabulary(notes), E.sentence_notes(notes))


def phrase_terms(spark, sf_dir):
    """Terms of one to four words, some cut inside words or with a sign, from the start of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    term = F.when(F.col("doc_id") % 5 == 0, F.regexp_extract("text", "[a-z]{2} [a-z]{2}", 0)).when(F.col("doc_id") % 5 == 1, F.regexp_extract("text", "[a-z]+, [a-z]+", 0)).when(F.col("doc_id") % 5 == 2, F.regexp_extract("text", "[a-z]{2} [a-z]+ [a-z]{2}", 0)).when(F.col("doc_id") % 5 == 3, F.regexp_extract("text", "[a-z]+ [a-z]+ [a-z]+ [a-z]", 0)).otherwise(F.regexp_extract("text", "[a-z]+[.,]", 0))
    return docs.select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), norm_db(term).alias("term_norm"))


def g5_match_phrases(spark, sf_dir):
    """Terms of several words and with signs, in whole texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return E.match_terms(phrase_terms(spark, sf_dir), docs.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), norm_db(F.col("text")).alias("sentence_norm")))


def g6_enrich_links(spark, sf_dir):
    return E.enrich_links(stored(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        e1_exact_lookup, e2_find_items, e3_fuzzy_lookup, e3_levenshtein_lookup, e4_lookup, e5_graded_lookup, e6_consolidate, e7_with_relations, e8_tokens, e9_postings, e9_extended_index, e10_phrase_match,
        e11_all_terms_match, e12_bm25, e13_text_search, e13_top_documents, e13_split_words, e14_snippet, f1_build_activity, f2_item_activity_view, f4_sync_activity, g1_sentences, g2_extract_sentences, g3_extract_summary,
        g4_annotate, g5_match_terms, g5_match_phrases, g6_enrich_links,
    )
}
QUERIES |= {f"f3_{name.replace('-', '_')}": partial(f3_report, name) for name in A.VIEWS}

_tok = lambda x: f"list_filter(string_split(regexp_replace(translate(lower({x}), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_terms = f"terms AS (SELECT item_id AS qid, regexp_extract(text, '[a-z]{{5,}}', 0) AS text, CASE WHEN item_id % 2 = 0 THEN 'english' END AS lang FROM benchmark), asked AS (SELECT *, {O.norm_db('text')} AS norm FROM terms)"
_doc_words = f"terms AS (SELECT doc_id AS qid, regexp_extract(text, '[a-z]{{5,}}', 0) AS text, CASE WHEN lang = 'en' THEN 'english' END AS lang FROM documents), asked AS (SELECT *, {O.norm_db('text')} AS norm FROM terms)"
_words = f"asked AS (SELECT item_id AS qid, {_tok('text')} AS t FROM benchmark UNION ALL SELECT -1 - item_id, {_tok("regexp_extract(text, '[a-z]{5,}', 0)")} FROM benchmark), q AS (SELECT qid, unnest(t) AS term, unnest(range(len(t))) AS ord, len(t) AS n_terms FROM asked)"
_fits = "(a.lang IS NULL OR a.lang = i.language)"
_docs = f"docs AS (SELECT path, item_key, type, language, text AS title, {O.clean_body('body')} AS body FROM counted)"
_postings = f"""{_docs}, cells AS (SELECT path, 'title' AS col, {_tok('title')} AS t FROM docs UNION ALL SELECT path, 'body', {_tok('body')} FROM docs),
tokens AS (SELECT path, col, unnest(t) AS term, unnest(range(len(t))) AS pos FROM cells)"""
_all = "per AS (SELECT qid, count(DISTINCT term) AS n FROM q GROUP BY qid), every_term AS (SELECT h.qid, h.path FROM (SELECT qid, path, count(DISTINCT term) AS n FROM q JOIN tokens USING (term) GROUP BY qid, path) h JOIN per p ON p.qid = h.qid AND p.n = h.n)"
_bm25 = f"""tf AS (SELECT term, path, count(*) AS tf FROM tokens GROUP BY ALL), lens AS (SELECT path, sum(tf) AS len FROM tf GROUP BY path), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
stats AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM lens),
scored AS (
    SELECT q.qid, tf.path, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * {S.K1 + 1} / (tf + {S.K1} * ({1 - S.B} + {S.B} * len / avg_len))) AS score
    FROM (SELECT DISTINCT qid, term FROM q) q JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (path), stats GROUP BY q.qid, tf.path
)"""
_phrase = "phrase AS (SELECT DISTINCT qid, path FROM (SELECT q.qid, t.path, t.col, t.pos - q.ord AS start, n_terms, count(*) AS n FROM q JOIN tokens t USING (term) GROUP BY ALL) WHERE n = n_terms)"
_first_ten = "QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pass, round(score, 6) DESC, path) <= 10"
_lookup = f"look AS (SELECT item_key, split_part(item_key, '|', 1) AS type, split_part(item_key, '|', 2) AS language, array_to_string(string_split(item_key, '|')[3:], '|') AS normalized, title, path AS file_path, CASE WHEN length({O.collapse(O.strip('body'))}) > 180 THEN substr({O.collapse(O.strip('body'))}, 1, 177) || '...' ELSE {O.collapse(O.strip('body'))} END AS text_preview FROM docs)"
_rich = "(CASE WHEN coalesce(title, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(file_path, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(text_preview, '') <> '' THEN 1 ELSE 0 END)"
_act = f""", names AS (SELECT item_key, status, {O.stem('obsidian_path')} AS title FROM items), touches AS ({TOUCHES}),
act AS (
    SELECT item_key, count(*) AS access_count, max(ts) AS last_accessed_at, CASE WHEN any_value(status) IN ('ignored', 'archived') THEN 'ignored' ELSE 'active' END AS review_status, 'normal' AS review_priority, 14 AS stale_after_days
    FROM touches JOIN names USING (title) GROUP BY item_key
),
act_view AS (
    SELECT i.item_key, i.type, i.language, i.text, i.status, i.seen_count, i.obsidian_path, coalesce(access_count, 0) AS access_count, last_accessed_at, coalesce(review_status, 'unreviewed') AS review_status,
           coalesce(review_priority, 'normal') AS review_priority, coalesce(stale_after_days, 14) AS stale_after_days FROM items i LEFT JOIN act a ON a.item_key = i.item_key
)"""
_report = {
    "never-accessed": "WHERE access_count = 0 ORDER BY seen_count DESC, text, item_key",
    "least-accessed": "ORDER BY access_count, seen_count DESC, text, item_key",
    "oldest-accessed": "WHERE last_accessed_at IS NOT NULL ORDER BY last_accessed_at, item_key",
    "recently-accessed": "WHERE last_accessed_at IS NOT NULL ORDER BY last_accessed_at DESC, item_key",
    "high-seen-low-access": "WHERE seen_count >= 2 AND access_count <= 1 ORDER BY seen_count DESC, access_count, item_key",
    "stale-learning": f"WHERE status = 'learning' AND (last_accessed_at IS NULL OR last_accessed_at <= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS) ORDER BY last_accessed_at NULLS FIRST, seen_count DESC, item_key",
}
_mark = "regexp_replace({0}, '([.!?。！？]){1}+', '\\1' || chr(1), 'g')"


def _sentences(source: str, normal, extract: bool) -> str:
    """The SQL of sentences() over source(path, text)."""
    drop = "AND NOT regexp_matches(sentence, '^[^\\p{L}\\p{N}]+$')" if extract else ""
    return f"""SELECT path, ord, sentence, normalized FROM (
        SELECT path, ord, sentence, {normal('sentence')} AS normalized FROM (
            SELECT path, {O.strip('part')} AS sentence, ord FROM (
                SELECT path, unnest(p) AS part, unnest(range(len(p))) AS ord FROM (SELECT path, string_split({_mark.format(O.strip('text'), O.S)}, chr(1)) AS p FROM {source})
            )
        ) WHERE length(sentence) BETWEEN 2 AND 300 {drop}
    ) QUALIFY row_number() OVER (PARTITION BY path, normalized ORDER BY ord) = 1"""


ORACLE = {
    "e1_exact_lookup": PRELUDE + f", {_doc_words} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY seen_count DESC, updated_at DESC, item_key) AS rank, item_key, i.text, seen_count FROM items i JOIN asked a ON a.norm = i.normalized WHERE {_fits}",
    "e2_find_items": PRELUDE
    + f""", {_terms}, exact AS (SELECT qid, 'exact' AS match, row_number() OVER (PARTITION BY qid ORDER BY CASE i.type WHEN 'vocabulary' THEN 1 WHEN 'sentence' THEN 2 WHEN 'grammar' THEN 3 ELSE 9 END, i.language, i.text, item_key) AS rank, item_key FROM items i JOIN asked a ON a.norm = i.normalized WHERE {_fits})
    SELECT * FROM exact UNION ALL
    SELECT qid, 'contains', row_number() OVER (PARTITION BY qid ORDER BY seen_count DESC, i.text, item_key) AS rank, item_key FROM items i JOIN asked a ON contains(i.normalized, a.norm) WHERE a.norm <> '' AND {_fits} AND qid NOT IN (SELECT qid FROM exact) QUALIFY rank <= 10""",
    "e3_levenshtein_lookup": PRELUDE
    + f", {_terms} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, seen_count DESC, item_key) AS rank, item_key, distance FROM (SELECT qid, item_key, seen_count, levenshtein(translate(i.normalized, 'éóèñüçäöêßíúá', chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7)||chr(8)||chr(14)||chr(15)||chr(16)||chr(17)||chr(18)), a.norm) AS distance FROM items i JOIN asked a ON abs(length(i.normalized) - length(a.norm)) <= 2 WHERE {_fits}) WHERE distance <= 2 QUALIFY rank <= 10",
    "e5_graded_lookup": PRELUDE
    + f""", {_docs}, {_lookup}, one AS (SELECT * FROM look QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY {_rich} DESC, file_path) = 1), {_terms}
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, type, language, normalized) AS rank, item_key, score FROM (
        SELECT qid, i.*, CASE WHEN lower(a.text) = lower(item_key) THEN 100 WHEN lower(a.text) = lower(normalized) THEN 90 WHEN starts_with(lower(normalized), lower(a.text)) THEN 75 WHEN contains(lower(normalized), lower(a.text)) THEN 60 WHEN contains(lower(title), lower(a.text)) OR contains(lower(text_preview), lower(a.text)) THEN 40 END AS score
        FROM one i, asked a WHERE a.text <> '' AND {_fits}) WHERE score IS NOT NULL QUALIFY rank <= 20""",
    "e6_consolidate": GRAPH
    + f""", {_docs}, {_lookup} SELECT item_key, type, language, normalized, title, file_path, text_preview FROM (SELECT *, 0 AS src FROM look UNION ALL SELECT item_key, item_type, language, normalized, NULL, path, NULL, 1 FROM rel_keys)
    QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY {_rich} DESC, src, file_path) = 1""",
    "e7_with_relations": GRAPH
    + f""", {_doc_words}, hits AS (SELECT qid, item_key FROM items i JOIN asked a ON a.norm = i.normalized WHERE {_fits}), listed AS (SELECT item_key, count(*) AS n FROM views GROUP BY item_key)
    SELECT qid, h.item_key, coalesce(n, 0) AS n_relations, direction, relation_type, other_key FROM hits h LEFT JOIN listed l ON l.item_key = h.item_key LEFT JOIN views v ON v.item_key = h.item_key""",
    "e8_tokens": f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)",
    "e9_postings": PRELUDE + f", {_postings} SELECT term, path, col, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM tokens GROUP BY term, path, col",
    "e9_extended_index": PRELUDE + f", {_postings} SELECT term, path, col, count(*) AS tf, df, string_agg(pos, ',' ORDER BY pos) AS positions FROM tokens JOIN (SELECT term, count(DISTINCT path) AS df FROM tokens GROUP BY term) USING (term) GROUP BY term, path, col, df",
    "e13_top_documents": PRELUDE + f", {_postings}, {_words}, {_all}, {_bm25} SELECT qid, path, round(score, 6) AS score FROM scored JOIN every_term USING (qid, path) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, path) <= 10",
    "e10_phrase_match": PRELUDE + f", {_postings}, {_words} SELECT DISTINCT qid, path FROM (SELECT q.qid, t.path, t.col, t.pos - q.ord AS start, n_terms, count(*) AS n FROM q JOIN tokens t USING (term) GROUP BY ALL) WHERE n = n_terms",
    "e11_all_terms_match": PRELUDE + f", {_postings}, {_words}, {_all} SELECT qid, path FROM every_term",
    "e12_bm25": PRELUDE + f", {_postings}, {_words}, {_all}, {_bm25} SELECT qid, path, round(score, 6) AS score FROM scored JOIN every_term USING (qid, path)",
    "e13_text_search": PRELUDE
    + f""", {_postings}, {_words}, {_all}, {_bm25}, phrase AS (SELECT DISTINCT qid, path FROM (SELECT q.qid, t.path, t.col, t.pos - q.ord AS start, n_terms, count(*) AS n FROM q JOIN tokens t USING (term) GROUP BY ALL) WHERE n = n_terms),
    found AS (SELECT qid, path, min(pass) AS pass FROM (SELECT qid, path, 1 AS pass FROM phrase UNION ALL SELECT qid, path, 2 FROM every_term) GROUP BY qid, path)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pass, round(score, 6) DESC, path) AS rank, path, pass, round(score, 6) AS score FROM found JOIN scored USING (qid, path) QUALIFY rank <= 10""",
    "e13_split_words": PRELUDE
    + f""", {_postings}, asked AS (
        SELECT doc_id AS qid, regexp_extract(text, '[a-z]{{5,}}') || ' ' || replace(regexp_extract(text, '[a-z]+ [a-z]+'), ' ', '_') AS text FROM documents WHERE doc_id % 50 = 0
        UNION ALL SELECT -1 - item_id, regexp_replace(text, '([a-z]+) ([a-z]+)', '\\1_\\2', 'g') FROM benchmark
    ), q AS (SELECT qid, unnest(t) AS term, unnest(range(len(t))) AS ord, len(t) AS n_terms FROM (SELECT qid, {_tok('text')} AS t FROM asked)), {_bm25}, {_phrase},
    said AS (SELECT qid, unnest(w) AS word, unnest(range(len(w))) AS k, len(w) AS n_words FROM (SELECT qid, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM asked)),
    pieces AS (SELECT qid, k, n_words, unnest(t) AS term, unnest(range(len(t))) AS ord, len(t) AS n_terms FROM (SELECT *, {_tok('word')} AS t FROM said)),
    word_hits AS (SELECT DISTINCT qid, k, n_words, path FROM (SELECT p.qid, p.k, n_words, t.path, t.col, t.pos - p.ord AS start, n_terms, count(*) AS n FROM pieces p JOIN tokens t USING (term) GROUP BY ALL) WHERE n = n_terms),
    every_word AS (SELECT qid, path FROM word_hits GROUP BY qid, path, n_words HAVING count(*) = n_words),
    found AS (SELECT qid, path, min(pass) AS pass FROM (SELECT qid, path, 1 AS pass FROM phrase UNION ALL SELECT qid, path, 2 FROM every_word) GROUP BY qid, path)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pass, round(score, 6) DESC, path) AS rank, path, pass, round(score, 6) AS score FROM found JOIN scored USING (qid, path) QUALIFY rank <= 10""",
    "e14_snippet": PRELUDE
    + f""", {_postings}, {_words}, {_all}, {_bm25}, {_phrase},
    found AS (SELECT qid, path, min(pass) AS pass FROM (SELECT qid, path, 1 AS pass FROM phrase UNION ALL SELECT qid, path, 2 FROM every_term) GROUP BY qid, path),
    best AS (SELECT qid, path FROM found JOIN scored USING (qid, path) {_first_ten}),
    spelled AS (SELECT b.qid, b.path, t.pos, t.term, a.term IS NOT NULL AS hit FROM best b JOIN tokens t ON t.path = b.path AND t.col = 'body' LEFT JOIN (SELECT DISTINCT qid, term FROM q) a ON a.qid = b.qid AND a.term = t.term),
    windows AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY qid, path ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n, count(*) OVER (PARTITION BY qid, path) AS len FROM spelled),
    starts AS (SELECT qid, path, len, pos AS first FROM windows WHERE pos <= greatest(len - 20, 0) QUALIFY row_number() OVER (PARTITION BY qid, path ORDER BY n DESC, pos) = 1),
    shown AS (SELECT qid, path, first, len, string_agg(CASE WHEN hit THEN '[' || term || ']' ELSE term END, ' ' ORDER BY pos) AS words FROM starts JOIN spelled USING (qid, path) WHERE pos BETWEEN first AND first + 19 GROUP BY qid, path, first, len)
    SELECT qid, path, coalesce(CASE WHEN first > 0 THEN ' ... ' ELSE '' END || words || CASE WHEN first + 20 < len THEN ' ... ' ELSE '' END, '') AS snippet FROM best LEFT JOIN shown USING (qid, path)""",
    "g5_match_phrases": f"""WITH terms AS (SELECT 't' || doc_id AS path, lang, {O.norm_db("CASE doc_id % 5 WHEN 0 THEN regexp_extract(text, '[a-z]{2} [a-z]{2}', 0) WHEN 1 THEN regexp_extract(text, '[a-z]+, [a-z]+', 0) WHEN 2 THEN regexp_extract(text, '[a-z]{2} [a-z]+ [a-z]{2}', 0) WHEN 3 THEN regexp_extract(text, '[a-z]+ [a-z]+ [a-z]+ [a-z]', 0) ELSE regexp_extract(text, '[a-z]+[.,]', 0) END")} AS term FROM documents),
    said AS (SELECT 's' || doc_id AS path, lang, {O.norm_db('text')} AS sentence FROM documents)
    SELECT s.path AS sentence_path, t.path AS term_path FROM said s JOIN terms t ON t.lang = s.lang AND length(t.term) >= 3 AND contains(s.sentence, t.term)
    WHERE contains(t.term, ' ') OR regexp_matches(' ' || s.sentence || ' ', '[^A-Za-z0-9_ÄÖÜäöüß]' || regexp_escape(t.term) || '[^A-Za-z0-9_ÄÖÜäöüß]')""",
    "f1_build_activity": PRELUDE + _act + " SELECT * FROM act",
    "f2_item_activity_view": PRELUDE + _act + " SELECT * FROM act_view",
    "g1_sentences": f"SELECT path, sentence, normalized FROM ({_sentences('(SELECT doc_id AS path, text FROM documents)', O.norm_ext, True)})",
}
ORACLE |= {f"f3_{k.replace('-', '_')}": PRELUDE + _act + f" SELECT item_key, access_count, last_accessed_at, seen_count FROM act_view {v} LIMIT 20" for k, v in _report.items()}

_synced = "'access_count: ' || access_count || chr(10) || 'last_accessed_at: ' || strftime(last_accessed_at, '%Y-%m-%dT%H:%M:%S') || chr(10) || 'last_reviewed_at:' || chr(10) || 'review_status: ' || review_status || chr(10) || 'review_priority: normal' || chr(10) || 'stale_after_days: 14'"
ORACLE["f4_sync_activity"] = PRELUDE + _act + f""" SELECT path, 6 AS n_changed, '---' || chr(10) || regexp_replace(raw_fm, '^\\n+|\\n+$', '', 'g') || chr(10) || {_synced} || chr(10) || '---' || chr(10) || chr(10) || body AS text
FROM act_view JOIN cut ON path = obsidian_path WHERE has_fm AND access_count > 0"""
