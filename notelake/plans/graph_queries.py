"""Queries over the relation graph, with their SQL."""

from __future__ import annotations

from notelake.operators import graph as G
from notelake.plans import oracle as O
from notelake.plans.index_queries import items_of, parsed, stored
from notelake.plans.oracle import PRELUDE
from notelake.sources.tables import written

EDGE = ["source_key", "target_key", "relation_type", "confidence", "evidence"]
CANDIDATE = ["path", "relation_type", "target", "confidence", "evidence"]


def relations_of(notes, spark):
    return written(G.build_relations(notes, G.taxonomy(spark)), "relations")


def relations(spark, sf_dir):
    return relations_of(stored(spark, sf_dir), spark)


def d1_generic_candidates(spark, sf_dir):
    return G.generic_candidates(parsed(spark, sf_dir)).select(*CANDIDATE)


def d2_legacy_candidates(spark, sf_dir):
    return G.legacy_candidates(parsed(spark, sf_dir)).select(*CANDIDATE)


def d3_relation_keys(spark, sf_dir):
    return G.relation_keys(parsed(spark, sf_dir)).select("path", "link", "title", "item_key")


def resolved(spark, sf_dir):
    rows = stored(spark, sf_dir)
    return G.resolve_links(G.generic_candidates(rows).unionByName(G.legacy_candidates(rows)), G.relation_keys(rows))


def d4_resolve_links(spark, sf_dir):
    return resolved(spark, sf_dir).select("path", "relation_type", "target", "source_key", "target_key")


def d5_validate_edges(spark, sf_dir):
    return G.validate_edges(resolved(spark, sf_dir), G.taxonomy(spark)).select("path", "source_key", "target_key", "relation_type", "symmetric")


def d6_canonical_edges(spark, sf_dir):
    return G.canonical_edges(G.validate_edges(resolved(spark, sf_dir), G.taxonomy(spark))).select("path", "source_key", "target_key", "relation_type")


def d7_dedupe_edges(spark, sf_dir):
    return G.build_relations(stored(spark, sf_dir), G.taxonomy(spark)).select(*EDGE)


def d8_build_relations(spark, sf_dir):
    return relations(spark, sf_dir).select(*EDGE, "source_path", "target_path")


def d9_list_relations(spark, sf_dir):
    return G.list_relations(relations(spark, sf_dir).select("source_key", "target_key", "relation_type"))


def d10_search_keys(spark, sf_dir):
    return G.search_keys(relations(spark, sf_dir), "doc_1")


def d11_neighbors(spark, sf_dir):
    notes = stored(spark, sf_dir)
    return G.neighbors(relations_of(notes, spark), items_of(notes).filter("type = 'vocabulary'"))


def d12_relation_views(spark, sf_dir):
    return G.relation_views(relations(spark, sf_dir))


def d13_known_keys(spark, sf_dir):
    notes = stored(spark, sf_dir)
    return G.known_keys(items_of(notes), G.relation_keys(notes))


def audit(spark, sf_dir):
    notes = stored(spark, sf_dir)
    rel = relations_of(notes, spark)
    return G.audit_relations(rel, items_of(notes).select("item_key"), G.taxonomy(spark)), rel


def d14_audit_relations(spark, sf_dir):
    return audit(spark, sf_dir)[0]


def d14_duplicate_rows(spark, sf_dir):
    """The rows of edges that are stated more than once, before only the first is kept."""
    edges = G.canonical_edges(G.validate_edges(resolved(spark, sf_dir), G.taxonomy(spark)))
    return G.duplicate_rows(written(edges, "stated-edges")).select("source_key", "relation_type", "target_key", "n", "path")


def d15_audit_summary(spark, sf_dir):
    issues, rel = audit(spark, sf_dir)
    return G.audit_summary(written(issues, "issues"), rel)


QUERIES = {
    f.__name__: f
    for f in (
        d1_generic_candidates, d2_legacy_candidates, d3_relation_keys, d4_resolve_links, d5_validate_edges, d6_canonical_edges, d7_dedupe_edges, d8_build_relations, d9_list_relations,
        d10_search_keys, d11_neighbors, d12_relation_views, d13_known_keys, d14_audit_relations, d14_duplicate_rows, d15_audit_summary,
    )
}

_link = lambda x: f"lower(regexp_replace(regexp_replace(replace({O.strip(x)}, '\\', '/'), '\\.md$', ''), '^/+|/+$', '', 'g'))"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_types = ", ".join(f"('{i}', {_list(s)}, {_list(t)}, {str(y).lower()})" for i, s, t, y in G.TAXONOMY)
_legacy = ", ".join(f"({n}, '{h}', '{r}')" for n, (h, r) in enumerate(G.LEGACY_SECTIONS.items()))
_links = r"regexp_extract_all(content, '\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 1)"

#: Common tables of the graph, from lines and windows.
GRAPH = PRELUDE + f""", taxonomy(id, source_types, target_types, mutual) AS (VALUES {_types}),
legacy(n, heading, relation_type) AS (VALUES {_legacy}),
rel_keys AS (
    SELECT *, item_type || '|' || language || '|' || normalized AS item_key FROM (
        SELECT path, {_link('path')} AS link, {O.norm_db(O.stem('path'))} AS title, lower({O.strip('p_type')}) AS item_type, coalesce(nullif(lower({O.strip('p_language')}), ''), 'unknown') AS language,
               coalesce(nullif(lower({O.strip('p_normalized')}), ''), {O.norm_db("coalesce(nullif(p_term, ''), nullif(p_sentence, ''), nullif(p_title, ''), " + O.stem('path') + ")")}) AS normalized
        FROM props WHERE has_fm
    ) WHERE item_type <> '' AND normalized <> ''
),
body_lines AS (SELECT path, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM cut),
l2 AS (SELECT path, n, line, count(*) FILTER (regexp_matches(line, '^##[ \\t]')) OVER (PARTITION BY path ORDER BY n) AS sec FROM body_lines),
l2_head AS (SELECT path, sec, lower({O.strip('substr(line, 3)')}) AS heading FROM l2 WHERE regexp_matches(line, '^##[ \\t]')),
l2_first AS (SELECT path, heading, min(sec) AS sec FROM l2_head GROUP BY path, heading),
l2_lines AS (SELECT l.path, l.n, l.line, f.heading FROM l2 l JOIN l2_first f ON f.path = l.path AND f.sec = l.sec WHERE NOT regexp_matches(l.line, '^##[ \\t]')),
legacy_found AS (
    SELECT path, 1 AS origin, g.n AS ord, g.relation_type, 0.95::DOUBLE AS confidence, 'legacy_section:' || heading AS evidence, content FROM (
        SELECT path, heading, string_agg(line, chr(10) ORDER BY n) AS content FROM l2_lines GROUP BY path, heading
    ) JOIN legacy g USING (heading)
),
l3 AS (SELECT path, n, line, count(*) FILTER (regexp_matches(line, '^###[ \\t]')) OVER (PARTITION BY path ORDER BY n) AS blk FROM l2_lines WHERE heading = 'relations'),
l3_block AS (
    SELECT path, blk, max({O.strip('substr(line, 4)')}) FILTER (regexp_matches(line, '^###[ \\t]')) AS heading, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT regexp_matches(line, '^###[ \\t]')), '') AS content
    FROM l3 WHERE blk > 0 GROUP BY path, blk
),
l3_typed AS (SELECT *, lower(regexp_extract(content, '(?im)^relation_type:[ \\t]*`?([a-zA-Z0-9_]+)`?[ \\t]*$', 1)) AS stated, replace({O.norm_db('heading')}, ' ', '_') AS headed FROM l3_block),
generic_found AS (
    SELECT path, 0 AS origin, blk AS ord, CASE WHEN stated IN (SELECT id FROM taxonomy) THEN stated ELSE headed END AS relation_type, 1.0::DOUBLE AS confidence, 'generic_relations_section:' || heading AS evidence, content
    FROM l3_typed WHERE stated IN (SELECT id FROM taxonomy) OR headed IN (SELECT id FROM taxonomy)
),
cands AS (
    SELECT path, origin, ord, pos, relation_type, {O.strip('target')} AS target, confidence, evidence FROM (
        SELECT *, unnest({_links}) AS target, unnest(range(len({_links}))) AS pos FROM (SELECT * FROM generic_found UNION ALL SELECT * FROM legacy_found)
    ) WHERE {O.strip('target')} <> '' AND upper({O.strip('target')}) <> 'TODO'
),
resolved AS (
    SELECT c.*, s.item_key AS source_key, coalesce(p.item_key, t.item_key) AS target_key
    FROM cands c JOIN rel_keys s ON s.path = c.path
    LEFT JOIN (SELECT link, arg_max(item_key, path) AS item_key FROM rel_keys GROUP BY link) p ON p.link = {_link('c.target')}
    LEFT JOIN (SELECT title, min(item_key) AS item_key FROM rel_keys GROUP BY title HAVING count(*) = 1) t ON t.title = {O.norm_db(O.stem("regexp_replace(" + O.strip('c.target') + ", '\\.md$', '')"))}
    WHERE coalesce(p.item_key, t.item_key) IS NOT NULL
),
valid AS (
    SELECT r.*, x.mutual FROM resolved r JOIN taxonomy x ON x.id = r.relation_type
    WHERE list_contains(x.source_types, split_part(source_key, '|', 1)) AND list_contains(x.target_types, split_part(target_key, '|', 1)) AND confidence BETWEEN 0 AND 1
),
canonical AS (
    SELECT path, origin, ord, pos, relation_type, confidence, evidence, CASE WHEN mutual THEN least(source_key, target_key) ELSE source_key END AS source_key,
           CASE WHEN mutual THEN greatest(source_key, target_key) ELSE target_key END AS target_key FROM valid
),
deduped AS (SELECT * FROM canonical QUALIFY row_number() OVER (PARTITION BY source_key, target_key, relation_type ORDER BY path, origin, ord, pos) = 1),
key_paths AS (SELECT item_key, regexp_replace(max(path), '\\.md$', '') AS path FROM rel_keys GROUP BY item_key),
relations AS (SELECT d.source_key, d.target_key, d.relation_type, d.confidence, d.evidence, a.path AS source_path, b.path AS target_path FROM deduped d LEFT JOIN key_paths a ON a.item_key = d.source_key LEFT JOIN key_paths b ON b.item_key = d.target_key),
views AS (
    SELECT source_key AS item_key, 'outgoing' AS direction, relation_type, target_key AS other_key, target_path AS other_path FROM relations
    UNION ALL SELECT target_key, 'incoming', relation_type, source_key, source_path FROM relations
),
issues AS (
    SELECT 'error' AS severity, 'unknown_relation_type' AS code, source_key, relation_type, target_key FROM relations WHERE relation_type NOT IN (SELECT id FROM taxonomy)
    UNION ALL SELECT 'error', 'dangling_source', source_key, relation_type, target_key FROM relations WHERE source_key NOT IN (SELECT item_key FROM items)
    UNION ALL SELECT 'error', 'dangling_target', source_key, relation_type, target_key FROM relations WHERE target_key NOT IN (SELECT item_key FROM items)
    UNION ALL SELECT 'warning', 'duplicate_relation', source_key, relation_type, target_key FROM relations GROUP BY 3, 4, 5 HAVING count(*) > 1
    UNION ALL SELECT 'error', 'no_relations_found', NULL, NULL, NULL WHERE (SELECT count(*) FROM relations) = 0
)
"""
_label = O.cases("relation_type", {k: f"'{v}'" for k, v in G.LABELS.items()}, "array_to_string(list_transform(string_split(relation_type, '_'), lambda w: upper(w[1]) || substr(w, 2)), ' ')")
ORACLE = {
    "d1_generic_candidates": GRAPH + f"SELECT {', '.join(CANDIDATE)} FROM cands WHERE origin = 0",
    "d2_legacy_candidates": GRAPH + f"SELECT {', '.join(CANDIDATE)} FROM cands WHERE origin = 1",
    "d3_relation_keys": GRAPH + "SELECT path, link, title, item_key FROM rel_keys",
    "d4_resolve_links": GRAPH + "SELECT path, relation_type, target, source_key, target_key FROM resolved",
    "d5_validate_edges": GRAPH + 'SELECT path, source_key, target_key, relation_type, mutual AS "symmetric" FROM valid',
    "d6_canonical_edges": GRAPH + "SELECT path, source_key, target_key, relation_type FROM canonical",
    "d7_dedupe_edges": GRAPH + f"SELECT {', '.join(EDGE)} FROM deduped",
    "d8_build_relations": GRAPH + f"SELECT {', '.join(EDGE)}, source_path, target_path FROM relations",
    "d9_list_relations": GRAPH + "SELECT source_key, target_key, relation_type FROM relations ORDER BY source_key, relation_type, target_key LIMIT 50",
    "d10_search_keys": GRAPH
    + """SELECT * FROM (SELECT source_key AS item_key, source_path AS path FROM relations UNION SELECT target_key, target_path FROM relations)
    WHERE contains(lower(item_key), 'doc_1') OR contains(lower(path), 'doc_1') ORDER BY item_key, path LIMIT 20""",
    "d11_neighbors": GRAPH + "SELECT v.* FROM views v WHERE item_key IN (SELECT item_key FROM items WHERE type = 'vocabulary')",
    "d12_relation_views": GRAPH + f"SELECT item_key, direction, relation_type, other_key, {_label} AS label, array_to_string(string_split(other_key, '|')[3:], '|') AS other_text FROM views",
    "d13_known_keys": GRAPH + "SELECT item_key FROM items UNION SELECT item_key FROM rel_keys",
    "d14_audit_relations": GRAPH + "SELECT * FROM issues",
    "d14_duplicate_rows": GRAPH + "SELECT source_key, relation_type, target_key, count(*) OVER (PARTITION BY source_key, relation_type, target_key) AS n, path FROM canonical QUALIFY n > 1",
    "d15_audit_summary": GRAPH
    + """SELECT 'severity' AS dim, severity AS value, count(*) AS n FROM issues GROUP BY 2 UNION ALL SELECT 'code', code, count(*) FROM issues GROUP BY 2 UNION ALL SELECT 'relation_type', relation_type, count(*) FROM relations GROUP BY 2
    UNION ALL SELECT 'edges', 'valid', count(*) FROM relations r WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.severity = 'error' AND i.source_key = r.source_key AND i.target_key = r.target_key AND i.relation_type = r.relation_type)""",
}
