"""Small literal notes with rows written by hand."""

from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import graph as G
from notelake.operators import index as I
from notelake.operators import notes as N
from notelake.sources import files

AS_OF = "2024-02-01 00:00:00"


def column(spark, f, *values):
    return [r.y for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x")).alias("y")).collect()]


def test_front_matter_with_a_list(notes):
    row = N.parse_frontmatter(notes(("a.md", '---\ntype: vocabulary\nlanguage: german\nterm: "trotzdem"\ntags:\n  - a\n  - b\n---\n\n# trotzdem\n'))).first()
    assert row.has_fm and row.props == {"type": ["vocabulary"], "language": ["german"], "term": ["trotzdem"], "tags": ["a", "b"]}
    assert row.body == "# trotzdem\n"


def test_without_or_with_broken_front_matter(notes):
    rows = {r.path: r for r in N.parse_frontmatter(notes(("a", "plain text"), ("b", "---\ntype: x\n"), ("c", None), ("d", ""))).collect()}
    assert [rows[p].has_fm for p in "abcd"] == [False] * 4
    assert [rows[p].body for p in "abcd"] == ["plain text", "---\ntype: x\n", "", ""] and rows["a"].props == {}


def test_value_with_dashes_cuts_the_block(notes):
    row = N.parse_frontmatter(notes(("a", "---\ntype: x\ntitle: a---b\nlevel: 1\n---\nbody"))).first()
    assert row.props == {"type": ["x"], "title": ["a"]} and row.body.startswith("b\nlevel: 1")


def test_later_keys_overwrite_and_lines_close_lists(notes):
    row = N.parse_frontmatter(notes(("a", "---\nx: 1\nx: 2\nl:\n- a\nno colon\n- b\nn: null\n---\n"))).first()
    assert row.props == {"x": ["2"], "l": ["a"], "n": [""]}


def test_normal_forms(spark):
    assert column(spark, T.norm_db, "  Guten   Morgen!? ", 'a " b', "Straße.") == ["guten morgen", "a  b", "straße"]
    assert column(spark, T.norm_ext, "Ja!") == ["ja!"]
    assert column(spark, T.norm_cell, " A\t b ") == ["A b"]


def test_keys(spark):
    got = spark.createDataFrame([("a | b |c|d",), ("a|b",), (None,)], "k string").select(T.parse_key(F.col("k")).alias("p")).collect()
    assert tuple(got[0].p) == ("a", "b", "c|d") and got[1].p is None and got[2].p is None


def test_last_note_wins_and_first_date_stays(notes):
    note = "---\ntype: vocabulary\nlanguage: de\nterm: Haus{}\nseen_count: {}\ncreated_at: {}\n---\n"
    rows = I.build_items(N.parse_frontmatter(notes(("Vocabulary/b.md", note.format(".", 2, "2024")), ("Vocabulary/a.md", note.format("", 1, "2023")))), AS_OF).collect()
    assert [(r.normalized, r.seen_count, r.created_at, r.obsidian_path) for r in rows] == [("haus", 2, "2023", "Vocabulary/b.md")]


def test_skip_reasons(notes):
    fm = "---\ntype: {}\nterm: '{}'\n---\n"
    rows = I.classify_notes(N.parse_frontmatter(notes(("x/Sentence Bank.md", fm.format("sentence", "a")), ("x/a.md", "text"), ("x/b.md", fm.format("odd", "a")), ("Vocabulary/....md", fm.format("vocabulary", "")), ("x/d.md", fm.format("vocabulary", "w"))))).collect()
    assert {r.path: r.skip_reason for r in rows} == {"x/Sentence Bank.md": "aggregate_note", "x/a.md": "missing_frontmatter", "x/b.md": "unknown_type", "Vocabulary/....md": "empty_text", "x/d.md": None}


SENTENCE = "---\ntype: sentence\nlanguage: german\nsentence: {}\n---\n\n## Relations\n\n### {}\n\n- [[{}]]\n"
WORD = "---\ntype: vocabulary\nlanguage: german\nterm: {}\n---\n\n## Related Grammar\n\n- [[{}]]\n"
RULE = "---\ntype: grammar\nlanguage: german\ntitle: {}\n---\n"


def edges(spark, df):
    got = G.build_relations(N.parse_frontmatter(df), G.taxonomy(spark)).collect()
    return sorted((r.source_key, r.relation_type, r.target_key) for r in got)


def test_typed_and_legacy_edges_and_todo(spark, notes):
    df = notes(("S/s.md", SENTENCE.format("Trotzdem.", "Contains Vocabulary", "V/w|w")), ("V/w.md", WORD.format("trotzdem", "g")), ("G/g.md", RULE.format("Satz")), ("S/t.md", SENTENCE.format("Nein.", "Contains Vocabulary", "TODO")))
    assert edges(spark, df) == [("sentence|german|trotzdem", "contains_vocabulary", "vocabulary|german|trotzdem"), ("vocabulary|german|trotzdem", "uses_grammar", "grammar|german|satz")]


def test_symmetric_pair_is_one_edge(spark, notes):
    df = notes(("S/a.md", SENTENCE.format("A", "Similar To", "S/b")), ("S/b.md", SENTENCE.format("B", "Similar To", "S/a")))
    assert edges(spark, df) == [("sentence|german|a", "similar_to", "sentence|german|b")]


def test_edges_are_compared_without_the_texts_in_their_keys(spark, notes, monkeypatch):
    held, dedupe = [], G.dedupe_edges
    monkeypatch.setattr(G, "dedupe_edges", lambda e: (held.append(e.agg(F.max(F.length(F.concat("source_key", "target_key")))).first()[0]), dedupe(e))[1])
    long = ["Wort " * 2000 + x for x in "AB"]
    df = notes(("S/a.md", SENTENCE.format(long[0], "Similar To", "S/b")), ("S/b.md", SENTENCE.format(long[1], "Similar To", "S/a")), ("V/w.md", WORD.format("w", "g")), ("G/g.md", RULE.format("Satz")))
    keys = [f"sentence|german|{x.lower()}" for x in long]
    assert edges(spark, df) == [(keys[0], "similar_to", keys[1]), ("vocabulary|german|w", "uses_grammar", "grammar|german|satz")]
    assert held[0] < 200


def test_no_edges_is_an_issue(spark, notes):
    rel = G.build_relations(N.parse_frontmatter(notes(("a.md", "x"))), G.taxonomy(spark))
    assert [r.code for r in G.audit_relations(rel, spark.createDataFrame([], "item_key string"), G.taxonomy(spark)).collect()] == ["no_relations_found"]


def test_folder_scan_and_change_set(spark, tmp_path):
    for path, text in (("Vocabulary/trotz dem+.md", "eins"), (".obsidian/x.md", "no"), ("b.txt", "no"), ("Sentences/s.md", "zwei")):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    found = files.read_notes(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("Sentences/s.md", "zwei"), ("Vocabulary/trotz dem+.md", "eins")]
    after = found.withColumn("text", F.when(F.col("path").startswith("S"), "drei").otherwise(F.col("text")))
    assert {r.path[0]: r.status for r in files.change_set(found, after).collect()} == {"S": "would_update", "V": "unchanged"}
    assert {r.status for r in files.change_set(after, after).collect()} == {"unchanged"}
