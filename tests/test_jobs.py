"""Queues, quality, search, activity, enrichment and streams on small literal tables."""

import json

from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import activity as A
from notelake.operators import enrich as E
from notelake.operators import notes as N
from notelake.operators import quality as H
from notelake.operators import queues as U
from notelake.operators import relation_notes as R
from notelake.operators import search as S
from notelake.sources import files
from notelake.sources.markdown import markdown_tables
from notelake.streaming import incremental


def test_key_normalizer(spark):
    rows = [("Trotzdem lerne ich Deutsch.", "sentence"), ("  a   b  c ", "vocabulary"), ("Mädchen", "vocabulary"), ("Straße!", "vocabulary"), ("ﬁn", "grammar")]
    got = H.norm_key(spark.createDataFrame(rows, "t string, k string"), "t", "k").collect()
    assert [r.key_text for r in got] == ["trotzdem lerne ich deutsch", "a b c", "mädchen", "strasse!", "fin"]
    assert got[0].operations == ["casefold", "strip_terminal_punctuation"] and got[1].operations == ["trim", "collapse_whitespace"] and got[4].operations == ["unicode:NFKC"]


def test_extract_key(notes):
    df = notes(("a", "---\nid: x|y|z|w\n---\n"), ("b", "---\ntype: t\nlang: de\nnormalized: n\n---\n"), ("c", "---\ntype: t\n---\n"))
    assert {r.path: (r.item_type, r.language, r.normalized) for r in H.extract_key(N.parse_frontmatter(df)).collect()} == {"a": ("x", "y", "z|w"), "b": ("t", "de", "n")}


def test_migrations_do_nothing_twice(notes):
    df = notes(("a", '---\ntype: tts_audio\ntags:\n  - old\nsource_path: "C:\\\\x\\\\y.mp3"\nsource_file: a\\\\b\n---\nbody'), ("b", "text"))
    for job in (lambda p: H.backfill_schema_version(p, "v1"), H.fix_paths, lambda p: H.sync_tags(p, p.select("path", F.array(F.lit("los/x")).alias("tags")))):
        once = job(N.parse_frontmatter(df))
        assert {r.path: r.status for r in files.change_set(df, once).collect()} == {"a": "would_update", "b": "unchanged"}
        assert {r.status for r in files.change_set(once, job(N.parse_frontmatter(once))).collect()} == {"unchanged"}
    fixed = H.fix_paths(N.parse_frontmatter(df)).filter("path = 'a'").first().text
    assert "\nsource_path: C:/x/y.mp3\nsource_file: a\\\\b\n" in fixed and fixed.endswith("\n---\n\nbody")


def test_tables_by_both_rules(notes):
    df = notes(("a", "## S\n| A | B |\n|---|:-:|\n| 1 | 2 |\n| ragged |\n\n| 3 | 4 |\n"))
    assert [(r.section, r.cells) for r in markdown_tables(df).orderBy("line_no").collect()] == [("S", {"A": "1", "B": "2"}), ("S", {"A": "3", "B": "4"})]
    assert [r.cells for r in markdown_tables(df, ["B"]).collect()] == [{"A": "1", "B": "2"}]


def test_approval(spark):
    cands = spark.createDataFrame([(0, "german", "Haus ", "pending_review"), (1, "xx", " haus", "pending_review"), (2, "german", " ", "pending_review"), (3, "german", "Neu", "pending_review"), (4, "german", "Alt", "approved")], "pos int, language string, word_or_phrase string, status string")
    got = U.approve_vocabulary(cands, spark.createDataFrame([("NEU",)], "word string")).orderBy("pos").collect()
    assert [r.new_status for r in got] == ["approved", "duplicate", "error", "duplicate", "approved"] and got[1].target_language == "english"
    errors = spark.createDataFrame([(0, "pending_review", "a", "b"), (1, "pending_review", "A", " b"), (2, "pending_review", "a", "")], "pos int, status string, wrong string, correct string")
    assert [r.new_status for r in U.approve_errors(errors, errors.limit(0)).orderBy("pos").collect()] == ["approved", "duplicate", "error"]


def test_card_status_and_duplicates(spark):
    rows = spark.createDataFrame([("Ein  Satz", ""), ("Zwei", "No"), ("Drei", "")], "sentence string, status string")
    cands = spark.createDataFrame([(0, "Ein Satz", "error"), (1, " Ein Satz", "approved"), (2, "Zwei", "approved"), (3, "Drei", "odd")], "pos int, sentence string, status string")
    assert {r.sentence: r.new_status for r in U.sync_card_status(rows, cands).collect()} == {"Ein  Satz": "Added", "Zwei": "No", "Drei": ""}
    cards = spark.createDataFrame([("d", "f", 2), ("d", "f", 1)], "deck string, front string, note_id int")
    got = U.dedupe_cards(spark.createDataFrame([("d", "f"), ("e", "f")], "deck string, front string"), cards).orderBy("deck", "note_id").collect()
    assert [(r.is_duplicate, r.n_held, r.note_id) for r in got] == [(True, 2, 1), (True, 2, 2), (False, 0, None)]
    words = spark.createDataFrame([("Haus", "German", 3), ("Haus", "German", 4)], "word string, language string, line_no int")
    have = spark.createDataFrame([("Vocabulary/German/Haus.md", 2)], "path string, seen_count int")
    assert [(r.seen_count, r.action) for r in U.upsert_vocabulary(words, have, "2024-02-01", True).collect()] == [(3, "updated")]
    assert [r.action for r in U.upsert_vocabulary(words, have, "2024-02-01").collect()] == ["unchanged"]


def test_marks(notes):
    note = "---\ntype: {}\nseen_count: {}\n---\n\n## Meaning\n\n{}\n"
    df = notes(("a", note.format("sentence", 2, "yes")), ("b", note.format("sentence", 1, "yes")), ("c", note.format("sentence", 5, "TODO")), ("d", note.format("grammar", 5, "x")))
    got = {r.path: (r.marked, r.reason) for r in U.mark_candidates(N.parse_frontmatter(df)).collect()}
    assert got == {"a": (True, "seen_count 2 >= min_seen 2"), "b": (False, "seen_count 1 < min_seen 2"), "c": (False, "meaning is empty or TODO"), "d": (False, "not sentence type: grammar")}


def test_fuzzy_pruning_loses_nothing(spark):
    from difflib import SequenceMatcher

    words = ["haus", "hause", "maus", "häuser", "trotzdem", "trotz", "dem", "x", "auch nicht", "nicht auch"]
    items = spark.createDataFrame([(f"k|{w}", w, 0, "vocabulary", "german") for w in words], "item_key string, normalized string, seen_count int, type string, language string")
    q = spark.createDataFrame([(i, w, None, None) for i, w in enumerate(words)], "qid int, text string, language string, type string")
    got = {(r.qid, r.item_key[2:]) for r in S.fuzzy_lookup(items, q, 60, 100).collect()}
    assert got == {(i, w) for i, a in enumerate(words) for w in words if 100 * SequenceMatcher(None, T and a, w).ratio() >= 60}


def test_term_boundaries(spark):
    words = spark.createDataFrame([("w1", "de", "haus"), ("w2", "de", "im haus"), ("w3", "de", "ab"), ("w4", "de", "c++"), ("w5", "en", "haus")], "path string, language string, term_norm string")
    texts = spark.createDataFrame([("s1", "de", "das haus, é"), ("s2", "de", "hausbau im hausflur"), ("s3", "de", "c++ ab c++x")], "path string, language string, sentence_norm string")
    got = {(r.sentence_path, r.term_path) for r in E.match_terms(words, texts).collect()}
    assert got == {("s1", "w1"), ("s2", "w2"), ("s3", "w4")}


def test_review_status(spark):
    rows = [(0, None, "x"), (1, "2024-01-18 00:00:01", "x"), (1, "2024-01-18 00:00:00", "x"), (5, "2024-01-31 00:00:00", " Archived ")]
    df = spark.createDataFrame(rows, "n int, t string, s string").withColumn("t", F.to_timestamp("t"))
    got = df.select(A.review_status(F.col("n"), F.col("t"), F.col("s"), F.lit(14), F.to_timestamp(F.lit("2024-02-01 00:00:00"))).alias("r")).collect()
    assert [r.r for r in got] == ["unreviewed", "active", "stale", "ignored"]


def test_registry_and_queue_files(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"candidates": [{"word": "a"}, {"word": None}, {"word": "a"}]}))
    rows = files.read_candidates(spark, str(path), "word string")
    assert [r.word for r in rows.orderBy("pos").collect()] == ["a", None, "a"]
    assert sorted((r.code, r.entry) for r in files.registry_issues(rows, "word", ["word"]).collect()) == [("duplicate_id", "a"), ("missing_field", None)]
    files.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


def test_touch_stream_equals_batch(spark, tmp_path):
    touches = spark.createDataFrame([("a", "2024-01-02"), ("a", "2024-01-01"), ("b", "2024-01-03")], "item_key string, t string").select("item_key", F.to_timestamp("t").alias("ts"))
    touches.repartition(2).write.parquet(str(tmp_path / "in"))
    run = lambda: incremental.run_touch_stream(spark, str(tmp_path / "in"), str(tmp_path / "counts"), str(tmp_path / "state"))
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, incremental.touch_counts(touches).collect()))
    touches.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, incremental.touch_counts(spark.read.parquet(str(tmp_path / "in"))).collect()))


def test_long_runs_take_linear_time(spark):
    import time

    texts = [(f"a{c * 300_000}b",) for c in (" ", ".", "_", "\n", '"')]
    began = time.time()
    df = spark.createDataFrame(texts, "t string")
    got = df.select(T.strip(F.col("t")).alias("a"), T.norm_db(F.col("t")).alias("b"), T.safe_tag(F.col("t")).alias("c"), E.safe_name(F.col("t")).alias("d")).collect()
    assert [r.a for r in got] == [x for x, in texts] and time.time() - began < 60
    ends = spark.createDataFrame([(" \u00a0 x  y \t",), ("   ",), ("",), (None,)], "t string").select(T.strip(F.col("t")).alias("a")).collect()
    assert [r.a for r in ends] == ["x  y", "", "", None]


def test_path_values(spark):
    rows = [('"D:\\\\a\\b"', "D:/a/b"), ("'x//y'", "x/y"), ("\"'x'\"", "x"), ('"x', '"x'), ('""x""', '"x"'), (" D:////Dev////f.mp3 ", "D:/Dev/f.mp3"), ("", "")]
    assert [r.p for r in spark.createDataFrame(rows, "t string, w string").select(T.fix_path(F.col("t")).alias("p")).collect()] == [w for _, w in rows]


def test_display_and_inline_text(spark):
    rows = [("---\na: b\n---\n# T #x\n![[p/q.png]] [[a/b|c d]]\n\n\n\nz", "**T #x**\nq.png c d\n\nz", "--- a: b --- # T #x q.png c d z"), (" ---\n---\nx `y` z", "x `y` z", "--- --- x y z"), ("---\nopen", "---\nopen", "--- open"), ("[[a\\\\b ]]", "b", "b")]
    got = spark.createDataFrame(rows, "t string, d string, i string").select(N.clean_display(F.col("t")).alias("d"), N.clean_inline(F.col("t")).alias("i")).collect()
    assert [(r.d, r.i) for r in got] == [(d, i) for _, d, i in rows]


def test_tokens_lose_all_accents(spark):
    assert spark.createDataFrame([("Šő ñ e\u0301 ǆ Ά_x ł",)], "t string").select(T.tokens(F.col("t")).alias("t")).first().t == ["so", "n", "e", "ǆ", "α", "x", "ł"]


def test_activity_replaces_and_appends(spark, notes):
    df = N.parse_frontmatter(notes(("a.md", "---\ntype: x\n  review_status:old\naccess_count: 2\n---\nbody"), ("b.md", "---\ntype: x\n---\n"), ("c.md", "no")))
    view = spark.createDataFrame([("a.md", 2, "active"), ("b.md", 0, "unreviewed"), ("c.md", 5, "active")], "obsidian_path string, access_count long, review_status string").withColumns({"last_accessed_at": F.to_timestamp(F.lit("2024-01-02 03:04:05")), "review_priority": F.lit("normal"), "stale_after_days": F.lit(14)})
    got = {r.path: (r.n_changed, r.text) for r in A.sync_activity(df, view).collect()}
    assert got == {"a.md": (5, "---\ntype: x\n  review_status: active\naccess_count: 2\nlast_accessed_at: 2024-01-02T03:04:05\nlast_reviewed_at:\nreview_priority: normal\nstale_after_days: 14\n---\n\nbody")}
    again = A.sync_activity(N.parse_frontmatter(notes(("a.md", got["a.md"][1]))), view)
    assert again.count() == 0


def test_keys_are_rewritten_whole_and_longest_first(spark, notes):
    import random

    mapping = [("voc|de|Haus", "voc|de|haus"), ("voc|de|Haus bau", "voc|de|haus-bau"), ("voc|de|haus", "voc|de|x"), ("s|en|(A) b.", "s|en|a b"), ("s|en|!?", "s|en|none"), ("g|de|Über", "g|de|über")]
    rng = random.Random(4)
    parts = [old for old, _ in mapping] + [" ", "\n", "x", "voc|de|Hausbau", "|", ".", "ab|cd|", "[[", "]]"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(150)] + [""]

    def brute(text):
        import re

        out, at, n = [], 0, 0
        while at < len(text):
            starts = lambda i: not (i and (text[i - 1].isalnum() or text[i - 1] in "_|-")) and re.compile(H.KEY_START).match(text, i)
            ends = lambda i: not text[i : i + 1].isalnum() or starts(i)
            fits = [m for m in mapping if starts(at) and text.startswith(m[0], at) and ends(at + len(m[0])) and not any(starts(i) for i in range(at + 1, at + len(m[0])))]
            best = max(fits, key=lambda m: len(m[0]), default=None)
            if best:
                out.append(best[1])
                at, n = at + len(best[0]), n + 1
            else:
                out.append(text[at])
                at += 1
        return "".join(out), n

    df = notes(*[(str(i), t) for i, t in enumerate(texts)])
    got = {r.path: (r.text, r.n_replaced) for r in H.rewrite_keys(df, spark.createDataFrame(mapping, "old_key string, new_key string")).collect()}
    assert got == {str(i): brute(t) for i, t in enumerate(texts)}


def test_key_migration_of_notes(notes):
    df = notes(("a", "---\ntype: voc\nlanguage: de\nnormalized: Haus\nkey: voc|de|Haus\n---\nsee voc|de|Haus."), ("b", "to voc|de|Haus, not voc|de|Hausbau"), ("c", "x"))
    audit = H.audit_keys(H.extract_key(N.parse_frontmatter(df)))
    got = {r.path: (r.text, r.n_replaced) for r in H.migrate_keys(N.parse_frontmatter(df), audit).collect()}
    assert got == {"a": ("---\ntype: voc\nlanguage: de\nnormalized: haus\nkey: voc|de|haus\n---\n\nsee voc|de|haus.", 1), "b": ("to voc|de|haus, not voc|de|Hausbau", 1), "c": ("x", 0)}


def test_relation_sections(notes):
    texts = {
        "old": "---\ntype: vocabulary\n---\n\n## Similar Meaning\n\n- [[b|B]]\n- [[B.md]]\n- [[c#x]]\n",
        "blank": "---\ntype: grammar\nrelations_template_version: 1.0\n---\n\n## Relations\n\n<!-- [[x]] -->\n### Similar To\n\n- TODO\n\n## Notes\nx\n",
        "used": "---\ntype: sentence\n---\n\n## Meaning\nm\n\n## Contrast with\n[[q]] [[z|zz]] [[TODO]]\n## Relations\n\n### Contrast With\n- [[q|Q]]\n- TODO\n\n### Odd\nfoo\n\n## Opposites\n[[o]]\n",
        "other": "---\ntype: transcript\n---\n\n## Opposites\n[[o]]\n",
        "bare": "## Opposites\n[[o]]\n",
        "empty": "",
        "null": None,
        "heading": "---\ntype: grammar\n---\n\n## Relations",
    }
    parsed = N.parse_frontmatter(notes(*texts.items()))
    made = {r.path: r.text for r in R.relations_template(parsed).collect()}
    assert made["old"].count("## Meanings / Senses") == 1 and made["old"].count("relation_type:") == 12 and made["old"].endswith("`register_variant_of`\n\n- TODO\n")
    assert made["blank"].startswith("---\ntype: grammar\nrelations_template_version: 1.1\n---\n\n## Relations\n\nAdd") and made["blank"].endswith("- TODO\n\n## Notes\nx\n") and made["blank"].count("###") == 4
    assert made["used"] == texts["used"].replace("sentence\n", "sentence\nrelations_template_version: 1.1\n")
    assert all(made[k] == texts[k] for k in ("other", "bare", "empty", "null"))
    assert made["heading"] == "---\ntype: grammar\nrelations_template_version: 1.1\n---\n\n## Relations\n"
    moved = {r.path: r.text for r in R.backfill_relations(parsed).collect()}
    assert "`similar_to`\n\n- [[b|B]]\n- [[c#x]]\n\n### Opposite Of" in moved["old"] and moved["old"].count("relation_type:") == 12
    assert "### Contrast With\n- [[q|Q]]\n- [[z|zz]]\n\n### Odd\nfoo\n\n### Opposite Of\n\nrelation_type: `opposite_of`\n\n- [[o]]\n\n## Opposites" in moved["used"]
    assert all(moved[k] == texts[k] for k in texts if k not in ("old", "used"))
    for job, once in ((R.relations_template, made), (R.backfill_relations, moved)):
        assert {r.path: r.text for r in job(N.parse_frontmatter(notes(*once.items()))).collect()} == once


def test_untyped_notes_are_left_out_on_request(spark, notes):
    from notelake.operators import notes as N
    from notelake.operators import quality as H

    rows = N.parse_frontmatter(notes(("a.md", "plain"), ("b.md", "---\nterm: x\n---\n"), ("c.md", "---\ntype: diary\n---\n"), ("d.md", "---\nnote_type: odd\n---\n")))
    codes = lambda **how: {(r.path, r.code) for r in H.validate_notes(rows, H.note_types(spark), **how).collect()}
    typed = {("c.md", "unknown_note_type"), ("d.md", "unknown_note_type")}
    assert codes(untyped=False) == typed
    assert codes() == typed | {("a.md", "missing_frontmatter"), ("b.md", "missing_note_type")}


def test_rows_behind_duplicate_edges(spark):
    from notelake.operators import graph as G

    edges = [("a", "r", "b", "n1", 0, 0), ("a", "r", "b", "n2", 1, 0), ("a", "s", "b", "n1", 0, 1), ("a", "r", "b", "n2", 1, 0), ("c", "r", "b", "n3", 0, 0)]
    got = sorted(map(tuple, G.duplicate_rows(spark.createDataFrame(edges, "source_key string, relation_type string, target_key string, path string, ord int, pos int")).collect()))
    assert got == [("a", "r", "b", 3, "n1", 0, 0), ("a", "r", "b", 3, "n2", 1, 0), ("a", "r", "b", 3, "n2", 1, 0)]


def test_partitions_are_replaced_alone(spark, tmp_path):
    from notelake.sources import files

    frame = lambda *rows: spark.createDataFrame(list(rows), "item_key string, type string, language string")
    files.write_index({"items": frame(("a", "x", "de"), ("b", "x", "en"), ("c", "y", "de"))}, str(tmp_path))
    files.replace_partitions(frame(("d", "x", "de"), ("e", "z", "de")), str(tmp_path))
    files.replace_partitions(frame(), str(tmp_path))
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/items").collect()} == {("d", "x", "de"), ("b", "x", "en"), ("c", "y", "de"), ("e", "z", "de")}


def test_quality_gate_makes_items_once(spark, monkeypatch):
    """h12 takes keys, known items and the lookup from the search documents; these hold what the notes' items hold."""
    from notelake.operators import index as I
    from notelake.plans import product_queries as Q
    from notelake.plans.index_queries import items_of, stored
    from notelake.plans.search_queries import docs_of

    sf, made, real = "/root/testdata/sf0.001", [], I.note_items
    notes = stored(spark, sf)
    docs = docs_of(notes)
    keys = docs.select("path", F.col("doc_type").alias("item_type"), "language", F.col("title").alias("normalized"))
    assert sorted(keys.collect()) == sorted(Q.keys_of(notes).collect())
    assert {r.item_key for r in docs.select("item_key").collect()} == {r.item_key for r in items_of(notes).select("item_key").collect()}
    monkeypatch.setattr(I, "note_items", lambda parsed: (made.append(1), real(parsed))[1])
    assert {r.check for r in Q.h12_quality_gate(spark, sf).collect()} >= {"validation", "keys", "relations"}
    assert len(made) <= 1
