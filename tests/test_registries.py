"""Broken registries of each kind are found and not let in; the gate's lookups pass and fail; examples are merged once."""

import json

import pytest
from pyspark.sql import functions as F

from notelake.operators import quality as H
from notelake.operators import queues as U
from notelake.operators import search as S
from notelake.sources import files, registries

REL = {"id": "similar_to", "label": "x", "source_types": ["vocabulary"], "target_types": ["vocabulary"], "symmetric": True, "enabled": True}
NOTE = {"id": "vocabulary", "key_type": "vocabulary", "folders": {"german": "V"}, "required": ["type"]}
KEY = {"id": "sentence", "strip_terminal_punctuation": True}


def text(name, *entries, version=None, **head):
    return json.dumps({"schema_version": version or registries.SCHEMA_VERSIONS[name], **head, "entries": list(entries)})


CASES = [
    ("relation_types", text("relation_types", REL, version="9"), ("unknown_schema_version", "9", "schema_version")),
    ("relation_types", text("relation_types", {**REL, "id": "likes"}), ("outside_enum", "likes", "id")),
    ("relation_types", text("relation_types", REL, REL), ("duplicate_id", "similar_to", "id")),
    ("relation_types", text("relation_types", {**REL, "source_types": []}), ("empty_field", "similar_to", "source_types")),
    ("relation_types", text("relation_types", {k: v for k, v in REL.items() if k != "symmetric"}), ("missing_field", "similar_to", "symmetric")),
    ("relation_types", text("relation_types", {**REL, "label": "  "}), ("empty_field", "similar_to", "label")),
    ("note_types", text("note_types", {**NOTE, "folders": {"french": "V"}}, languages=["german"]), ("unsupported_language", "vocabulary", "french")),
    ("note_types", text("note_types", NOTE, languages=["french"]), ("unsupported_language", None, "french")),
    ("note_types", text("note_types", NOTE), ("missing_field", None, "languages")),
    ("note_types", text("note_types", {**NOTE, "key_type": "poem"}, languages=["german"]), ("outside_enum", "vocabulary", "key_type")),
    ("key_policies", text("key_policies", {**KEY, "id": "poem"}, unicode_form="NFKC"), ("outside_enum", "poem", "id")),
    ("key_policies", text("key_policies", KEY, {"strip_terminal_punctuation": False}, unicode_form="NFKC"), ("missing_field", "#1", "id")),
]


@pytest.mark.parametrize("name, broken, issue", CASES)
def test_broken_registries_are_found(spark, name, broken, issue):
    got = {(r.registry, r.code, r.entry, r.field) for r in registries.issues(registries.read(spark, texts={name: broken})).collect()}
    assert got == {(name, *issue)}
    with pytest.raises(registries.RegistryError, match=issue[0]):
        registries.load(spark, texts={name: broken})


def test_packaged_and_own_registries_are_let_in(spark, tmp_path):
    assert registries.load(spark).relation_types.count() == len(registries.RELATION_TYPES)
    for name, entry, head in (("relation_types", REL, {}), ("note_types", NOTE, {"languages": ["german"]}), ("key_policies", KEY, {"unicode_form": "NFKC"})):
        (tmp_path / f"{name}.json").write_text(text(name, entry, **head))
    assert [r.name for r in H.note_types(spark, str(tmp_path)).collect()] == ["vocabulary"]


def test_smoke_lookups_pass_and_fail(spark):
    rows = [("vocabulary|german|trotzdem", "vocabulary", "german", "trotzdem", "Trotzdem", "t.md", "text"), ("grammar|german|satz", "grammar", "german", "satz", "Satz", "s.md", "about trotzdem")]
    items = spark.createDataFrame(rows, "item_key string, type string, language string, normalized string, title string, file_path string, text_preview string")
    q = spark.createDataFrame([(0, "trotzdem", "german", None), (1, "trotzdem", "german", "grammar"), (2, "Satz", None, None)], "qid int, text string, language string, type string")
    expected = spark.createDataFrame([("word", 0, rows[0][0]), ("word", 0, rows[1][0]), ("kind", 1, rows[0][0]), ("related", 2, "sentence|german|x"), ("related", 2, rows[1][0])], "check string, qid int, item_key string")
    views = spark.createDataFrame([(rows[1][0], "sentence|german|x")], "item_key string, other_key string")
    got = {r.check: (r.found, r.passed, r.missing) for r in H.smoke_lookups(S.index_for_grades(items), q, expected, views).collect()}
    assert got == {"word": (0, True, ""), "kind": (1, False, rows[0][0]), "related": (0, True, "")}


def test_examples_are_merged_once(spark):
    note = "---\ntype: vocabulary\nseen_count: 2\nlast_seen: 2020-01-01\n---\n\n## Contexts\n\n- x\n\n## Example Sentences\n\n- Das Haus.\n\n## Related\n\n- \n"
    notes = spark.createDataFrame([("Vocabulary/German/Haus.md", note), ("Vocabulary/English/none.md", "plain"), ("Vocabulary/German/Other.md", note)], "path string, text string")
    rows = spark.createDataFrame(
        [("Haus", "German", 1, "Das Haus.", "a"), (" Haus ", "german", 2, "Ein Haus steht da.", None), ("Haus", "German", 3, "Ein Haus", "b"), ("Haus", "German", 4, "Ein Haus steht da.", "c"), ("none", "x", 5, "e", "s"), ("", "German", 6, "y", ""), ("new", "German", 7, "z", "")],
        "word string, language string, line_no int, example string, source string",
    )
    merge = lambda n, **k: {r.path: (r.n_added, r.action, r.text) for r in U.merge_examples(rows, n, "2024-02-01", **k).collect()}
    got = merge(notes)
    want = note.replace("## Example", "\n- Vocabulary Inbox\n  - Ein Haus steht da.\n\n## Example").replace("## Related", "- Ein Haus steht da.\n\n## Related").replace("seen_count: 2", "seen_count: 3").replace("2020-01-01", "2024-02-01")
    assert got == {"Vocabulary/German/Haus.md": (1, "updated", want), "Vocabulary/English/none.md": (0, "unchanged", "plain")}
    again = spark.createDataFrame([(p, t) for p, (_, _, t) in got.items()], "path string, text string")
    assert {a for _, a, _ in merge(again).values()} == {"unchanged"}
    assert "seen_count: 6" in merge(notes, count_again=True)["Vocabulary/German/Haus.md"][2]


def test_index_tables_are_replaced(spark, tmp_path):
    items = spark.createDataFrame([("a", "vocabulary", "de"), ("b", "sentence", None)], "item_key string, type string, language string")
    for n in (2, 1):
        files.write_index({"items": items.limit(n).orderBy("item_key"), "tags": items.select("item_key")}, str(tmp_path / "index"))
        assert spark.read.parquet(str(tmp_path / "index/items")).count() == n
    assert spark.read.parquet(str(tmp_path / "index/items")).filter(F.col("type") == "vocabulary").count() + spark.read.parquet(str(tmp_path / "index/tags")).count() >= 2
