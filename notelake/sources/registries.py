"""Registries of relation types, note types and key policies: read, checked as rows of issues, and let in only without any.

A registry is a JSON file with a schema version and entries. The packaged ones are what the library runs from; a folder on shared storage
replaces them. They are small by nature (a few hundred entries), so the driver reads them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("relation_types", "note_types", "key_policies")
#: The version that each registry must state.
SCHEMA_VERSIONS = {"relation_types": "1.0", "note_types": "note_type_registry_v1", "key_policies": "key_policy_registry_v1"}
ENTRIES = {
    "relation_types": "id string, label string, source_types array<string>, target_types array<string>, symmetric boolean, enabled boolean",
    "note_types": "id string, key_type string, folders map<string,string>, required array<string>",
    "key_policies": "id string, strip_terminal_punctuation boolean",
}
HEADS = {"relation_types": "", "note_types": "languages array<string>, ", "key_policies": "unicode_form string, "}
#: The only relation types that there are, and languages and item types that may be named.
RELATION_TYPES = (
    "contains_vocabulary", "uses_grammar", "example_of", "source_of", "derived_from", "similar_to", "opposite_of", "contrast_with", "confusable_with", "negative_counterpart", "translation_of",
    "translation_variant_of", "formal_variant_of", "informal_variant_of", "slang_variant_of", "register_variant_of", "grammar_contrast_with",
)
LANGUAGES = ("english", "german")
ITEM_TYPES = ("vocabulary", "sentence", "grammar", "transcript", "tts_audio")


class RegistryError(ValueError):
    """Registries with issues; they are listed in the message."""


class Registries(NamedTuple):
    """The entries of each registry, and heads(registry, schema_version, languages, unicode_form)."""

    relation_types: DataFrame
    note_types: DataFrame
    key_policies: DataFrame
    heads: DataFrame


def packaged(name: str) -> dict:
    return json.loads((Path(__file__).parents[1] / "registries" / f"{name}.json").read_text(encoding="utf-8"))


def read(spark: SparkSession, folder: str | None = None, texts: Mapping[str, str] | None = None) -> Registries:
    """The registries of a folder of files, of given JSON texts, or the packaged ones; nothing is checked."""
    tables, heads = [], None
    for name in NAMES:
        if texts and name in texts:
            text = texts[name]
        elif folder:
            text = spark.read.text(f"{folder}/{name}.json", wholetext=True).first().value
        else:
            text = json.dumps(packaged(name))
        whole = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", f"schema_version string, {HEADS[name]}entries array<struct<{ENTRIES[name]}>>").alias("r")).select("r.*")
        tables.append(whole.select(F.posexplode("entries").alias("place", "e")).select("place", "e.*"))
        languages = F.col("languages") if "languages" in whole.columns else F.lit(None).cast("array<string>")
        form = F.col("unicode_form") if "unicode_form" in whole.columns else F.lit(None).cast("string")
        head = whole.select(F.lit(name).alias("registry"), "schema_version", languages.alias("languages"), form.alias("unicode_form"))
        heads = head if heads is None else heads.unionByName(head)
    return Registries(*tables, heads)


def issues(found: Registries) -> DataFrame:
    """(registry, code, entry, field) of all that is wrong.

    unknown_schema_version; missing_field and empty_field (a text without characters or a list without elements); duplicate_id; outside_enum (an id
    or a key type that nothing knows); unsupported_language (of the registry, or of a folder).
    """
    rows = None

    def add(df: DataFrame, name: str, code: str, entry, field) -> None:
        nonlocal rows
        one = df.select(F.lit(name).alias("registry"), F.lit(code).alias("code"), entry.cast("string").alias("entry"), field.cast("string").alias("field"))
        rows = one if rows is None else rows.unionByName(one)

    none = F.lit(None)
    for name, table in zip(NAMES, found[:3], strict=True):
        head = found.heads.filter(F.col("registry") == name)
        add(head.filter(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSIONS[name]))), name, "unknown_schema_version", F.col("schema_version"), F.lit("schema_version"))
        who = F.coalesce("id", F.concat(F.lit("#"), F.col("place").cast("string")))
        for field in (f.split()[0] for f in ENTRIES[name].split(", ")):
            add(table.filter(F.col(field).isNull()), name, "missing_field", who, F.lit(field))
            kind = table.schema[field].dataType.simpleString()
            if kind == "string" or kind.startswith("array"):
                add(table.filter(F.trim(field) == "" if kind == "string" else F.size(field) == 0), name, "empty_field", who, F.lit(field))
        twice = table.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        add(twice, name, "duplicate_id", F.col("id"), F.lit("id"))
    add(found.relation_types.filter(~F.col("id").isin(*RELATION_TYPES)), "relation_types", "outside_enum", F.col("id"), F.lit("id"))
    add(found.note_types.filter(~F.col("key_type").isin(*ITEM_TYPES)), "note_types", "outside_enum", F.col("id"), F.lit("key_type"))
    add(found.key_policies.filter(~F.col("id").isin(*ITEM_TYPES)), "key_policies", "outside_enum", F.col("id"), F.lit("id"))
    spoken = found.heads.filter("registry = 'note_types'")
    add(spoken.filter(F.coalesce(F.size("languages"), F.lit(0)) <= 0), "note_types", "missing_field", none, F.lit("languages"))
    add(spoken.select(F.explode("languages").alias("l")).filter(~F.col("l").isin(*LANGUAGES)), "note_types", "unsupported_language", none, F.col("l"))
    add(found.note_types.select("id", F.explode(F.map_keys("folders")).alias("l")).filter(~F.col("l").isin(*LANGUAGES)), "note_types", "unsupported_language", F.col("id"), F.col("l"))
    return rows


def load(spark: SparkSession, folder: str | None = None, texts: Mapping[str, str] | None = None) -> Registries:
    """The registries, if nothing is wrong with them."""
    found = read(spark, folder, texts)
    wrong = issues(found).collect()  # a few rows for each entry at most
    if wrong:
        raise RegistryError("; ".join(sorted(f"{r.registry}: {r.code} {r.entry} {r.field}" for r in wrong)))
    return found
