"""Schema checks, key audits and migrations of notes, each as rows of issues or changes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.text import collapse, fix_path, item_key, let, strip, without_sentence_end
from notelake.operators.index import filled
from notelake.operators.notes import fm_lines, prop, with_front_matter
from notelake.operators.search import LookupIndex, graded_lookup
from notelake.sources import registries
from notelake.sources.tables import written

#: As the packaged registries state them: note type, key type, folder by language, required properties; languages; item types whose keys lose sentence ends.
NOTE_TYPES = tuple((e["id"], e["key_type"], e["folders"], e["required"]) for e in registries.packaged("note_types")["entries"])
LANGUAGES = tuple(registries.packaged("note_types")["languages"])
NO_FINAL_PUNCTUATION = tuple(e["id"] for e in registries.packaged("key_policies")["entries"] if e["strip_terminal_punctuation"])


def nfkc(c: Column) -> Column:
    """NFKC form; only texts beyond ASCII go to Python."""

    def form(xs: pd.Series) -> pd.Series:
        import unicodedata

        return xs.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.when(c.rlike(r"[^\x00-\x7F]"), F.pandas_udf(form, "string")(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def casefold(c: Column) -> Column:
    """Full case folding; only texts beyond ASCII go to Python."""

    def fold(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else x.casefold())

    return F.when(c.rlike(r"[^\x00-\x7F]"), F.pandas_udf(fold, "string")(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(F.lower(c))


def norm_key(df: DataFrame, text: str, kind: str, bare: Sequence[str] = NO_FINAL_PUNCTUATION) -> DataFrame:
    """df with columns key_text and operations (the steps that changed the text, in order); bare are the item types that lose sentence ends."""
    final = F.lower(strip(F.col(kind))).isin(*bare)
    steps = df.withColumn("__0", F.col(text)).withColumn("__1", nfkc(F.col("__0"))).withColumn("__2", strip(F.col("__1"))).withColumn("__3", collapse(F.col("__2"))).withColumn("__4", casefold(F.col("__3")))
    steps = steps.withColumn("__5", F.when(final, strip(without_sentence_end(F.col("__4")))).otherwise(F.col("__4")))
    names = ("unicode:NFKC", "trim", "collapse_whitespace", "casefold", "strip_terminal_punctuation")
    done = F.array_compact(F.array(*[F.when(F.col(f"__{i}") != F.col(f"__{i + 1}"), n) for i, n in enumerate(names)]))
    return steps.withColumns({"key_text": F.col("__5"), "operations": done}).drop(*[f"__{i}" for i in range(6)])


def extract_key(parsed: DataFrame) -> DataFrame:
    """(path, item_type, language, normalized): an explicit key of three parts, else the first filled fields, else no row."""
    first = lambda *names: F.get(F.filter(F.transform(F.array(*[prop(n) for n in names]), strip), lambda x: x != ""), 0)
    named = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, ("item_type", "language", "normalized"))])
    made = named(first("type", "item_type", "note_type"), first("language", "lang"), first("normalized", "normalized_text", "canonical"))
    key = let(F.split(first("item_key", "key", "id"), r"\|", 3), lambda k: F.when(F.size(k) == 3, named(*[strip(F.get(k, i)) for i in range(3)])).otherwise(made))
    whole = F.filter(F.array(key), lambda k: k["item_type"].isNotNull() & k["language"].isNotNull() & k["normalized"].isNotNull())
    return parsed.select("path", F.inline(whole))


def note_types(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """The note types of checked registry files."""
    return registries.load(spark, folder).note_types.select(F.col("id").alias("name"), "key_type", "folders", "required")


def validate_notes(parsed: DataFrame, types: DataFrame, untyped: bool = True) -> DataFrame:
    """Issues (path, severity, code, field) of notes: the first three codes end a note's checks. Notes that state no type are left out on request."""
    base = parsed.select(
        "path", "has_fm", "props", F.lower(strip(filled(strip(prop("type")), filled(strip(prop("item_type")), prop("note_type"))))).alias("kind"),
        F.lower(strip(filled(strip(prop("language")), prop("lang")))).alias("lang"), filled(strip(prop("normalized")), filled(strip(prop("normalized_text")), strip(prop("canonical")))).alias("norm"),
    )
    base = base if untyped else base.filter("kind <> ''")
    rows = norm_key(base.join(F.broadcast(types.withColumnRenamed("name", "kind")), "kind", "left"), "norm", "key_type")
    issue = lambda severity, code, field: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (field if isinstance(field, Column) else F.lit(field).cast("string")).alias("field"))
    has_value = lambda name: F.coalesce(F.size(F.filter(F.try_element_at("props", name), lambda v: strip(v) != "")) > 0, F.lit(False))
    missing = F.transform(F.filter("required", lambda f: ~has_value(f)), lambda f: issue("error", "missing_required_frontmatter", f))
    folder = F.try_element_at("folders", "lang")
    known = F.col("lang").isin(*LANGUAGES)
    rest = F.array_compact(F.array(
        F.when((F.col("lang") == "") & F.array_contains("required", "language"), issue("error", "missing_language", "language")),
        F.when((F.col("lang") != "") & ~known, issue("error", "unsupported_language", "language")),
        F.when(known & folder.isNull(), issue("warning", "missing_default_folder_for_language", "language")),
        F.when((F.col("lang") != "") & (F.col("norm") != "") & (F.col("norm") != F.col("key_text")), issue("error", "normalized_key_mismatch", "normalized")),
        F.when(folder.isNotNull() & ~F.startswith("path", F.concat(folder, F.lit("/"))), issue("warning", "folder_mismatch", "path")),
    ))
    found = (
        F.when(~F.col("has_fm"), F.array(issue("error", "missing_frontmatter", None))).when(F.col("kind") == "", F.array(issue("error", "missing_note_type", "type")))
        .when(F.col("required").isNull(), F.array(issue("error", "unknown_note_type", "type"))).otherwise(F.concat(missing, rest))
    )
    return rows.select("path", F.explode(found).alias("i")).select("path", "i.*")


def validation_summary(parsed: DataFrame, issues: DataFrame) -> DataFrame:
    """(dim, value, n): notes, notes without errors, issues by severity and code."""
    n = F.count(F.lit(1)).alias("n")
    count = lambda df, value: df.agg(n).select(F.lit("notes").alias("dim"), F.lit(value).alias("value"), "n")
    valid = parsed.select("path").join(issues.filter("severity = 'error'").select("path").distinct(), "path", "left_anti")
    by = lambda c: issues.groupBy(F.col(c).alias("value")).agg(n).select(F.lit(c).alias("dim"), "value", "n")
    return count(parsed, "checked").unionByName(count(valid, "valid")).unionByName(by("severity")).unionByName(by("code"))


def audit_keys(keys: DataFrame) -> DataFrame:
    """(path, old_key, new_key, changed, operations) of keys(path, item_type, language, normalized)."""
    rows = norm_key(keys, "normalized", "item_type")
    new = item_key(F.lower(strip(F.col("item_type"))), F.lower(strip(F.col("language"))), F.col("key_text"))
    old = item_key(F.col("item_type"), F.col("language"), F.col("normalized"))
    return rows.select("path", old.alias("old_key"), new.alias("new_key"), (old != new).alias("changed"), F.array_join("operations", ",").alias("operations"))


def plan_key_migration(audit: DataFrame) -> DataFrame:
    """(code, key, n): keys that stop a migration: held by several notes, several keys that become one, or one that an unchanged note has."""
    n = F.count(F.lit(1)).alias("n")
    changed = audit.filter("changed")
    duplicate = audit.groupBy(F.col("old_key").alias("key")).agg(n).filter("n > 1").withColumn("code", F.lit("duplicate_key"))
    merged = changed.groupBy(F.col("new_key").alias("key")).agg(n).filter("n > 1").withColumn("code", F.lit("merged_keys"))
    kept = audit.select(F.col("old_key").alias("key")).distinct().join(changed.select(F.col("old_key").alias("key")).distinct(), "key", "left_anti")
    hit = changed.select(F.col("new_key").alias("key")).join(kept, "key", "left_semi").groupBy("key").agg(n).withColumn("code", F.lit("collision"))
    return duplicate.unionByName(merged).unionByName(hit).select("code", "key", "n")


def backfill_schema_version(parsed: DataFrame, version: str) -> DataFrame:
    """(path, text) of typed notes, with a schema_version line first in the front matter where there is none."""
    lacks = F.col("has_fm") & (strip(prop("type")) != "") & ~F.map_contains_key("props", "schema_version")
    text = F.concat(F.lit(f"---\nschema_version: {version}\n"), F.regexp_replace(F.substr("text", F.lit(4)), r"\A\n", ""))
    return parsed.select("path", F.when(lacks, text).otherwise(F.col("text")).alias("text"))


def sync_tags(parsed: DataFrame, tags: DataFrame) -> DataFrame:
    """(path, text): the tags block of the front matter replaced by tags(path, tags)."""
    rows = parsed.join(tags, "path", "left")
    bare = F.regexp_replace("raw_fm", r"(?m)^tags\s*:.*\n(?:[ \t]*-[^\n]*\n)*", "")
    block = F.concat(F.lit("tags:\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("  - "), t, F.lit("\n"))), ""))
    new = F.concat(F.lit("---"), bare, block, F.lit("---"), F.substr("text", F.length("raw_fm") + 7))
    return rows.select("path", F.when(F.col("has_fm"), new).otherwise(F.col("text")).alias("text"))


#: The properties that hold paths.
PATH_FIELDS = ("source_path", "audio_path", "video_path")


def fix_paths(parsed: DataFrame) -> DataFrame:
    """(path, text): path values of the front matter with single forward slashes and no quotes. Notes without a path to mend stay as they are."""
    lead = lambda x: F.regexp_extract(x, r"\A(\s*[A-Za-z0-9_]+\s*:\s*)", 1)
    value = lambda x: F.substr(x, F.length(lead(x)) + 1, F.length(x))
    wrong = lambda x: F.regexp_extract(x, r"\A\s*([A-Za-z0-9_]+)\s*:", 1).isin(*PATH_FIELDS) & (fix_path(value(x)) != strip(value(x)))
    rows = parsed.withColumn("__lines", fm_lines())
    mended = F.array_join(F.transform("__lines", lambda x: F.when(wrong(x), F.concat(lead(x), fix_path(value(x)))).otherwise(x)), "\n")
    new = with_front_matter(mended)
    return rows.select("path", F.when(F.col("has_fm") & F.exists("__lines", wrong), new).otherwise(F.col("text")).alias("text"))


#: Where the key of a note may stand, in order.
NORMALIZED_FIELDS, KEY_FIELDS = ("normalized", "normalized_text", "canonical"), ("item_key", "key", "id")
#: The start of a key inside a text: type, language, and what follows up to the end of the first run of letters and digits.
KEY_START = r"[A-Za-z0-9_-]+\|[A-Za-z0-9_-]+\|"
BLOCK = rf"\A({KEY_START})[^\p{{L}}\p{{N}}\n]*([\p{{L}}\p{{N}}]*)"


def own_key_renamed(parsed: DataFrame, renamed: DataFrame) -> DataFrame:
    """(path, text): the first normalized field and the first key field of notes in renamed(path, new_key) hold the new key."""
    rows = parsed.join(renamed.select("path", F.col("new_key").alias("__new")), "path", "left").withColumn("__lines", fm_lines())
    name = lambda x: F.regexp_extract(x, r"\A([A-Za-z0-9_]+)\s*:", 1)
    held = F.transform("__lines", name)
    values = {NORMALIZED_FIELDS: F.element_at(F.split("__new", r"\|", 3), 3), KEY_FIELDS: F.col("__new")}
    first = {fields: F.coalesce(*[F.when(F.array_contains(held, f), f) for f in fields]) for fields in values}

    def line(x: Column) -> Column:
        out = x
        for fields, value in values.items():
            out = F.when(name(x) == first[fields], F.concat(first[fields], F.lit(": "), value)).otherwise(out)
        return out

    changes = F.col("has_fm") & F.col("__new").isNotNull() & F.coalesce(*first.values()).isNotNull()
    return rows.select("path", F.when(changes, with_front_matter(F.array_join(F.transform("__lines", line), "\n"))).otherwise(F.col("text")).alias("text"))


def rewrite_keys(notes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(path, text, n_replaced): every whole old key of mapping(old_key, new_key) in any note's text replaced by the new one.

    Texts are cut where a key may start. A piece meets only those old keys that have its type, language and first run of letters and
    digits, of which the longest that the piece starts with wins; so nothing is replaced twice, and no key inside a longer one. A key
    ends before a character that is no letter or digit, or where another key starts.
    """
    pieces = notes.select("path", F.posexplode(F.split("text", rf"(?<![\p{{L}}\p{{N}}_|-])(?={KEY_START})", -1)).alias("pos", "piece"))
    head, block = lambda c: F.regexp_extract(c, BLOCK, 1), lambda c: F.concat(F.regexp_extract(c, BLOCK, 1), F.regexp_extract(c, BLOCK, 2))
    old = mapping.filter("old_key <> new_key").select(block(F.col("old_key")).alias("block"), "old_key", "new_key").distinct()
    #: A key without letters and digits of its own has no run, whatever follows it in a text.
    starts = pieces.withColumn("block", F.explode(F.array_distinct(F.array(block(F.col("piece")), head(F.col("piece")))))).filter("block <> ''").join(old, "block")
    whole = F.startswith("piece", "old_key") & ~F.substr("piece", F.length("old_key") + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    best = starts.filter(whole).groupBy("path", "pos").agg(F.max_by(F.struct("old_key", "new_key"), F.length("old_key")).alias("k"))
    mended = pieces.join(best.select("path").distinct(), "path", "left_semi").join(best, ["path", "pos"], "left")
    now = F.coalesce(F.concat("k.new_key", F.substr("piece", F.length("k.old_key") + 1, F.length("piece"))), F.col("piece"))
    texts = mended.select("path", F.struct("pos", now.alias("t")).alias("p"), F.col("k").isNotNull().cast("long").alias("hit")).groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("new"), F.sum("hit").alias("n")
    )
    return notes.join(texts, "path", "left").select("path", F.coalesce("new", "text").alias("text"), F.coalesce("n", F.lit(0).cast("long")).alias("n_replaced"))


def migrate_keys(parsed: DataFrame, audit: DataFrame) -> DataFrame:
    """(path, text, n_replaced): the changed keys of audit_keys carried out, in the notes that have them and wherever else they stand."""
    changed = written(audit.filter("changed").select("path", "old_key", "new_key"), "key-changes")
    return rewrite_keys(own_key_renamed(parsed, changed), changed.groupBy("old_key").agg(F.min("new_key").alias("new_key")))


def smoke_lookups(index: LookupIndex, q: DataFrame, expected: DataFrame, views: DataFrame | None = None, n: int = 20) -> DataFrame:
    """(check, found, passed, missing) for each check of expected(check, qid, item_key): the keys that its query's ranked lookup must bring.

    A key may also come as what a match is related to (views of relations). found counts the missing keys, of which missing names up to the first in order.
    """
    hits = graded_lookup(index, q, n).select("qid", "item_key")
    if views is not None:
        related = hits.join(views.select("item_key", "other_key"), "item_key").select("qid", F.col("other_key").alias("item_key"))
        hits = hits.unionByName(related)
    brought = hits.distinct().withColumn("__brought", F.lit(True))
    rows = expected.join(brought, ["qid", "item_key"], "left")
    lost = F.when(F.col("__brought").isNull(), F.col("item_key"))
    return rows.groupBy("check").agg(F.count(lost).alias("found"), F.min(lost).alias("missing")).select("check", "found", (F.col("found") == 0).alias("passed"), F.coalesce("missing", F.lit("")).alias("missing"))


def quality_gate(issues: DataFrame, audit: DataFrame, relation_issues: DataFrame, smoke: DataFrame | None = None) -> DataFrame:
    """(check, found, passed, missing): validation errors, key changes and relation errors must all be none; so must the keys that smoke_lookups miss."""
    row = lambda df, name: df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("check"), "found", (F.col("found") == 0).alias("passed"))
    counted = row(issues.filter("severity = 'error'"), "validation").unionByName(row(audit.filter("changed"), "keys")).unionByName(row(relation_issues.filter("severity = 'error'"), "relations"))
    counted = counted.withColumn("missing", F.lit(""))
    return counted if smoke is None else counted.unionByName(smoke)
