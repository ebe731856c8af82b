"""The typed relation graph between items: candidates, link resolution, validation, dedupe, neighbours, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.functions.text import item_key, let, norm_db, section, stem, strip, without_md
from notelake.operators.index import filled, link_path, looked_up
from notelake.operators.notes import links_of, prop
from notelake.sources import registries
from notelake.sources.tables import written

#: Level-2 headings of older notes and the relations they stand for, in their order.
LEGACY_SECTIONS = {
    "contains vocabulary": "contains_vocabulary", "grammar / pattern": "uses_grammar", "related grammar": "uses_grammar", "similar sentences": "similar_to",
    "similar vocabulary": "similar_to", "similar meaning": "similar_to", "antonyms / opposites": "opposite_of", "opposites": "opposite_of",
    "opposite / contrast sentences": "contrast_with", "contrast with": "contrast_with", "confusable words": "confusable_with",
    "confusable / compare with": "confusable_with", "negative counterpart": "negative_counterpart",
}
#: Relation type, source types, target types, symmetric: as the packaged registry states them.
TAXONOMY = tuple((e["id"], e["source_types"], e["target_types"], e["symmetric"]) for e in registries.packaged("relation_types")["entries"])
LABELS = {
    "contains_vocabulary": "Contains Vocabulary", "uses_grammar": "Uses Grammar", "similar_to": "Similar to", "opposite_of": "Opposite of", "confusable_with": "Confusable with",
    "related_to": "Related to", "contrasts_with": "Contrasts with",
}


def taxonomy(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """The relation types of checked registry files."""
    return registries.load(spark, folder).relation_types.select("id", "source_types", "target_types", "symmetric", "enabled")


def relation_keys(parsed: DataFrame) -> DataFrame:
    """(path, link, title, item_type, language, normalized, item_key) of notes with a type; types and languages as written."""
    own = filled(prop("term"), filled(prop("sentence"), filled(prop("title"), stem(F.col("path")))))
    rows = parsed.filter("has_fm").select(
        "path", link_path(F.col("path")).alias("link"), norm_db(stem(F.col("path"))).alias("title"), F.lower(strip(prop("type"))).alias("item_type"),
        filled(F.lower(strip(prop("language"))), F.lit("unknown")).alias("language"), filled(F.lower(strip(prop("normalized"))), norm_db(own)).alias("normalized"),
    )
    return rows.filter("item_type <> '' AND normalized <> ''").withColumn("item_key", item_key(F.col("item_type"), F.col("language"), F.col("normalized")))


def _linked(rows: DataFrame) -> DataFrame:
    """rows(path, origin, ord, relation_type, confidence, evidence, content) with a row per link of content."""
    links = rows.select("path", "origin", "ord", "relation_type", "confidence", "evidence", F.posexplode(links_of(F.col("content"))).alias("pos", "link"))
    return links.select("path", "origin", "ord", "pos", "relation_type", F.col("link.target").alias("target"), "confidence", "evidence")


def generic_candidates(parsed: DataFrame) -> DataFrame:
    """Edge candidates of the blocks under ## Relations; the type is stated in the block, else is the heading's."""
    blocks = parsed.select("path", F.posexplode(F.split(section(F.col("body"), "Relations"), r"(?m)(?=^###\s)")).alias("ord", "block")).filter(F.col("block").rlike(r"\A###\s"))
    heading = strip(F.regexp_replace(F.regexp_extract("block", r"\A([^\n]*)", 1), r"\A###", ""))
    rows = blocks.select("path", "ord", heading.alias("heading"), F.regexp_replace("block", r"\A[^\n]*\n?", "").alias("content"))
    known = [t[0] for t in TAXONOMY]
    stated = F.lower(F.regexp_extract("content", r"(?im)^relation_type:\s*`?([a-zA-Z0-9_]+)`?\s*$", 1))
    headed = F.regexp_replace(norm_db(F.col("heading")), " ", "_")
    kind = F.coalesce(let(stated, lambda x: F.when(x.isin(known), x)), let(headed, lambda x: F.when(x.isin(known), x)))
    typed = rows.select("path", F.lit(0).alias("origin"), "ord", kind.alias("relation_type"), F.lit(1.0).alias("confidence"), F.concat(F.lit("generic_relations_section:"), F.col("heading")).alias("evidence"), "content")
    return _linked(typed.filter("relation_type IS NOT NULL"))


def legacy_candidates(parsed: DataFrame) -> DataFrame:
    """Edge candidates of the older level-2 sections; of same-named sections the first counts."""
    pieces = parsed.select("path", F.posexplode(F.split("body", r"(?m)(?=^##\s)")).alias("at", "piece")).filter(F.col("piece").rlike(r"\A##\s"))
    named = pieces.select("path", "at", F.lower(strip(F.regexp_replace(F.regexp_extract("piece", r"\A([^\n]*)", 1), r"\A##", ""))).alias("heading"), F.regexp_replace("piece", r"\A[^\n]*\n?", "").alias("content"))
    order = {k: i for i, k in enumerate(LEGACY_SECTIONS)}
    known = named.filter(F.col("heading").isin(list(LEGACY_SECTIONS))).withColumn("__k", F.row_number().over(Window.partitionBy("path", "heading").orderBy("at"))).filter("__k = 1")
    rows = known.select(
        "path", F.lit(1).alias("origin"), F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("heading")).alias("ord"),
        looked_up(F.col("heading"), LEGACY_SECTIONS).alias("relation_type"), F.lit(0.95).alias("confidence"), F.concat(F.lit("legacy_section:"), F.col("heading")).alias("evidence"), "content",
    )
    return _linked(rows)


def resolve_links(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """candidates with source and target keys: by path, else by a title that only one note has; others are dropped."""
    by_path = keys.groupBy("link").agg(F.max_by("item_key", "path").alias("path_key"))
    by_title = keys.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.first("item_key").alias("title_key")).filter("n = 1").drop("n")
    rows = candidates.withColumns({"link": link_path(F.col("target")), "title": norm_db(stem(without_md(strip(F.col("target")))))})
    found = rows.join(by_path, "link", "left").join(by_title, "title", "left").withColumn("target_key", F.coalesce("path_key", "title_key"))
    sources = keys.select("path", F.col("item_key").alias("source_key"))
    return found.filter("target_key IS NOT NULL").join(sources, "path").drop("link", "title", "path_key", "title_key")


def validate_edges(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges of a known, enabled type between allowed item types, with a confidence from 0 to 1; adds symmetric."""
    kind = lambda c: F.split(F.col(c), r"\|", 3)[0]
    joined = edges.join(types, edges["relation_type"] == types["id"])
    ok = F.col("enabled") & F.array_contains("source_types", kind("source_key")) & F.array_contains("target_types", kind("target_key")) & F.col("confidence").between(0, 1)
    return joined.filter(ok).drop("id", "source_types", "target_types", "enabled")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Symmetric edges point from the smaller to the larger key."""
    swap = F.col("symmetric") & (F.col("source_key") > F.col("target_key"))
    source, target = F.when(swap, F.col("target_key")).otherwise(F.col("source_key")), F.when(swap, F.col("source_key")).otherwise(F.col("target_key"))
    return edges.withColumns({"source_key": source, "target_key": target})


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge per source, target and type over all notes: the first by path, then generic before legacy, then place."""
    same = Window.partitionBy("source_key", "target_key", "relation_type").orderBy("path", "origin", "ord", "pos")
    return edges.withColumn("__k", F.row_number().over(same)).filter("__k = 1").drop("__k")


def short_keys(keys: DataFrame) -> DataFrame:
    """keys whose item_key is the type and a digest. A key holds a note's whole sentence; edges are resolved and compared without it."""
    return keys.withColumn("item_key", F.concat_ws("|", "item_type", F.sha2("item_key", 256)))


def build_relations(parsed: DataFrame, types: DataFrame) -> DataFrame:
    """The relation index: (source_key, target_key, relation_type, confidence, evidence, source_path, target_path).

    Edges carry short keys until one of each triple is left; only then each end is given its key, so that no sort holds texts once for every
    edge that is stated.
    """
    keys = written(relation_keys(parsed).withColumn("place", F.monotonically_increasing_id()), "relation-keys")
    short = short_keys(keys)
    found = resolve_links(generic_candidates(parsed).unionByName(legacy_candidates(parsed)), short)
    first = dedupe_edges(canonical_edges(validate_edges(found, types))).select("source_key", "target_key", "relation_type", "confidence", "evidence", "symmetric")
    last = short.groupBy("item_key").agg(F.max(F.struct("path", "place")).alias("note"))
    for side in ("source", "target"):
        at = last.select(F.col("item_key").alias(f"{side}_key"), without_md(F.col("note.path")).alias(f"{side}_path"), F.col("note.place").alias(f"{side}_place"))
        first = first.join(at, f"{side}_key").drop(f"{side}_key")
    edges = written(first, "short-edges")
    for side in ("source", "target"):
        edges = edges.join(keys.select(F.col("place").alias(f"{side}_place"), F.col("item_key").alias(f"{side}_key")), f"{side}_place").drop(f"{side}_place")
    # Short keys are in another order.
    swap = F.col("symmetric") & (F.col("source_key") > F.col("target_key"))
    ends = {f"{a}_{c}": F.when(swap, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")) for a, b in (("source", "target"), ("target", "source")) for c in ("key", "path")}
    return edges.withColumns(ends).select("source_key", "target_key", "relation_type", "confidence", "evidence", "source_path", "target_path")


def list_relations(relations: DataFrame, n: int = 50) -> DataFrame:
    return relations.orderBy("source_key", "relation_type", "target_key").limit(n)


def search_keys(relations: DataFrame, text: str, n: int = 20) -> DataFrame:
    """Distinct (item_key, path) at either end whose key or path holds the text, as it stands, in any case."""
    ends = [relations.select(F.col(f"{s}_key").alias("item_key"), F.col(f"{s}_path").alias("path")) for s in ("source", "target")]
    low = text.lower()
    hit = F.lower("item_key").contains(low) | F.coalesce(F.lower("path").contains(low), F.lit(False))
    return ends[0].union(ends[1]).distinct().filter(hit).orderBy("item_key", "path").limit(n)


def neighbors(relations: DataFrame, keys: DataFrame) -> DataFrame:
    """(item_key, direction, relation_type, other_key, other_path) for every key of keys(item_key)."""
    out = relations.select(F.col("source_key").alias("item_key"), F.lit("outgoing").alias("direction"), "relation_type", F.col("target_key").alias("other_key"), F.col("target_path").alias("other_path"))
    into = relations.select(F.col("target_key").alias("item_key"), F.lit("incoming").alias("direction"), "relation_type", F.col("source_key").alias("other_key"), F.col("source_path").alias("other_path"))
    wanted = keys.select("item_key").distinct()
    return out.join(wanted, "item_key").unionByName(into.join(wanted, "item_key"))


def relation_label(kind: Column) -> Column:
    return F.coalesce(looked_up(F.lower(strip(kind)), LABELS), F.initcap(F.regexp_replace(F.lower(strip(kind)), "_", " ")))


def relation_views(relations: DataFrame) -> DataFrame:
    """Each edge from both of its ends, with a readable label and the other end's text."""
    both = [relations.select(F.col(f"{a}_key").alias("item_key"), F.lit(d).alias("direction"), "relation_type", F.col(f"{b}_key").alias("other_key")) for a, b, d in (("source", "target", "outgoing"), ("target", "source", "incoming"))]
    return both[0].unionByName(both[1]).withColumns({"label": relation_label(F.col("relation_type")), "other_text": F.get(F.split("other_key", r"\|", 3), 2)})


def known_keys(*sources: DataFrame) -> DataFrame:
    """Distinct item_key of all sources."""
    rows = sources[0].select("item_key")
    for s in sources[1:]:
        rows = rows.union(s.select("item_key"))
    return rows.distinct()


def audit_relations(relations: DataFrame, keys: DataFrame, types: DataFrame) -> DataFrame:
    """Issues (severity, code, source_key, relation_type, target_key).

    Unknown types and ends that no known key has are errors of an edge (ends only if any key is known); a triple stated twice
    is a warning; no edges at all is an error.
    """
    edge = ["source_key", "relation_type", "target_key"]
    issue = lambda df, severity, code: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), *edge)
    unknown = relations.join(types.select(F.col("id").alias("relation_type")), "relation_type", "left_anti")
    any_key = keys.limit(1).select(F.lit(True).alias("__any"))
    dangling = []
    for side in ("source", "target"):
        missing = relations.join(keys.select(F.col("item_key").alias(f"{side}_key")), f"{side}_key", "left_anti")
        dangling.append(issue(missing.join(any_key, F.lit(True), "left_semi"), "error", f"dangling_{side}"))
    twice = relations.groupBy(*edge).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    empty = relations.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(*[F.lit(None).cast("string").alias(c) for c in edge])
    return (
        issue(unknown, "error", "unknown_relation_type").unionByName(dangling[0]).unionByName(dangling[1])
        .unionByName(issue(twice, "warning", "duplicate_relation")).unionByName(issue(empty, "error", "no_relations_found"))
    )


def duplicate_rows(edges: DataFrame) -> DataFrame:
    """(source_key, relation_type, target_key, n, path, ord, pos) of every edge whose triple is stated n > 1 times: the rows behind duplicate_relation."""
    triple = ["source_key", "relation_type", "target_key"]
    twice = edges.groupBy(*triple).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return edges.select(*triple, "path", "ord", "pos").join(twice, triple).select(*triple, "n", "path", "ord", "pos")


def audit_summary(issues: DataFrame, relations: DataFrame) -> DataFrame:
    """(dim, value, n): issues by severity and code, edges by type, and edges without an error."""
    count = lambda df, dim, col: df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(dim).alias("dim"), "value", "n")
    edge = ["source_key", "relation_type", "target_key"]
    valid = relations.join(issues.filter("severity = 'error'").select(*edge), edge, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return (
        count(issues, "severity", "severity").unionByName(count(issues, "code", "code")).unionByName(count(relations, "relation_type", "relation_type"))
        .unionByName(valid.select(F.lit("edges").alias("dim"), F.lit("valid").alias("value"), "n"))
    )


def backfill_links(parsed: DataFrame) -> DataFrame:
    """(path, relation_type, target): links of older sections that the note's typed blocks do not state yet, each once.

    Run again after they were added, it finds none.
    """
    bare = F.regexp_replace(F.lower("target"), r"\.md\z", "").alias("__bare")
    old = legacy_candidates(parsed).select("path", "relation_type", "target", "origin", "ord", "pos", bare)
    stated = generic_candidates(parsed).select("path", "relation_type", bare)
    same = Window.partitionBy("path", "relation_type", "__bare").orderBy("ord", "pos")
    new = old.join(stated, ["path", "relation_type", "__bare"], "left_anti").withColumn("__k", F.row_number().over(same))
    return new.filter("__k = 1").select("path", "relation_type", "target")
