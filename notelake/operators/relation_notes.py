"""Relation sections of notes: the scaffold that learning notes get, and links of older sections moved into it.

Both jobs are projections of the parsed notes: one pass over each text, no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import LINK, let, section, strip
from notelake.operators.graph import LEGACY_SECTIONS
from notelake.operators.index import looked_up
from notelake.operators.notes import fm_lines, prop, with_front_matter

#: The relation types of each kind of note, in the order of their blocks.
SECTION_TYPES = {
    "vocabulary": (
        "uses_grammar", "example_of", "similar_to", "opposite_of", "contrast_with", "confusable_with", "translation_of", "translation_variant_of", "formal_variant_of",
        "informal_variant_of", "slang_variant_of", "register_variant_of",
    ),
    "sentence": (
        "contains_vocabulary", "uses_grammar", "derived_from", "similar_to", "opposite_of", "contrast_with", "confusable_with", "negative_counterpart", "translation_of",
        "translation_variant_of",
    ),
    "grammar": ("similar_to", "contrast_with", "confusable_with", "grammar_contrast_with"),
}
#: What a sense section holds until it is filled in.
SENSES = {
    "vocabulary": "## Meanings / Senses\n\n### Sense 1 — main usage\n\nMain meaning:\n- TODO\n\nUsage:\n- TODO\n\nExamples:\n- TODO",
    "sentence": "## Meaning Variants\n\n### Variant 1 — main interpretation\n\nMain meaning:\n- TODO\n\nAlternative translations:\n- TODO\n\nUsage note:\n- TODO",
}
#: Headings that stand for a sense section.
SENSE_HEADINGS = {"vocabulary": ("Meanings / Senses", "Meaning"), "sentence": ("Meaning Variants", "Meaning")}
HINT = "Add Obsidian links under the relevant relation type.\nUse the `relation_type` line as the machine-readable id."
#: Lines of a Relations section that nobody has written by hand.
UNTOUCHED = r"\A(?:Add Obsidian links.*|Use the `relation_type`.*|###\s+[A-Za-z0-9_ ]+|relation_type:.*|- TODO|<!--|-->|- \[\[Vocabulary/German/trotzdem\|trotzdem\]\]|Controlled relation section\.|Example:)?\z"
RELATIONS = r"(?imsd)^##\s+Relations\s*$\n.*?(?=^##\s+|\z)"


def block(kind: str, content: str = "- TODO") -> str:
    return f"### {kind.replace('_', ' ').title()}\n\nrelation_type: `{kind}`\n\n{content}"


def template(note_type: str) -> str:
    """The Relations section of a kind of note, without links."""
    return "\n\n".join(["## Relations", HINT, *[block(k) for k in SECTION_TYPES[note_type]]])


def _kind() -> Column:
    """The type of a note that has relation sections; else null."""
    kind = F.lower(strip(prop("type")))
    return F.when(F.col("has_fm") & kind.isin(list(SECTION_TYPES)), kind)


def _end_stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\z", "")


def _has(body: Column, heading: str) -> Column:
    return body.rlike(rf"(?imd)^##\s+{heading}\s*$")


def _appended(body: Column, part: Column) -> Column:
    return F.when(body == "", part).otherwise(F.concat(body, F.lit("\n\n"), part))


def _replaced(body: Column, part: Column) -> Column:
    """The body with another first Relations section, an empty line before what follows it."""
    sides = F.split(body, RELATIONS, 2)
    return F.when(F.size(sides) == 2, _end_stripped(F.concat(F.get(sides, 0), part, F.lit("\n\n"), F.get(sides, 1)))).otherwise(body)


def _stamped(name: str, version: str) -> Column:
    """The front matter's lines with name set to the version, in place or at the end."""
    mine, new = (lambda x: x.rlike(rf"\A{name}\s*:")), F.lit(f"{name}: {version}")
    lines = fm_lines()
    return F.array_join(F.when(F.exists(lines, mine), F.transform(lines, lambda x: F.when(mine(x), new).otherwise(x))).otherwise(F.concat(lines, F.array(new))), "\n")


def _rewritten(rows: DataFrame, name: str, version: str, applies: Column) -> DataFrame:
    """(path, text) from rows with __old and __new bodies: where applies, and the version or the body differs, the note written anew."""
    changes = applies & ((strip(prop(name)) != version) | (F.col("__new") != F.col("__old")))
    fresh = rows.withColumn("body", F.concat("__new", F.lit("\n")))
    return fresh.select("path", F.when(F.coalesce(changes, F.lit(False)), with_front_matter(_stamped(name, version))).otherwise(F.col("text")).alias("text"))


def relations_template(parsed: DataFrame, version: str = "1.1") -> DataFrame:
    """(path, text): vocabulary, sentence and grammar notes with the scaffold of their kind.

    The version is stamped; a sense section is added to vocabulary and sentence notes that have none; a Relations section is added where
    there is none, and one that nobody has filled in is replaced. Notes without front matter or of another type stay as they are; run
    again, nothing changes. Later Relations sections of a note are left alone.
    """
    rows = parsed.withColumns({"__kind": _kind(), "__old": _end_stripped(F.col("body"))})
    body = F.col("__old")
    for kind, headings in SENSE_HEADINGS.items():
        lacks = (F.col("__kind") == kind) & ~_has(F.col("__old"), headings[0]) & ~_has(F.col("__old"), headings[1])
        body = F.when(lacks, _appended(F.col("__old"), F.lit(SENSES[kind]))).otherwise(body)
    rows = rows.withColumn("__body", body).withColumn("__part", looked_up(F.col("__kind"), {k: template(k) for k in SECTION_TYPES}))
    shown = F.split(F.regexp_replace(section(F.col("__body"), "Relations"), r"(?s)<!--.*?-->", ""), "\n")
    untouched = F.forall(shown, lambda x: strip(x).rlike(UNTOUCHED))
    new = F.when(~_has(F.col("__body"), "Relations"), _appended(F.col("__body"), F.col("__part"))).when(untouched, _replaced(F.col("__body"), F.col("__part"))).otherwise(F.col("__body"))
    return _rewritten(rows.withColumn("__new", new), "relations_template_version", version, F.col("__kind").isNotNull())


def _links(c: Column) -> Column:
    """Links as they stand, with the lower-case target that tells them apart; TODO is none."""
    whole = F.regexp_extract_all(c, F.lit(LINK), F.lit(0))
    key = lambda x: F.lower(F.regexp_replace(F.regexp_replace(strip(F.regexp_extract(x, LINK, 1)), r"#.*\z", ""), r"\.md\z|\A/+|/+\z", ""))
    both = F.transform(whole, lambda x: F.struct(key(x).alias("key"), x.alias("link")))
    return F.filter(both, lambda x: ~x["key"].isin("", "todo"))


def _unheld(links: Column, held: Column) -> Column:
    """The first link of each key that is not held, in order; by sorting, so that many links take no longer than they must."""
    ranked = lambda xs, origin: F.transform(xs, lambda x, i: F.struct(x["key"].alias("key"), F.lit(origin).alias("origin"), i.alias("i"), x["link"].alias("link")))
    first = lambda s: F.filter(s, lambda x, i: (x["origin"] == 1) & ((i == 0) | ~F.get(s, i - 1)["key"].eqNullSafe(x["key"])))
    kept = let(F.array_sort(F.concat(ranked(held, 0), ranked(links, 1))), first)
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["link"].alias("link")))), lambda x: x["link"])


def _listed(links: Column) -> Column:
    return F.array_join(F.transform(links, lambda x: F.concat(F.lit("- "), x)), "\n")


def _with_links(blocks: Column, more: Column) -> Column:
    """The blocks of a Relations section with the links of more(kind, links) in the first block of that kind, or in a new one."""

    def of_kind(b: Column) -> Column:
        stated = F.lower(F.regexp_extract(b, r"(?imd)^relation_type:\s*`?([a-zA-Z0-9_]+)`?\s*$", 1))
        headed = F.replace(F.lower(strip(F.regexp_extract(b, r"\A###\s+([^\n]*)", 1))), F.lit(" "), F.lit("_"))
        return b.startswith("###") & ((stated == more["kind"]) | (headed == more["kind"]))

    def filled(b: Column) -> Column:
        kept = _end_stripped(F.array_join(F.filter(F.split(b, "\n"), lambda x: strip(x) != "- TODO"), "\n"))
        new = let(_unheld(more["links"], _links(b)), lambda n: F.when(F.size(n) == 0, "").otherwise(F.concat(F.when(kept.rlike(r"\n[ \t]*-[^\n]*\z"), "\n").otherwise("\n\n"), _listed(n))))
        return F.concat(kept, new)

    fresh = F.concat(F.lit("### "), F.initcap(F.replace(more["kind"], F.lit("_"), F.lit(" "))), F.lit("\n\nrelation_type: `"), more["kind"], F.lit("`\n\n"), _listed(_unheld(more["links"], F.filter(more["links"], lambda x: F.lit(False)))))
    at = F.array_position(F.transform(blocks, of_kind), True)
    return let(at, lambda p: F.when(p > 0, F.transform(blocks, lambda b, i: F.when(i + 1 == p, filled(b)).otherwise(b))).otherwise(F.concat(blocks, F.array(fresh))))


def backfill_relations(parsed: DataFrame, version: str = "1.0") -> DataFrame:
    """(path, text): links of older level-2 sections added to the typed blocks of the Relations section.

    Only notes with such links change: the version is stamped, a missing Relations section is added whole, and the links of each allowed
    type join its first block without ``- TODO``, or a new block. A link whose target the block has is not added again, so a second run
    changes nothing. Blocks are parted by one empty line.
    """
    rows = parsed.withColumns({"__kind": _kind(), "__old": _end_stripped(F.col("body"))})
    kinds = list(dict.fromkeys(LEGACY_SECTIONS.values()))
    found = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.concat(*[_links(section(F.col("__old"), h)) for h, t in LEGACY_SECTIONS.items() if t == k]).alias("links")) for k in kinds
    ])
    allowed = looked_up(F.col("__kind"), {k: F.array(*[F.lit(t) for t in v]) for k, v in SECTION_TYPES.items()})
    rows = rows.withColumn("__found", F.when(F.col("__kind").isNotNull(), F.filter(found, lambda x: F.size(x["links"]) > 0)))
    rows = rows.withColumn("__more", F.filter("__found", lambda x: F.array_contains(allowed, x["kind"])))
    part = looked_up(F.col("__kind"), {k: template(k) for k in SECTION_TYPES})
    rows = rows.withColumn("__body", F.when(_has(F.col("__old"), "Relations"), F.col("__old")).otherwise(_appended(F.col("__old"), part)))
    blocks = F.transform(F.split(section(F.col("__body"), "Relations"), r"(?m)(?=^###\s)"), strip)
    mended = F.aggregate("__more", F.filter(blocks, lambda x: x != ""), _with_links)
    new = F.when(F.size("__more") > 0, _replaced(F.col("__body"), F.concat(F.lit("## Relations\n\n"), F.array_join(mended, "\n\n")))).otherwise(F.col("__body"))
    return _rewritten(rows.withColumn("__new", new), "relation_backfill_version", version, F.size("__found") > 0)
