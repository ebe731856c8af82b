"""Study cards, their relations, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import let, strip
from notelake.operators.index import looked_up, note_items
from notelake.operators.notes import clean_display, clean_inline, prop, study_sections
from notelake.operators.search import item_counts, paired
from notelake.sources.tables import written

#: Learning types and what their cards say below the front.
SUBTITLES = {"vocabulary": "Vocabulary item", "sentence": "Sentence card", "grammar": "Grammar concept"}
LEARNING_TYPES = tuple(SUBTITLES)
PLACEHOLDER = "No Meaning/Explanation found yet."
#: Where each side of a card is looked for, properties first, then sections.
FRONT_FIELDS, BACK_FIELDS = ("term", "sentence", "title", "name"), ("meaning", "explanation")
BACK_SECTIONS = ("meaning", "explanation", "definition", "pattern", "notes")
EXAMPLE_SECTIONS = ("examples", "example", "sentences")
NOTE_SECTIONS = ("notes", "usage", "grammar_notes", "pattern")


def _first(*values: Column) -> Column:
    """The first stripped value that is not empty; else empty."""
    return F.coalesce(F.get(F.filter(F.transform(F.array(*values), strip), lambda x: x != ""), 0), F.lit(""))


def _section(pieces: Column, key: str) -> Column:
    """Same-named sections joined in order."""
    return F.array_join(F.transform(F.filter(pieces, lambda x: x["key"] == key), lambda x: x["content"]), "\n\n")


def build_deck(parsed: DataFrame, views: DataFrame, text: str | None = None, n: int | None = None) -> DataFrame:
    """Cards (path, item_key, type, language, front, subtitle, back, examples, notes, n_relations) of learning notes by path.

    Each side is the first filled property, then section, of its list; a back without any is a placeholder. text keeps the cards that
    hold it in any case anywhere, in a label or other end of a relation, too; n keeps the first ones. A card's relations are rows of
    card_relations, so that an item with very many of them needs no large array.
    """
    rows = note_items(parsed).filter(F.col("skip_reason").isNull() & F.col("type").isin(*LEARNING_TYPES)).select("path", "type", "language", "normalized")
    own = parsed.select("path", *[prop(p).alias(f"__{p}") for p in (*FRONT_FIELDS, *BACK_FIELDS)], study_sections(F.col("body")).alias("__pieces"))
    rows = rows.join(own, "path")
    fields, parts = (lambda names: [F.col(f"__{p}") for p in names]), (lambda names: [_section(F.col("__pieces"), k) for k in names])
    cards = rows.select(
        "path", F.concat_ws("|", "type", "language", "normalized").alias("item_key"), "type", "language", clean_inline(_first(*fields(FRONT_FIELDS), F.col("normalized"))).alias("front"),
        looked_up(F.col("type"), SUBTITLES).alias("subtitle"), clean_display(let(_first(*fields(BACK_FIELDS), *parts(BACK_SECTIONS)), lambda b: F.when(b == "", PLACEHOLDER).otherwise(b))).alias("back"),
        clean_display(_first(*parts(EXAMPLE_SECTIONS))).alias("examples"), clean_display(_first(*parts(NOTE_SECTIONS))).alias("notes"),
    )
    linked = views.groupBy("item_key").agg(F.count(F.lit(1)).alias("n_relations"))
    deck = cards.join(linked, "item_key", "left").withColumn("n_relations", F.coalesce("n_relations", F.lit(0).cast("long")))
    wanted = (text or "").strip().lower()
    if wanted:
        hit = views.filter(F.contains(F.lower(F.concat_ws(" ", "label", "other_text")), F.lit(wanted))).select("item_key", F.lit(True).alias("__hit")).distinct()
        said = F.lower(F.concat_ws("\n", "item_key", "type", "language", "front", "subtitle", "back", "examples", "notes", "path"))
        deck = deck.join(hit, "item_key", "left").filter(F.contains(said, F.lit(wanted)) | F.col("__hit")).drop("__hit")
    return deck.orderBy("path").limit(n) if n else deck


def card_relations(deck: DataFrame, views: DataFrame) -> DataFrame:
    """(path, item_key, direction, label, other_text): the relations of the deck's cards. Cards of one item repeat its relations."""
    cards, each = written(deck.select("path", "item_key"), "card-keys"), views.select("item_key", "direction", "label", "other_text")
    return paired(each, cards, item_counts(each, cards)).select("path", "item_key", "direction", "label", "other_text")


def deck_summary(cards: DataFrame) -> DataFrame:
    """(type, language, n): cards by type, by language and in all."""
    return cards.groupingSets([["type"], ["language"], []], "type", "language").agg(F.count(F.lit(1)).alias("n"))
