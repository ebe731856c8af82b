"""Review queues: approval of candidates, and marking of sentences that are ready for cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import let, norm_cell, norm_low, section, strip
from notelake.operators.index import looked_up
from notelake.operators.notes import prop

#: Meanings that say nothing; fixed values.
EMPTY_MEANINGS = ("", "todo", "TODO", "Todo", "-", "...", "tbd", "TBD", "none", "None")


def approve(candidates: DataFrame, existing: DataFrame, key: Column, ready: Column) -> DataFrame:
    """candidates(pos, status, ...) with a new status.

    Pending ones without what they need are errors; keys that exist(key), or came earlier in the batch, are duplicates; the rest are approved.
    """
    rows = candidates.withColumns({"__key": key, "__ready": ready & (F.col("status") == "pending_review")})
    known = existing.select(F.col("key").alias("__key"), F.lit(True).alias("__known")).distinct()
    joined = rows.join(known, "__key", "left")
    earlier = F.row_number().over(Window.partitionBy("__key", "__ready").orderBy("pos")) > 1
    status = (
        F.when(F.col("status") != "pending_review", F.col("status")).when(~F.col("__ready"), "error")
        .when(F.col("__known") | earlier, "duplicate").otherwise("approved")
    )
    return joined.withColumn("new_status", status).drop("__key", "__ready", "__known")


def approve_vocabulary(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """approve by word; existing(word). Languages without a list of their own go to the English one."""
    keys = existing.select(norm_low(F.col("word")).alias("key"))
    done = approve(candidates, keys, norm_low(F.col("word_or_phrase")), strip(F.col("word_or_phrase")) != "")
    return done.withColumn("target_language", F.when(F.col("language").isin("english", "german"), F.col("language")).otherwise("english"))


def approve_errors(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """approve by wrong and correct text; existing(wrong, correct). Both texts are needed."""
    pair = lambda: F.concat(norm_low(F.col("wrong")), F.lit(" -> "), norm_low(F.col("correct")))
    return approve(candidates, existing.select(pair().alias("key")), pair(), (strip(F.col("wrong")) != "") & (strip(F.col("correct")) != ""))


def meaning_ready(c: Column) -> Column:
    return ~strip(c).isin(*EMPTY_MEANINGS)


def wants_card(c: Column) -> Column:
    """An empty cell or yes makes a card; everything else does not."""
    return F.lower(strip(c)).isin("", "yes")


def mark_candidates(parsed: DataFrame, min_seen: int = 2, all_ready: bool = False) -> DataFrame:
    """(path, marked, reason): which notes become card candidates, and why or why not."""
    rows = parsed.filter("has_fm").select(
        "path", F.lower(strip(prop("type"))).alias("kind"), F.lower(strip(prop("anki_status"))).alias("anki"), F.lower(strip(prop("status"))).alias("status"),
        section(F.col("body"), "Meaning").alias("meaning"), F.coalesce(prop("seen_count").try_cast("int"), F.lit(0)).alias("seen"),
    )
    reason = (
        F.when(F.col("kind") != "sentence", F.concat(F.lit("not sentence type: "), F.col("kind"))).when(~F.col("anki").isin("", "none"), F.concat(F.lit("anki_status already "), F.col("anki")))
        .when(F.col("status").isin("ignored", "archived"), F.concat(F.lit("sentence status is "), F.col("status"))).when(~meaning_ready(F.col("meaning")), "meaning is empty or TODO")
    )
    enough = F.lit(all_ready) | (F.col("seen") >= min_seen)
    count = F.concat(F.lit("seen_count "), F.col("seen"), F.when(F.col("seen") < min_seen, " < ").otherwise(" >= "), F.lit(f"min_seen {min_seen}"))
    last = F.lit("ready meaning and all ready ones taken") if all_ready else count
    return rows.select("path", (reason.isNull() & enough).alias("marked"), F.coalesce(reason, last).alias("reason"))


def dedupe_cards(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates(deck, front, ...) with is_duplicate, n_held and note_id: a row for each existing(deck, front, note_id) card of the same deck and front.

    A candidate without such a card has one row and no note_id. A front that very many cards have is many rows, not a large one.
    """
    counts = existing.groupBy("deck", "front").agg(F.count("note_id").alias("n_held"))
    rows = candidates.join(counts, ["deck", "front"], "left").join(existing.select("deck", "front", "note_id"), ["deck", "front"], "left")
    return rows.withColumns({"n_held": F.coalesce("n_held", F.lit(0).cast("long")), "is_duplicate": F.col("note_id").isNotNull()})


def card_candidates(rows: DataFrame, front: Column, back: Column, note: Column, wants: Column, language: Column) -> DataFrame:
    """(path, line_no, front, back, language, tags) of table rows that want a card and have both sides.

    A section named after German is German, any other English; the tags are the language and what the card is.
    """
    whole = F.concat_ws("\n\n", F.nullif(strip(back), F.lit("")), F.nullif(strip(note), F.lit("")))
    cards = rows.filter(wants_card(wants)).select("path", "line_no", strip(front).alias("front"), whole.alias("back"), F.when(language.contains("German"), "german").otherwise("english").alias("language"))
    cards = cards.withColumn("tags", F.array("language", F.lit("sentence"), F.lit("candidate")))
    return cards.filter("front <> '' AND back <> ''")


#: What a candidate's status means in the sentence table; other statuses change nothing.
TABLE_STATUS = {"approved": "Added", "duplicate": "Added", "error": "Error"}


def sync_card_status(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """rows(sentence, status, ...) with new_status from candidates(pos, sentence, status).

    Sentences meet on their stripped, collapsed text; the last candidate counts; a row set to No by hand stays.
    """
    known = candidates.withColumn("__key", norm_cell(F.col("sentence")))
    last = known.groupBy("__key").agg(F.max_by("status", "pos").alias("__status"))
    joined = rows.withColumn("__key", norm_cell(F.col("sentence"))).join(last, "__key", "left")
    mapped = looked_up(F.col("__status"), TABLE_STATUS)
    keep = (F.lower(strip(F.col("status"))) == "no") | mapped.isNull()
    return joined.withColumn("new_status", F.when(keep, F.col("status")).otherwise(mapped)).drop("__key", "__status")


def vocabulary_path(word: Column, language: Column) -> Column:
    """The note of a word: its text without signs that file names may not have, in the folder of its language; null for an empty word."""
    name = F.regexp_replace(strip(F.regexp_replace(strip(word), r'[\\/:*?"<>|]', " ")), " +", " ")
    folder = F.when(F.lower(language) == "german", "German").otherwise("English")
    return F.when(strip(word) != "", F.concat(F.lit("Vocabulary/"), folder, F.lit("/"), F.left(name, F.lit(120)), F.lit(".md")))


def upsert_vocabulary(rows: DataFrame, notes: DataFrame, as_of: str, count_again: bool = False) -> DataFrame:
    """(path, term, seen_count, last_seen, action) for vocabulary rows(word, language, line_no) against notes(path, seen_count).

    A note that exists is touched only with count_again, as every run would count it once more.
    """
    made = rows.withColumn("path", vocabulary_path(F.col("word"), F.col("language"))).filter("path IS NOT NULL")
    words = made.groupBy("path").agg(F.min_by("word", "line_no").alias("term"))
    old = notes.select("path", F.col("seen_count").alias("__seen"))
    joined = words.join(old, "path", "left")
    is_new = F.col("__seen").isNull()
    return joined.select(
        "path", "term", F.when(is_new, 1).otherwise(F.col("__seen") + int(count_again)).alias("seen_count"), F.lit(as_of[:10]).alias("last_seen"),
        F.when(is_new, "created").otherwise("updated" if count_again else "unchanged").alias("action"),
    )


#: The headings under which a word's examples stand, and what follows each.
CONTEXTS, EXAMPLES, RELATED = "## Contexts", "## Example Sentences", "## Related"


def _before(text: Column, heading: str, block: Column) -> Column:
    """text with block before the first place of heading; without the heading as it is."""
    at = F.instr(text, heading)
    return F.when(at > 0, F.concat(F.left(text, at - 1), block, F.substr(text, at, F.length(text)))).otherwise(text)


def _first(text: Column, pattern: str, value: Column) -> Column:
    """text with what follows the pattern's group 2 at its first place replaced by value."""
    return F.regexp_replace(text, F.lit(rf"(?s)\A(.*?)({pattern[0]}){pattern[1]}"), F.concat(F.lit("$1$2"), value))


def merge_examples(rows: DataFrame, notes: DataFrame, as_of: str, count_again: bool = False) -> DataFrame:
    """(path, text, n_added, action) of notes(path, text) that vocabulary rows(word, language, line_no, example, source) name.

    Rows and note are merged by example: one that the note's text does not hold yet is added once, with its source before the example
    sentences where there are contexts, and in the sentences themselves, before what is related. Its earliest row counts. The seen
    counts grow by the examples added (with count_again by all rows) and the dates are the day's; a note that gains nothing stays as it
    is, so a second run changes nothing. Words without a note are not in the result.
    """
    made = rows.withColumn("path", vocabulary_path(F.col("word"), F.col("language"))).filter("path IS NOT NULL")
    counts = made.groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"))
    said = made.select("path", "line_no", strip(F.coalesce("example", F.lit(""))).alias("example"), F.coalesce(F.nullif(strip(F.col("source")), F.lit("")), F.lit("Vocabulary Inbox")).alias("source"))
    # Many rows of one example are one before a note's examples are brought together; its text will hold those anyway.
    once = said.filter("example <> ''").groupBy("path", "example").agg(F.min(F.struct("line_no", "source")).alias("at"))
    unseen = once.join(notes.select("path", "text"), "path").filter(~F.contains("text", "example")).select("path", F.struct("at.line_no", "example", "at.source").alias("e"))
    gained = unseen.groupBy("path").agg(F.array_sort(F.collect_list("e")).alias("es"))
    joined = notes.select("path", "text").join(counts, "path").join(gained, "path", "left")

    def put(t: Column, e: Column) -> Column:
        context = F.concat(F.lit("\n- "), e["source"], F.lit("\n  - "), e["example"], F.lit("\n\n"))
        with_context = F.when(F.contains(t, F.lit(CONTEXTS)), _before(t, EXAMPLES, context)).otherwise(t)
        line = F.concat(F.lit("- "), e["example"], F.lit("\n\n"))
        # An example inside one that was added just before is there already.
        return F.when(F.contains(t, e["example"]), t).otherwise(let(with_context, lambda w: F.when(F.contains(w, F.lit(EXAMPLES)), _before(w, RELATED, line)).otherwise(w)))

    start = F.struct(F.col("text").alias("t"), F.lit(0).alias("n"))
    step = lambda s, e: let(put(s["t"], e), lambda t: F.struct(t.alias("t"), (s["n"] + (t != s["t"]).cast("int")).alias("n")))
    merged = joined.withColumn("m", F.aggregate(F.coalesce("es", F.array().cast("array<struct<line_no:int,example:string,source:string>>")), start, step))
    more = F.col("n_rows") if count_again else F.col("m.n")
    seen = F.coalesce(F.nullif(F.regexp_extract("text", r"(?s)\A---.*?\bseen_count:\s*(\d+)", 1), F.lit("")).cast("long"), F.lit(1)) + more
    day = F.lit(as_of[:10])
    text = _first(F.col("m.t"), (r"seen_count:\s*", r"\d+"), seen.cast("string"))
    for field in ("last_seen", "updated_at"):
        text = _first(text, (rf"{field}:\s*", r"[^\n]*"), day)
    text = _first(text, (r"🔁 Seen:\s*", r"\d+"), seen.cast("string"))
    changed = more > 0
    return merged.select("path", F.when(changed, text).otherwise(F.col("text")).alias("text"), F.col("m.n").cast("long").alias("n_added"), F.when(changed, "updated").otherwise("unchanged").alias("action"))
