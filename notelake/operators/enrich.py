"""Sentences out of transcripts, and links from sentences to the vocabulary they use."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import LINK, collapse, let, norm_db, norm_ext, note_link, section, stem, strip, strip_any, without_md
from notelake.operators.grams import build_grams, candidates
from notelake.operators.index import filled, item_language, item_type, looked_up
from notelake.operators.notes import links_of, prop, transcript_text
from notelake.sources.tables import written

#: Characters that a single word must not touch.
BOUNDARY = "A-Za-z0-9_ÄÖÜäöüß"


def sentences(texts: DataFrame, rule: str = "extract") -> DataFrame:
    """(path, ord, sentence, normalized) of texts(path, text), first of each normal form per path.

    Cut at white space after a sentence end; 2 to 300 characters. The extract rule drops punctuation alone and keeps sentence
    ends in the normal form; the annotate rule does neither.
    """
    parts = texts.select("path", F.posexplode(F.split(strip(F.col("text")), r"(?U)(?<=[.!?。！？])[\s\x1c-\x1f]+")).alias("ord", "part"))
    rows = parts.select("path", "ord", strip(F.col("part")).alias("sentence")).filter(F.length("sentence").between(2, 300))
    if rule == "extract":
        rows = rows.filter(~F.col("sentence").rlike(r"(?U)\A[\W_]+\z"))
    normal = (norm_ext if rule == "extract" else norm_db)(F.col("sentence"))
    same = Window.partitionBy("path", "normalized").orderBy("ord")
    return rows.withColumn("normalized", normal).withColumn("__k", F.row_number().over(same)).filter("__k = 1").drop("__k")


def transcripts(parsed: DataFrame) -> DataFrame:
    """(path, language, text) of transcript notes."""
    rows = parsed.filter("has_fm").select("path", item_type().alias("type"), item_language().alias("language"), "body")
    return rows.filter("type = 'transcript'").select("path", "language", transcript_text(F.col("body")).alias("text"))


def safe_name(sentence: Column, most: int = 80) -> Column:
    """A file name for a sentence."""
    name = strip_any(collapse(F.regexp_replace(strip(sentence), r'[\\/:*?"<>|]', " ")), " .")
    return F.concat(F.when(name == "", "Untitled Sentence").otherwise(F.rtrim(F.left(name, F.lit(most)))), F.lit(".md"))


def contexts(parsed: DataFrame) -> DataFrame:
    """(path, ord, language, name, sentence, line, action): each sentence of each English or German transcript, and the line that names it.

    created: its sentence note does not exist yet; unchanged: the note has the line; updated: it gains it.
    """
    source = transcripts(parsed).filter(F.col("language").isin("english", "german"))
    alias = parsed.select("path", filled(prop("source_file"), stem(F.col("path"))).alias("alias"))
    found = sentences(source.select("path", "text")).join(source.select("path", "language"), "path").join(alias, "path").withColumn("name", safe_name(F.col("sentence")))
    rows = found.withColumn("line", F.concat(F.lit("- "), note_link(F.col("path"), F.col("alias")), F.lit(" — "), "sentence"))
    old = sentence_files(parsed)
    lines = context_lines(parsed).withColumn("__stated", F.lit(True))
    known = rows.join(old.select("language", "name", F.lit(True).alias("__old")), ["language", "name"], "left").join(lines, ["language", "name", "line"], "left")
    action = F.when(F.col("__old").isNull(), "created").when(F.col("__stated"), "unchanged").otherwise("updated")
    return known.select("path", "ord", "language", "name", "sentence", "line", action.alias("action"))


def _sentence_files(parsed: DataFrame) -> DataFrame:
    return parsed.filter("has_fm").filter(item_type() == "sentence").withColumns({"language": item_language(), "name": F.concat(stem(F.col("path")), F.lit(".md"))})


def sentence_files(parsed: DataFrame) -> DataFrame:
    """(language, name, first_seen, last_seen) of the sentence notes that exist, one a language and file name."""
    return _sentence_files(parsed).groupBy("language", "name").agg(F.min(prop("first_seen")).alias("first_seen"), F.max(prop("last_seen")).alias("last_seen"))


def context_lines(parsed: DataFrame) -> DataFrame:
    """(language, name, line): the distinct context lines that sentence notes have."""
    lines = _sentence_files(parsed).select("language", "name", F.explode(F.split(section(F.col("body"), "Contexts"), "\n")).alias("line"))
    return lines.select("language", "name", strip(F.col("line")).alias("line")).filter("startswith(line, '- ')").distinct()


def extract_sentences(parsed: DataFrame, as_of: str) -> DataFrame:
    """(language, name, sentence, seen_count, first_seen, last_seen, action): a sentence item per language and file name.

    Counted are the context lines that the note has or gains. A note that gains none is unchanged and keeps its dates. The table should
    be kept: the sentences are joined with what exists.
    """
    new = contexts(parsed)
    both = new.select("language", "name", "line", F.struct("path", "ord", "sentence").alias("at"), "action").unionByName(
        context_lines(parsed).withColumns({"at": F.lit(None).cast("struct<path:string,ord:int,sentence:string>"), "action": F.lit(None).cast("string")})
    )
    lines = both.groupBy("language", "name", "line").agg(F.min("at").alias("at"), F.max("action").alias("action"))
    gains = F.count(F.when(F.col("action").isin("created", "updated"), 1))
    items = lines.groupBy("language", "name").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("seen_count"), gains.alias("__gains")).filter("at IS NOT NULL")
    old = sentence_files(parsed).withColumn("__old", F.lit(True))
    rows, day = items.join(old, ["language", "name"], "left"), F.lit(as_of[:10])
    action = F.when(F.col("__old").isNull(), "created").when(F.col("__gains") > 0, "updated").otherwise("unchanged")
    first = F.coalesce(F.nullif("first_seen", F.lit("")), day)
    return rows.withColumn("action", action).select(
        "language", "name", F.col("at.sentence").alias("sentence"), "seen_count", first.alias("first_seen"), F.when(F.col("action") == "unchanged", F.col("last_seen")).otherwise(day).alias("last_seen"), "action",
    )


def extract_totals(found: DataFrame) -> DataFrame:
    """(path, n_sentences, n_created, n_updated, n_unchanged) of contexts, and over all notes where path is null."""
    counts = [F.count(F.when(F.col("action") == a, 1)).alias(f"n_{a}") for a in ("created", "updated", "unchanged")]
    return found.groupingSets([["path"], []], "path").agg(F.count(F.lit(1)).alias("n_sentences"), *counts)


def extract_summary(extracted: DataFrame) -> DataFrame:
    """(language, action, n, n_contexts) with totals where language is null."""
    return extracted.groupBy("language", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("seen_count").alias("n_contexts")).unionByName(
        extracted.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("seen_count").alias("n_contexts")).withColumn("language", F.lit(None).cast("string"))
    )


#: How a sentence's status is shown; any other is a question mark.
ICONS = {"new": "🔴", "learning": "🟡", "learned": "✅", "generated": "🔊", "raw_transcript": "🎧"}


def annotated_sentences(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """(path, ord, sentence, found, status, has_card, shown): a transcript's sentences, with the item of its language that each one is.

    Shown is the status and a link to the item's note, with a pin where it has a card; a sentence without an item is marked as new.
    Transcripts of unknown language are left out.
    """
    source = transcripts(parsed).filter("language <> 'unknown'")
    said = sentences(source.select("path", "text"), "annotate").join(source.select("path", "language"), "path")
    known = items.filter("type = 'sentence'").select("language", "normalized", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("anki_status", F.lit("none")).isin("added", "duplicate").alias("has_card"), F.col("obsidian_path").alias("__note"), F.lit(True).alias("__known"))
    rows = said.join(known, ["language", "normalized"], "left").withColumn("found", F.coalesce("__known", F.lit(False)))
    safe = F.replace(F.replace(F.replace("sentence", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    icon = F.concat(F.coalesce(looked_up(F.lower(strip(F.col("status"))), ICONS), F.lit("❔")), F.when(F.col("has_card"), " 📌").otherwise(""))
    shown = F.when(F.col("found"), F.concat(icon, F.lit(" "), note_link(F.col("__note"), F.col("sentence")))).otherwise(F.concat(F.lit('<span class="los-new">● '), safe, F.lit("</span>")))
    return rows.select("path", "ord", "sentence", "found", "status", "has_card", shown.alias("shown"))


def annotate(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """(path, n_sentences, n_found, n_new): how many of a transcript's sentences are items of its language."""
    n, found = F.count(F.lit(1)), F.count_if("found")
    return annotated_sentences(parsed, items).groupBy("path").agg(n.alias("n_sentences"), found.alias("n_found"), (n - found).alias("n_new"))


def vocabulary(parsed: DataFrame) -> DataFrame:
    """(path, term, language, term_norm, link) of vocabulary notes."""
    rows = parsed.filter("has_fm").filter(F.lower(strip(prop("type"))) == "vocabulary").filter(F.col("path").startswith("Vocabulary/"))
    term = strip(filled(prop("term"), stem(F.col("path"))))
    base = rows.select("path", "body", term.alias("term"), filled(F.lower(strip(prop("language"))), F.lit("unknown")).alias("language")).filter("term <> ''")
    return base.select("path", "body", "term", "language", norm_db(F.col("term")).alias("term_norm"), note_link(F.col("path"), F.col("term")).alias("link"))


def sentence_notes(parsed: DataFrame) -> DataFrame:
    """(path, language, sentence, sentence_norm, body) of sentence notes."""
    rows = parsed.filter("has_fm").filter(F.lower(strip(prop("type"))) == "sentence")
    text = filled(strip(prop("sentence")), filled(strip(F.regexp_extract(section(F.col("body"), "Sentence"), r"\A([^\n]*)", 1)), stem(F.col("path"))))
    base = rows.select("path", "body", filled(F.lower(strip(prop("language"))), F.lit("unknown")).alias("language"), text.alias("sentence"))
    return base.withColumn("sentence_norm", norm_db(F.col("sentence")))


def _runs_of(texts: DataFrame, lengths: DataFrame) -> DataFrame:
    """(sentence_path, language, k, run, before, after): each run of k - 2 whole words, by its hash, and the words beside it; k from lengths(k).

    A row has two words and a hash, whatever the sentence's length.
    """
    sized = lengths.agg(F.array_sort(F.collect_set("k")).alias("ks"))  # one row: a term's length in words is bounded by its own text
    split = texts.select("sentence_path", "language", F.split("sentence_norm", " ").alias("w")).join(F.broadcast(sized))
    ends = F.filter("ks", lambda k: k <= F.size("w"))
    at = split.select("sentence_path", "language", "w", F.explode(ends).alias("k"))
    at = at.select("sentence_path", "language", "w", "k", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("i"))
    return at.select("sentence_path", "language", "k", _run(F.slice("w", F.col("i") + 2, F.col("k") - 2)).alias("run"), F.get("w", F.col("i")).alias("before"), F.get("w", F.col("i") + F.col("k") - 1).alias("after"), F.slice("w", F.col("i") + 2, F.col("k") - 2).alias("inner"))


def _runs(c: Column) -> Column:
    """Runs of boundary characters. They are picked out: to split at all others takes six times as long."""
    return F.regexp_extract_all(c, F.lit(rf"[{BOUNDARY}]+"), F.lit(0))


def _run(words: Column) -> Column:
    return F.xxhash64(words)


#: Most pairs of sentence and term that one key of the last join makes, and letters beside the space on which two words meet.
PAIRS_PER_SALT, ENDS = 2_000_000, 3
#: Pairs that one task of that join makes, and most tasks; beyond, tasks make more. They go by the pairs that come out, which may be very many more than what goes in.
PAIRS_PER_TASK, MOST_TASKS = 8_000_000, 4_000


class TermHits(NamedTuple):
    """Which different terms sentences hold, and the paths of each term: much less than all pairs of paths."""

    #: (sentence_path, tid), each pair once.
    hits: DataFrame
    #: (tid, term_path).
    terms: DataFrame
    #: Whether every path is one sentence, or one term; else pairs of paths may come twice.
    unique: bool


def _meeting_ends(split: DataFrame, two: DataFrame) -> DataFrame:
    """(sentence_path, tid): terms of two words, which may begin inside a word and end inside one.

    Neighbouring words meet terms on up to ENDS letters beside the space, in the lengths that terms with the same last letter before it have; the rest of
    the two words is compared there.
    """
    sized = two.withColumns({"a": F.least(F.length("first"), F.lit(ENDS)), "b": F.least(F.length("second"), F.lit(ENDS)), "c": F.right("first", F.lit(1))})
    asked = sized.withColumns({"left": F.right("first", F.col("a")), "right": F.left("second", F.col("b"))})
    lengths = sized.groupBy("c").agg(F.collect_set(F.struct("a", "b")).alias("ends"))  # a row a letter
    w = F.split("sentence_norm", " ")
    beside = F.array_distinct(let(w, lambda x: F.zip_with(x, F.slice(x, 2, F.size(x)), lambda p, q: F.concat(p, F.lit(" "), F.coalesce(q, F.lit(""))))))  # strings: different structs are found by comparing all with all
    pairs = split.select("sentence_path", "language", F.explode(beside).alias("p")).select("sentence_path", "language", F.substring_index("p", " ", 1).alias("before"), F.substring_index("p", " ", -1).alias("after"))
    pairs = pairs.withColumn("c", F.right("before", F.lit(1)))
    ends = pairs.join(F.broadcast(lengths), "c").select("sentence_path", "language", "before", "after", F.inline("ends"))
    met = ends.withColumns({"left": F.right("before", F.col("a")), "right": F.left("after", F.col("b"))}).join(asked.select("tid", "language", "a", "b", "left", "right", "first", "second"), ["language", "a", "b", "left", "right"])
    return met.filter(F.endswith("before", "first") & F.startswith("after", "second")).select("sentence_path", "tid")


def term_hits(words: DataFrame, texts: DataFrame) -> TermHits:
    """Terms of 3 characters or more in sentences of their language.

    Several words may begin inside a word and end inside one; a single word must not touch a boundary character. Every different term is looked
    for once, however many paths have it. Single words of boundary characters meet sentences on their tokens. So do those with other signs, on their longest run of boundary
    characters, which is a token of the sentence; the sentence's word around it is compared. Two words meet neighbouring words on the letters beside the space. Of three
    words or more all but the ends are whole words: they meet on the hash of those, one for each length, and the ends are compared with the words
    beside them. Only words without any boundary character are looked up in a gram index of the sentences.
    """
    named = written(words.filter(F.length("term_norm") >= 3).select(F.col("path").alias("term_path"), "language", "term_norm").distinct(), "term-paths")
    known = written(named.select("language", "term_norm").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    terms = known.withColumn("w", F.split("term_norm", " ")).withColumn("k", F.size("w"))
    plain = F.col("term_norm").rlike(rf"\A[{BOUNDARY}]+\z")
    split = written(texts.select(F.col("path").alias("sentence_path"), "language", "sentence_norm"), "sentence-texts")
    tokens = split.select("sentence_path", "language", F.explode(F.array_distinct(_runs(F.col("sentence_norm")))).alias("term_norm"))
    hits = tokens.join(terms.filter(plain), ["language", "term_norm"]).select("sentence_path", "tid")

    several = terms.filter("k >= 3").select("tid", "language", "k", F.slice("w", 2, F.col("k") - 2).alias("t_inner"), F.get("w", F.lit(0)).alias("first"), F.get("w", F.col("k") - 1).alias("last"))
    met = _runs_of(split, several).join(several.withColumn("run", _run(F.col("t_inner"))), ["language", "k", "run"])
    rare = met.filter((F.col("inner") == F.col("t_inner")) & F.endswith("before", "first") & F.startswith("after", "last")).select("sentence_path", "tid")

    two = terms.filter("k = 2").select("tid", "language", F.get("w", F.lit(0)).alias("first"), F.get("w", F.lit(1)).alias("second"))
    open_ends = (F.col("first") == "") | (F.col("second") == "")
    rare = rare.unionByName(_meeting_ends(split, two.filter(~open_ends)))

    longest = F.array_max(F.transform(_runs(F.col("term_norm")), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    signed = terms.filter(~plain & (F.col("k") == 1)).select("tid", "language", "term_norm", longest.alias("run"))
    around = split.select("sentence_path", "language", F.explode(F.array_distinct(F.split("sentence_norm", " "))).alias("word"))
    around = around.filter(~F.col("word").rlike(rf"\A[{BOUNDARY}]*\z")).select("sentence_path", "language", "word", F.explode(F.array_distinct(_runs(F.col("word")))).alias("run"))
    alone = lambda c: F.contains(c, "term_norm") & F.regexp_like(c, F.concat(F.lit(rf"(?<![{BOUNDARY}])\Q"), F.col("term_norm"), F.lit(rf"\E(?![{BOUNDARY}])")))
    rare = rare.unionByName(around.join(signed.filter("run IS NOT NULL"), ["language", "run"]).filter(alone(F.col("word"))).select("sentence_path", "tid"))

    odd = written(signed.filter("run IS NULL").select(F.col("tid").alias("qid"), "language", "term_norm", F.lit(1).alias("k")).unionByName(two.filter(open_ends).select(F.col("tid").alias("qid"), "language", F.concat_ws(" ", "first", "second").alias("term_norm"), F.lit(2).alias("k"))), "odd-terms")
    if not odd.isEmpty():
        kept = written(split.withColumn("id", F.monotonically_increasing_id()), "sentences-by-id")
        looked = candidates(build_grams(kept, "id", F.col("sentence_norm")), odd, "term_norm").join(odd, "qid").join(kept.withColumnRenamed("language", "s_language"), "id").filter("language = s_language")
        held = F.contains("sentence_norm", "term_norm") & ((F.col("k") > 1) | alone(F.col("sentence_norm")))
        rare = rare.unionByName(looked.filter(held).select("sentence_path", F.col("qid").alias("tid")))
    unique = all(rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty() for rows, c in ((named, "term_path"), (split, "sentence_path")))
    hits = hits.unionByName(rare.distinct())  # a plain term meets a sentence's distinct tokens once
    hits = written(hits if unique else hits.distinct(), "term-hits")
    return TermHits(hits, named.join(known, ["language", "term_norm"]).select("tid", "term_path"), unique)


def term_pairs(found: TermHits, details: DataFrame) -> DataFrame:
    """(sentence_path, columns of details(tid, ...)): a row for each sentence and each row of a term that it holds. Frequent terms are dealt over salts."""
    counts = found.hits.groupBy("tid").agg(F.count(F.lit(1)).alias("held")).join(details.groupBy("tid").agg(F.count(F.lit(1)).alias("paths")), "tid")
    counts = written(counts.select("tid", (F.col("held") * F.col("paths")).alias("pairs")), "term-counts")
    salts = counts.withColumn("salts", F.ceil(F.col("pairs") / PAIRS_PER_SALT).cast("int")).filter("salts > 1").select("tid", "salts")
    tasks = min(1 + (counts.agg(F.sum("pairs")).first()[0] or 0) // PAIRS_PER_TASK, MOST_TASKS)
    salted = lambda rows: rows.join(salts, "tid", "left")
    dealt = salted(found.hits).withColumn("salt", F.coalesce(F.pmod(F.xxhash64("sentence_path"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    copies = salted(details).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    if tasks > 1:  # of few bytes, too, many pairs come: partitions put together by their bytes would be few and long
        dealt, copies = dealt.repartition(tasks, "tid", "salt"), copies.repartition(tasks, "tid", "salt")
    return dealt.join(copies, ["tid", "salt"]).drop("tid", "salt")


def match_terms(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(sentence_path, term_path): terms in sentences of their language, as term_hits finds them. There are as many rows as pairs, whatever finds them."""
    found = term_hits(words, texts)
    pairs = term_pairs(found, found.terms)
    return pairs if found.unique else pairs.distinct()


def enrich_links(parsed: DataFrame) -> DataFrame:
    """(path, vocab_links, grammar_links, status): detected links, then those the note has, first of each target."""
    words, notes = vocabulary(parsed), sentence_notes(parsed)
    found = term_hits(words, notes)
    grammar = F.transform(links_of(section(F.col("body"), "Related Grammar"), LINK), lambda l: F.concat(F.lit("[["), without_md(l["target"]), F.lit("|"), l["display"], F.lit("]]")))
    hit = term_pairs(found, written(found.terms.join(words.select(F.col("path").alias("term_path"), "link", grammar.alias("grammar")), "term_path"), "term-links"))

    def listed(rows: DataFrame, name: str) -> DataFrame:
        """rows(path, origin, first, pos, link) -> joined links, one per target."""
        target = F.lower(F.regexp_extract("link", r"\A\[\[([^\]|]+)", 1))
        same = Window.partitionBy("path", target).orderBy("origin", "first", "pos")
        # Dealt by note once: the window and the list need no shuffle of their own.
        kept = rows.repartition("path").withColumn("__k", F.row_number().over(same)).filter("__k = 1")
        return kept.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("origin", "first", "pos", "link"))), lambda x: x["link"]), " ").alias(name))

    link = F.concat(F.lit("[["), without_md(F.col("l.target")), F.lit("|"), F.col("l.display"), F.lit("]]"))
    had = lambda heading: notes.select("path", F.posexplode(links_of(section(F.col("body"), heading), LINK)).alias("pos", "l")).select("path", F.lit(1).alias("origin"), F.lit("").alias("first"), "pos", link.alias("link"))
    new_words = hit.select(F.col("sentence_path").alias("path"), F.lit(0).alias("origin"), F.col("term_path").alias("first"), F.lit(0).alias("pos"), "link")
    new_grammar = hit.select(F.col("sentence_path").alias("path"), F.lit(0).alias("origin"), F.col("term_path").alias("first"), F.posexplode("grammar").alias("pos", "link"))
    out = notes.select("path").join(listed(new_words.unionByName(had("Contains Vocabulary")), "vocab_links"), "path", "left").join(listed(new_grammar.unionByName(had("Grammar / Pattern")), "grammar_links"), "path", "left")
    rows = out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("vocab_links", "grammar_links")})
    return rows.withColumn("status", F.when((F.col("vocab_links") == "") & (F.col("grammar_links") == ""), "unchanged").otherwise("would_update"))
