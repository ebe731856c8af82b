"""Front matter, sections, links and transcripts of a notes table (path, text).

One pass over each text and no shuffle: everything here is a projection. The parsed table should be written once and read
by all later jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import LINK_NO_ANCHOR, norm_cell, section, stem, strip

#: Line ends of Python's str.splitlines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
PROPS = "map<string,array<string>>"


def split_frontmatter(notes: DataFrame) -> DataFrame:
    """Adds has_fm, raw_fm (null without front matter) and body. The block ends at the second ---, wherever it is."""
    parts = F.split(F.col("text"), "---", 3)
    has = F.col("text").startswith("---") & (F.size(parts) == 3)
    return notes.withColumns({
        "has_fm": F.coalesce(has, F.lit(False)),
        "raw_fm": F.when(has, F.get(parts, 1)),
        "body": F.when(has, F.regexp_replace(F.get(parts, 2), r"\A\n+", "")).otherwise(F.coalesce("text", F.lit(""))),
    })


def fm_lines() -> Column:
    """The lines of raw_fm, without empty ones at both ends."""
    return F.split(F.regexp_replace("raw_fm", r"\A\n++|(?<!\n)\n++\z", ""), "\n")


def with_front_matter(lines: Column) -> Column:
    """The note's text with other front matter, an empty line, and its body."""
    return F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n"), F.col("body"))


def scalar(value: Column) -> Column:
    """A value without one layer of matching quotes; null words are empty."""
    quoted = (F.length(value) >= 2) & ((value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'")))
    return F.when(value.isin("", "null", "None"), "").when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def props_of(raw: Column) -> Column:
    """The front matter as a map; scalars are lists of one value.

    ``key:`` opens a list, ``- item`` adds to the open list, a line without a colon closes it, later keys overwrite.
    """

    def step(acc: Column, line: Column) -> Column:
        at = F.locate(":", line)
        key, value = strip(F.substr(line, F.lit(1), at - 1)), strip(F.substr(line, at + 1, F.length(line)))
        with_value = lambda k, v: F.map_concat(F.map_filter(acc["props"], lambda x, _: x != k), F.create_map(k, v))
        state = lambda props, open_key: F.struct(props.alias("props"), open_key.alias("open"))
        none = F.lit(None).cast("string")
        item = scalar(strip(F.substr(line, F.lit(3), F.length(line))))
        return (
            F.when(line == "", acc)
            .when(line.startswith("- ") & acc["open"].isNotNull(), state(with_value(acc["open"], F.concat(F.element_at(acc["props"], acc["open"]), F.array(item))), acc["open"]))
            .when(at == 0, state(acc["props"], none))
            .when(value == "", state(with_value(key, F.array().cast("array<string>")), key))
            .otherwise(state(with_value(key, F.array(scalar(value))), none))
        )

    start = F.struct(F.create_map().cast(PROPS).alias("props"), F.lit(None).cast("string").alias("open"))
    lines = F.transform(F.split(raw, LINE_END), strip)
    return F.coalesce(F.aggregate(lines, start, step, lambda acc: acc["props"]), F.create_map().cast(PROPS))


def parse_frontmatter(notes: DataFrame) -> DataFrame:
    """split_frontmatter and a map column props."""
    return split_frontmatter(notes).withColumn("props", props_of(F.col("raw_fm")))


def prop(name: str, props: str = "props") -> Column:
    """A scalar property, empty where it is missing."""
    return F.coalesce(F.get(F.try_element_at(F.col(props), F.lit(name)), 0), F.lit(""))


def prop_list(name: str, props: str = "props") -> Column:
    """A property's stripped, not empty values."""
    values = F.coalesce(F.try_element_at(F.col(props), F.lit(name)), F.array().cast("array<string>"))
    return F.filter(F.transform(values, strip), lambda x: x != "")


def frontmatter_long(parsed: DataFrame) -> DataFrame:
    """(path, key, pos, value), one row per value."""
    return parsed.select("path", F.explode("props").alias("key", "values")).select("path", "key", F.posexplode("values").alias("pos", "value"))


def sections(parsed: DataFrame) -> DataFrame:
    """(path, ord, level, heading, content): a piece per heading of level 1 to 6; what precedes the first has level 0."""
    pieces = F.posexplode(F.split("body", r"(?m)(?=^#{1,6}\s)"))
    piece = F.col("piece")
    marks = F.regexp_extract(piece, r"\A(#{1,6})\s", 1)
    first = F.regexp_extract(piece, r"\A([^\n]*)", 1)
    return parsed.select("path", pieces.alias("ord", "piece")).filter("piece <> ''").select(
        "path", "ord", F.length(marks).alias("level"),
        F.when(marks == "", "").otherwise(strip(F.regexp_replace(first, r"\A#{1,6}", ""))).alias("heading"),
        strip(F.when(marks == "", piece).otherwise(F.regexp_replace(piece, r"\A[^\n]*", ""))).alias("content"),
    )


def study_sections(body: Column) -> Column:
    """Array of (key, content) of the sections of any level, empty ones dropped; keys in lower case with _ for white space."""
    pieces = F.filter(F.split(body, r"(?m)(?=^#{1,6}\s)"), lambda x: x.rlike(r"\A#{1,6}\s"))
    heading = lambda x: strip(F.regexp_replace(F.regexp_extract(x, r"\A#{1,6}([^\n]*)", 1), r"(?<!#)#+\s*\z", ""))
    named = F.transform(pieces, lambda x: F.struct(F.regexp_replace(F.lower(heading(x)), r"(?U)\s+", "_").alias("key"), strip(F.regexp_replace(x, r"\A[^\n]*", "")).alias("content")))
    return F.filter(named, lambda x: x["content"] != "")


def links_of(c: Column, pattern: str = LINK_NO_ANCHOR) -> Column:
    """Array of (target, display) in order; display defaults to the target's last path part without extension."""
    both = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("target"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("display"))
    shown = lambda x: F.when(strip(x["display"]) == "", stem(strip(x["target"]))).otherwise(strip(x["display"]))
    named = F.transform(both, lambda x: F.struct(strip(x["target"]).alias("target"), shown(x).alias("display")))
    return F.filter(named, lambda x: (x["target"] != "") & (F.upper(x["target"]) != "TODO"))


def wikilinks(df: DataFrame, col: str, dedupe: bool = False) -> DataFrame:
    """(path, pos, target, display) of the links in a column; dedupe keeps the first of each target in lower case without .md."""
    rows = df.select("path", F.posexplode(links_of(F.col(col))).alias("pos", "link")).select("path", "pos", "link.*")
    if not dedupe:
        return rows
    same = Window.partitionBy("path", F.regexp_replace(F.lower("target"), r"\.md\z", "")).orderBy("pos")
    return rows.withColumn("__k", F.row_number().over(same)).filter("__k = 1").drop("__k")


def transcript_text(body: Column) -> Column:
    """Plain text of a transcript: its raw, full or timestamped section, else the body, without stamps, headings, bullets and links."""
    pick = F.lit("")
    for heading in ("Timestamped Transcript", "Full Transcript", "Raw Transcript"):
        pick = F.when(section(body, heading) != "", section(body, heading)).otherwise(pick)
    text = F.when(pick == "", body).otherwise(pick)
    text = F.regexp_replace(text, r"`?\[\d{2}:\d{2}(?::\d{2})?\s*-\s*\d{2}:\d{2}(?::\d{2})?\]`?", " ")
    text = F.regexp_replace(text, r"(?m)^#+\s+.*$", " ")
    text = F.regexp_replace(text, r"(?m)^\s*-\s+", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"), r"\[\[([^\]]+)\]\]", "$1")
    return norm_cell(text)


def shown_links(c: Column) -> Column:
    """Links and embeds as what they show: the alias, or the last part of the target."""
    text = F.regexp_replace(c, r"(?U)!?\[\[[^\]|]+\|\s*+([^\]]*?)\s*\]\]", "$1")
    return F.regexp_replace(text, r"(?U)!?\[\[(?:[^\]|]*[/\\])?\s*([^\]|/\\]*?)\s*\]\]", "$1")


def clean_display(c: Column) -> Column:
    """Note text for display: no front matter, links as what they show, headings bold, one empty line at most between others."""
    text = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?s)\A---[ \t]*\n(?:.*?\n)??[ \t]*---[ \t]*(?:\n|\z)", "")
    text = F.regexp_replace(shown_links(text), r"(?m)^[ \t]*#{1,6}[ \t]+(\S[^\n]*?)[ \t]*$", "**$1**")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_inline(c: Column) -> Column:
    """A text on one line: links as what they show, code without its backticks. Front matter and headings stay."""
    return norm_cell(F.regexp_replace(shown_links(F.coalesce(c, F.lit(""))), "`([^`]+)`", "$1"))
