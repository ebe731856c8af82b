"""Column functions over note text: white space, normal forms of keys, links, cleaning, file names, tags.

White space means Unicode white space and the separators U+001C to U+001F, as in Python's str.strip.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
LINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
LINK_NO_ANCHOR = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|([^\]]+))?\]\]"


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends. A run inside is passed once: it is only entered at its first character, and given up whole."""
    return F.regexp_replace(c, rf"(?U)\A{WS}++|(?<!{WS}){WS}++\z", "")


def strip_any(c: Column, characters: str) -> Column:
    """Without those characters (inside a regular expression's brackets) at both ends."""
    return F.regexp_replace(c, rf"\A[{characters}]++|(?<![{characters}])[{characters}]++\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){WS}+", " ")


def norm_cell(c: Column) -> Column:
    """Stripped and collapsed, case kept."""
    return collapse(strip(c))


def norm_low(c: Column) -> Column:
    return F.lower(norm_cell(c))


def norm_ext(c: Column) -> Column:
    """Lower case, collapsed, quotes deleted; what deleting leaves is not collapsed again."""
    return strip(F.regexp_replace(collapse(F.lower(strip(c))), "[“”\"'`]", ""))


def without_sentence_end(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<![.!?。！？])[.!?。！？]++\z", "")


def norm_db(c: Column) -> Column:
    """norm_ext without a run of sentence ends at the end."""
    text = F.regexp_replace(collapse(F.lower(strip(c))), "[“”\"'`]", "")
    return strip(without_sentence_end(text))


def item_key(kind: Column, language: Column, normalized: Column) -> Column:
    return F.concat_ws("|", kind, language, normalized)


def parse_key(key: Column) -> Column:
    """Struct of the three stripped parts; null unless there are three. The last may hold bars."""
    parts = F.split(key, r"\|", 3)
    part = lambda i: strip(F.get(parts, i))
    return F.when(F.size(parts) == 3, F.struct(part(0).alias("item_type"), part(1).alias("language"), part(2).alias("normalized")))


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*\z", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"/+\z", ""), "/"), -1)


def without_md(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md\z", "")


def note_link(path: Column, text: Column) -> Column:
    return F.concat(F.lit("[["), without_md(path), F.lit("|"), text, F.lit("]]"))


def clean_body(c: Column) -> Column:
    """Body text for search: links give way to what they show, white space is collapsed."""
    text = F.regexp_replace(c, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2")
    text = F.regexp_replace(text, r"\[\[([^\]]+)\]\]", "$1")
    return norm_cell(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1"))


def section(body: Column, heading: str) -> Column:
    """The stripped text of the first level-2 section of that heading, up to the next one; else empty."""
    quoted = "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in heading)
    return strip(F.regexp_extract(body, rf"(?imsd)^##\s+{quoted}\s*$\n(.*?)(?=^##\s+|\z)", 1))


def preview(c: Column, n: int = 180) -> Column:
    return let(norm_cell(c), lambda t: F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - 3)), F.lit("..."))).otherwise(t))


def safe_tag(c: Column) -> Column:
    """A tag part: a-z, digits, underscore, slash and hyphen; empty gives unknown."""
    text = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), rf"(?U){WS}+", "_"), r"\+", "plus")
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9_/-]", ""), "_+", "_")
    return let(strip_any(text, "_/-"), lambda t: F.when(t == "", "unknown").otherwise(t))


def fix_path(c: Column) -> Column:
    """A path value with single forward slashes, without one layer of matching double quotes and then one of single quotes."""
    bare = lambda x, q: F.regexp_replace(x, rf"(?s)\A{q}(.*){q}\z", "$1")
    return F.regexp_replace(F.regexp_replace(bare(bare(strip(c), '"'), "'"), r"\\+", "/"), "/{2,}", "/")


def source_type(c: Column) -> Column:
    low = F.lower(strip(c))
    return (
        F.when(low.contains("stt") | low.contains("transcript"), "stt").when(low.contains("tts"), "tts").when(low.contains("writing"), "writing")
        .when(low.contains("dictionary"), "dictionary").when(low.contains("reading"), "reading").otherwise("manual")
    )


def _accented() -> tuple[str, str]:
    """Every small letter of the Latin, Greek and Cyrillic blocks that Unicode takes apart into a letter and marks, and that letter."""
    blocks = (range(0xC0, 0x250), range(0x370, 0x530), range(0x1E00, 0x2000))
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for block in blocks for c in block]
    whole = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:]) and c == c.lower()]
    return "".join(c for c, _ in whole), "".join(d for _, d in whole)


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case, without accents: composed letters lose them, combining marks go."""
    plain = F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), *_accented())
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: x != "")
