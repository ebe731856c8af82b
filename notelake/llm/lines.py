"""Line dedup by a segment-partition edit join.

Equal lines of all documents form one class. Two classes are linked if their texts are within EDITS edits (insert, delete,
replace a character). A text is cut into EDITS + 1 segments; whatever the edits, one segment survives whole, so a linked
text holds it near the same place. The join stores each text under its segments, and probes with only those
substrings whose place and length the segment's number and the length difference allow. Pairs that meet are
verified by a banded bit-parallel edit distance. All of it is DataFrame and SQL functions.

A signature that more than HOT lines store (a passage with thousands of near copies) does not go through that join: its lines first get
a sketch of all their letters, which tells nearly all pairs apart that are too far from each other, and are joined by themselves.

Of a class, and of linked classes, the line of the first document stays: the order is by the smallest document id of a class,
then by text. Two edits are a similarity of 0.9 or more in a line of MIN_CHARS; shorter lines are only linked to equal ones. Null texts
count as empty, and empty lines belong to no class. Null ids come after all others; rows with equal ids count as one document. Lines may be
of any length up to a million characters (two longer ones of like length may stay unlinked). An empty table gives an empty table. Extra columns of any name are carried
along, but ``without_repeated_lines`` uses the names ``__text``, ``__key``, ``__first`` and ``__cut`` for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.shared import table, written

EDITS = 2
#: Two edits in a shorter line change a large part of it.
MIN_CHARS = 20


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line): each document's distinct lines that have a character."""
    return docs.select(F.col(key).alias("doc"), F.explode(F.array_distinct(text_lines(F.col(text)))).alias("line")).filter("line <> ''")


def hashes(line: Column) -> list[Column]:
    """A 96-bit name of a line, in two columns."""
    return [F.xxhash64(line).alias("h"), F.hash(line).alias("g")]


#: Stored lines under one signature beyond which they are told apart by all their letters first.
HOT = 64
#: Signatures up to which the table of hot ones is broadcast: 8 MB.
BROADCAST_SIGNATURES = 1_000_000

#: Letters whose numbers, modulo 8, make up the low bits of a line's sketch; its length stands above them. One edit
#: changes two of the numbers by one at most.
SKETCHED = "etanirso"
LETTER_BITS = 3 * len(SKETCHED)


def letter_count(line: Column, letter: str) -> Column:
    """How often an ASCII character occurs."""
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))).cast("long")


def sketch(line: Column) -> Column:
    count = lambda x: letter_count(line, x)
    return sum((F.shiftleft(count(x).bitwiseAND(F.lit(7)), 3 * i) for i, x in enumerate(SKETCHED)), F.shiftleft(F.length(line).cast("long"), LETTER_BITS))


def may_be_near(a: Column, b: Column) -> Column:
    """False only for sketches of texts that are more than EDITS edits apart."""
    part = lambda c, i: F.shiftright(c, 3 * i).bitwiseAND(F.lit(7))
    apart = lambda i: F.abs(part(a, i) - part(b, i))
    return sum((F.least(apart(i), 8 - apart(i)) for i in range(len(SKETCHED))), F.lit(0)) <= 2 * EDITS


#: The same for the lines of hot signatures: 31 characters, modulo 4.
ALL_SKETCHED = "abcdefghijklmnopqrstuvwxyz .,01"


def full_sketch(line: Column) -> Column:
    return sum((F.shiftleft(letter_count(line, x).bitwiseAND(F.lit(3)), 2 * i) for i, x in enumerate(ALL_SKETCHED)), F.lit(0).cast("long"))


def may_be_near_by_all(a: Column, b: Column) -> Column:
    """False only for full sketches of texts that are more than EDITS edits apart; counts 0 to 3 stand in a circle."""
    #: Digit by digit the difference modulo 4 (as 4 + a - b, two digits at a time so that nothing is carried over), then 1 for 1 and 3, 2 for 2.
    even = F.lit(int("0011" * 16, 2) & (1 << 62) - 1)
    four = F.lit(int("0100" * 16, 2) & (1 << 62) - 1)
    digits = lambda c, k: F.shiftrightunsigned(c, 2 * k).bitwiseAND(even)
    ones = F.lit(int("0001" * 16, 2) & (1 << 62) - 1)

    def apart(k: int) -> Column:
        d = (digits(a, k) + four - digits(b, k)).bitwiseAND(even)
        low, high = d.bitwiseAND(ones), F.shiftrightunsigned(d, 1).bitwiseAND(ones)
        return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))

    return apart(0) + apart(1) <= 2 * EDITS


#: Slots of the bitmap that tells which texts to read again: one megabyte, in tables of 256 rows at most.
BITMAP_SLOTS = 1 << 23


def held_in_bitmap(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows whose h may be among wanted(h): it drops most others without a shuffle, and none that is wanted.

    The bitmap's size does not depend on wanted, so it is safe to broadcast.
    """
    slot = lambda: F.pmod("h", F.lit(BITMAP_SLOTS))
    bits = wanted.select(F.bitmap_bucket_number(slot()).alias("__bucket"), F.bitmap_bit_position(slot()).alias("at")).groupBy("__bucket").agg(F.bitmap_construct_agg("at").alias("__bits"))
    at = F.bitmap_bit_position(slot())
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(slot()) == F.col("__bucket"))
    return met.filter(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("__bucket", "__bits")


def line_classes(found: DataFrame) -> DataFrame:
    """(h, g, line, first, n, sketch): one row per different line, with the smallest document that holds it."""
    first = found.groupBy("line").agg(F.min("doc").alias("first"))
    return first.select(*hashes(F.col("line")), "line", "first", F.length("line").alias("n"), sketch(F.col("line")).alias("sketch"))


def segment(length: Column, i: int) -> tuple[Column, Column]:
    """Start (from 1) and length of a text's i-th of EDITS + 1 segments; the last ones take what is left over."""
    n = EDITS + 1
    base, longer = F.floor(length / n).cast("int"), length % n
    start = base * i + F.greatest(F.lit(0), longer - (n - i)) + 1
    return start, base + F.when(F.lit(n - i) <= longer, 1).otherwise(0)


def signatures(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored and probing rows (sig, h, sketch) of the lines with MIN_CHARS characters or more.

    Probes in place for the own length are the stored rows themselves, which the join adds.
    """
    rows = classes.filter(F.col("n") >= MIN_CHARS)
    line, n = F.col("line"), F.col("n")

    def sig(length: Column, i: int, start: Column, size: Column) -> Column:
        return F.xxhash64(length, F.lit(i), F.substring(line, start, size))

    stored, probing = [], []
    for i in range(EDITS + 1):
        start, size = segment(n, i)
        stored.append(sig(n, i, start, size))
        for less in range(EDITS + 1):
            start, size = segment(n - less, i)
            #: With i segments before it unmatched, a segment moves by i at most, and what follows takes at most EDITS - i edits.
            for move in range(max(-i, less - (EDITS - i)), min(i, less + (EDITS - i)) + 1):
                if less or move:
                    probing.append(F.when((start + move >= 1) & (start + move + size - 1 <= n), sig(n - less, i, start + move, size)))
    #: The array is a column of its own, as a generator's argument is not compiled; compacted, it is not computed again for a filter.
    arrays = [rows.select("h", "sketch", F.array(*sigs).alias("sigs")) for sigs in (stored, probing)]
    out = [df.select("h", "sketch", F.explode(F.array_compact("sigs")).alias("sig")) for df in arrays]
    return out[0], out[1]


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by steps of halving size."""
    steps = [F.lit(1 << k) for k in range(20, -1, -1)]
    longest = F.least(F.length(a), F.length(b))

    def step(at: Column, k: Column) -> Column:
        fits = (at + k <= longest) & (F.substr(a, at + 1, k) == F.substr(b, at + 1, k))
        return F.when(fits, at + k).otherwise(at)

    return F.aggregate(F.array(*steps), F.lit(0), step)


def banded_distance(a: Column, b: Column) -> Column:
    """Edit distance of a and b if it is EDITS at most, else EDITS + 1.

    Bit-parallel over a band of 2 * EDITS + 1 diagonals: for each character of b one word holds the vertical differences of the
    dynamic programming column inside the band, and a few bit operations give the next word. b is not shorter than a.
    """
    width = 2 * EDITS + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    bits = lambda c: c.bitwiseAND(F.lit(full))
    flip = lambda c: bits(F.bitwise_not(c))
    bound = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  value is computed once
    n, m = F.length(a), F.length(b)

    def matches(chars_a: Column, char: Column, j: Column) -> Column:
        """Bit i of the band stands for row j - EDITS + i of a (from 0) in column j of b."""
        return sum((F.when((j - EDITS + i >= 0) & (F.get(chars_a, j - EDITS + i) == char), 1 << i).otherwise(0) for i in range(width)), F.lit(0))

    def turn(s: Column) -> Column:
        x, vp, vn = s["x"], s["vp"], s["vn"]
        zero = bits((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn))
        return F.struct(zero.alias("zero"), vp.alias("vp"), vn.alias("vn"), s["d"].alias("d"), s["j"].alias("j"))

    def close(s: Column, n: Column) -> Column:
        zero, vp, vn, j = s["zero"], s["vp"], s["vn"], s["j"]
        hp, hn = vn.bitwiseOR(flip(zero.bitwiseOR(vp))), zero.bitwiseAND(vp)
        down = F.shiftright(zero, 1)
        #: Down the lowest diagonal while it is inside a, then along a's last row.
        row = n - 1 - (j - EDITS)
        along = F.call_function("shiftleft", F.lit(1), F.greatest(F.least(row, F.lit(width - 1)), F.lit(0)))
        grown = F.when(row >= width - 1, F.when(zero.bitwiseAND(F.lit(top)) != 0, 0).otherwise(1)).otherwise(
            F.when(hp.bitwiseAND(along) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(along) != 0, 1).otherwise(0)
        )
        return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["d"] + grown).alias("d"))

    start = F.struct(F.lit(full - (1 << EDITS) + 1 & full).alias("vp"), F.lit(0).alias("vn"), F.least(n, F.lit(EDITS)).alias("d"))

    def run(chars: Column) -> Column:
        step = lambda s, j: F.struct(matches(chars["a"], F.get(chars["b"], j), j).alias("x"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), j.alias("j"))
        return F.aggregate(F.sequence(F.lit(0), chars["m"] - 1), start, lambda s, j: bound(bound(step(s, j), turn), lambda t: close(t, chars["n"])), lambda s: s["d"])

    end = bound(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), n.alias("n"), m.alias("m")), run)
    found = F.when(m == 0, n).when(n == 0, m).otherwise(end)
    return F.when(F.abs(m - n) > EDITS, EDITS + 1).otherwise(F.least(found, F.lit(EDITS + 1)))


def edit_distance(a: Column, b: Column) -> Column:
    """banded_distance of what lies between the common prefix and the common suffix."""
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    pair = F.struct(shorter.alias("a"), longer.alias("b"))
    bound = lambda value, f: F.transform(F.array(value), f)[0]

    def rest(p: Column) -> Column:
        k = common_prefix(p["a"], p["b"])
        return bound(k, lambda k: F.struct(*[F.reverse(F.substr(p[x], k + 1, F.length(p[x]))).alias(x) for x in "ab"]))

    return bound(bound(bound(pair, rest), rest), lambda p: banded_distance(p["a"], p["b"]))


def joined_pairs(stored: DataFrame, asked: DataFrame, near) -> DataFrame:
    """(ha, hb): different lines that meet under a signature and may be near by their sketches; one row for each signature."""
    s, p = stored.alias("s"), asked.alias("p")
    size = lambda x: F.shiftright(F.col(f"{x}.sketch"), LETTER_BITS)
    once = (size("s") < size("p")) | (size("s") == size("p")) & (F.col("s.h") < F.col("p.h"))
    met = s.join(p, (F.col("s.sig") == F.col("p.sig")) & once & near("s", "p"))
    return met.select(F.least("s.h", "p.h").alias("ha"), F.greatest("s.h", "p.h").alias("hb"))


def texts_of(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The classes whose h is among wanted(h), which has different rows only: an inner join, as a semi join would be pushed below the bitmap."""
    return held_in_bitmap(classes.select("h", "g", "line", "first"), wanted).join(wanted, "h")


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """(ha, hb) of all lines that may be within EDITS edits, each pair once."""
    stored, probing = signatures(classes)
    asked = probing.unionByName(stored)
    #: Twelve rows a line meet here; the sketch of eight letters drops most pairs at once, that of all letters most of the rest.
    by_few = lambda s, p: may_be_near(F.col(f"{s}.sketch"), F.col(f"{p}.sketch"))
    hot = written(stored.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("sig"), "hot-signatures")
    n_hot = hot.count()
    if not n_hot:
        return joined_pairs(stored, asked, by_few).distinct()
    marks = F.broadcast(hot) if n_hot <= BROADCAST_SIGNATURES else hot
    cold = joined_pairs(stored.join(marks, "sig", "left_anti"), asked, by_few)
    held = written(stored.join(marks, "sig").withColumn("stored", F.lit(True)).unionByName(asked.join(marks, "sig").withColumn("stored", F.lit(False))), "hot-lines")
    letters = written(texts_of(classes, held.select("h").distinct()).select("h", full_sketch(F.col("line")).alias("all")), "hot-sketches")
    told = held.join(letters, "h")
    by_all = lambda s, p: may_be_near_by_all(F.col(f"{s}.all"), F.col(f"{p}.all"))
    return cold.unionByName(joined_pairs(told.filter("stored"), told.filter("NOT stored"), by_all)).distinct()


def line_links(classes: DataFrame) -> DataFrame:
    """(h, g, h2, g2, later): pairs of different lines within EDITS edits, each way; later: the second line comes first."""
    pairs = written(candidate_pairs(classes), "line-pairs")
    wanted = pairs.select(F.col("ha").alias("h")).unionByName(pairs.select(F.col("hb").alias("h"))).distinct()
    texts = written(texts_of(classes, wanted).withColumn("all", full_sketch(F.col("line"))), "line-texts")
    both = pairs.join(texts.select(*[F.col(c).alias(f"{c}_a") for c in texts.columns]), F.col("ha") == F.col("h_a")).join(
        texts.select(*[F.col(c).alias(f"{c}_b") for c in texts.columns]), F.col("hb") == F.col("h_b")
    )
    near = both.filter(may_be_near_by_all(F.col("all_a"), F.col("all_b"))).filter(edit_distance(F.col("line_a"), F.col("line_b")) <= EDITS)
    place = lambda x: F.struct(F.col(f"first_{x}").isNull(), F.col(f"first_{x}"), F.col(f"line_{x}"))
    #: Written, as both ways read it and the distances are worth computing once only.
    one = written(near.select("h_a", "g_a", "h_b", "g_b", (place("b") < place("a")).alias("b_first")), "line-links")
    way = lambda x, y, later: one.select(F.col(f"h_{x}").alias("h"), F.col(f"g_{x}").alias("g"), F.col(f"h_{y}").alias("h2"), F.col(f"g_{y}").alias("g2"), later.alias("later"))
    return way("a", "b", F.col("b_first")).unionByName(way("b", "a", ~F.col("b_first")))


def judged_classes(found: DataFrame) -> DataFrame:
    """(h, g, class_id, first, n_links, later): every different line, its links, and whether a linked line comes first."""
    classes = written(line_classes(found), "line-classes")
    links = line_links(classes).groupBy("h", "g").agg(F.count(F.lit(1)).alias("n_links"), F.max("later").alias("later"))
    named = classes.select("h", "g", F.md5(F.col("line").cast("binary")).alias("class_id"), "first", "n")
    return named.join(links, ["h", "g"], "left").withColumns({"n_links": F.coalesce("n_links", F.lit(0).cast("long")), "later": F.coalesce("later", F.lit(False))})


def judged_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h, g, class_id, n, n_links, kept) for each document and each of its different lines."""
    found = occurrences(docs, key, text)
    judged = judged_classes(found).withColumnRenamed("h", "h_c").withColumnRenamed("g", "g_c")
    lines = found.select("doc", *hashes(F.col("line")))
    joined = lines.join(judged, (F.col("h") == F.col("h_c")) & (F.col("g") == F.col("g_c")))
    return joined.select("doc", "h", "g", "class_id", "n", "n_links", (F.col("doc").eqNullSafe(F.col("first")) & ~F.col("later")).alias("kept"))


def placed_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, t, pos, line, again): every line with a character, its place (from 0) in the text named t, and whether the text has it before."""
    by_line = F.array_sort(F.transform(text_lines(F.col(text)), lambda x, i: F.struct(x.alias("line"), i.alias("pos"))))
    mark = lambda a: F.transform(a, lambda s, i: F.struct(s["line"].alias("line"), s["pos"].alias("pos"), ((i > 0) & (F.get(a, i - 1)["line"] == s["line"])).alias("again")))
    marked = F.transform(F.array(by_line), mark)[0]
    rows = docs.select(F.col(key).alias("doc"), text_name(F.col(text)).alias("t"), F.explode(marked).alias("x"))
    return rows.select("doc", "t", "x.pos", "x.line", "x.again").filter("line <> ''")


def text_name(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with repeated lines of min_chars or more cut from the texts of all but the first document, and there from all but the first place.

    A document with the whole text of an earlier one loses the same lines as that one, so it stays its copy, for near-dedup. A text all
    of whose lines are cut becomes empty. Null texts stay null.
    """
    found = placed_lines(docs, key, text)
    judged = judged_classes(found.filter(~F.col("again")).select("doc", "line")).select(F.col("h").alias("h_c"), F.col("g").alias("g_c"), "first", "n", "later")
    lines = found.select("doc", "t", "pos", "again", *hashes(F.col("line")))
    met = lines.join(judged, (F.col("h") == F.col("h_c")) & (F.col("g") == F.col("g_c")) & (F.col("n") >= min_chars))
    gone = met.filter(F.col("again") | F.col("later") | ~F.col("doc").eqNullSafe(F.col("first")))
    cut = gone.groupBy("doc", "t").agg(F.array_sort(F.collect_set("pos")).alias("__cut"))
    originals = docs.select(F.col(key).alias("__key"), text_name(F.col(text)).alias("__text")).groupBy("__text").agg(F.min("__key").alias("__first"))
    by_text = originals.join(cut, F.col("__first").eqNullSafe(F.col("doc")) & (F.col("__text") == F.col("t"))).select("__text", "__cut")
    rows = docs.join(by_text, text_name(F.col(text)) == F.col("__text"), "left")

    def left(lines: Column) -> Column:
        """What stands between one cut line and the next."""
        ends = F.concat("__cut", F.array(F.size(lines)))
        return F.flatten(F.transform(ends, lambda end, i: F.slice(lines, F.coalesce(F.get(ends, i - 1), F.lit(-1)) + 2, end - F.coalesce(F.get(ends, i - 1), F.lit(-1)) - 1)))

    shortened = F.array_join(F.transform(F.array(text_lines(F.col(text))), left)[0], "\n")
    return rows.withColumn(text, F.when(F.col("__cut").isNotNull() & F.col(text).isNotNull(), shortened).otherwise(F.col(text))).select(*[f"`{c}`" for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = judged_lines(table(spark, sf_dir, "documents"))
    return lines.select(F.col("doc").alias("doc_id"), "class_id", "n_links", "kept")


#: DuckDB's levenshtein counts bytes; these letters of the test tables are first replaced by single-byte characters.
LETTERS = "éóèñüçäöêßíáúàâÉÈÑÓÇÊÜÄÖÍÁ"
BYTES = " || ".join(f"chr({n})" for n in [*range(1, 9), *range(14, 32)])
#: The same by brute force: every pair of lines of like length is compared.
OP2_SQL = f"""
WITH occurrences AS (
    SELECT doc_id, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents
),
lines AS (SELECT line, min(doc_id) AS first, length(line) AS n, translate(line, '{LETTERS}', {BYTES}) AS plain FROM occurrences WHERE line <> '' GROUP BY line),
links AS (
    SELECT a.line, count(*) AS n_links, bool_or((b.first, b.line) < (a.first, a.line)) AS later
    FROM lines a JOIN lines b ON b.n BETWEEN a.n - {EDITS} AND a.n + {EDITS} AND a.line <> b.line AND a.n >= {MIN_CHARS} AND b.n >= {MIN_CHARS}
    WHERE levenshtein(a.plain, b.plain) <= {EDITS}
    GROUP BY a.line
)
SELECT o.doc_id, md5(o.line) AS class_id, coalesce(k.n_links, 0) AS n_links, o.doc_id = l.first AND NOT coalesce(k.later, false) AS kept
FROM occurrences o JOIN lines l USING (line) LEFT JOIN links k USING (line)
"""
