"""Benchmark decontamination by spaced-seed hashing.

A seed mask reads some of the tokens in a short window and ignores the rest, so a hit survives
substitutions at the ignored places. The three masks below are a lossless family: however three tokens of a
window of 15 are changed, one of them still hits. Test and training hashes are joined, and around each hit the aligned
tokens are compared: a document is contaminated by an item if a window of 15 tokens (the whole item, if it
is shorter) agrees in 80 % of its places. For whole items of less than 15 tokens, masks that together are as lossless are
made from the item's length and read from the item's start; below 5 tokens 80 % means all of them.

Tokens are hashed a slice of texts at a time, by array operations. A bitmap, filled from the test hashes and sized by their number,
rides along to the documents and lets only few training hashes into the join; the join itself is exact, so the bitmap's collisions cost
time, not results. The table of test items may be of any size; beyond some four million seeds the bitmap does not grow and lets more through.

Tokens are runs of letters and digits in lower case. Texts and items without a token (null and empty ones too) match nothing, and
an empty table on either side gives an empty result. Rows with equal ids, null ids too, count as
one document; repeated rows add hits, not matches. Long texts are worked on whole. Other columns are carried along and may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.shared import table, written

#: Lossless for 3 changes in 15 tokens (a test runs through all of them). Weight 6, span 11 at most.
MASKS = ("1111011", "11001000111", "11010110001")
SPAN = max(map(len, MASKS))
WINDOW, AGREE = 15, 0.8
#: The bitmap has a power of two of bits, at least BITS_A_SEED for each test seed; from four megabytes to eight.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 16, 1 << 25, 1 << 26
#: Tokens on both sides of a seed that a window around it can reach.
BEFORE, AFTER = WINDOW - 1, WINDOW
TOKEN = re.compile(r"[^\W_]+")
NO_DOC_TOKEN, NO_ITEM_TOKEN = 1, 2
#: Characters of the texts that are hashed together; a longer text is a slice of its own.
SLICE_CHARS = 1_000_000

SEEDS = "h bigint, pos int, around array<bigint>"


class Characters:
    """For each code point whether it belongs to a token, and a 64-bit number; filled in as blocks of 256 are met."""

    def __init__(self) -> None:
        self.known = np.zeros(0x1100, bool)
        self.in_token, self.number = np.zeros(0x110000, bool), np.zeros(0x110000, np.uint64)

    def meet(self, points: np.ndarray) -> None:
        for block in np.flatnonzero((np.bincount(points >> 8, minlength=0x1100) > 0) & ~self.known):
            at = np.arange(block << 8, (block + 1) << 8)
            self.in_token[at] = [TOKEN.fullmatch(chr(c)) is not None for c in at]
            self.number[at] = mixed(at.astype(np.uint64) + np.uint64(1))
            self.known[block] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(1)
def characters() -> Characters:
    return Characters()


@lru_cache(1)
def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, 0xD6E8FEB86659FD93, np.uint64))


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens of the texts in order, and the number of tokens of each text."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = characters()
    known.meet(points)
    inside = known.in_token[points]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(t) + 1 for t in lower])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    first = np.cumsum(sizes) - sizes
    chars = known.number[points[inside]]
    power = powers(1 << int(sizes.max()).bit_length())
    chars *= power[np.arange(len(chars)) - np.repeat(first, sizes)]
    return mixed(np.add.reduceat(chars, first)) | np.uint64(4), counts


def missed(n: int) -> list[tuple[int, ...]]:
    """The changed places of an item of n tokens, as many as AGREE allows, at which none of MASKS hits."""
    seeds_of = [{o + i for i, c in enumerate(m) if c == "1"} for m in MASKS for o in range(n - len(m) + 1)]
    return [gone for gone in combinations(range(n), n - math.ceil(n * AGREE)) if all(set(gone) & seed for seed in seeds_of)]


@lru_cache(16)
def item_masks(n: int) -> tuple[tuple[int, ...], ...]:
    """Places, from the start of a whole item of n tokens, that find what MASKS miss."""
    skipped: list[set[int]] = []
    #: As many places are left as MASKS read; half of a shorter item, more than half of a very short one.
    left = MASKS[0].count("1") if n >= SPAN else max(n // 2, min(n - 1, 3))
    for gone in missed(n):
        fits = [x for x in skipped if len(x | set(gone)) <= n - left]
        if fits:
            min(fits, key=lambda x: len(x | set(gone))).update(gone)
        else:
            skipped.append(set(gone))
    return tuple(tuple(i for i in range(n) if i not in x) for x in skipped)


def mask_places(short_lengths: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], int | None]]:
    """Token offsets that each mask reads, with None; then those of whole items of the given lengths, with the length."""
    return [(tuple(i for i, c in enumerate(m) if c == "1"), None) for m in MASKS] + [(places, n) for n in short_lengths for places in item_masks(n)]


def seed_hashes(t: np.ndarray, at: np.ndarray, places: tuple[int, ...], number: int) -> np.ndarray:
    """The hash of the mask at each of the given positions of t."""
    h = np.full(len(at), (0x9E3779B97F4A7C15 * (number + 1)) & (2**64 - 1), np.uint64)
    for i in places:
        h ^= t[at + i]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def slices(texts: Iterable[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) with SLICE_CHARS characters at most, or one text."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if held and size + len(t or "") > SLICE_CHARS:
            yield first, held
            held, size, first = [], 0, i
        held.append(t or "")
        size += len(t or "")
    if held:
        yield first, held


def seeds(rows: DataFrame, key: str, text: str, filler: int, short_lengths: tuple[int, ...], bitmap=None) -> DataFrame:
    """(key, h, pos, around) of every seed; with a bitmap (a broadcast variable) only of those it lets through."""
    kind = rows.schema[key].dataType.simpleString()
    whole_items = bitmap is None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = mask_places(short_lengths)
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for first, texts in slices(x.as_py() for x in batch.column(1)):
                tokens, counts = token_hashes(texts)
                #: Each text stands between fillers, so that no seed and no window reaches into another.
                offset = np.cumsum(counts) - counts + np.arange(len(texts)) * (BEFORE + AFTER) + BEFORE
                t = np.full(len(tokens) + len(texts) * (BEFORE + AFTER), filler, np.uint64)
                owner = np.repeat(np.arange(len(texts)), counts)
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
                t[offset[owner] + pos] = tokens
                left = counts[owner] - pos
                for number, (places_of, length) in enumerate(places):
                    fits = left > places_of[-1]
                    if whole_items and length is not None:
                        fits &= (pos == 0) & (left == length)
                    of, p = owner[fits], pos[fits]
                    at = offset[of] + p
                    h = seed_hashes(t, at, places_of, number)
                    if bits is not None:
                        slot = h & np.uint64(8 * len(bits) - 1)
                        met = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                        h, of, p, at = h[met], of[met], p[met], at[met]
                    for some in range(0, len(h), 65536):
                        part = slice(some, some + 65536)
                        a = t[at[part, None] + np.arange(-BEFORE, AFTER)]
                        lists = pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel().view(np.int64)))
                        ids = batch.column(0).take(pa.array(first + of[part]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(h[part].view(np.int64)), pa.array(p[part].astype(np.int32)), lists], names=["k", "h", "pos", "around"])

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(cut, f"k {kind}, {SEEDS}")


def lengths_below_window(rows: DataFrame, text: str) -> tuple[int, ...]:
    """The different numbers of tokens below WINDOW: WINDOW - 1 values at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = {int(x) for _, texts in slices(x.as_py() for x in batch.column(0)) for x in token_hashes(texts)[1]}
            yield pa.RecordBatch.from_arrays([pa.array([x for x in n if 0 < x < WINDOW], pa.int32())], names=["n"])

    return tuple(sorted(r.n for r in rows.select(text).mapInArrow(count, "n int").distinct().collect()))


def bitmap_of(test: DataFrame) -> bytes:
    """A bit for each test hash; the collected table has MOST_BITS / 64 rows at most."""
    n_bits = min(max(LEAST_BITS, 1 << (BITS_A_SEED * test.count()).bit_length()), MOST_BITS)
    slot = F.col("h").bitwiseAND(F.lit(n_bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    got = test.select(F.shiftright(slot, 6).alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(n_bits // 64, "<i8")
    bits[got["at"].to_numpy()] = got["bits"].to_numpy()
    return bits.tobytes()


def contaminated(docs: DataFrame, bench: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document and item that share a passage: doc, item, matches in the best window, its size, first place."""
    spark = docs.sparkSession
    short = lengths_below_window(bench, text)
    test = written(seeds(bench, item_key, text, NO_ITEM_TOKEN, short), "test-seeds")
    bitmap = spark.sparkContext.broadcast(bitmap_of(test))
    found = seeds(docs, doc_key, text, NO_DOC_TOKEN, short, bitmap)
    n_item = F.size(F.filter("b.around", lambda x: x != NO_ITEM_TOKEN))
    same = F.zip_with("a.around", "b.around", lambda x, y: (x == y).cast("int"))
    window = F.least(n_item, F.lit(WINDOW))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(BEFORE + AFTER - WINDOW + 1)), lambda i: F.aggregate(F.slice(same, i, WINDOW), F.lit(0), lambda s, x: s + x)))
    hits = found.alias("a").join(test.alias("b"), (F.col("a.h") == F.col("b.h")) & (best >= F.ceil(window * AGREE)))
    return hits.groupBy(F.col("a.k").alias("doc"), F.col("b.k").alias("item")).agg(
        F.max(best).alias("matches"), F.max(window).alias("window"), F.min("a.pos").alias("first_token"), F.count(F.lit(1)).alias("n_hits")
    )


def decontaminated(docs: DataFrame, bench: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """docs without the contaminated ones."""
    bad = contaminated(docs, bench, doc_key, item_key, text).select("doc").distinct()
    return docs.join(bad, docs[doc_key].eqNullSafe(bad["doc"]), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "matches", "window", "first_token", "n_hits")
