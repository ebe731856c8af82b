"""Alignment of two tokenizers over a corpus: which tokens of one cover which tokens of the other.

Both tokenizers cut a text's bytes (a space and the text). Offsets where tokens of both end cut the text into groups; between
two neighbouring ends of either, one token of each lies over the other: a link. How many documents hold a pair of ids linked says which
token of B a token of A goes with.

The fast path: an array gives for every id of A the id of B with the same bytes. Most groups are one such pair, and a task counts
documents of those in a vector of the length of A's vocabulary, one row of the result at its end. Only other pairs are rows of the pair
shuffle, counted in the tasks first. Documents are encoded once; their ids' groups go into the digest, their distinct linked pairs are
kept with how often each is linked, for the look-up of the corpus's counts.

The vectors, and so the counts of identical pairs and each A id's highest count, have one row for an id of A at most, whatever the corpus: they are
broadcast. Counts of other pairs are broadcast up to BROADCAST_PAIRS rows, counted before; beyond, both sides are shuffled by pair, with
the counts copied to SALTS places so that no common pair is one task's.

Defined results: texts that are null, empty, or that a tokenizer does not give back (B puts other white space or signs in some) have no
tokens: zeros and an empty digest. Repeated rows count as documents of their own; on ties of counts all the highest are best. Long texts
are encoded whole, a slice of SLICE_BYTES (one text at least) at a time. An empty table gives an empty one. Only the text
is read; further columns are carried along, and columns of the names that ``aligned`` adds are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.shared import table, written

#: A pair of ids as one number: A's id times this, and B's.
SIDE = 1 << 20
SLICE_BYTES = 1 << 19
#: Words whose tokens of A a worker remembers, and how A's byte-level splitter cuts a text into words.
REMEMBERED = 300_000
A_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Signs that are letters, digits or white space to one Unicode version and not to another: texts with others are left to A's own splitter.
UNSURE = r"[^\x09-\x0D\x20-\x7E\u00A0-\u017F\u2010-\u2027\u20AC]"
BROADCAST_PAIRS, SALTS = 1_000_000, 32

ADDED = "n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string"
KEPT = "__row long, __same array<long>, __same_n array<int>, __pairs array<long>, __pairs_n array<int>, __vector array<long>"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and for every id of A the id of B with the same bytes (or -1)."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        if max(len(self.a_bytes), len(self.b_bytes)) > SIDE:
            raise ValueError(f"vocabularies may have {SIDE} entries")
        import regex

        self.words_of, self.unsure, self.known = regex.compile(A_WORD).findall, regex.compile(UNSURE).search, {}
        splitter = json.loads(self.a.to_str())
        # Words are looked up only where A cuts texts as A_WORD does and nothing comes before or after.
        self.by_word = splitter["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not (
            splitter["normalizer"] or splitter["truncation"] or splitter["padding"] or any(not x["special"] for x in splitter["added_tokens"])
        )
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        by_bytes = {x: i for i, x in reversed(list(enumerate(self.b_bytes)))}
        self.same = np.array([by_bytes.get(x, -1) for x in self.a_bytes], np.int64)
        # What the digest has for a token: its id, and the sign after it inside a group and at the group's end.
        self.said = [f"{i}{sign}" for sign in ",|" for i in range(len(self.a_bytes))] + [f"{i}{sign}" for sign in ",;" for i in range(len(self.b_bytes))]

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        """A's ids of a space and each text: those of its words in order. A word is encoded once, as long as it is remembered."""
        whole = lambda parts: [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        sure = [self.by_word and not self.unsure(t) for t in texts]
        words = [self.words_of(" " + t) if ok else [] for t, ok in zip(texts, sure, strict=True)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(chain.from_iterable(words)).difference(self.known))
        self.known.update(zip(new, whole(new), strict=True))
        rest = iter(whole([" " + t for t, ok in zip(texts, sure, strict=True) if not ok]))
        return [list(chain.from_iterable(map(self.known.__getitem__, w))) if ok else next(rest) for w, ok in zip(words, sure, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both, empty where one side's bytes are not the text's."""
        a_ids = self.a_ids(texts)
        b_ids = self.b.encode(texts, num_threads=1)
        for k, t in enumerate(texts):
            want = b" " + t.encode()
            if not t or b"".join(map(self.a_bytes.__getitem__, a_ids[k])) != want or b"".join(map(self.b_bytes.__getitem__, b_ids[k])) != want:
                a_ids[k], b_ids[k] = [], []
        return a_ids, b_ids

    def aligned(self, texts: list[str]) -> dict:
        """Per text the counts, groups, and distinct linked pairs with their links, identical pairs apart."""
        a_ids, b_ids = self.encode(texts)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a_ids, n_a), (b_ids, n_b)))
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        # All texts in a row: both sides end together at each text's end, so no group spans two texts. Ends are marked at their byte offsets.
        a_ends, b_ends = (np.zeros(int(max(a_end[-1:].sum(), b_end[-1:].sum())) + 1, bool) for _ in "ab")
        a_ends[a_end], b_ends[b_end] = True, True
        a_last, b_last = b_ends[a_end], a_ends[b_end]
        ends = np.flatnonzero(a_ends | b_ends)
        a_at, b_at = (np.cumsum(x) - x for x in (a_ends[ends], b_ends[ends]))
        doc_of_a = np.repeat(np.arange(len(texts)), n_a)
        doc = doc_of_a[a_at] if len(ends) else a_at
        left, right = a[a_at], b[b_at]

        same = self.same[left] == right
        found = []
        for keep in (same, ~same):
            key = np.sort((doc[keep] * SIDE + left[keep]) * SIDE + right[keep])
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(first)
            counts = np.diff(np.append(starts, len(key)))
            offsets = np.searchsorted(key[starts], np.arange(len(texts) + 1) * SIDE * SIDE)
            found.append((key[starts] % (SIDE * SIDE), counts.astype(np.int32), offsets))

        # The digest's order: a group's tokens of A, then its tokens of B.
        groups_before_a, groups_before_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        a_through, b_through = np.append(np.flatnonzero(a_last) + 1, len(a)), np.append(0, np.flatnonzero(b_last) + 1)
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + b_through[groups_before_a]] = a + a_last * len(self.a_bytes)
        code[np.arange(len(b)) + a_through[groups_before_b]] = 2 * len(self.a_bytes) + b + b_last * len(self.b_bytes)
        per_doc = np.bincount(doc_of_a[a_last], minlength=len(texts))
        at = np.append(0, np.cumsum(n_a + n_b))
        said = list(map(self.said.__getitem__, code.tolist()))
        groups = ["".join(said[at[k] : at[k + 1]])[:-1] for k in range(len(texts))]
        return {"n_a": n_a, "n_b": n_b, "n_groups": per_doc, "n_links": np.bincount(doc, minlength=len(texts)), "groups": groups, "same": found[0], "pairs": found[1]}


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """Loaded once a worker."""
    return Tokenizers(a_path, b_path)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of SLICE_BYTES characters, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _linked(a_path: str, b_path: str, text: str, whole_groups: bool):
    """A task: its documents aligned, and at the end one row with the vector of documents by identical pair."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_path, b_path)
        vector = np.zeros(len(t.a_bytes), np.int64)
        row, schema = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            for i, j in _slices(texts):
                found = t.aligned(texts[i:j])
                vector += np.bincount(found["same"][0] // SIDE, minlength=len(vector))
                lists = lambda values, offsets, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
                digests = [sha256(g.encode()).hexdigest() if g else "" for g in found["groups"]]
                names, columns = list(batch.schema.names), [c.slice(i, j - i) for c in batch.columns]
                columns += [pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                columns += [pa.array(found["groups"] if whole_groups else [None] * (j - i), pa.string()), pa.array(digests, pa.string()), pa.array(np.arange(row, row + j - i), pa.int64())]
                for key in ("same", "pairs"):
                    pair, counts, offsets = found[key]
                    columns += [lists(pair, offsets, pa.int64()), lists(counts, offsets, pa.int32())]
                columns.append(pa.nulls(j - i, pa.list_(pa.int64())))
                row += j - i
                names += [f.split()[0] for f in f"{ADDED}, {KEPT}".split(", ")]
                out = pa.RecordBatch.from_arrays(columns, names)
                schema = out.schema
                yield out
        if schema is not None:
            yield pa.RecordBatch.from_arrays([pa.array([vector.tolist()], f.type) if f.name == "__vector" else pa.nulls(1, f.type) for f in schema], schema=schema)

    return run


def pair_counts(kept: DataFrame, same: list[int]) -> tuple[DataFrame, DataFrame]:
    """(pair, count, best) of identical pairs and of other pairs: documents that hold them linked, and whether none of the A id's is higher."""
    vectors = kept.filter("__vector IS NOT NULL").select(F.posexplode("__vector").alias("a", "n")).filter("n > 0").groupBy("a").agg(F.sum("n").alias("count"))
    of = kept.sparkSession.createDataFrame([(a, a * SIDE + b) for a, b in enumerate(same) if b >= 0], "a int, pair long")
    exact = written(vectors.join(F.broadcast(of), "a").select("pair", "count"), "alignment-same")
    other = written(kept.select(F.explode("__pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "alignment-pairs")
    a = F.floor(F.col("pair") / SIDE)
    highest = exact.unionByName(other).groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    graded = lambda rows: rows.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    return graded(exact), written(graded(other), "alignment-counts")


def _summed(links: DataFrame) -> DataFrame:
    n = F.col("n").cast("long")
    return links.groupBy("__row").agg(F.sum(F.when(F.col("best"), n).otherwise(0)).alias("n_best"), F.sum(n * F.col("count")).alias("count_sum"))


def looked_up(kept: DataFrame, exact: DataFrame, other: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(__row, n_best, count_sum) of documents with links."""
    laid = lambda pairs: kept.select("__row", F.inline(F.arrays_zip(F.col(pairs).alias("pair"), F.col(f"{pairs}_n").alias("n"))))
    plain = _summed(laid("__same").join(F.broadcast(exact), "pair"))
    if other.count() <= broadcast_pairs:
        rest = _summed(laid("__pairs").join(F.broadcast(other), "pair"))
    else:
        salt = F.pmod("__row", F.lit(SALTS)).cast("int").alias("salt")
        copies = other.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        rest = _summed(laid("__pairs").withColumn("salt", salt).join(copies, ["pair", "salt"]))
    return plain.unionByName(rest).groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", whole_groups: bool = True) -> DataFrame:
    """docs and n_a, n_b, n_groups, n_links, groups (as the digest reads them; null unless whole_groups), groups_sha256, n_best and count_sum."""
    added = [f.split()[0] for f in f"{ADDED}, n_best long, count_sum long".split(", ")]
    given = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c not in added])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    kept = written(given.mapInArrow(_linked(a_path, b_path, text, whole_groups), f"{fields}, {ADDED}, {KEPT}"), "alignment")
    same = tokenizers(a_path, b_path).same.tolist()
    found = looked_up(kept, *pair_counts(kept, same))
    rows = kept.filter("__row IS NOT NULL").join(found, "__row", "left")
    zero = F.lit(0).cast("long")
    return rows.select(*given.columns, *added[:6], F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def vocabulary_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment figures."""
    found = aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary_files(), whole_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
