"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Spark deals out the documents; in every partition the texts are cut into words (matches of the tokenizer's
pattern), and the different words that the worker does not remember go to an in-process DuckDB. There a
recursive query holds one row per token position. Each round joins neighbouring positions to the merge table,
finds every word's leftmost pair of minimum rank, and contracts it; words without such a pair leave the recursion.
All positions are put in order by one sort a round: words are short, and a window's partition for each would cost more than its rows.
An ordered aggregation over the surviving positions gives a word's ids. A text's ids are those of its words in order, and
they are decoded as a whole: another ordered aggregation joins each id of the text to the vocabulary. Nothing is shuffled.

Memory is bounded, whatever the texts: words are worked on in slices of SLICE_WORDS, a query takes words up to QUERY_ROWS rows of all its
rounds, and a worker remembers two generations of REMEMBERED words. DuckDB may not spill. A word of more than LONG_WORD bytes
would need as many rounds as bytes, each over all its positions; it is contracted by the same rule with a heap (README has figures).

Null and empty texts have no tokens and decode to nothing. Only the text is read, so extra columns of any name are carried along
(given columns of the names that a function adds are replaced), repeated rows give equal rows, and an empty table gives an empty one.
Of equal pairs the leftmost is contracted first, as the tiktoken library does.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.shared import table

#: Bytes beyond which a word is contracted with a heap.
LONG_WORD = 1024
#: Rows that all rounds of one recursive query may hold, words of a slice, and words in each of two generations that a worker remembers.
QUERY_ROWS, SLICE_WORDS, REMEMBERED = 1_000_000, 300_000, 150_000
#: Longer words are not remembered.
REMEMBERED_CHARS = 64
DUCKDB_MEMORY = "200MB"

#: How a pair is packed for ``min``: its rank, then its place, then the length in bytes of its first token.
LENGTH, PLACE = 1 << 10, 1 << 28

ENCODE = f"""
WITH RECURSIVE rounds AS (
    SELECT word, pos, token, 0::SMALLINT AS round FROM positions
    UNION ALL
    SELECT c.word, c.pos, CASE WHEN c.pos = b.best // {LENGTH} % {PLACE} THEN (b.best // {LENGTH * PLACE})::INTEGER ELSE c.token END, (c.round + 1)::SMALLINT
    FROM rounds c
    JOIN (
        SELECT word, min((m.rank * {PLACE} + p.pos) * {LENGTH} + p.next_pos - p.pos) AS best
        FROM (
            SELECT word, pos, token, lead(word) OVER following AS next_word, lead(token) OVER following AS next_token, lead(pos) OVER following AS next_pos
            FROM rounds WINDOW following AS (ORDER BY word, pos)
        ) p
        JOIN merges m ON m.pair = p.token * 4294967296 + p.next_token
        WHERE p.next_word = p.word
        GROUP BY word
    ) b ON b.word = c.word
    WHERE c.pos <> b.best // {LENGTH} % {PLACE} + b.best % {LENGTH}
),
ended AS (SELECT word, max(round) AS round FROM rounds GROUP BY word)
SELECT word, list(token ORDER BY pos) AS ids FROM rounds JOIN ended USING (word, round) GROUP BY word
"""
#: The vocabulary's text has a character for each byte (U+0000 to U+00FF).
DECODE = "SELECT row, array_to_string(list(chars ORDER BY pos), '') AS chars FROM tokens JOIN vocabulary USING (token) GROUP BY row"


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def opened(known: dict[bytes, int]):
    """A DuckDB connection with the vocabulary and the merge table: every pair of tokens whose joined bytes are a token."""
    import duckdb

    if max(known.values()) * PLACE * LENGTH >= 1 << 63 or max(map(len, known)) >= LENGTH:
        raise ValueError("ranks or tokens are too large for the recursive query's packed pairs")
    pairs = [(known[t[:i]], known[t[i:]], r) for t, r in known.items() for i in range(1, len(t)) if t[:i] in known and t[i:] in known]
    merges = np.array(pairs, np.int64).reshape(-1, 3)
    con = duckdb.connect()
    con.execute(f"SET threads = 1; SET memory_limit = '{DUCKDB_MEMORY}'; SET temp_directory = ''")
    con.register("m", pa.table({"pair": merges[:, 0] * (1 << 32) + merges[:, 1], "rank": merges[:, 2]}))
    con.register("v", pa.table({"token": pa.array(known.values(), pa.int32()), "chars": [t.decode("latin-1") for t in known]}))
    con.execute("CREATE TABLE merges AS SELECT * FROM m; CREATE TABLE vocabulary AS SELECT * FROM v")
    con.unregister("m")
    con.unregister("v")
    return con


@lru_cache(2)
def engine(path: str):
    return opened(ranks(path))


def contract_long(word: bytes, known: dict[bytes, int]) -> list[int]:
    """Ids of one long word: the leftmost pair of minimum rank first, found with a heap."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := known.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := known.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        k = before[i]
        if k >= 0 and (r := known.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [known[word[i : end[i]]] for i in range(n) if alive[i]]


def encode_words(words: list[bytes], known: dict[bytes, int], con) -> list[bytes]:
    """For each word its ids as little-endian 32-bit integers."""
    out, single = [b""] * len(words), np.array([known[bytes([b])] for b in range(256)], np.int32)

    def run(part: list[int]) -> None:
        sizes = np.array([len(words[i]) for i in part])
        first = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
        pos = np.arange(len(raw)) - np.repeat(first, sizes)
        con.register("positions", pa.table({"word": np.repeat(np.array(part, np.int32), sizes), "pos": pos.astype(np.int32), "token": single[raw]}))
        got = con.sql(ENCODE).to_arrow_table()
        con.unregister("positions")
        ids = got["ids"].combine_chunks()
        flat, cuts = ids.flatten().to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
        for k, i in enumerate(got["word"].to_pylist()):
            out[i] = flat[cuts[k] : cuts[k + 1]]

    part, rows = [], 0
    for i, w in enumerate(words):
        if len(w) > LONG_WORD:
            out[i] = np.array(contract_long(w, known), "<u4").tobytes()
        elif w:
            part.append(i)
            rows += len(w) * (len(w) + 1) // 2
            if rows > QUERY_ROWS:
                run(part)
                part, rows = [], 0
    if part:
        run(part)
    return out


def decode_rows(row: np.ndarray, ids: np.ndarray, con) -> dict[int, bytes]:
    """The bytes that each row's ids stand for, in order."""
    con.register("tokens", pa.table({"row": row, "pos": np.arange(len(ids), dtype=np.int32), "token": ids.astype(np.int32)}))
    got = con.sql(DECODE).fetchall()
    con.unregister("tokens")
    return {r: chars.encode("latin-1") for r, chars in got}


class Words:
    """The ids of words, remembered in two generations: the older goes when the younger is full."""

    def __init__(self, path: str):
        self.path, self.young, self.old = path, {}, {}

    def ids_of(self, words: list[str]) -> list[bytes]:
        out, new = [self.young.get(w) for w in words], []
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = ids = self.old.get(words[i])
                if ids is None:
                    new.append(i)
                else:
                    self.young[words[i]] = ids
        for i, ids in zip(new, encode_words([words[i].encode() for i in new], ranks(self.path), engine(self.path)), strict=True):
            out[i] = ids
            if len(words[i]) <= REMEMBERED_CHARS:
                self.young[words[i]] = ids
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        return out


@lru_cache(2)
def remembered(path: str) -> Words:
    return Words(path)


@lru_cache(2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def encoded(texts: Iterable[str | None], path: str, pattern: str) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(number of the text, ids, decoded bytes) in order; a long text comes in several pieces, one without words in none."""
    words_of, known = splitter(pattern), remembered(path)

    def answer(words: list[str], owners: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, bytes]]:
        coded = pa.array(words, pa.string()).dictionary_encode()
        code = coded.indices.to_numpy()
        ids_of = known.ids_of(coded.dictionary.to_pylist())
        size = np.array([len(x) // 4 for x in ids_of])
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(ids_of), "<u4")
        sizes = size[code]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(start[code] - (ends - sizes), sizes) + np.arange(ends[-1])].view(np.int32)
        last = ends[np.cumsum([n for _, n in owners]) - 1]
        cuts = [0, *last.tolist()]
        chars = decode_rows(np.repeat(np.arange(len(owners), dtype=np.int32), np.diff(cuts)), ids, engine(path))
        for k, (doc, _) in enumerate(owners):
            yield doc, ids[cuts[k] : cuts[k + 1]], chars[k]

    held: list[str] = []
    owners: list[tuple[int, int]] = []
    for doc, text in enumerate(texts):
        #: All words at once, unless there may be more than a slice holds.
        short = len(text or "") <= SLICE_WORDS
        matches = iter(()) if short else (m[0] for m in words_of.finditer(text))
        part = words_of.findall(text or "") if short else list(islice(matches, SLICE_WORDS))
        while part:
            held += part
            owners.append((doc, len(part)))
            if len(held) >= SLICE_WORDS:
                yield from answer(held, owners)
                held, owners = [], []
            part = list(islice(matches, SLICE_WORDS))
    if held:
        yield from answer(held, owners)


def by_text(texts: pa.Array, path: str, pattern: str) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
    """The pieces of each text, one item per text."""
    ids: list[np.ndarray] = []
    chars: list[bytes] = []
    at = 0
    for doc, x, b in encoded((t.as_py() for t in texts), path, pattern):
        while at < doc:
            yield ids, chars
            ids, chars, at = [], [], at + 1
        ids.append(x)
        chars.append(b)
    while at < len(texts):
        yield ids, chars
        ids, chars, at = [], [], at + 1


def vocabulary_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path and split pattern of a public rank file."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _list_array(parts: list[list[np.ndarray]]) -> pa.ListArray:
    sizes = [sum(map(len, p)) for p in parts]
    flat = np.concatenate([x for p in parts for x in p] or [np.empty(0, np.int32)]).astype(np.int32, copy=False)
    return pa.ListArray.from_arrays(np.cumsum([0, *sizes], dtype=np.int32), pa.array(flat, pa.int32()))


def bpe_encode(text: Column, path: str, pattern: str) -> Column:
    """The token ids of each text, an array of int."""

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _list_array([x for x, _ in by_text(texts, path, pattern)])

    ids.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(ids, "array<int>")(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """The bytes of each list of ids; null for a null list."""

    def chars(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            size = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            got = decode_rows(np.repeat(np.arange(len(rows), dtype=np.int32), size), rows.flatten().to_numpy(zero_copy_only=False), engine(path))
            yield pa.array([got.get(i, b"") if ok else None for i, ok in enumerate(rows.is_valid().to_pylist())], pa.binary())

    chars.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(chars, "binary")(ids)


IDS = pa.struct([("token_ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("round_trip", pa.bool_())])


def with_token_ids(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with columns token_ids, n_tokens and round_trip (the ids decode to the text's bytes); such columns are replaced."""

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ids, same = [], []
            for t, (x, b) in zip(texts, by_text(texts, path, pattern), strict=True):
                ids.append(x)
                same.append(b"".join(b) == (t.as_py() or "").encode())
            lists = _list_array(ids)
            yield pa.StructArray.from_arrays([lists, lists.value_lengths().cast(pa.int64()), pa.array(same, pa.bool_())], fields=list(IDS))

    both.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = F.arrow_udf(both, "token_ids array<int>, n_tokens bigint, round_trip boolean")(F.col(text))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in IDS.names]
    return docs.select(*others, out.alias("__bpe")).select(*others, "__bpe.*")


DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def bpe_digest(text: Column, path: str, pattern: str) -> Column:
    """Token count, and SHA-256 of the ids and of what they decode to."""

    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for ids, chars in by_text(texts, path, pattern):
                both = sha256(), sha256()
                for x, b in zip(ids, chars, strict=True):
                    both[0].update(x.astype("<u4").tobytes())
                    both[1].update(b)
                rows.append((sum(map(len, ids)), both[0].hexdigest(), both[1].hexdigest()))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(DIGEST)], fields=list(DIGEST))

    digests.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")(text)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe_digest(F.col("text"), *vocabulary_file()).alias("d"))
    return docs.select("doc_id", "d.*")
