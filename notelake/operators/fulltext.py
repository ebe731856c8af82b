"""A kept full-text index that grows by segments, and searches of whole tables of queries over it.

A segment holds the postings of one batch of documents, bucketed by term, and their tokens in order, bucketed by path. Postings are
lists: a row has those of one term in up to 16,384 documents that follow each other, made where these lie, so that few rows are shuffled, once,
into their buckets. A query meets the postings of its rarest token only: that shuffles the query terms.
What else it asks of a document is looked up in the document's tokens: that shuffles the pairs of query and document.
Documents that come again or are gone are struck out of older segments by a small table, and their terms are taken off the counts;
merging writes what is left as one segment. What belongs to the index is one committed version (sources.versions).

Ranked search reads few of the postings: for each term and BLOCK documents a segment states the highest frequency and the least
length, which bound a document's score from above. A query first scores its most promising blocks; then only those whose bound
reaches the score of its n-th best so far. Results are those of scoring all documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.functions.text import let, tokens
from notelake.operators.search import K1, B, _fits, query_terms, query_words, snippets_of, top
from notelake.sources import versions
from notelake.sources.tables import COMPRESSION, written

#: Least number of buckets of a segment, and documents for which it has one more (rounded up to a power of two).
BUCKETS, DOCS_PER_BUCKET = 16, 16_384
#: Documents of a block (a power of two), and blocks that a query scores first for each result wanted.
BLOCK_BITS, FIRST_BLOCKS = 7, 1
#: Documents of a chunk (a power of two), whose postings of a term are one list, and letters of a chunk after which a new list begins.
CHUNK_BITS, MOST_LETTERS = 14, 1 << 25

#: A list's data is one array, which takes less than several: for each of n places a document's number in the chunk, doubled, plus 1 for its body; for each, where
#: its positions end; for each of n_blocks the block's number in the chunk with its documents, the highest frequency and the least length; all positions.
LISTS = "term string, chunk bigint, docs int, n int, n_blocks int, data array<int>"
COUNTS = "term string, df bigint"
TEXTS = "path string, doc bigint, language string, type string, len bigint, title string, body string"
SEGMENT = "segments array<string>, struck string"


class TextIndex(NamedTuple):
    """Postings, blocks, texts and lists: one table a segment; documents, counts and what is struck out over all of them."""

    #: (term, path, doc, col, tf, positions) of living documents.
    postings: list[DataFrame]
    #: (term, block, max_tf, min_len, n).
    blocks: list[DataFrame]
    #: (path, len, title, body) of living documents, as tokens in order with blanks between them.
    texts: list[DataFrame]
    #: (path, segment, doc, language, type, len) of living documents.
    docs: DataFrame
    #: (term, df) of living documents.
    counts: DataFrame
    #: The postings as they are kept.
    lists: list[DataFrame]
    #: docs of each segment.
    parts: list[DataFrame]


def _bucketed(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The table at path, bucketed by its first column into as many buckets as the segment's name ends with, named for this session."""
    name, by, buckets = f"bucketed_{uuid.uuid4().hex}", columns.split()[0], int(path.rsplit("/", 1)[0].rsplit("-", 1)[1])
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _write_dealt(df: DataFrame, path: str, columns: str, buckets: int) -> None:
    """Writes rows that are dealt into the buckets already, as columns states."""
    name, names = f"bucketed_{uuid.uuid4().hex}", [c.split()[0] for c in columns.split(", ")]
    by = names[0]
    df.select(*names).write.bucketBy(buckets, by).sortBy(by).option("path", path).option("compression", COMPRESSION).saveAsTable(name)


def _words(c: str | Column) -> Column:
    """A text's tokens, which are kept with blanks between them: they hold none."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def _said(c: str) -> Column:
    """A text's tokens with blanks around each: any of them, or some that follow each other, are found as strings between two blanks."""
    return F.concat(F.lit(" "), c, F.lit(" "))


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _lists_of(doc: np.ndarray, length: np.ndarray, title: pa.Array, body: pa.Array, block_bits: int) -> pa.RecordBatch:
    """The lists of some documents of one chunk."""
    chunk = int(doc[0]) >> CHUNK_BITS
    texts = pa.concat_arrays([title, body]).take(pa.array(np.arange(2 * len(doc)).reshape(2, -1).T.ravel()))  # a title, its body, the next title
    split = pc.split_pattern(texts, " ")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    at = np.repeat((((doc - (chunk << CHUNK_BITS)) << 1)[:, None] + np.array([0, 1])).ravel(), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flat = split.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # an empty text is one empty string
    coded = flat.filter(pa.array(full)).dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code, at, pos = code[order], at[full][order], pos[full][order]
    entries = _firsts(code, at)
    terms = _firsts(code[entries])
    ends = np.append(entries[1:], len(code))
    sizes = np.diff(np.append(terms, len(entries)))
    ends = ends - np.repeat(entries[terms], sizes)
    held = _firsts(code, at >> 1)
    tf, of = np.diff(np.append(held, len(code))), at[held] >> 1
    inner = of >> block_bits
    blocks = _firsts(code[held], inner)
    lengths, n_held = length[of - (int(doc[0]) & ((1 << CHUNK_BITS) - 1))], np.diff(np.append(blocks, len(held)))
    by_block = np.column_stack(((inner[blocks] << (block_bits + 1)) + n_held, np.maximum.reduceat(tf, blocks), np.minimum.reduceat(lengths, blocks))).ravel()
    starts = _firsts(code[held][blocks])
    n_blocks = np.diff(np.append(starts, len(blocks)))
    n_positions = np.diff(np.append(entries[terms], len(code)))
    parts = [(at[entries], sizes), (ends, sizes), (by_block, 3 * n_blocks), (pos, n_positions)]
    firsts = np.cumsum(whole := sum(n for _, n in parts)) - whole
    data, before = np.empty(whole.sum(), dtype=np.int32), firsts
    for values, n in parts:
        data[np.arange(len(values)) + np.repeat(before - (np.cumsum(n) - n), n)] = values
        before = before + n
    columns = [
        coded.dictionary.take(pa.array(code[entries][terms])), pa.array(np.full(len(terms), chunk)), pa.array(np.add.reduceat(n_held, starts), pa.int32()), pa.array(sizes, pa.int32()), pa.array(n_blocks, pa.int32()),
        pa.ListArray.from_arrays(pa.array(np.append(firsts, len(data)), pa.int32()), pa.array(data)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LISTS.split(", ")])


def _inverted(block_bits: int):
    """Lists of the documents (doc, len, title, body) of each batch, chunk by chunk; doc ascends by one in a chunk's part."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "len"))
            title, body = (batch.column(c) for c in ("title", "body"))
            letters = np.cumsum(pc.binary_length(title).to_numpy(zero_copy_only=False).astype(np.int64) + pc.binary_length(body).to_numpy(zero_copy_only=False))
            cuts = [*_firsts(doc >> CHUNK_BITS, doc - np.arange(len(doc)), letters // MOST_LETTERS), len(doc)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if length[a:b].any():
                    yield _lists_of(doc[a:b], length[a:b], title.slice(a, b - a), body.slice(a, b - a), block_bits)

    return invert


def _write_segment(docs: DataFrame, prefix: str, expected: int | None = None) -> str:
    """docs(path, language, doc_type, title, body) as a segment; its path, which ends with the number of its buckets.

    Texts are shuffled and written once, postings likewise; all else is made from these two tables, on their buckets. The number of
    buckets goes by the documents expected; without it they are counted.
    """
    spark = docs.sparkSession
    buckets = max(BUCKETS, 1 << ((docs.count() if expected is None else expected) // DOCS_PER_BUCKET).bit_length())
    path = f"{prefix}-{buckets}"
    listed = [F.array_join(F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")), " ").alias(c) for c in ("title", "body")]
    dealt = docs.select("path", "language", F.col("doc_type").alias("type"), *listed).repartition(buckets, "path").sortWithinPartitions("path")
    length = F.size(_words("title")) + F.size(_words("body"))
    _write_dealt(dealt.withColumns({"doc": F.monotonically_increasing_id(), "len": length.cast("long")}), f"{path}/texts", TEXTS, buckets)
    numbered = _bucketed(spark, f"{path}/texts", TEXTS)
    numbered.select("path", "doc", "language", "type", "len").write.parquet(f"{path}/docs", compression=COMPRESSION)
    _paths(numbered).write.parquet(f"{path}/paths", compression=COMPRESSION)
    lists = numbered.select("doc", "len", "title", "body").mapInArrow(_inverted(BLOCK_BITS), LISTS)
    _write_dealt(lists.repartition(buckets, "term"), f"{path}/postings", LISTS, buckets)
    _write_dealt(_bucketed(spark, f"{path}/postings", LISTS).groupBy("term").agg(F.sum("docs").alias("df")), f"{path}/counts", COUNTS, buckets)
    return path


def _paths(docs: DataFrame) -> DataFrame:
    """(chunk, paths): a row for each chunk of docs(doc, path)."""
    return docs.groupBy(F.shiftright("doc", CHUNK_BITS).alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("doc", "path"))), lambda x: x["path"]).alias("paths"))


def _places(n: str) -> Column:
    """0 to n - 1, where n is above 0."""
    return F.sequence(F.lit(0), F.col(n) - 1)


def _flat(lists: DataFrame, paths: DataFrame) -> DataFrame:
    """(term, path, doc, col, tf, positions) of lists, without documents whose path is null in paths(chunk, paths)."""

    def one(i: Column) -> Column:
        at, first, end = F.get("data", i), F.when(i == 0, F.lit(0)).otherwise(F.get("data", F.col("n") + i - 1)), F.get("data", F.col("n") + i)
        return F.struct(F.get("paths", F.shiftright(at, 1)).alias("path"), (F.shiftleft("chunk", CHUNK_BITS) + F.shiftright(at, 1)).alias("doc"), at.alias("at"), first.alias("first"), (end - first).alias("tf"))

    rows = lists.join(paths, "chunk").select("term", "data", (2 * F.col("n") + 3 * F.col("n_blocks") + 1).alias("begin"), F.inline(F.transform(_places("n"), one))).filter("path IS NOT NULL")
    return rows.select("term", "path", "doc", F.when(F.col("at") % 2 == 0, "title").otherwise("body").alias("col"), F.col("tf").cast("long").alias("tf"), F.slice("data", F.col("begin") + F.col("first"), F.col("tf")).alias("positions"))


def _blocks(lists: DataFrame) -> DataFrame:
    """(term, block, max_tf, min_len, n) of lists, on their buckets. A block that a list's end cuts is put together."""
    own = lambda i, k: F.get("data", 2 * F.col("n") + 3 * i + k)
    rows = lists.select("term", "chunk", F.inline(F.transform(_places("n_blocks"), lambda i: F.struct(own(i, 0).alias("at"), own(i, 1).alias("max_tf"), own(i, 2).alias("min_len")))))
    block = F.shiftleft("chunk", CHUNK_BITS - BLOCK_BITS) + F.shiftright("at", BLOCK_BITS + 1)
    n = F.col("at").bitwiseAND((2 << BLOCK_BITS) - 1)
    return rows.groupBy("term", block.alias("block")).agg(F.max("max_tf").cast("long").alias("max_tf"), F.min("min_len").cast("long").alias("min_len"), F.sum(n).alias("n"))


def _state(spark: SparkSession, folder: str):
    now = versions.current(spark, folder, SEGMENT)
    return (0, [], None) if now is None else (now.number, list(now.segments), now.struck)


STRUCK = "segment string, path string"
TAKEN = "term string, df bigint"


def add_documents(folder: str, docs: DataFrame, gone: DataFrame | None = None, expected: int | None = None) -> None:
    """Adds search documents, about as many as expected, as a segment; documents of the same paths, and those of gone(path), are struck out of older ones."""
    spark = docs.sparkSession
    number, segments, struck = _state(spark, folder)
    new = _write_segment(docs, f"{folder}/segment-{number + 1}-{uuid.uuid4().hex}", expected)
    at = None
    if segments:
        out = docs.select("path").unionByName(gone.select("path")) if gone is not None else docs.select("path")
        index = read_index(spark, folder)
        hit = index.docs.join(out.distinct(), "path", "left_semi").select("segment", "path")
        at = f"{folder}/struck-{number + 1}-{uuid.uuid4().hex}"
        before = spark.read.schema(STRUCK).parquet(f"{struck}/docs") if struck else spark.createDataFrame([], STRUCK)
        hit.write.parquet(f"{at}/new")
        lost = spark.read.schema(STRUCK).parquet(f"{at}/new")
        before.unionByName(lost).write.parquet(f"{at}/docs")
        taken = None
        for s, x in zip(segments, index.texts, strict=True):
            held = x.join(lost.filter(F.col("segment") == s).select("path"), "path", "left_semi").select(F.explode(F.array_distinct(_words(F.concat("title", F.lit(" "), "body")))).alias("term"))
            one = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            taken = one if taken is None else taken.unionByName(one)
        old = spark.read.schema(TAKEN).parquet(f"{struck}/taken") if struck else spark.createDataFrame([], TAKEN)
        old.unionByName(taken).groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{at}/taken")
    versions.commit(spark, folder, SEGMENT, number + 1, [*segments, new], at)


def read_index(spark: SparkSession, folder: str) -> TextIndex:
    """The current version. What is struck out is left out of all tables but the blocks, whose bounds stay above the truth."""
    _, segments, struck = _state(spark, folder)
    if not segments:
        raise ValueError(f"no index in {folder}")
    lost = spark.read.schema(STRUCK).parquet(f"{struck}/docs") if struck else None
    docs = counts = None
    postings, blocks, texts, kept, parts = [], [], [], [], []
    for s in segments:
        own = spark.read.parquet(f"{s}/docs").withColumn("segment", F.lit(s))
        df = _bucketed(spark, f"{s}/counts", COUNTS)
        p = _bucketed(spark, f"{s}/postings", LISTS)
        x = _bucketed(spark, f"{s}/texts", TEXTS).select("path", "len", "title", "body")
        gone = None if lost is None else lost.filter(F.col("segment") == s).select("path")
        named = spark.read.parquet(f"{s}/paths")
        if gone is not None:
            struck_out = own.select("path", "doc").join(gone.withColumn("__gone", F.lit(True)), "path", "left")
            named = _paths(struck_out.select("doc", F.when(F.col("__gone").isNull(), F.col("path")).alias("path")))
            own, x = own.join(gone, "path", "left_anti"), x.join(gone, "path", "left_anti")
        docs = own if docs is None else docs.unionByName(own)
        counts = df if counts is None else counts.unionByName(df)
        texts.append(x)
        postings.append(_flat(p, named))
        blocks.append(_blocks(p))
        kept.append(p)
        parts.append(own)
    if struck:
        counts = counts.unionByName(spark.read.schema(TAKEN).parquet(f"{struck}/taken").select("term", (-F.col("df")).alias("df")))
    if len(segments) > 1 or struck:  # else they are on their buckets
        counts = counts.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    return TextIndex(postings, blocks, texts, docs, counts, kept, parts)


def merge_segments(folder: str, docs: DataFrame) -> None:
    """Writes the living documents, of which docs holds the texts, as one segment, and removes the older ones."""
    spark = docs.sparkSession
    number, segments, struck = _state(spark, folder)
    living = docs.join(read_index(spark, folder).docs.select("path"), "path", "left_semi")
    new = _write_segment(living, f"{folder}/segment-{number + 1}-{uuid.uuid4().hex}")
    versions.commit(spark, folder, SEGMENT, number + 1, [new], None)
    for old in [*segments, *([struck] if struck else [])]:
        versions.remove(spark, old)


def _met(tables: list[DataFrame], terms: DataFrame, *on: str) -> DataFrame:
    """Each segment's table joined with the query terms, on its buckets, and the segments' rows together."""
    rows = None
    for t in tables:
        one = t.join(terms, list(on))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def index_terms(index: TextIndex, q: DataFrame) -> DataFrame:
    """(qid, term, ord, n_terms, df) of queries all of whose terms are in the index."""
    met = query_terms(q).join(index.counts, "term")
    return met.withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("qid"))).filter("known = n_terms").drop("known")


def _hits(index: TextIndex, rarest: DataFrame, *columns: str, blocks: DataFrame | None = None) -> DataFrame:
    """(columns, path, language, type) of documents that hold the term of rarest(term, columns); of blocks(qid, segment, block) alone, if given.

    Segments are numbered. A document comes once for each row of rarest.
    """
    rows = None
    for i, (kept, part) in enumerate(zip(index.lists, index.parts, strict=True)):
        held = F.array_distinct(F.transform(F.slice("data", 1, F.col("n")), lambda a: F.shiftleft("chunk", CHUNK_BITS) + F.shiftright(a, 1)))
        met = kept.select("term", "chunk", "n", "data").join(rarest, "term").select(*columns, F.explode(held).alias("doc"))
        if blocks is not None:
            wanted = blocks.filter(F.col("segment") == i).select("qid", "block")
            met = met.withColumn("block", F.shiftright("doc", BLOCK_BITS)).join(wanted, ["qid", "block"], "left_semi").drop("block")
        one = met.join(part.select("doc", "path", "language", "type"), "doc").drop("doc")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def phrase_match(index: TextIndex, q: DataFrame) -> DataFrame:
    """(qid, path): the query's tokens follow each other in one column. Only documents with the rarest token are looked into."""
    terms = written(index_terms(index, q), "phrase-terms")
    rarest = terms.groupBy("qid").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.max("n_terms").alias("n_terms"))
    hits = written(_hits(index, rarest, "qid", "n_terms").select("qid", "path", "n_terms"), "phrase-hits")
    asked = q.select("qid", F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" ")).alias("phrase"))
    rows = _met(index.texts, hits.filter("n_terms > 1").select("qid", "path"), "path").join(asked, "qid")
    found = rows.filter(F.contains(_said("title"), "phrase") | F.contains(_said("body"), "phrase"))
    return hits.filter("n_terms = 1").select("qid", "path").unionByName(found.select("qid", "path"))


def split_words(q: DataFrame) -> DataFrame:
    """(qid, phrases, n_tokens) of queries with words that are no single token of the index: each such word, as its tokens, and the least number of tokens of one."""
    words = query_words(q).filter("n_tokens <> 1")
    said = F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" "))
    return words.groupBy("qid").agg(F.collect_set(said).alias("phrases"), F.min("n_tokens").alias("n_tokens"))


def _with_split_words(asked: DataFrame, q: DataFrame) -> DataFrame:
    """asked(qid, ...) with the phrases that split words are; a word without any token, such as _, is held by no document, so its query goes."""
    rows = asked.join(split_words(q), "qid", "left").filter(F.col("n_tokens").isNull() | (F.col("n_tokens") > 0)).drop("n_tokens")
    return rows.withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))


def all_terms_match(index: TextIndex, q: DataFrame) -> DataFrame:
    """(qid, path): every word of the query is somewhere in title or body, one that the index splits as a phrase.

    Only documents with the rarest token are asked for the others, the next rarest first.
    """
    terms = written(index_terms(index, q).groupBy("qid", "term").agg(F.max("df").alias("df")), "all-terms")
    asked = terms.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("terms"))
    asked = written(_with_split_words(asked, q), "asked-terms")
    rarest = asked.select("qid", F.col("terms")[0]["term"].alias("term"), (F.size("terms") + F.size("phrases")).alias("wanted"))
    first = written(_hits(index, rarest, "qid", "wanted").select("qid", "path", "wanted"), "rarest-hits")
    found = _met(index.texts, first.filter("wanted > 1").select("qid", "path"), "path").join(asked, "qid").filter(_holds_all())
    return first.filter("wanted = 1").select("qid", "path").unionByName(found.select("qid", "path"))


def _holds_all() -> Column:
    """title or body holds each of terms, which are asked for in their order until one is missing, and each of phrases."""
    held = lambda part: F.contains(_said("body"), part) | F.contains(_said("title"), part)
    return F.forall("terms", lambda t: held(F.concat(F.lit(" "), t["term"], F.lit(" ")))) & F.forall("phrases", held)


def query_weights(index: TextIndex, q: DataFrame) -> DataFrame:
    """(qid, term, idf, avg_len, wanted) of each query's different terms."""
    stats = index.docs.filter("len > 0").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))  # one row
    terms = index_terms(index, q).groupBy("qid", "term").agg(F.max("df").alias("df")).join(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return terms.select("qid", "term", idf.alias("idf"), "avg_len", F.count(F.lit(1)).over(Window.partitionBy("qid")).alias("wanted"))


def _part(idf: Column, tf: Column, length: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg_len")))


def bm25(index: TextIndex, weights: DataFrame, pairs: DataFrame | None = None, blocks: DataFrame | None = None, q: DataFrame | None = None) -> DataFrame:
    """(qid, path, score) of documents with all of a query's terms: of pairs(qid, path), or of blocks(qid, segment, block).

    In blocks, only documents with the rarest token are asked for the others. Of q, those queries alone whose language and type fit, and
    documents that hold its split words.
    """
    asked = weights.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("idf")).alias("order"), "term", "idf"))).alias("terms"), F.max("avg_len").alias("avg_len"))
    none = F.array().cast("array<string>")
    asked = written(asked.withColumn("phrases", none) if q is None else _with_split_words(asked, q), "weighted-terms")
    if blocks is not None:
        rarest = asked.select("qid", F.col("terms")[0]["term"].alias("term"))
        if q is not None:
            rarest = rarest.join(q.select("qid", F.col("language").alias("q_language"), F.col("type").alias("q_type")), "qid")
        hits = _hits(index, rarest, *rarest.drop("term").columns, blocks=blocks)
        pairs = (hits if q is None else hits.filter(_fits())).select("qid", "path")
    rows = _met(index.texts, pairs, "path").join(asked, "qid").filter(_holds_all())
    tf = lambda words, t: (F.size(words) - F.size(F.array_remove(words, t["term"]))).cast("long")
    score = let(F.split(F.concat("title", F.lit(" "), "body"), " "), lambda words: F.aggregate("terms", F.lit(0.0), lambda s, t: s + _part(t["idf"], tf(words, t), F.col("len"))))
    return rows.select("qid", "path", F.round(score, 6).alias("score"))


def block_bounds(index: TextIndex, weights: DataFrame) -> DataFrame:
    """(qid, segment, block, bound): blocks that have all of a query's terms, and what no score in them exceeds."""
    rows = None
    for i, kept in enumerate(index.lists):
        one = _blocks(kept.join(weights.select("term").distinct(), "term", "left_semi")).join(weights, "term").withColumn("segment", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    bound = rows.groupBy("qid", "segment", "block", "wanted").agg(F.sum(_part(F.col("idf"), F.col("max_tf"), F.col("min_len"))).alias("bound"), F.count(F.lit(1)).alias("n"))
    return bound.filter("n = wanted").select("qid", "segment", "block", "bound")


def top_documents(index: TextIndex, q: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """The n best documents with all words of each query (qid, path, score), and (qid, n_blocks, n_read) of the work."""
    weights = written(query_weights(index, q), "query-weights")
    bounds = written(block_bounds(index, weights), "block-bounds")
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "segment", "block")
    ranked = bounds.withColumn("k", F.row_number().over(order))
    first = written(bm25(index, weights, blocks=ranked.filter(F.col("k") <= FIRST_BLOCKS * n).select("qid", "segment", "block"), q=q), "first-scores")
    least = top(first, [F.desc("score"), F.asc("path")], n).groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("held"))
    more = ranked.join(least, "qid", "left").filter(F.col("k") > FIRST_BLOCKS * n)
    # Scores are rounded to six places; a bound half a place short may still tie.
    more = written(more.filter(F.col("held").isNull() | (F.col("held") < n) | (F.col("bound") + 1e-6 >= F.col("least"))).select("qid", "segment", "block"), "more-blocks")
    rows = first.unionByName(bm25(index, weights, blocks=more, q=q))
    best = top(rows, [F.desc("score"), F.asc("path")], n).select("qid", "path", "score")
    read = more.groupBy("qid").agg(F.count(F.lit(1)).alias("more"))
    work = bounds.groupBy("qid").agg(F.count(F.lit(1)).alias("n_blocks")).join(read, "qid", "left")
    return best, work.select("qid", "n_blocks", (F.least("n_blocks", F.lit(FIRST_BLOCKS * n)) + F.coalesce("more", F.lit(0))).alias("n_read"))


def text_search(index: TextIndex, q: DataFrame, n: int = 10) -> DataFrame:
    """(qid, rank, path, pass, score): phrase matches by score; queries with fewer than n of them go on with documents that have all terms.

    Queries of the same text, language and type are searched for once.
    """
    same = written(q.withColumn("__first", F.min("qid").over(Window.partitionBy("text", "language", "type"))), "queries")
    once = same.filter(F.col("qid") == F.col("__first")).drop("__first")
    asked = once.select("qid", F.col("language").alias("q_language"), F.col("type").alias("q_type"))
    hits = phrase_match(index, once).join(index.docs.select("path", "language", "type"), "path").join(asked, "qid").filter(_fits()).select("qid", "path")
    phrase = written(bm25(index, query_weights(index, once), pairs=written(hits, "phrase-matches")).withColumn("pass", F.lit(1)), "phrase-scores")
    full = phrase.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n)
    rest = once.join(full, "qid", "left_anti")
    second = top_documents(index, rest, n)[0].join(phrase.select("qid", "path"), ["qid", "path"], "left_anti").withColumn("pass", F.lit(2))
    best = top(phrase.unionByName(second), [F.asc("pass"), F.desc("score"), F.asc("path")], n)
    return best.withColumnRenamed("qid", "__first").join(same.select("qid", "__first"), "__first").select("qid", "rank", "path", "pass", "score")


def snippets(index: TextIndex, q: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, path, snippet) of documents found(qid, path), as search.snippet makes them."""
    rows = _met(index.texts, written(found.select("qid", "path"), "found-documents"), "path")
    return snippets_of(written(rows.select("qid", "path", _words("body").alias("t")), "found-texts"), q)
