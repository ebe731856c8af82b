"""Quality rules by zstandard compression bands.

A text that compresses far better than prose repeats itself; one that hardly compresses is noise. The
ratio (compressed bytes / bytes) of prose falls with length, so each length class has its own band. Texts longer than
a chunk are also judged chunk by chunk (all chunks have the same length, the last one ends with the text), which finds a bad stretch inside
a long document and decides for lengths without labelled text. The default bands are wide and hold for any text.

``fitted`` narrows them with a bounded sample of labelled documents: a limit lies halfway between the outermost good ratio and the next
bad one beyond it, and where no bad ratio lies beyond, the wide limit stays. So text unlike the labelled good one is only rejected where
labelled bad text is known. A class with few good texts keeps the wide limits.

Null texts count as empty (no words, so they fail the base rule). Any other column, whatever its name, is
carried along untouched; rows are judged one by one, so repeated rows get equal verdicts. Null labels and labels without a document count for
nothing; a document with several labels has the worst of them. Without labels the wide bands stand; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.shared import WORD, table

#: (bytes up to, lowest ratio, highest ratio) for whole texts. Short texts carry zstandard's frame
#: overhead, so their upper limits are above 1 or absent.
DOCUMENT_BANDS = (
    (256, 0.20, float("inf")),
    (512, 0.25, 0.90),
    (1024, 0.25, 0.82),
    (4096, 0.22, 0.76),
    (16384, 0.18, 0.72),
    (float("inf"), 0.15, 0.70),
)
#: Bytes of a chunk; its lowest and highest ratio; the share of chunks outside that a text may have.
CHUNK_BYTES, CHUNK_BAND, CHUNK_SHARE = 4096, (0.20, 0.80), 0.1
CHUNK_BANDS = ((float("inf"), *CHUNK_BAND),)
LEVEL = 3

#: Bytes up to which each length class of fitted bands reaches.
FITTED_EDGES = (128, 256, 512, 1024, 1536, 2048, 3072, 4096, 6144, 8192, 12288, 16384, 32768, float("inf"))
#: Labelled documents that bands are fitted on at most, and good ratios that a class needs.
SAMPLE, LEAST_GOOD = 20_000, 20
#: A limit keeps at least MARGIN from the outermost good ratio, and more if these are few: their range times MARGIN_ROWS / their number.
MARGIN, MARGIN_ROWS = 0.003, 4

Bands = tuple[tuple[float, float, float], ...]


def fitted_bands(ratios: Iterable[tuple[int, float, bool, int]], wide: Bands = DOCUMENT_BANDS, edges: tuple[float, ...] = FITTED_EDGES) -> Bands:
    """Bands between good and bad ratios in each length class, inside the wide ones; ratios has (bytes, ratio, good, number)."""
    good: dict[float, list[tuple[float, int]]] = defaultdict(list)
    bad: dict[float, list[float]] = defaultdict(list)
    for n_bytes, ratio, is_good, n in ratios:
        edge = next(e for e in edges if n_bytes <= e)
        if is_good:
            good[edge].append((ratio, n))
        else:
            bad[edge].append(ratio)
    bands = []
    for edge in edges:
        low, high = next((low, high) for most, low, high in wide if edge <= most)
        count = sum(n for _, n in good[edge])
        if count >= LEAST_GOOD:
            least, most = min(good[edge])[0], max(good[edge])[0]
            margin = max(MARGIN, (most - least) * MARGIN_ROWS / count)
            below, above = [r for r in bad[edge] if low <= r < least], [r for r in bad[edge] if most < r <= high]
            if below:
                low = max(low, min((least + max(below)) / 2, least - margin))
            if above:
                high = min(high, max((most + min(above)) / 2, most + margin))
        bands.append((edge, round(low, 4), round(high, 4)))
    return tuple(bands)


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, ratio double, n_chunks bigint, n_bad_chunks bigint, kept boolean"
)


def base_counts(text: str, word=re.compile(WORD)) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    words = word.findall(text)
    seen, dup_lines = set(), 0
    for line in text.split("\n"):
        if word.search(line):
            dup_lines += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeated, first = set(), {}
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            repeated.add(i)
            repeated.add(j)
    covered, end = 0, 0
    for i in sorted(repeated):
        covered += i + 5 - max(i, end)
        end = i + 5
    symbols = sum(text.count(s) for s in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, dup_lines, covered


def in_band(n_bytes: int, ratio: float, bands=DOCUMENT_BANDS) -> bool:
    low, high = next((low, high) for most, low, high in bands if n_bytes <= most)
    return low <= ratio <= high


def ratio_of(raw: bytes, squeeze) -> float:
    return len(squeeze(raw)) / len(raw) if raw else 0.0


def chunks_of(raw: bytes, n: int) -> list[bytes]:
    """Chunks of n bytes that cover a longer text; the last one ends with it and may overlap the one before."""
    return [raw[i : i + n] for i in range(0, len(raw) - n, n)] + [raw[-n:]] if len(raw) > n else []


def failed_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def quality(text: Column, bands: Bands = DOCUMENT_BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_share: float = CHUNK_SHARE, chunk_bands: Bands = CHUNK_BANDS) -> Column:
    """A struct of the base counts, the whole text's ratio, its chunks, and the verdict."""

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for texts in batches:
            rows = []
            for text in texts:
                n, chars, symbols, dups, repeats = base_counts(text or "")
                failed = failed_base(n, repeats)
                raw = (text or "").encode()
                ratio = ratio_of(raw, squeeze)
                ratios = [ratio_of(c, squeeze) for c in chunks_of(raw, chunk_bytes)]
                bad = sum(not in_band(chunk_bytes, r, chunk_bands) for r in ratios)
                kept = not failed and in_band(len(raw), ratio, bands) and bad <= chunk_share * len(ratios)
                rows.append((n, chars, symbols, dups, repeats, failed, ratio, len(ratios), bad, kept))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return F.pandas_udf(judged, SCHEMA)(text)


def labelled_sample(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(id, good): at most ``most`` labelled ids, drawn by hash."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg((F.min("quality") > 0).alias("good"))
    return known.orderBy(F.xxhash64("id"), "id").limit(most)


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, chunk_bytes: int = CHUNK_BYTES) -> dict[str, Bands]:
    """Arguments ``bands`` and ``chunk_bands`` for ``quality``, fitted on at most ``most`` labelled documents (labels: doc_id, quality 0 or 1).

    Ratios are counted by length class in steps of a thousandth, so what reaches the driver is bounded by the classes.
    """

    def ratios(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for texts in batches:
            out = []
            for text in texts:
                n, *_, repeats = base_counts(text)
                raw = text.encode()
                rows = [] if failed_base(n, repeats) else [{"n": len(raw), "chunk": False, "ratio": ratio_of(raw, squeeze)}]
                rows += [{"n": chunk_bytes, "chunk": True, "ratio": ratio_of(c, squeeze)} for c in (chunks_of(raw, chunk_bytes) if rows else ())]
                out.append(rows)
            yield pd.Series(out, dtype=object)

    measure = F.pandas_udf(ratios, "array<struct<n:int,chunk:boolean,ratio:double>>")
    sample = F.broadcast(labelled_sample(labels, most))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).filter("t is not null").join(sample, "id").select("good", F.explode(measure("t")).alias("x"))
    edges = F.array(*[F.lit(e) for e in FITTED_EDGES[:-1]])
    counted = rows.groupBy("good", "x.chunk", F.size(F.filter(edges, lambda e: e < F.col("x.n"))).alias("class"), F.round("x.ratio", 3).alias("ratio"))
    found = counted.agg(F.count(F.lit(1)).alias("n")).collect()
    part = lambda chunk: [(FITTED_EDGES[r["class"]], r.ratio, r.good, r.n) for r in found if r.chunk == chunk]
    return {"bands": fitted_bands(part(False)), "chunk_bands": fitted_bands([(0, *r[1:]) for r in part(True)], CHUNK_BANDS, (float("inf"),))}


def with_quality(docs: DataFrame, out: str = "quality", **limits) -> DataFrame:
    """docs and a struct column ``out``; a column of that name is replaced."""
    return docs.withColumn(out, quality(F.col("text"), **limits))


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows whose text passes, with docs' own columns."""
    return docs.filter(quality(F.col("text"), **limits)["kept"])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs, **fitted(docs, table(spark, sf_dir, "labels"))).select("doc_id", "quality.*")
