"""SimHash near-duplicates found with vantage-point trees.

A fingerprint has 64 bits; two texts are near-duplicates if their fingerprints differ in 4 bits at most. Cut
into four blocks of 16 bits, such a pair differs in one bit at most in some block, and in one at most in a second block, too. Each block has a
vantage-point tree: every level splits by the Hamming distance of the block to a vantage point drawn from the data, one ring for each
distance, and the rings of all levels name a leaf (a shard). By the triangle inequality a point within one
bit of another lies in the same or the next ring on every level; of the branches inside these bounds only those can hold such a point that hold the block
itself or one of the 16 blocks a bit away, however many levels there are. A point is stored in its own leaf of each tree and asks these
leaves. Points at an even distance from zero ask those at an odd one, so each pair meets once.

A leaf with many points goes on with the trees of the three other blocks: stored points and those that ask go down to the leaf of their second block and
the leaves a bit away, at most 17 in a tree, so rows stay linear and the work in a leaf falls with the number of leaves squared. What still holds many points there is
compared in parts by several tasks. Inside a task, a leaf is a vantage-point tree over whole fingerprints: points and questions are
put in rings around a vantage point taken from the leaf, a ring only meets questions whose distance is within 4 of its own, and so on
down to small rings, which are compared exactly. Leaves give a spanning forest of their links, never all pairs; star contraction joins forests into components.

The number of levels grows with the number of distinct fingerprints until every block is a leaf of its own.

Null and empty texts have fingerprint zero, linked like any other; a long text is read whole. Null ids are members of components but
never name one. Equal fingerprints are compared once, whatever their number; repeated rows are copies. Of equal texts the smallest id names the
group. An empty table gives an empty table. ``one_per_group`` keeps all columns; it uses the names ``__rows`` and ``__key`` for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.shared import table, written

BITS_APART = 4
BLOCKS, BLOCK_BITS = 4, 16
#: Fingerprints that vantage points are drawn from, by hash; levels of a tree, each with one vantage point.
VANTAGE_SAMPLE, LEAST_LEVELS, MOST_LEVELS = 256, 4, 12
#: Stand in for vantage points where the data have too few different blocks.
SPARE_POINTS = (0x0000, 0x00FF, 0x0F0F, 0x3333, 0x5555, 0x0FF0, 0x3C3C, 0x5A5A, 0x1248, 0x8421, 0x7000, 0x0700)
#: Points that a leaf is meant to hold on average, weighted by its points.
POINTS_A_LEAF = 1_000
#: Leaves with more points than this go on with a second block, and are dealt to several tasks if they are still larger there.
LEAF_POINTS = 20_000
SHINGLE, SEED = 4, 42
#: Rows of a leaf that are compared with all others at once; rings of at most so many points are not split further; candidates for a vantage point.
COMPARE_ROWS, RING_POINTS, CANDIDATES = 256, 64, 8

Trees = tuple[tuple[int, ...], ...]


def fingerprint(text: str | None) -> int:
    """The text's SimHash as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    first, last = starts[:n].tolist(), ends[SHINGLE - 1 :].tolist() or [int(ends[-1])]
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[i : i + 65536], last[i : i + 65536], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def simhash(text: Column) -> Column:
    return F.pandas_udf(_fingerprints, "bigint")(text)


def leaves_of_levels(vantage: tuple[int, ...]) -> tuple[float, ...]:
    """How many leaves of equal size would be as good as those of 1, 2, ... levels, if blocks are spread evenly."""
    block, leaf, out = np.arange(1 << BLOCK_BITS, dtype=np.int64), np.zeros(1 << BLOCK_BITS, np.int64), []
    for i, v in enumerate(vantage):
        leaf += np.bitwise_count(block ^ v).astype(np.int64) << 5 * i
        size = np.unique(leaf, return_counts=True)[1] / len(block)
        out.append(1 / (size**2).sum())
    return tuple(out)


def vantage_points(blocks: list[int]) -> tuple[int, ...]:
    """Of the blocks, those whose distances tell most apart: the next one is as near as possible to half the bits from all before."""
    left, chosen = list(dict.fromkeys([*blocks, *SPARE_POINTS])), []
    while len(chosen) < MOST_LEVELS:
        best = min(left, key=lambda b: max((abs((b ^ c).bit_count() - BLOCK_BITS // 2) for c in chosen), default=0))
        left.remove(best)
        chosen.append(best)
    return tuple(chosen)


def trees_for(points: DataFrame) -> Trees:
    """The vantage points of each block's tree, from VANTAGE_SAMPLE fingerprints, as many as the number of points asks for."""
    n = points.count()
    sample = [r.f for r in points.orderBy(F.xxhash64("f"), "f").limit(VANTAGE_SAMPLE).collect()]
    trees = [vantage_points([f >> BLOCK_BITS * k & (1 << BLOCK_BITS) - 1 for f in sample]) for k in range(BLOCKS)]
    fewest = np.min([leaves_of_levels(v) for v in trees], axis=0)
    levels = next((i for i, leaves in enumerate(fewest, 1) if i >= LEAST_LEVELS and n <= leaves * POINTS_A_LEAF), MOST_LEVELS)
    return tuple(v[:levels] for v in trees)


def block_of(k: int) -> Column:
    return F.shiftrightunsigned("f", BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def leaf_of(block: Column, vantage: tuple[int, ...]) -> Column:
    """The rings of all levels as one number."""
    return sum((F.shiftleft(F.bit_count(block.bitwiseXOR(F.lit(v))).cast("long"), 5 * i) for i, v in enumerate(vantage)), F.lit(0).cast("long"))


def leaves_a_bit_away(block: Column, vantage: tuple[int, ...]) -> Column:
    flips = F.array(*[F.lit(1 << i) for i in range(BLOCK_BITS)])
    return F.array_distinct(F.transform(flips, lambda bit: leaf_of(block.bitwiseXOR(bit), vantage)))


def ways(k: int, vantage: tuple[int, ...], asks: Column) -> Column:
    """(k, leaf, asks) of the leaves where a point is stored or asks: an asking point asks its own leaf and all a bit away."""
    block = block_of(k)
    step = lambda leaf, asking: F.struct(F.lit(k).alias("k"), leaf.alias("leaf"), asking.alias("asks"))
    near = F.when(asks | (F.bit_count(block) % 2 == 0), leaves_a_bit_away(block, vantage)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.array(step(leaf_of(block, vantage), asks)), F.transform(near, lambda leaf: step(leaf, F.lit(True))))


def leaf_rows(points: DataFrame, trees: Trees) -> DataFrame:
    """(leaf, f, asks): each point in its own leaf of every tree, and as a question in those that its ball overlaps."""
    steps = F.concat(*[ways(k, vantage, F.lit(False)) for k, vantage in enumerate(trees)])
    return points.select("f", F.explode(steps).alias("x")).select(F.struct("x.k", "x.leaf", F.lit(-1).alias("k2"), F.lit(0).cast("long").alias("leaf2")).alias("leaf"), "f", "x.asks")


def large_leaves(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("asks")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAF_POINTS)


def deepened(rows: DataFrame, large: DataFrame, trees: Trees) -> DataFrame:
    """rows with those of large leaves taken down the trees of the other blocks; a pair within BITS_APART bits meets in one of them."""
    found = rows.join(large.select("leaf", F.lit(True).alias("deep")), "leaf", "left")
    none = F.array().cast("array<struct<k:int,leaf:bigint,asks:boolean>>")
    steps = F.concat(*[F.when(F.col("leaf.k") != k, ways(k, vantage, F.col("asks"))).otherwise(none) for k, vantage in enumerate(trees)])
    stay = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("leaf"), F.col("asks").alias("asks")))
    down = found.select("leaf", "f", F.explode(F.when(F.col("deep"), steps).otherwise(stay)).alias("x"))
    return down.select(F.struct("leaf.k", "leaf.leaf", F.col("x.k").alias("k2"), F.col("x.leaf").alias("leaf2")).alias("leaf"), "f", "x.asks")


def dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows with a part number: a large leaf's own points are dealt to parts and everyone in it asks every part.

    Points inside one part are compared with each other there; across parts as question and point.
    """
    parts = large.select("leaf", F.ceil(F.col("n") / LEAF_POINTS).cast("int").alias("parts"))
    wide = rows.join(parts, "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    home = F.pmod(F.xxhash64("f"), F.col("parts")).cast("int")
    places = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("part"), F.col("asks").alias("asks")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), (F.col("asks") | (p != home)).alias("asks")))
    )
    return wide.select("leaf", "f", F.explode(places).alias("x")).select("leaf", "x.part", "f", "x.asks")


def vantage_of(points: np.ndarray) -> np.uint64:
    """Of a few points the one whose distances to the others vary most."""
    step = max(1, len(points) // CANDIDATES)
    tried, seen = points[::step][:CANDIDATES], points[:: max(1, len(points) // 256)]
    return tried[np.bitwise_count(tried[:, None] ^ seen[None, :]).astype(float).var(axis=1).argmax()]


def meetings(points: np.ndarray, at: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of stored points and of those, themselves included, that they must be compared with: what a vantage-point tree's bounds leave over."""
    if len(at) <= RING_POINTS:
        yield at, asks
        return
    v = vantage_of(points[at])
    own, other = (np.bitwise_count(points[x] ^ v).astype(np.int64) for x in (at, asks))
    at, own = at[order := np.argsort(own, kind="stable")], own[order]
    asks, other = asks[order := np.argsort(other, kind="stable")], other[order]
    rings = np.flatnonzero(np.diff(own, prepend=-1))
    if len(rings) == 1:
        yield at, asks[np.searchsorted(other, int(own[0]) - BITS_APART) : np.searchsorted(other, int(own[0]) + BITS_APART, "right")]
        return
    for first, end in zip(rings, [*rings[1:], len(at)], strict=True):
        d = int(own[first])
        inside = asks[np.searchsorted(other, d - BITS_APART) : np.searchsorted(other, d + BITS_APART, "right")]
        if len(inside):
            yield from meetings(points, at[first:end], inside)


def leaf_forest(own: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, root) that link all points of a leaf within BITS_APART bits of each other."""
    points = np.concatenate([own, asking])
    root, linked = np.arange(len(points)), np.zeros(len(points), bool)
    for stored, others in meetings(points, np.arange(len(own)), np.arange(len(points))):
        for i in range(0, len(stored), COMPARE_ROWS):
            rows = stored[i : i + COMPARE_ROWS]
            near = np.bitwise_count(points[rows][:, None] ^ points[others][None, :]) <= BITS_APART
            for r in np.flatnonzero(np.count_nonzero(near, axis=1) > 1):
                hit = others[near[r]]
                linked[hit] = True
                roots = np.unique(root[hit])
                if len(roots) > 1:
                    root[np.isin(root, roots[1:])] = roots[0]
    at = np.flatnonzero(linked & (root != np.arange(len(points))))
    return points[at], points[root[at]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaf by leaf over rows that come sorted by leaf, part and asks: the own points are held, those that ask pass by in pieces."""
    own: list[np.ndarray] = []
    asking: list[np.ndarray] = []
    n_asking, whole = 0, False
    place: tuple[int, ...] | None = None

    def compared() -> Iterator[pa.RecordBatch]:
        nonlocal asking, n_asking, whole
        if not own or whole and not asking:
            return
        points = np.concatenate(own).view(np.uint64)
        asks = np.unique(np.concatenate(asking)).view(np.uint64) if asking else np.empty(0, np.uint64)
        x, y = leaf_forest(points, asks)
        asking, n_asking, whole = [], 0, True
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    for batch in batches:
        rows = np.empty((batch.num_rows, 7), np.int64)
        for j in range(7):
            rows[:, j] = batch.column(j).cast(pa.int64()).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((rows[1:, :6] != rows[:-1, :6]).any(axis=1)) + 1
        for piece in np.split(rows, cuts):
            if not len(piece):
                continue
            here = tuple(piece[0, :5].tolist())
            if here != place:
                yield from compared()
                own, asking, n_asking, whole, place = [], [], 0, False, here
            if piece[0, 5]:
                for i in range(0, len(piece), LEAF_POINTS):
                    asking.append(piece[i : i + LEAF_POINTS, 6])
                    n_asking += len(asking[-1])
                    if n_asking >= LEAF_POINTS:
                        yield from compared()
            else:
                own.append(piece[:, 6])
    yield from compared()


def links(points: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column f) that connect what BITS_APART connects."""
    trees = trees_for(points)
    rows = leaf_rows(points, trees).withColumn("part", F.lit(0))
    large = written(large_leaves(rows), "large-leaves")
    if not large.isEmpty():
        rows = deepened(rows, large, trees)
        rows = dealt(rows, written(large_leaves(rows), "large-leaves"))
    place = ["k", "leaf", "k2", "leaf2", "part"]
    flat = rows.select("leaf.*", "part", F.col("asks").cast("int").alias("asks"), "f")
    return flat.repartition(*place).sortWithinPartitions(*place, "asks").mapInArrow(_forests, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge is connected with.

    Alternating large-star and small-star steps (Kiveris et al., 2014); each round is a written table.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        count = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if count == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = count
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(down.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), "edges")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, f, component): every row's fingerprint and the smallest key of its component."""
    prints = written(docs.select(F.col(key).alias("key"), simhash(F.col(text)).alias("f")), "fingerprints")
    points = written(prints.groupBy("f").agg(F.min("key").alias("least")), "points")
    roots = points.join(components(links(points.select("f"))), F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component")), "root").select("f", "component")
    return prints.join(named, "f").select("key", "f", "component")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the row with the smallest key.

    Rows that share that key: one of them, the first by its text. A component of null keys keeps one row.
    """
    found = written(near_duplicates(docs, key, text), "near-duplicates")
    first = found.filter(F.col("key").eqNullSafe(F.col("component")))
    kept = first.groupBy("key").agg(F.count(F.lit(1)).alias("__rows")).withColumnRenamed("key", "__key")
    rows = docs.join(kept, docs[key].eqNullSafe(kept["__key"]), "inner").drop("__key")
    single, several = rows.filter("__rows = 1"), rows.filter("__rows > 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    grouped = several.groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*columns), F.coalesce(F.col(text), F.lit(""))).alias("__row"))
    return single.drop("__rows").unionByName(grouped.select("__row.*"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
