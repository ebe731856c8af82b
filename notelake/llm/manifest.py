"""Merkle manifest of a dataset, from levels kept as one hex string a block.

Every row of a table is a leaf: the SHA-256 of its columns, each written with its length. The leaves of a group (a source, say) ascend
by key and form a tree of FANOUT children a node; the groups' roots form one more tree, whose root states the whole table.

BLOCK consecutive leaves make an aligned block, one row with two levels in it, each a concatenation of 64-character hex digests. A parent is
the hash of a fixed-width substring of the level below, a block's last parent is a node of the next round, and rounds go on until every tree
has one node: a tree of n leaves takes log n / log BLOCK rounds, and a round has 1 / BLOCK of the rows of the one before. The way back
goes down: a node's siblings are the two substrings that flank it in its run of FANOUT, followed by those of its block in the
next round. So no task ever holds more than a block, however many rows a group has.

Leaves are numbered by a range sort over (group, key, leaf, row): a large group is spread over many tasks, and equal rows too. All
rounds are written to the shared folder, so that a lost executor costs tasks alone.

Defined results: null columns are stated as ``-``; a null group is a group of its own, before all others; null keys come first in
their group, rows of equal keys follow each other by the leaf, and equal rows in any order (they are alike). A group of one row has
its leaf as root, one group's root is the dataset's root, and a table without rows gives no rows. Columns that are not named are not
read, whatever they are called. Digests of long texts take no more room than those of short ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.llm.shared import LOWER, UPPER, ascii_lower, table, written

#: Children of a node, and leaves of a block (two levels of nodes).
FANOUT = 16
BLOCK = FANOUT * FANOUT
HEX = 64
#: Rows of a sorted partition have its number above these bits.
ROW_BITS = 33

PATH = "array<struct<before:string,after:string>>"


def digest(c: Column) -> Column:
    """Lower-case hex SHA-256 of a text."""
    return F.sha2(c.cast("binary"), 256)


def stated(c: Column) -> Column:
    """A value with its length in bytes, or ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*[stated(c) for c in columns]))


def tree_name(group: Column) -> Column:
    """A name that is never null and sorts like the group, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows(tree, ...) with pos, the place in the tree from 0 by order, and n, the tree's size. rows must be a kept table.

    Sorted by range; a row's place is its number in the partition, less that of the tree's first row there, plus the rows of the
    tree in the partitions before. Null sorts first.
    """
    sort = [F.asc_nulls_first(c) for c in ("tree", *order)]
    sorted_rows = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__id", F.monotonically_increasing_id())
    kept = written(sorted_rows, "manifest-sorted")
    part = F.shiftright("__id", ROW_BITS)
    counts = kept.groupBy("tree", part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(tree).alias("n"))
    return kept.withColumn("__part", part).join(starts, ["tree", "__part"]).withColumn("pos", F.col("__id") + F.col("__shift")).drop("__part", "__shift", "__id")


def _pieces(level: Column, width: int) -> Column:
    """The level cut into substrings of width; the last may be shorter."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int")), lambda i: F.substring(level, i * width + 1, F.lit(width)))


def blocks(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """(tree, block, n, items, level0, level1, top) of nodes(tree, pos, n, node): each block's two levels, and what it becomes.

    items has the nodes' places and carried columns in order. A tree of one block stops at one node; in a larger tree every block
    goes up both levels, the last one, too.
    """
    item = F.struct("pos", "node", *carried)
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
    rows = rows.withColumn("level0", F.array_join(F.col("items.node"), ""))
    rows = rows.withColumn("level1", F.array_join(F.transform(_pieces(F.col("level0"), FANOUT * HEX), digest), ""))
    top = F.when(F.col("n") == 1, F.col("level0")).when(F.col("n") <= FANOUT, F.col("level1")).otherwise(digest(F.col("level1")))
    return rows.withColumn("top", top)


def grown(nodes: DataFrame, carried: Sequence[str] = ()) -> list[DataFrame]:
    """The kept blocks of every round, leaves first. Each round takes the blocks' tops of trees that have more than one."""
    rounds = [written(blocks(nodes, carried), "manifest-blocks")]
    while True:
        last = rounds[-1]
        n = F.ceil(F.col("n") / BLOCK)
        above = last.filter(n > 1).select("tree", F.col("block").alias("pos"), n.alias("n"), F.col("top").alias("node"))
        if above.isEmpty():
            return rounds
        rounds.append(written(blocks(above), "manifest-blocks"))


def roots(rounds: Sequence[DataFrame]) -> DataFrame:
    """(tree, root) of all trees: the tops of the rounds in which a tree is down to one block."""
    found = [r.filter(F.col("n") <= BLOCK).select("tree", F.col("top").alias("root")) for r in rounds]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows


def _siblings(i: Column) -> Column:
    """What flanks node i of the block in its run, in each of the block's levels that its tree has."""
    run, inside = F.floor(i / FANOUT).cast("int"), i % FANOUT
    low = F.struct(
        F.substring("level0", run * (FANOUT * HEX) + 1, inside * HEX).alias("before"),
        F.substring("level0", (i + 1) * HEX + 1, (FANOUT - 1 - inside) * HEX).alias("after"),
    )
    high = F.struct(F.substring("level1", F.lit(1), run * HEX).alias("before"), F.substring("level1", (run + 1) * HEX + 1, F.lit(FANOUT * HEX)).alias("after"))
    return F.when(F.col("n") == 1, F.array().cast(PATH)).when(F.col("n") <= FANOUT, F.array(low)).otherwise(F.array(low, high))


def paths(rounds: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, pos, item, path) of every node of the first round: the siblings up to its tree's root, then above(tree, path)."""
    up = above.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for k in reversed(range(len(rounds))):
        met = rounds[k].join(up, ["tree", "block"])
        each = met.select("tree", "n", "level0", "level1", "path", F.posexplode("items").alias("__i", "item"))
        down = each.select("tree", F.col("item.pos").alias("pos"), "item", F.concat(_siblings(F.col("__i")), F.col("path")).alias("path"))
        if k == 0:
            return down
        # Blocks of this round's trees hang below; trees that end one round earlier start from above.
        ended = rounds[k - 1].filter(F.col("n") <= BLOCK).select("tree").distinct().join(above, "tree").select("tree", F.lit(0).cast("long").alias("block"), "path")
        up = written(down.select("tree", F.col("pos").alias("block"), "path").unionByName(ended), "manifest-paths")
    raise ValueError("no rounds")


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(path, node, lambda x, s: digest(F.concat(s["before"], x, s["after"])))


def proof_text(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(rows: DataFrame, group: str, key: str, columns: Sequence[str], altered: Sequence[Column] | None = None) -> DataFrame:
    """(key, group, leaf, altered, subroot, root, path) of every row; path has the siblings from the leaf to the root.

    altered is the leaf of the same columns as given there (a later state of the table to be verified), else null.
    """
    names = [c for c in dict.fromkeys((key, group))]
    leaves = rows.select(
        tree_name(F.col(group)).alias("tree"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(names)], leaf([F.col(c) for c in columns]).alias("node"),
        (leaf(altered) if altered is not None else F.lit(None).cast("string")).alias("altered"),
    )
    kept = written(leaves.withColumn("row", F.monotonically_increasing_id()), "manifest-leaves")
    carried = ["altered", *[f"__{i}" for i in range(len(names))]]
    trees = grown(numbered(kept, ["__0", "node", "row"]), carried)
    found = roots(trees).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node"))
    forest = grown(numbered(written(found, "manifest-subroots"), ["name"]), ["name"])
    root = roots(forest).select("tree", "root")
    none = root.select("tree", F.array().cast(PATH).alias("path"))
    up = written(paths(forest, none).join(root, "tree").select(F.col("item.name").alias("tree"), F.col("item.node").alias("subroot"), "root", "path"), "manifest-subpaths")
    down = paths(trees, up.select("tree", "path")).join(up.select("tree", "subroot", "root"), "tree")
    columns_of = [F.col(f"item.__{i}").alias(c) for i, c in enumerate(names)]
    return down.select(*columns_of, F.col("item.node").alias("leaf"), F.col("item.altered").alias("altered"), "subroot", "root", "path")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, the roots, a digest of its proof, and whether the proof still holds after the tampering of a fifth of all documents."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    rows = manifest(docs, "source", "doc_id", columns, [*[F.col(c) for c in columns[:-1]], text])
    found = rows.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof_sha256"), folded(F.col("altered"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL can climb in each tree: enough for 16 ** 8 rows.
SQL_LEVELS = 8


def _climb(name: str) -> str:
    """Common tables name_0 (given as tree, pos, n, node) to name_8 of the levels of trees, each with its nodes' siblings in name_k_sides."""
    out = []
    for k in range(SQL_LEVELS):
        run = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}_{k}_sides AS (
    SELECT *, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}_{k}
), {name}_{k + 1} AS (
    SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node FROM {name}_{k} GROUP BY tree, pos // 16, n
)""")
    return ", ".join(out)


def _fold(name: str, start: str) -> str:
    """Common tables that take start(rid, tree, pos, folded, proof) up the levels of name; the last is start_8."""
    out = []
    for k in range(SQL_LEVELS):
        old = start if k == 0 else f"{start}_{k}"
        out.append(f"""{start}_{k + 1} AS (
    SELECT f.rid, f.tree, f.pos // 16 AS pos, CASE WHEN s.n = 1 THEN folded ELSE sha256(concat(before, folded, after)) END AS folded, CASE WHEN s.n = 1 THEN proof ELSE concat(proof, before, after) END AS proof
    FROM {old} f JOIN {name}_{k}_sides s ON s.tree = f.tree AND s.pos = f.pos
)""")
    return ", ".join(out)


def _op12_sql() -> str:
    """The same level by level: runs grouped and flanked by windows, every leaf folded through a join with each level."""
    said = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf_of = lambda text: f"sha256(concat({', '.join(said(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))}, {said(text)}))"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, crc_steps[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"
    last = SQL_LEVELS
    return f"""
WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, k: {bit})) AS crc_steps),
rows_of AS (
    SELECT row_number() OVER () AS rid, coalesce('=' || source, '') AS tree, doc_id, {leaf_of('text')} AS leaf,
           CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf_of(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf_of('text')} END AS altered
    FROM documents, crc_table
),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows_of),
low_0 AS (SELECT tree, pos, n, leaf AS node FROM placed), {_climb('low')},
top_0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, node, tree AS name FROM low_{last}), {_climb('top')},
walk AS (SELECT rid, tree, pos, altered AS folded, '' AS proof FROM placed), {_fold('low', 'walk')},
ride AS (SELECT w.rid, '' AS tree, t.pos, w.folded, w.proof FROM walk_{last} w JOIN top_0 t ON t.name = w.tree), {_fold('top', 'ride')}
SELECT p.doc_id, p.leaf, t.node AS subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = r.node AS verified
FROM placed p JOIN top_0 t ON t.name = p.tree JOIN ride_{last} f ON f.rid = p.rid, top_{last} r
"""


OP12_SQL = _op12_sql()
