"""Lookup and full-text search of whole tables of queries q(qid, text, language, type).

Null language or type means any. Joins are equi-joins throughout: an exact match on the normal form, a part of a text on the
query's rarest grams, full text on tokens, similar texts on rare letters that both must have. Hits are ranked as ids; texts are read where they are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import let, norm_db, preview, tokens
from notelake.operators.grams import GramIndex, build_grams, candidates, letters
from notelake.sources.tables import written

K1, B = 1.2, 0.75


def _fits() -> Column:
    """The item is of the query's language and type, where it names any."""
    return (F.col("q_language").isNull() | (F.col("q_language") == F.col("language"))) & (F.col("q_type").isNull() | (F.col("q_type") == F.col("type")))


def _queries(q: DataFrame) -> DataFrame:
    return q.select("qid", F.col("text").alias("q_text"), F.col("language").alias("q_language"), F.col("type").alias("q_type"), norm_db(F.col("text")).alias("q_norm"))


def top(df: DataFrame, by: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each query in that order, numbered."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy("qid").orderBy(*by))).filter(F.col(rank) <= n)


def exact_lookup(items: DataFrame, q: DataFrame) -> DataFrame:
    """(qid, rank, item_key, ...) of items whose normal form is the query's, most seen first."""
    hits = items.join(_queries(q), F.col("normalized") == F.col("q_norm")).filter(_fits())
    order = Window.partitionBy("qid").orderBy(F.desc("seen_count"), F.desc("updated_at"), "item_key")
    return hits.withColumn("rank", F.row_number().over(order)).select("qid", "rank", "item_key", "text", "seen_count")


class LookupIndex(NamedTuple):
    """Items with an id that ascends in the order given, and the grams of their texts; both are kept and serve any number of queries."""

    items: DataFrame
    grams: GramIndex


def in_order(items: DataFrame, *order: Column | str) -> DataFrame:
    """items kept in that order, with ids that ascend in it: ranks then compare ids instead of texts."""
    rows = items.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.withColumn("id", F.monotonically_increasing_id()), "lookup-items")


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def index_by_text(items: DataFrame) -> LookupIndex:
    """The index that find_items reads."""
    kept = in_order(items, "text", "item_key")
    return LookupIndex(kept, build_grams(kept, "id", F.col("normalized")))


def index_for_grades(items: DataFrame) -> LookupIndex:
    """The index that graded_lookup reads; its texts are in lower case, once and not for every query that meets them."""
    lowered = items.withColumns({"__key": _low("item_key"), "__norm": _low("normalized"), "__title": _low("title"), "__preview": _low("text_preview")})
    kept = in_order(lowered, "type", "language", "normalized", "item_key")
    return LookupIndex(kept, build_grams(kept, "id", F.col("__norm"), F.col("__title"), F.col("__preview")))


def _same(items: DataFrame, text: Column, asked: DataFrame, part: str) -> DataFrame:
    """(qid, id) of items whose text has the hash of the query's part."""
    return items.select("id", F.xxhash64(text).alias("h")).join(asked.select("qid", F.xxhash64(part).alias("h")), "h").select("qid", "id")


def find_items(items: DataFrame | LookupIndex, q: DataFrame, n: int = 10) -> DataFrame:
    """Exact matches, vocabulary first; queries without any get up to n items that hold the query, most seen first."""
    index = items if isinstance(items, LookupIndex) else index_by_text(items)
    kept, asked = index.items, _queries(q)
    exact = _same(kept, F.col("normalized"), asked, "q_norm").join(asked, "qid").join(kept, "id").filter(F.col("normalized") == F.col("q_norm")).filter(_fits())
    kind = F.when(F.col("type") == "vocabulary", 1).when(F.col("type") == "sentence", 2).when(F.col("type") == "grammar", 3).otherwise(9)
    order = Window.partitionBy("qid").orderBy(kind, "language", "id")
    exact = written(exact.select("qid", "type", "language", "id").withColumn("rank", F.row_number().over(order)).select("qid", F.lit("exact").alias("match"), "rank", "id"), "exact-hits")
    rest = asked.join(exact.select("qid").distinct(), "qid", "left_anti")
    held = candidates(index.grams, rest, "q_norm").join(rest, "qid").join(kept, "id").filter(F.contains("normalized", "q_norm")).filter(_fits())
    fallback = top(held.select("qid", "id", "seen_count"), [F.desc("seen_count"), F.asc("id")], n).select("qid", F.lit("contains").alias("match"), "rank", "id")
    return exact.unionByName(fallback).join(kept.select("id", "item_key"), "id").drop("id")


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff/Obershelp similarity of a and b, in this order, times 100."""

    def score(xs: pd.Series, ys: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([100 * SequenceMatcher(None, x, y).ratio() for x, y in zip(xs, ys, strict=True)], dtype="float64")

    return F.pandas_udf(score, "double")(a, b)


def _bag(rows: DataFrame, id: str, text: str) -> DataFrame:
    """(id, token): each letter of a text with its number among equal ones, so that common tokens count common letters."""
    each = rows.select(id, F.explode(letters(F.col(text))).alias("letter")).groupBy(id, "letter").agg(F.count(F.lit(1)).alias("n"))
    return each.select(id, F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "n"), lambda k: F.concat("letter", k.cast("string")))).alias("token"))


def _by_rarity(bag: DataFrame, id: str, counts: DataFrame) -> DataFrame:
    order = Window.partitionBy(id).orderBy(F.coalesce("n_holders", F.lit(0)), "token")
    return bag.join(counts, "token", "left").select(id, "token", F.row_number().over(order).alias("r"))


def letter_pairs(items: DataFrame, asked: DataFrame, lengths: Callable[[Column], tuple[Column, Column]], needed: Callable[[Column, Column], Column]) -> DataFrame:
    """(qid, id): items(id, normalized) and queries asked(qid, q_norm) that can have as many letters in common as they need.

    lengths(n) are the least and greatest length of a text that goes with one of n letters, needed(n, m) the common letters that n and m
    letters need, which grows with m. Two texts with k common letters of n share one of the n - k + 1 tokens that are rarest in all
    items; so they meet on such a token and the item's length. Pairs that need no common letter meet on the length alone.
    """
    n = F.length("q_norm")
    sides = asked.select("qid", "q_norm", n.alias("n"), F.explode(F.sequence(*lengths(n))).alias("m"))
    sides = sides.select("qid", "q_norm", "n", F.col("m").cast("int").alias("m"))
    # Items of no asked length, long texts among them, are not taken apart.
    sized = items.select("id", "normalized", F.length("normalized").alias("m")).join(sides.select("m").distinct(), "m", "left_semi")
    bag = written(_bag(sized, "id", "normalized"), "item-letters")
    counts = bag.groupBy("token").agg(F.count(F.lit(1)).alias("n_holders"))
    m = F.col("m")
    least = needed(m, lengths(m)[0])
    ranked = _by_rarity(bag, "id", counts).join(sized.select("id", "m"), "id")
    held = ranked.filter(F.col("r") <= m - least + 1).select("id", "m", "token").unionByName(sized.filter(least <= 0).select("id", "m", F.lit("").alias("token")))
    need = needed(F.col("n"), m)
    tokens_of = _by_rarity(_bag(asked, "qid", "q_norm"), "qid", counts)
    wanted = sides.select("qid", "n", "m").join(tokens_of, "qid").filter(F.col("r") <= F.col("n") - need + 1).select("qid", "m", "token")
    wanted = wanted.unionByName(sides.filter(need <= 0).select("qid", "m", F.lit("").alias("token")))
    return held.join(wanted, ["token", "m"]).select("qid", "id").distinct()


def _with_ids(items: DataFrame) -> DataFrame:
    return items if "id" in items.columns else written(items.withColumn("id", F.monotonically_increasing_id()), "lookup-items")


def fuzzy_pairs(items: DataFrame, q: DataFrame, threshold: float = 70) -> DataFrame:
    """The pairs of items(id, ...) and queries that a ratio of threshold allows, by three bounds that lose none.

    A ratio counts letters of a common subsequence twice, over both lengths. So the common letters bound it (letter_pairs), and so does the edit
    distance d of lengths n and m: a common subsequence has (n + m - d) / 2 letters at most.
    """
    asked = _queries(q).filter("q_norm <> ''")
    lengths = lambda n: (F.ceil(n * threshold / (200 - threshold) - 1e-9), F.floor(n * (200 - threshold) / threshold + 1e-9))
    needed = lambda n, m: F.ceil((n + m) * threshold / 200 - 1e-9)
    met = letter_pairs(items.filter("normalized <> ''"), asked, lengths, needed).join(asked, "qid").join(items, "id").filter(_fits())
    both = F.length("q_norm") + F.length("normalized")
    return met.filter(F.levenshtein("q_norm", "normalized") <= both * (100 - threshold) / 100 + 1e-9)


def fuzzy_lookup(items: DataFrame, q: DataFrame, threshold: float = 70, n: int = 10) -> DataFrame:
    """Items like the query, best first."""
    pairs = fuzzy_pairs(_with_ids(items), q, threshold)
    scored = pairs.select("qid", "item_key", "seen_count", ratio(F.col("q_norm"), F.col("normalized")).alias("score")).filter(F.col("score") >= threshold)
    return top(scored, [F.desc("score"), F.desc("seen_count"), F.asc("item_key")], n).select("qid", "rank", "item_key", "score")


def levenshtein_lookup(items: DataFrame, q: DataFrame, edits: int = 2, n: int = 10) -> DataFrame:
    """Items within some edits of the query, nearest first. Each edit costs one common letter of the longer text at most."""
    kept, asked = _with_ids(items), _queries(q)
    lengths = lambda n: (F.greatest(n - edits, F.lit(0)), n + edits)
    met = letter_pairs(kept, asked, lengths, lambda n, m: F.greatest(n, m) - edits).join(asked, "qid").join(kept, "id").filter(_fits())
    scored = met.select("qid", "item_key", "seen_count", F.levenshtein("normalized", "q_norm", edits).alias("distance")).filter("distance >= 0")
    return top(scored, [F.asc("distance"), F.desc("seen_count"), F.asc("item_key")], n).select("qid", "rank", "item_key", "distance")


def lookup(items: DataFrame, q: DataFrame, threshold: float = 70, n: int = 10) -> DataFrame:
    """Exact matches, then fuzzy ones that are not exact."""
    exact = exact_lookup(items, q).select("qid", F.lit("exact").alias("match"), "rank", "item_key")
    fuzzy = fuzzy_lookup(items, q, threshold, n).join(exact.select("qid", "item_key"), ["qid", "item_key"], "left_anti")
    return exact.unionByName(fuzzy.select("qid", F.lit("fuzzy").alias("match"), "rank", "item_key"))


def lookup_items(docs: DataFrame) -> DataFrame:
    """The lookup form of search documents: key parts, title, path and a preview."""
    parts = F.split("item_key", r"\|", 3)
    return docs.select("item_key", parts[0].alias("type"), parts[1].alias("language"), parts[2].alias("normalized"), "title", F.col("path").alias("file_path"), preview(F.col("body")).alias("text_preview"))


def consolidate(*sources: DataFrame) -> DataFrame:
    """One row per key: the one with more of title, path and preview; on ties the earlier source, then the smaller path."""
    rich = sum(F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in ("title", "file_path", "text_preview"))
    rows = None
    for i, s in enumerate(sources):
        one = s.withColumn("__source", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    columns = [c for c in rows.columns if c not in ("item_key", "__source")]
    best = rows.groupBy("item_key").agg(F.min_by(F.struct(*columns), F.struct(-rich, "__source", "file_path")).alias("r"))
    return best.select("item_key", "r.*").select(*[c for c in rows.columns if c != "__source"])


def graded_lookup(items: DataFrame | LookupIndex, q: DataFrame, n: int = 20) -> DataFrame:
    """Items by how they match: key 100, normal form 90, its start 75, a part of it 60, a part of title or preview 40."""
    index = items if isinstance(items, LookupIndex) else index_for_grades(items)
    kept, asked = index.items, _queries(q).withColumn("q_low", F.lower("q_text")).filter("q_low <> ''")
    met = _same(kept, F.col("__key"), asked, "q_low").unionByName(candidates(index.grams, asked, "q_low")).distinct()
    rows = met.join(asked, "qid").join(kept, "id").filter(_fits())
    norm, ask = F.col("__norm"), F.col("q_low")
    held = F.contains("__title", ask) | F.contains("__preview", ask)
    score = F.when(ask == F.col("__key"), 100).when(ask == norm, 90).when(F.startswith(norm, ask), 75).when(F.contains(norm, ask), 60).when(held, 40)
    graded = rows.select("qid", "id", score.alias("score")).filter("score IS NOT NULL")
    return top(graded, [F.desc("score"), F.asc("id")], n).join(kept.select("id", "item_key"), "id").select("qid", "rank", "item_key", "score")


#: Relations of one item that go with one copy of its matches; pairs of relation and match that one key, or one task, of the join makes; and most tasks, beyond which they make more.
RELATIONS_PER_SALT, PAIRS_PER_TASK, MOST_TASKS = 500, 2_000_000, 4_000
KEY = "sha2(item_key, 256) AS __key"


def item_counts(relations: DataFrame, holders: DataFrame) -> DataFrame:
    """(__key, n_relations, n_holders) of items that both have, by a digest: a key may hold a whole sentence."""
    n = lambda rows, name: rows.selectExpr(KEY).groupBy("__key").agg(F.count(F.lit(1)).alias(name))
    return written(n(relations, "n_relations").join(n(holders, "n_holders"), "__key"), "relation-counts")


def paired(relations: DataFrame, holders: DataFrame, counts: DataFrame) -> DataFrame:
    """holders(item_key, ...) with n_relations, in a row for each of relations(item_key, ...) of the item.

    Relations meet holders on a digest of the item and a salt. Salts and tasks go by the pairs that come out, which may be very many more than what goes
    in. The rows of a relation follow each other, so that its text, which each holder of the item repeats, is stored in little more than the place of one.
    """
    pairs = F.col("n_relations") * F.col("n_holders")
    salts = F.least("n_relations", F.greatest(F.ceil(F.col("n_relations") / RELATIONS_PER_SALT), F.ceil(pairs / PAIRS_PER_TASK)))
    salted = counts.withColumn("__salts", salts)
    tasks = min(1 + (counts.agg(F.sum(pairs)).first()[0] or 0) // PAIRS_PER_TASK, MOST_TASKS)
    texts = [c for c in relations.columns if c != "item_key"]
    dealt = relations.selectExpr(KEY, *texts).join(salted.filter("__salts > 1").select("__key", "__salts"), "__key", "left")
    dealt = dealt.select("__key", F.coalesce(F.pmod(F.xxhash64(*texts), "__salts"), F.lit(0).cast("long")).alias("__salt"), *texts)
    copies = holders.selectExpr("*", KEY).join(salted, "__key").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1))).drop("__salts", "n_holders")
    if tasks > 1:
        dealt, copies = dealt.repartition(tasks, "__key", "__salt"), copies.repartition(tasks, "__key", "__salt")
    # A merge goes through its left side once; the other joins may go through the holders and repeat all texts for each.
    return dealt.hint("merge").join(copies, ["__key", "__salt"]).select(*holders.columns, "n_relations", *texts)


def with_relations(matches: DataFrame, views: DataFrame) -> DataFrame:
    """matches with the number of relations of each, and a row for each relation from either end (one without where there is none)."""
    columns = [*[c for c in matches.columns if c != "item_key"], "n_relations"]
    asked, each = written(matches, "matches"), views.select("item_key", "direction", "relation_type", "other_key")
    counts = item_counts(each, asked)
    none = asked.selectExpr("*", KEY).join(counts, "__key", "left_anti").drop("__key").withColumns({"n_relations": F.lit(0).cast("long"), **{c: F.lit(None).cast("string") for c in ("direction", "relation_type", "other_key")}})
    return paired(each, asked, counts).select("item_key", *columns, "direction", "relation_type", "other_key").unionByName(none)


def build_postings(docs: DataFrame) -> DataFrame:
    """(term, path, col, tf, positions) over titles and bodies of search documents."""
    fields = F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("tokens")) for c in ("title", "body")])
    rows = docs.select("path", F.explode(fields).alias("f")).select("path", "f.col", F.posexplode("f.tokens").alias("pos", "term"))
    return rows.groupBy("term", "path", "col").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def query_terms(q: DataFrame) -> DataFrame:
    """(qid, ord, term, n_terms)."""
    rows = q.select("qid", tokens(F.col("text")).alias("t"))
    return rows.select("qid", F.size("t").alias("n_terms"), F.posexplode("t").alias("ord", "term"))


def query_words(q: DataFrame) -> DataFrame:
    """(qid, word, text, n_tokens): the words of each query as they are typed. They may hold signs at which the index splits, such as _."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}_\u00C0-\u1EF9]+)"), F.lit(1))
    return q.select("qid", F.posexplode(words).alias("word", "text")).withColumn("n_tokens", F.size(tokens(F.col("text"))))


def snippet(docs: DataFrame, q: DataFrame, found: DataFrame, width: int = 20) -> DataFrame:
    """(qid, path, snippet): the first window of width tokens with most query terms, which are put in brackets."""
    return snippets_of(found.select("qid", "path").join(docs.select("path", tokens(F.col("body")).alias("t")), "path"), q, width)


def snippets_of(found: DataFrame, q: DataFrame, width: int = 20) -> DataFrame:
    """Snippets of found(qid, path, t), whose t are the body's tokens."""
    rows = found.join(q.select("qid", F.array_distinct(tokens(F.col("text"))).alias("terms")), "qid")
    hit = F.transform("t", lambda x: F.array_contains("terms", x).cast("int"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("t") - width + 1, F.lit(1)))
    score = lambda hits: F.transform(starts, lambda i: F.struct(F.aggregate(F.slice(hits, i, width), F.lit(0), lambda s, x: s + x).alias("n"), (-i).alias("at")))
    best = rows.withColumn("at", -let(hit, lambda hits: F.array_max(score(hits))["at"]))  # bound: else made again for every start
    shown = F.array_join(F.transform(F.slice("t", F.col("at"), width), lambda x: F.when(F.array_contains("terms", x), F.concat(F.lit("["), x, F.lit("]"))).otherwise(x)), " ")
    text = F.concat(F.when(F.col("at") > 1, " ... ").otherwise(""), shown, F.when(F.col("at") + width <= F.size("t"), " ... ").otherwise(""))
    return best.select("qid", "path", text.alias("snippet"))
