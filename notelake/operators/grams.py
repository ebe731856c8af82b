"""Substring search of many queries in many texts through a kept gram index.

A text has a gram at every place: the GRAM characters from there on, fewer at its end. The index has one row for a text and each of its
different grams, and no text at all: about a gram's length of characters is shuffled for a character of text. A gram that very many texts
hold is split over several salts, so that no key of a join has more than ROWS_PER_SALT rows. The vocabulary counts how many texts hold a gram.

A query probes its PROBES rarest grams by these counts (a query shorter than a gram, every gram that starts with it) and
keeps the texts that hold them all. Only for these are texts fetched, by id, and compared.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import let
from notelake.sources.tables import written

GRAM, PROBES = 3, 2
ROWS_PER_SALT = 200_000


class GramIndex(NamedTuple):
    """rows(gram, salt, id) and vocabulary(gram, n, salts), both kept tables."""

    rows: DataFrame
    vocabulary: DataFrame


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def grams(text: Column, whole: bool = False) -> Column:
    """The different grams of a text; whole leaves out the shorter ones at its end."""

    def made(cs: Column) -> Column:
        all_of = F.transform(cs, lambda x, i: F.concat(x, *[F.coalesce(F.get(cs, i + k), F.lit("")) for k in range(1, GRAM)]))
        return F.slice(all_of, 1, F.greatest(F.size(cs) - GRAM + 1, F.lit(0))) if whole else all_of

    return F.array_distinct(let(letters(text), made))


def build_grams(texts: DataFrame, id: str, *columns: Column) -> GramIndex:
    """The index of texts by their id; several columns are indexed as one. Null texts hold nothing."""
    bound = F.array(*[F.coalesce(c, F.lit("")) for c in columns])
    found = F.array_distinct(F.flatten(F.transform(bound, lambda c: grams(c))))
    rows = texts.select(F.col(id).alias("id"), F.explode(found).alias("gram"))
    kept = written(rows, "gram-rows")
    counts = kept.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = written(counts.withColumn("salts", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int")), "gram-counts")
    salted = kept.join(vocabulary.filter("salts > 1").select("gram", "salts"), "gram", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)).cast("int")
    return GramIndex(salted.select("gram", salt.alias("salt"), "id"), vocabulary)


def probes(index: GramIndex, asked: DataFrame, part: str) -> DataFrame:
    """(qid, gram, salts, wanted): what each query of asked(qid, part) looks up; wanted is how many of them a text must hold.

    Queries with a gram that no text has are gone, and so are empty ones.
    """
    known = index.vocabulary
    long = asked.filter(F.length(part) >= GRAM).select("qid", grams(F.col(part), whole=True).alias("g"))
    of = long.select("qid", F.size("g").alias("all"), F.explode("g").alias("gram")).join(known, "gram")
    order = Window.partitionBy("qid").orderBy("n", "gram")
    ranked = of.withColumns({"k": F.row_number().over(order), "met": F.count(F.lit(1)).over(Window.partitionBy("qid"))})
    rare = ranked.filter(f"met = all AND k <= {PROBES}").select("qid", "gram", "salts", F.least("all", F.lit(PROBES)).alias("wanted"))
    for n in range(1, GRAM):
        short = asked.filter(F.length(part) == n).select("qid", F.col(part).alias("start"))
        starts = known.withColumn("start", F.left("gram", F.lit(n)))
        rare = rare.unionByName(short.join(starts, "start").select("qid", "gram", "salts", F.lit(1).alias("wanted")))
    return rare


def candidates(index: GramIndex, asked: DataFrame, part: str) -> DataFrame:
    """(qid, id): texts that hold what the query probes; every text that holds the query is among them."""
    looked = probes(index, asked, part).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    met = index.rows.join(looked, ["gram", "salt"]).groupBy("qid", "id").agg(F.count(F.lit(1)).alias("n"), F.max("wanted").alias("wanted"))
    return met.filter("n >= wanted").select("qid", "id")


def holders(texts: DataFrame, id: str, text: Column, index: GramIndex, asked: DataFrame, part: str) -> DataFrame:
    """(qid, id) of texts that hold the query's part: the candidates, compared."""
    found = candidates(index, asked, part).join(asked.select("qid", F.col(part).alias("__part")), "qid")
    # The text moves once at most, to its candidates, and not beyond this join.
    return found.join(texts.select(F.col(id).alias("id"), text.alias("__text")), "id").filter(F.contains("__text", "__part")).select("qid", "id")
