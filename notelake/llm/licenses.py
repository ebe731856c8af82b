"""License scans by diagonal voting.

Every run of K words of every text meets the runs of K words of the license templates by their hash (and then word for word). A hit
at word d of the text and word t of the template votes for the diagonal d - t: a template that stands in the text unchanged puts all its votes on
one diagonal, and words put in or left out move the rest to a neighbouring one. Diagonals within MERGE of each other are merged to a
candidate span, which is verified on the text's words: the longest common subsequence with the template must reach SIMILAR of its words,
and the words that name the license must be among the span's. Of overlapping spans the one with most words in common stays.

The base phrases are templates as well, which must have all votes on one diagonal.

The templates are a small table given by the caller (at most MAX_TEMPLATE_WORDS words in all, checked), which is why they may be broadcast;
texts are never shuffled. A hit takes the words beside it along, which is all that verification reads. Equal texts are known by their SHA-256 and
vote once; what was found for a digest joins the documents at the end.

Defined results: null and empty texts have no words, no places and no labels, and score 0. Whole texts of any length are read. Several places of
equal phrases all count. Repeated rows give equal rows, an empty table gives an empty one, and further columns are
carried along; columns of the names that ``with_licenses`` adds are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.llm.shared import ascii_lower, table, written

#: Words of a hashed run, the most by which merged diagonals may lie apart, and the share of a template's words that must be found.
K, MERGE, SIMILAR = 3, 8, 0.8
MAX_TEMPLATE_WORDS = 100_000

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = "array<struct<less:int,start:int,end:int,label:string,score:double>>"


class Template(NamedTuple):
    label: str
    #: Words that a span must hold.
    names: str
    text: str


#: Phrases that count wherever their words stand consecutively.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: What licenses say of themselves in their notices.
TEMPLATES = (
    Template("mit", "mit license", "released under the mit license"),
    Template("mit", "mit license", "licensed under the terms of the mit license"),
    Template("mit", "permission granted charge software", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions"""),
    Template("apache-2", "apache license 2", "licensed under the apache license version 2 0"),
    Template("apache-2", "apache license 2", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""),
    Template("gpl-2", "gnu general public license 2", "licensed under the gnu general public license version 2"),
    Template("gpl-3", "gnu general public license 3", "licensed under the gnu general public license version 3"),
    Template("gpl-2", "gnu general public license 2", """
        This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of
        the License, or (at your option) any later version"""),
    Template("gpl-3", "gnu general public license 3", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of
        the License, or (at your option) any later version"""),
    Template("lgpl-2.1", "gnu lesser general public license 2 1", "licensed under the gnu lesser general public license version 2 1"),
    Template("lgpl-3", "gnu lesser general public license 3", "licensed under the gnu lesser general public license version 3"),
    Template("lgpl-3", "gnu lesser general public license 3", """
        This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version
        3 of the License, or (at your option) any later version"""),
    Template("agpl-3", "gnu affero general public license 3", "licensed under the gnu affero general public license version 3"),
    Template("agpl-3", "gnu affero general public license 3", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version
        3 of the License, or (at your option) any later version"""),
    Template("bsd", "bsd license", "licensed under the bsd license"),
    Template("bsd", "redistribution source binary forms", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer"""),
    Template("isc", "permission software fee", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
        appear in all copies"""),
    Template("mpl-2", "mozilla public license 2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "creative commons attribution sharealike", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc", "creative commons attribution noncommercial", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-nd", "creative commons attribution noderivatives", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    Template("cc0", "dedicated public domain", "has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain"),
    Template("unlicense", "released public domain", "this is free and unencumbered software released into the public domain"),
    Template("zlib", "permission granted software freely", """
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""),
)


def words(text: Column) -> Column:
    """Letters and digits in runs, A-Z in lower case; characters beyond ASCII are part of words."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def runs(w: Column, k: int = K) -> Column:
    """The hash of every run of k words, by its first word."""
    n = F.size(w) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: Sequence[Template], base: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, label, names, size, least, exact, words): base phrases first; least is the number of runs that a span must hit."""
    rows = [(i, label, "", text, True) for i, (label, text) in enumerate(base)] + [(len(base) + i, *t, False) for i, t in enumerate(templates)]
    if sum(len(r[3].split()) for r in rows) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates may hold {MAX_TEMPLATE_WORDS} words in all")
    given = spark.createDataFrame(rows, "template int, label string, names string, text string, exact boolean")
    known = given.select("template", "label", words(F.col("names")).alias("names"), words(F.col("text")).alias("words"), "exact").withColumn("size", F.size("words"))
    # A span without 1 - SIMILAR of the words loses K runs for each of them at most.
    changed = F.floor(F.round(F.col("size") * (1 - SIMILAR), 6))
    least = F.greatest(F.lit(1), F.col("size") - (K - 1) - K * changed).cast("int")
    return known.withColumn("least", F.when(F.col("exact"), F.col("size") - (K - 1)).otherwise(least))


def votes(docs: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """(digest, template, d, t, around): the distinct hits of each distinct text, with the words (at, word) up to MERGE beside the run."""
    at = known.select("template", F.col("words").alias("__words"), F.posexplode(runs(F.col("words"))).alias("t", "run"))
    at = at.select("template", "t", "run", F.slice("__words", F.col("t") + 1, K).alias("__run_words"))
    # The texts' words and digests are computed once a text, before their runs are laid out.
    each = docs.select(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("digest"), words(F.col(text)).alias("__w"))
    hits = each.select("digest", "__w", F.posexplode(runs(F.col("__w"))).alias("d", "run")).join(F.broadcast(at), "run").filter(F.slice("__w", F.col("d") + 1, K) == F.col("__run_words"))
    first = F.greatest(F.col("d") - MERGE, F.lit(0))
    around = F.transform(F.slice("__w", first + 1, F.col("d") - first + K + MERGE), lambda x, i: F.struct((first + i).alias("at"), x.alias("word")))
    return hits.select("digest", "template", "d", "t", around.alias("around")).groupBy("digest", "template", "d", "t").agg(F.first("around").alias("around"))


def base_places(found: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, n_base, first_word, last_word, base_labels): phrases whose runs are all on one diagonal."""
    exact = known.filter("exact").select("template", "label", "least")
    on = found.join(F.broadcast(exact), "template").groupBy("digest", "template", "label", "least", (F.col("d") - F.col("t")).alias("at")).agg(F.count(F.lit(1)).alias("n")).filter("n = least")
    return on.groupBy("digest").agg(F.count(F.lit(1)).alias("n_base"), F.min("at").cast("long").alias("first_word"), F.max("at").cast("long").alias("last_word"), F.collect_set("label").alias("base"))


def candidates(found: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, template, said): candidate spans from merged neighbouring diagonals with enough votes, as their words (at, word) in order.

    Words further than MERGE from every hit are left out; they are no part of what is common.
    """
    loose = known.filter("NOT exact").select("template", "least")
    hits = found.join(F.broadcast(loose), "template").withColumn("diagonal", F.col("d") - F.col("t"))
    at = ["digest", "template", "diagonal"]
    diagonals = hits.groupBy(*at, "least").agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("digest", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > MERGE
    merged = diagonals.withColumn("group", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order))
    enough = merged.withColumn("all_votes", F.sum("votes").over(Window.partitionBy("digest", "template", "group"))).filter("all_votes >= least")
    said = hits.drop("least").join(enough.select(*at, "group", "least"), at).select("digest", "template", "group", "least", "t", F.explode("around").alias("w"))
    spans = said.groupBy("digest", "template", "group", "least").agg(F.size(F.collect_set("t")).alias("n"), F.array_sort(F.collect_set("w")).alias("said"))
    return spans.filter("n >= least").select("digest", "template", "said")


def common(a: Sequence[str], b: Sequence[str]) -> tuple[int, int]:
    """Length of the longest common subsequence, bit-parallel over b, and how many words of a it takes from the start."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row, most, taken = full, 0, 0
    for i, w in enumerate(a):
        hit = row & places.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
            n = len(b) - row.bit_count()
            if n > most:
                most, taken = n, i + 1
    return most, taken


def verified(said: Column, template: Column, templates: Sequence[tuple[list[str], list[str]]]) -> Column:
    """Of a candidate's words (at, word) the span that holds its template: (start, end, n common words), or null."""

    def judge(rows: pd.Series, which: pd.Series) -> pd.DataFrame:
        out = []
        for row, k in zip(rows, which, strict=True):
            names, text = templates[k]
            held = [s["word"] for s in row]
            n, end = common(held, text) if set(names) <= set(held) else (0, 0)
            if n < SIMILAR * len(text) - 1e-9:
                out.append((None, None, None))
                continue
            _, length = common(held[:end][::-1], text[::-1])
            out.append((row[end - length]["at"], row[end - 1]["at"] + 1, n))
        return pd.DataFrame(out, columns=["start", "end", "n"]).astype("Int64")

    return F.pandas_udf(judge, "start int, end int, n int")(said, template)


def best_apart(spans: Column) -> Column:
    """spans (less common words first in order, start, end, label, score) without those that share over half of the shorter one with a better one."""
    keep = lambda s, kept: F.forall(kept, lambda k: F.least(s["end"], k["end"]) - F.greatest(s["start"], k["start"]) <= F.least(s["end"] - s["start"], k["end"] - k["start"]) / 2)
    return F.aggregate(F.array_sort(spans), F.array().cast(SPAN), lambda kept, s: F.when(keep(s, kept), F.concat(kept, F.array(s))).otherwise(kept))


def facts(found: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, n_base, first_word, last_word, base, spans) of texts with phrases or verified spans."""
    rules = [(list(r.names), list(r.words)) for r in known.orderBy("template").collect()]
    held = candidates(found, known).withColumn("v", verified(F.col("said"), F.col("template"), rules)).filter("v.n IS NOT NULL").join(F.broadcast(known.select("template", "label", "size")), "template")
    span = F.struct((-F.col("v.n")).alias("less"), F.col("v.start").alias("start"), F.col("v.end").alias("end"), "label", (F.col("v.n") / F.col("size")).alias("score"))
    spans = held.groupBy("digest").agg(best_apart(F.collect_list(span)).alias("spans"))
    return base_places(found, known).join(spans, "digest", "full")


def with_licenses(docs: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """docs and n_words, n_base, first_word, last_word, base_labels, labels, license_spans (label, start, end, score) and score.

    Spans count words, the end exclusive. The score is 1 for a base phrase, else the best share of a template's words.
    """
    known = template_table(docs.sparkSession, templates, base)
    found = written(votes(docs, text, known), "license-votes")
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "license_spans", "score")
    own = [c for c in docs.columns if c not in added]
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(own)], F.size(words(said)).cast("long").alias("n_words"), F.sha2(said.cast("binary"), 256).alias("digest"))
    out = rows.join(written(facts(found, known), "license-facts"), "digest", "left").withColumn("__spans", F.transform(F.coalesce("spans", F.array().cast(SPAN)), lambda s: s.dropFields("less")))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat(F.coalesce("base", none), F.transform("__spans", lambda s: s["label"]))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("__spans", lambda s: s["score"])), F.lit(0.0)))
    return out.select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(own)], "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(F.coalesce("base", none)), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.col("__spans").alias("license_spans"), score.alias("score"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and labels."""
    found = with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
