"""Pipe tables inside notes as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import strip


def markdown_tables(notes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(path, section, line_no, cells): the body rows of pipe tables as maps from header to cell.

    Without columns, the first row after a ``##`` heading is the header; with columns, a row that holds them all is, and any
    line that is no table row ends the table. Separator rows, and rows with more or fewer cells than the header, are dropped.
    """
    lines = notes.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line", strip(F.col("raw")))
    heading = F.when(F.col("line").rlike(r"\A##\s"), strip(F.regexp_replace("line", r"\A##", "")))
    is_row = F.col("line").startswith("|")
    inner = F.regexp_replace(F.regexp_replace("line", r"\A\|", ""), r"\|\z", "")
    cells = F.when(is_row, F.transform(F.split(inner, r"\|"), strip))
    order = Window.partitionBy("path").orderBy("line_no")
    rows = lines.withColumns({"section": F.last(heading, True).over(order), "cells": cells, "is_row": is_row, "starts": heading.isNotNull()})
    rows = rows.filter(~F.coalesce(F.forall("cells", lambda c: c.rlike(r"\A:?-+:?\z")), F.lit(False)))
    #: A block is what follows a heading, or an unbroken run of table rows.
    cut = F.col("starts") if columns is None else ~F.col("is_row")
    rows = rows.withColumn("block", F.count(F.when(cut, 1)).over(order)).filter("is_row")
    block = Window.partitionBy("path", "block").orderBy("line_no")
    wanted = F.row_number().over(block) == 1 if columns is None else F.size(F.array_except(F.array(*[F.lit(c) for c in columns]), F.col("cells"))) == 0
    rows = rows.withColumn("is_header", wanted).withColumn("header", F.last(F.when(F.col("is_header"), F.col("cells")), True).over(block))
    body = rows.filter("NOT is_header AND header IS NOT NULL AND size(cells) = size(header)")
    return body.select("path", "section", "line_no", F.map_from_arrays("header", "cells").alias("cells"))
