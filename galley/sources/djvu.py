"""Structured page text as s-expressions: reading lines with boxes, writing a text layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import notation


def lines(raw: DataFrame, keys: list[str], text: str = "raw") -> DataFrame:
    """(keys..., page, line, x0, y0, x1, y1, text) of s-expressions with one element per row; a word outside of any line is
    a line of its own; boxes count from the bottom left.  Rows: (keys..., raw)."""
    row = raw.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "row"))
    p = r'^\s*\((page|line|word)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s*(?:"((?:[^"\\]|\\.)*)")?'
    at = row.withColumn("kind", F.regexp_extract("row", p, 1)).where("kind <> ''").select("*", *(F.regexp_extract("row", p, i + 2).cast("int").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))), F.regexp_replace(F.regexp_extract("row", p, 6), r"\\(.)", "$1").alias("text"), (F.length(F.regexp_replace("row", r"[^)]", "")) - F.length(F.regexp_replace("row", r"[^(]", ""))).alias("closes"))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("page", F.sum(F.when(F.col("kind") == "page", 1).otherwise(0)).over(w))
    # a line is open from its own row until brackets close it
    at = at.withColumn("opened", F.last(F.when(F.col("kind") == "line", F.col("pos")), True).over(w))
    at = at.withColumn("ended", F.last(F.when((F.col("kind") == "word") & (F.col("closes") >= 1), F.col("pos")), True).over(before))
    inside = F.col("opened").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("opened")))
    words = at.where("kind = 'word'").withColumn("line", F.when(inside, F.col("opened")).otherwise(F.col("pos")))
    return words.groupBy(*keys, "page", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda e: e["text"]), " ").alias("text"))


def text_layer(words: DataFrame, keys: list[str], height: str = "height", zoom: float = 1.0) -> DataFrame:
    """(keys..., layer): words (block, line, x0..y1 from the top left, text) as one s-expression per page."""
    i = lambda c: F.round(c * zoom).cast("int").cast("string")
    top = F.col(height)
    box = lambda x0, y0, x1, y1: F.concat_ws(" ", i(F.col(x0)), i(top - F.col(y1)), i(F.col(x1)), i(top - F.col(y0)))
    word = words.withColumn("w", F.concat(F.lit("(word "), box("x0", "y0", "x1", "y1"), F.lit(" "), notation.quoted(F.col("text")), F.lit(")")))
    line = word.groupBy(*keys, height, "block", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "w"))), lambda e: e["w"]), "\n").alias("ws"))
    line = line.withColumn("l", F.concat(F.lit("(line "), box("x0", "y0", "x1", "y1"), F.lit("\n"), F.col("ws"), F.lit(")")))
    page = line.groupBy(*keys, height).agg(F.max("x1").alias("x1"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "l"))), lambda e: e["l"]), "\n").alias("ls"))
    return page.select(*keys, F.concat(F.lit("(page 0 0 "), i(F.col("x1")), F.lit(" "), i(top), F.lit("\n"), F.col("ls"), F.lit(")")).alias("layer"))
