"""Diagrams: 64 read squares to a placement, and what a diagram leaves open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., placement, status) of cells (keys..., square 0..63 from a8 to h1, piece; '' for an empty square): a
    placement only if all 64 squares are read, else NULL and ``incomplete``."""
    rows = cells.groupBy(*keys).agg(F.count("square").alias("n"), F.count("piece").alias("read"), F.transform(F.array_sort(F.collect_list(F.struct("square", F.coalesce("piece", F.lit("?")).alias("piece")))), lambda e: F.when(e["piece"] == "", "1").otherwise(e["piece"])).alias("p"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.array_join(F.slice("p", r * 8 + 1, F.lit(8)), "")), "/")
    for n in range(8, 1, -1):
        text = F.regexp_replace(text, f"(?<!1)1{{{n}}}(?!1)", str(n))
    ok = (F.col("n") == 64) & (F.col("read") == 64)
    return rows.select(*keys, F.when(ok, text).alias("placement"), F.when(ok, "complete").otherwise("incomplete").alias("status"))


def checkered(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the dark squares are darker than the light ones: by 0.10 on average, and 24 of 32 above 0.15.
    Rows: (keys..., square, ink) with the ink share of a corner of each square."""
    dark = F.pmod(F.floor(F.col("square") / 8) + F.col("square") % 8, F.lit(2)) == 1
    a = cells.groupBy(*keys).agg((F.avg(F.when(dark, F.col("ink"))) - F.avg(F.when(~dark, F.col("ink")))).alias("lead"), F.count_if(dark & (F.col("ink") > 0.15)).alias("dark"))
    return a.select(*keys, ((F.col("lead") >= 0.10) & (F.col("dark") >= 24)).alias("is_board"))


def open_fields(setups: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of FEN in which the possible set-ups (keys..., fen) differ; a diagram is settled if there are none."""
    part = F.split("fen", " ")
    names = ("placement", "turn", "castling", "passant")
    return setups.groupBy(*keys).agg(*(F.size(F.collect_set(part[i])).alias(n) for i, n in enumerate(names)), F.min("fen").alias("fen"), F.count("*").alias("candidates")).select(*keys, "fen", "candidates", F.array_compact(F.array(*(F.when(F.col(n) > 1, n) for n in names))).alias("open"))
