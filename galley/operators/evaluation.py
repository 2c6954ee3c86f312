"""Games compared with reference games: paths, main lines, frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def move_paths(moves: DataFrame, games: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., start_fen, path, history): the whole history of moves up to each node, which is what identifies it; a
    transposition is another path.  Rows: moves (keys..., path, uci)."""
    own = moves.select(*keys, "path", "uci")
    up = own.select(*keys, "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n")).select(*keys, "path", F.slice("path", F.lit(1), F.col("n")).alias("prefix"))
    steps = up.join(own.select(*keys, F.col("path").alias("prefix"), "uci"), [*keys, "prefix"])
    hist = steps.groupBy(*keys, "path").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.size("prefix").alias("n"), "uci"))), lambda e: e["uci"]).alias("history"))
    return hist.join(games.select(*keys, "start_fen"), keys)


def precision_recall(found: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """(predicted, expected, matched, precision, recall) over distinct paths; 0.0 on an empty denominator."""
    f, w = found.select(*on).distinct().withColumn("f", F.lit(1)), wanted.select(*on).distinct().withColumn("w", F.lit(1))
    n = f.join(w, on, "full_outer").agg(F.count("f").alias("predicted"), F.count("w").alias("expected"), F.count_if(F.col("f").isNotNull() & F.col("w").isNotNull()).alias("matched"))
    share = lambda d: F.when(F.col(d) > 0, F.col("matched") / F.col(d)).otherwise(0.0)
    return n.withColumn("precision", share("predicted")).withColumn("recall", share("expected"))


def mainlines(moves: DataFrame, keys: list[str]) -> DataFrame:
    return moves.where(F.forall("path", lambda x: x == 0)).select(*keys, F.size("path").alias("ply"), "uci")


def prefix_match(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., matched, expected, exact): plies up to the first difference of two main lines (keys..., ply, uci)."""
    e = expected.select(*keys, "ply", F.col("uci").alias("want"))
    both = e.join(actual.select(*keys, "ply", F.col("uci").alias("have")), [*keys, "ply"], "full_outer")
    g = both.groupBy(*keys).agg(F.min(F.when(~F.col("want").eqNullSafe(F.col("have")), F.col("ply"))).alias("off"), F.count("want").alias("expected"))
    return g.select(*keys, F.coalesce(F.col("off") - 1, F.col("expected")).cast("bigint").alias("matched"), "expected", F.col("off").isNull().alias("exact"))


def tree_differences(actual: DataFrame, expected: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(missing, unexpected) paths of equal start positions."""
    return expected.join(actual, [*keys, "start_fen", "history"], "left_anti"), actual.join(expected, [*keys, "start_fen", "history"], "left_anti")


def frontiers(missing: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., frontier, affected): the highest missing nodes, each with the number of missing nodes at or below it."""
    rows = missing.select(*keys, "history").distinct()
    pre = rows.select(*keys, "history", F.explode(F.sequence(F.lit(1), F.size("history"))).alias("n")).select(*keys, "history", F.slice("history", F.lit(1), F.col("n")).alias("prefix"))
    tops = pre.join(rows.select(*keys, F.col("history").alias("prefix")), [*keys, "prefix"]).groupBy(*keys, "history").agg(F.min_by("prefix", F.size("prefix")).alias("frontier"))
    return tops.groupBy(*keys, "frontier").agg(F.count("*").alias("affected"))


def ordered_common(a: Column, e: Column) -> Column:
    """Whether the elements two lists have in common stand in the same order in both."""
    return F.array_intersect(a, e) == F.array_intersect(e, a)


def signature(moves: DataFrame, games: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., signature): a hash of start position and ordered tree with comments and marks."""
    node = F.struct("path", "uci", "comment", "starting_comment", F.array_sort("nags").alias("nags"))
    tree = moves.groupBy(*keys).agg(F.array_sort(F.collect_list(node)).alias("tree"))
    return games.select(*keys, "start_fen").join(tree, keys, "left").select(*keys, F.sha2(F.to_json(F.struct("start_fen", "tree")), 256).alias("signature"))


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows without later ones of the same key; the order of the first ones is kept in ``place``."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")
