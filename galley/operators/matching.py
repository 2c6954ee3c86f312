"""Matching that abstains: a value is taken only if exactly one candidate is good enough and clearly ahead."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


def unique_best(df: DataFrame, keys: list[str], score: Column, limit: float, margin: float, smallest: bool = True) -> DataFrame:
    """The best row of each key if its score reaches ``limit`` and the next one is at least ``margin`` behind; no row
    otherwise.  NULL scores do not take part.  Two partial minima per key are kept before the shuffle, no sort."""
    sign = F.lit(1 if smallest else -1)
    rows = df.withColumn("__s", score * sign).where("__s is not null")
    cols = [c for c in df.columns if c not in keys]
    two = rows.groupBy(*keys).agg(F.min("__s").alias("__a"), F.count("*").alias("__n"), F.min_by(F.struct(*cols, "__s"), F.struct("__s", F.xxhash64(*cols))).alias("__row"), F.sum(F.lit(0)).alias("__z"))
    best = rows.join(two.select(*keys, F.col("__a").alias("__best")), keys).groupBy(*keys).agg(F.min(F.when(F.col("__s") > F.col("__best"), F.col("__s"))).alias("__next"), F.count(F.when(F.col("__s") == F.col("__best"), 1)).alias("__ties"))
    ok = two.join(best, keys).where((F.col("__a") <= limit * (1 if smallest else -1)) & (F.col("__ties") == 1) & (F.col("__next").isNull() | (F.col("__next") - F.col("__a") >= margin - 1e-12)))
    return ok.select(*keys, *(F.col("__row")[c].alias(c) for c in cols))


def only_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once."""
    n = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return df.join(n, keys, "left_semi")


def agreed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) where all non-NULL values of a key are one."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__x")).where(F.col(value) == F.col("__x")).drop("__x")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def range_join(points: DataFrame, ranges: DataFrame, on: list[str], point: str, low: str, high: str, width: float) -> DataFrame:
    """points with low <= point <= high of the same ``on``.  Ranges are cut into bins of ``width`` and the join is by
    bin, so it never becomes a product; each pair comes once."""
    p = points.withColumn("__bin", F.floor(F.col(point) / width))
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, [*on, "__bin"]).where(F.col(point).between(F.col(low), F.col(high))).drop("__bin")


def one_apart(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., pairs): how many pairs of rows of equal keys have strings one character changed, lost or added apart.
    No pair is made: values are counted, and two of them are one change apart if they agree but for the sign at one place,
    one loss apart if the longer less one sign is the shorter."""
    v = F.col(value)
    at = F.filter(F.sequence(F.lit(0), F.length(v)), lambda i: i > 0)
    less = lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v)))
    form = lambda at, rest, own: F.struct(at.alias("at"), rest.alias("rest"), F.lit(own).alias("own"))
    shorter = F.transform(F.array_distinct(F.transform(at, less)), lambda x: form(F.lit(0), x, False))
    forms = F.concat(F.transform(at, lambda i: form(i, less(i), True)), F.array(form(F.lit(0), v, True)), shorter)
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    met = counts.select(*keys, "n", F.explode(forms).alias("f")).select(*keys, "n", "f.*").groupBy(*keys, "at", "rest").agg(
        F.sum(F.when(F.col("own"), F.col("n"))).alias("own"), F.sum(F.when(~F.col("own"), F.col("n"))).alias("longer"), F.sum(F.col("n") * F.col("n")).alias("same")
    )
    pairs = F.when(F.col("at") == 0, F.col("own") * F.col("longer")).otherwise(F.expr("(own * own - same) div 2"))
    return met.groupBy(*keys).agg(F.sum(pairs).alias("pairs")).where("pairs > 0")


def box_overlap(a: str, b: str) -> Column:
    """Common area of two boxes (structs x0, y0, x1, y1) over the area of the first."""
    g = lambda s, f: F.col(f"{s}.{f}")
    w = F.greatest(F.least(g(a, "x1"), g(b, "x1")) - F.greatest(g(a, "x0"), g(b, "x0")), F.lit(0.0))
    h = F.greatest(F.least(g(a, "y1"), g(b, "y1")) - F.greatest(g(a, "y0"), g(b, "y0")), F.lit(0.0))
    area = (g(a, "x1") - g(a, "x0")) * (g(a, "y1") - g(a, "y0"))
    return F.when(area > 0, w * h / area)


def best_boxes(glyphs: DataFrame, words: DataFrame, page: list[str], least: float = 0.45, bin_: float = 50.0) -> DataFrame:
    """Each glyph with the word it overlaps most (``least`` of its area); words that several glyphs claim are dropped.
    Rows: (page..., glyph_id, g struct), (page..., word_id, w struct).  Joined by horizontal bands of ``bin_``."""
    band = lambda df, s: df.withColumn("__band", F.explode(F.sequence(F.floor(F.col(f"{s}.y0") / bin_), F.floor(F.col(f"{s}.y1") / bin_))))
    pairs = band(glyphs, "g").join(band(words, "w"), [*page, "__band"]).withColumn("share", box_overlap("g", "w")).where(F.col("share") >= least)
    area = (F.col("w.x1") - F.col("w.x0")) * (F.col("w.y1") - F.col("w.y0"))
    best = pairs.groupBy(*page, "glyph_id").agg(F.max_by(F.struct("word_id", "share"), F.struct("share", -area, -F.col("word_id"))).alias("b")).select(*page, "glyph_id", "b.word_id", "b.share")
    return only_one(best, [*page, "word_id"])


def nearest(items: DataFrame, places: DataFrame, on: list[str], x: str, at: str) -> DataFrame:
    """Each item with the place of the same ``on`` that lies nearest; ties go to the smaller place.  The places of a
    page are few and come as one sorted array per page, so there is no product."""
    lists = places.groupBy(*on).agg(F.array_sort(F.collect_set(at)).alias("__places"))
    near = F.reduce(F.slice("__places", 2, F.greatest(F.size("__places") - 1, F.lit(0))), F.element_at("__places", 1), lambda best, p: F.when(F.abs(p - F.col(x)) < F.abs(best - F.col(x)), p).otherwise(best))
    return items.join(lists, on).withColumn(f"nearest_{at}", near).drop("__places")


def ratio(a: str, b: str) -> float:
    """Share of matching characters, 2 * M / T."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


#: Rows of one key on either side that are compared in one task; a key with more is no number on a page.
SIMILAR = 200


def similar_rows(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: float = 0.4) -> DataFrame:
    """Greedy one-to-one pairing of rows of equal keys by similarity of their texts: best pair first, each row used
    once, ties by order of the ids.  Rows: left (keys, a_id, a), right (keys, b_id, b).  Groups are rows of one number
    on one page, a handful each; a key with more than SIMILAR rows on a side is cut into stretches of that many in the order
    of the ids, and row number k of one side is compared with the stretch of the other that row falls into."""
    ship(left.sparkSession)

    def cut(df: DataFrame, i: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(i))
        return df.withColumn("__stretch", F.floor((place - 1) / SIMILAR))

    def pair(x: pa.Table, y: pa.Table) -> pa.Table:
        own, other = (list(zip(t.column(i).to_pylist(), map(str, t.column(v).to_pylist()))) for t, i, v in ((x, "a_id", a), (y, "b_id", b)))
        scored = sorted((-ratio(s, t), i, j) for i, s in own for j, t in other)
        used_a, used_b, out = set(), set(), []
        for s, i, j in scored:
            if -s >= least and i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out.append((i, j, -s))
        return pa.table({"a_id": pa.array([r[0] for r in out], pa.int64()), "b_id": pa.array([r[1] for r in out], pa.int64()), "ratio": pa.array([r[2] for r in out], pa.float64())})

    on = [*keys, "__stretch"]
    return cut(left, "a_id").groupBy(*on).cogroup(cut(right, "b_id").groupBy(*on)).applyInArrow(lambda x, y: pair(x, y), "a_id bigint, b_id bigint, ratio double")


def mutual_best(scored: DataFrame, a: str, b: str, score: str, least: float, margin: float) -> DataFrame:
    """Pairs that are each other's best, reach ``least``, and are ahead of every rival of either side by ``margin``."""
    one = unique_best(scored.where(F.col(score) >= least), [a], F.col(score), least, margin, smallest=False)
    two = unique_best(scored.where(F.col(score) >= least), [b], F.col(score), least, margin, smallest=False)
    return one.join(two.select(a, b), [a, b])


def ordinal_pairs(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of equal keys paired by their place, where both sides have equally many."""

    def place(df: DataFrame, n: str) -> DataFrame:
        own = Window.partitionBy(*keys)
        return df.withColumn("place", F.row_number().over(own.orderBy(order))).withColumn(n, F.count("*").over(own))

    x, y = place(left, "__n_left"), place(right, "__n_right").withColumnRenamed(order, f"{order}_right")
    return x.join(y, [*keys, "place"]).where("__n_left = __n_right").drop("__n_left", "__n_right")


def contiguous_match(tokens: DataFrame, patterns: DataFrame, on: list[str], order: str, value: str) -> DataFrame:
    """Patterns (on..., pattern_id, words array) that occur exactly once as consecutive tokens of the same ``on``:
    (on..., pattern_id, first token).  Runs are built with a bounded window for each length in use."""
    sizes = sorted(r[0] for r in patterns.select(F.size("words")).where(F.size("words") > 0).distinct().collect())  # lengths of patterns, a few
    out = None
    for n in sizes:
        w = Window.partitionBy(*on).orderBy(order).rowsBetween(0, n - 1)
        runs = tokens.select(*on, F.col(order).alias("first"), F.collect_list(value).over(w).alias("words")).where(F.size("words") == n)
        hit = only_one(patterns.where(F.size("words") == n).join(runs, [*on, "words"]).select(*on, "pattern_id", "first"), [*on, "pattern_id"])
        out = hit if out is None else out.unionByName(hit)
    return out if out is not None else patterns.select(*on, "pattern_id", F.lit(None).cast("bigint").alias("first")).limit(0)


def triples(rows: DataFrame, on: list[str], order: str, value: str) -> DataFrame:
    """Each row with the value before and after it."""
    w = Window.partitionBy(*on).orderBy(order)
    return rows.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))


def gap_fill(rows: DataFrame, on: list[str], order: str, anchor: str) -> DataFrame:
    """Rows without an anchor of their own with the anchors around them."""
    up = Window.partitionBy(*on).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*on).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("anchor_before", F.last(anchor, True).over(up)).withColumn("anchor_after", F.first(anchor, True).over(down)).where(F.col(anchor).isNull())


def full_compare(actual: DataFrame, expected: DataFrame, key: str, order: str, on: list[str] | None = None) -> DataFrame:
    """Full outer pairing of two lists of games: by ``key`` where it is unique on both sides, else by file order among the
    others.  Lists are those of one file or book, ``on``; only games without a unique key are numbered."""
    on = on or []
    unique = lambda df: df.groupBy(*on, key).agg(F.count("*").alias("__n")).where((F.col("__n") == 1) & F.col(key).isNotNull()).select(*on, key)
    keyed = unique(actual).join(unique(expected), [*on, key], "left_semi")
    place = Window.partitionBy(*on).orderBy(order) if on else Window.orderBy(order)

    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.join(keyed, [*on, key], "left_semi").select(*on, F.concat(F.lit("k"), F.col(key).cast("string")).alias("pair"), F.struct(*df.columns).alias(name))
        rest = df.join(keyed, [*on, key], "left_anti").select(*on, F.concat(F.lit("o"), F.row_number().over(place).cast("string")).alias("pair"), F.struct(*df.columns).alias(name))
        return own.unionByName(rest)

    return side(actual, "actual").join(side(expected, "expected"), [*on, "pair"], "full_outer")


def resume(previous: DataFrame, wanted: DataFrame, job: str, same: list[str]) -> tuple[DataFrame, DataFrame]:
    """(reused, to do): a job is reused only if it was completed and all of ``same`` agree (NULL never agrees)."""
    done = previous.where("status = 'completed'").select(job, *same)
    return wanted.join(done, [job, *same], "left_semi"), wanted.join(done, [job, *same], "left_anti")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` for their keys, rows of ``old`` for all others."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
