"""Splits that keep related records together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import written

#: A list of at most so many links is worked off in one task; in a longer one a node with more links than this is hot: its
#: row of minima is copied for each salt.
HOT = 100_000
SALTS = 64
ROUNDS = 60


def _minima(edges: DataFrame) -> DataFrame:
    """For every node u of the symmetric link list: the smallest of u and its neighbours, and u's degree."""
    return edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("degree")).select("u", F.least("u", "low").alias("m"), "degree")


def _spread(edges: DataFrame, minima: DataFrame) -> DataFrame:
    """edges joined with their u's minimum.  Rows of hot nodes are spread over SALTS keys, so no node is one task."""
    salts = F.when(F.col("degree") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = minima.select("u", "m", (F.col("degree") > HOT).alias("hot"), F.explode(salts).alias("salt"))
    many = minima.where(F.col("degree") > HOT).select(F.col("u").alias("h"))
    left = edges.join(many, edges["u"] == many["h"], "left").select("u", "v", F.when(F.col("h").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    return left.join(right, ["u", "salt"]).select("u", "v", "m")


def _mark(links: DataFrame) -> tuple[int, int | None]:
    """The number of links and a sum of their hashes, which tells whether a round changed any."""
    found = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
    return found["n"], found["h"]


def _roots(links: DataFrame) -> DataFrame:
    """(u, component) of every node of at most HOT links, by union and find in one task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, kind = {}, None

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            kind = b.schema.field("u").type
            for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                low, high = sorted((root(x), root(y)))
                up[high] = low
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in list(up)], kind)], ["u", "component"])

    kind = links.schema["u"].dataType
    return links.coalesce(1).mapInArrow(find, StructType([StructField("u", kind), StructField("component", kind)]))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each connected component, for every node of ``links``.  A list of at most HOT
    links is worked off in one task; a longer one by alternating large-star and small-star until it is that short or no link
    changes.  Links with a NULL end and loops say nothing beyond the node's being there; repeated links count once.  The
    list and each round are written to the shared folder; only counts come to the driver."""
    ends = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")), "ends")
    nodes = ends.select(F.col("a").alias("node")).union(ends.select("b")).where("node is not null").distinct()
    now = ends.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark, before = _mark(now), None
    if mark[0] > HOT:
        now = written(now, "links")
    for _ in range(ROUNDS):
        if mark[0] <= HOT or mark == before:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every neighbour above u is linked with the smallest of u and its neighbours
        large = written(_spread(both, _minima(both)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: u and its neighbours below are linked with the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        moved = _spread(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(low.select("u", F.col("m").alias("v")).union(moved).distinct(), "small")
        before, mark = mark, _mark(now)
    else:
        if mark[0] > HOT and mark != before:
            raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    roots = _roots(now) if mark[0] <= HOT else now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("component", "node").alias("component"))


def in_proportion(component: Column, plan: list[tuple[str, float]], seed: int = 0) -> Column:
    """The split of a component: its hash as a number in [0, 1) falls into the range of one split; ranges follow the
    plan's shares.  Equal components always get the same split."""
    total = sum(s for _, s in plan)
    at = F.pmod(F.xxhash64(component, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    out, upper = F.lit(plan[-1][0]), 1.0
    for name, share in reversed(plan[:-1]):
        upper = sum(s for n, s in plan[: [x for x, _ in plan].index(name) + 1]) / total
        out = F.when(at < upper, F.lit(name)).otherwise(out)
    return out


def book_groups(books: DataFrame) -> DataFrame:
    """(book_id, group_book): books linked by equal sha256 or a shared author, directly or through others.  Each file and
    surname links its books with the smallest of them, so the link list holds books only."""
    from .bookkeys import surnames

    own = books.where("book_id is not null").select("book_id", "sha256", "author")
    files = own.where(F.trim("sha256") != "").select("book_id", F.concat(F.lit("file:"), F.lower(F.trim("sha256"))).alias("entity"))
    entity = files.unionByName(surnames(own).select("book_id", F.concat(F.lit("person:"), "surname").alias("entity")))
    least = entity.groupBy("entity").agg(F.min("book_id").alias("b"))
    links = entity.join(least, "entity").select(F.col("book_id").alias("a"), "b").unionByName(own.select(F.col("book_id").alias("a"), F.lit(None).cast(own.schema["book_id"].dataType).alias("b")))
    return components(links).select(F.col("node").alias("book_id"), F.col("component").alias("group_book"))


def record_groups(clipped: DataFrame, classic: DataFrame, books: DataFrame) -> DataFrame:
    """(src, rec_id, split, group_book) of every record of the two tables; group_book is NULL where the record has
    no book.  Records sent again count once."""
    from .bookkeys import resolve

    rows = clipped.select(F.lit("clipped_notation").alias("src"), F.col("clip_id").alias("rec_id"), "split", "book").unionByName(classic.select(F.lit("classic").alias("src"), F.col("template_id").alias("rec_id"), "split", F.col("source.book").alias("book"))).distinct()
    names = written(resolve(rows, books).join(book_groups(books), "book_id").select("book", "group_book"), "names")
    return rows.join(names, "book", "left").select("src", "rec_id", "split", "group_book")


def spread_groups(records: DataFrame) -> DataFrame:
    """The records of groups that have more than one non-NULL split."""
    groups = records.where("group_book is not null").groupBy("group_book").agg(F.min("split").alias("low"), F.max("split").alias("high")).where("low <> high").select("group_book")
    return records.join(groups, "group_book").select("src", "rec_id", "group_book").distinct()


def assign(records: DataFrame, plan: DataFrame) -> DataFrame:
    """Every record with its new split.  A record without a book is a group of its own."""
    shares = sorted((r["split"], float(r["share"])) for r in plan.where("split is not null and share > 0").collect())  # a fixed table of a few rows
    alone = F.concat_ws(":", "src", F.col("rec_id").cast("string"))
    return records.select("src", "rec_id", F.col("split").alias("old_split"), "group_book", in_proportion(F.coalesce("group_book", alone), shares).alias("new_split")).distinct()
