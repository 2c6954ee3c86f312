"""Items of varying length into containers of fixed capacity.

1. The histogram of sizes (at most ``capacity`` rows, whatever the corpus) comes to the driver.
2. Dynamic programming over it chooses the length buckets whose upper bounds cost least padding.
3. Inside each bucket, largest first, token-budget batches form: as many items of the bucket as the capacity
   holds.  What a batch leaves free is topped up with items of smaller buckets, best fit first.  Both are
   decided on counts alone: the plan is a table (bucket, from_rank, to_rank, first container, ...).
4. Items get their rank within their bucket (salted, so that no bucket is one task) and look up their container.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets the dynamic programme may use: the fill grows with them, 97.5 % with 64 and 99.7 % with 512 for containers of 4,096.
BUCKETS = 512
#: Items that one task ranks, about; the number of salts follows the count.
RANKED = 100_000


def _layer(best: np.ndarray, sizes: np.ndarray, number: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One layer of the dynamic programme: for every j the least best[i] + cost(i, j) and its i.  The optimal i never falls as j
    grows, so the middle j of a stretch bounds those on either side; all stretches of one depth are worked out at once."""
    n = len(sizes)
    new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    new[0] = 0
    lo, hi, a, b = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(lo):
        j = (lo + hi) // 2
        many = np.minimum(b, j - 1) - a + 1
        start = np.cumsum(many) - many
        i = np.arange(many.sum()) - np.repeat(start - a, many)
        at = np.repeat(j, many)
        cost = best[i] + sizes[at - 1] * (number[at] - number[i]) - (weight[at] - weight[i])
        least = np.minimum.reduceat(cost, start)
        hit = np.flatnonzero(cost == np.repeat(least, many))
        first = i[hit[np.searchsorted(hit, start)]]
        new[j], cut[j] = least, first
        lo, hi, a, b = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (a, first), (first, b)))
        keep = lo <= hi
        lo, hi, a, b = lo[keep], hi[keep], a[keep], b[keep]
    return new, cut


def optimal_buckets(sizes: np.ndarray, counts: np.ndarray, most: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most ``most`` buckets with the least total padding sum(count * (bound - size)):
    f[k][j] = min over i of f[k-1][i] + cost(i, j)."""
    n = len(sizes)
    if n <= most:
        return sizes.copy()
    number = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    weight = np.concatenate([[0], np.cumsum(counts * sizes)]).astype(np.float64)
    best = np.concatenate([[0], sizes * number[1:] - weight[1:]])
    cuts = []
    for _ in range(1, most):
        best, cut = _layer(best, sizes, number, weight)
        cuts.append(cut)
    at, bounds = n, []
    for cut in reversed(cuts):
        if at <= 0:
            break
        bounds.append(sizes[at - 1])
        at = int(cut[at])
    if at > 0:
        bounds.append(sizes[at - 1])
    return np.array(sorted(set(bounds)))


def plan(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (bucket, from_rank, to_rank, first_bin, per_bin, slot): the items of ``bucket`` ranked in
    [from_rank, to_rank) go, ``per_bin`` to each, into the bins from ``first_bin`` on."""
    left = counts.astype(np.int64).copy()
    rank = np.zeros(len(bounds), np.int64)
    out, bins = [], 0
    for k in range(len(bounds) - 1, -1, -1):
        per = max(1, int(capacity // max(1, bounds[k])))
        while left[k] > 0:
            if left[k] >= per:
                groups, fill = int(left[k] // per), [(k, per)]
            else:
                groups, fill = 1, [(k, int(left[k]))]
            free = capacity - fill[0][1] * int(bounds[k])
            for j in range(k - 1, -1, -1):
                if bounds[j] <= free and left[j] > 0:
                    take = int(min(free // max(1, bounds[j]), left[j]))
                    fill.append((j, take))
                    free -= take * int(bounds[j])
            # the same filling is used for as many bins as all its buckets allow
            groups = min(groups, *(int(left[j] // n) for j, n in fill))
            for slot, (j, n) in enumerate(fill):
                out.append((j, int(rank[j]), int(rank[j] + groups * n), bins, n, slot))
                rank[j] += groups * n
                left[j] -= groups * n
            bins += groups
    return out


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", buckets: int = BUCKETS) -> DataFrame:
    """(id, piece, size, bin, n_pieces): every item in a bin of ``capacity``; only an item larger than the
    capacity is cut, into full pieces and a rest.  NULL sizes and sizes of 0 or less take no space and get bin
    NULL; ties go by id; rows repeated with the same id are items of their own."""
    spark = sizes.sparkSession
    n = F.col("n")
    items = sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("n"))
    pieces = items.where(n > 0).select("id", F.ceil(n / capacity).alias("n_pieces"), "n").select("id", "n_pieces", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_pieces")).alias("piece")).select("id", "n_pieces", "piece", F.when(F.col("piece") < F.col("n_pieces"), F.lit(capacity)).otherwise(n - (F.col("n_pieces") - 1) * capacity).cast("int").alias("size"))
    empty = items.where(n.isNull() | (n <= 0)).select("id", F.lit(1).cast("bigint").alias("n_pieces"), F.lit(1).cast("bigint").alias("piece"), F.coalesce(n, F.lit(0)).cast("int").alias("size"), F.lit(None).cast("bigint").alias("bin"))
    # the histogram has at most `capacity` rows
    hist = sorted((r["size"], r["count"]) for r in pieces.groupBy("size").count().collect())
    if not hist:
        return empty.select(F.col("id").alias(id_col), "piece", "size", "bin", "n_pieces")
    size, count = (np.array(x, np.int64) for x in zip(*hist))
    bounds = optimal_buckets(size, count, buckets)
    of = np.searchsorted(bounds, size)
    held = np.bincount(of, weights=count, minlength=len(bounds)).astype(np.int64)
    rows = plan(bounds, held, capacity)
    table = F.broadcast(spark.createDataFrame(rows, "bucket int, from_rank bigint, to_rank bigint, first_bin bigint, per_bin bigint, slot int"))
    salts = max(1, -(-int(held.max()) // RANKED))
    # as many rows as the histogram
    which = F.broadcast(spark.createDataFrame([(int(x), int(k)) for x, k in zip(size, of)], "size int, bucket int"))
    salted = pieces.join(which, "size").withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    # ranks over all salts: counts of the groups before plus the rank within the group
    before = salted.groupBy("bucket", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy(F.desc("size"), "id", "piece")) - 1).join(before, ["bucket", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    placed = ranked.join(table, (ranked["bucket"] == table["bucket"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    done = placed.select("id", "n_pieces", "piece", "size", (F.col("first_bin") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("per_bin"))).cast("bigint").alias("bin"))
    return done.unionByName(empty).select(F.col("id").alias(id_col), "piece", "size", "bin", "n_pieces")


def check(placed: DataFrame, sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """One row on a packing of ``sizes`` (ids unique) in bins of ``capacity``: items placed, items without size, items cut,
    items whose pieces do not add up to their size or are cut without need, bins over capacity, and whether the bins used are
    at most a twentieth more than the total size needs."""
    own = sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)).alias("n"))
    pieces = placed.select(F.col(id_col).alias("id"), "bin", F.col("size").cast("bigint").alias("size"))
    item = pieces.groupBy("id").agg(F.sum("size").alias("got"), F.count("*").alias("pieces"), F.count("bin").alias("binned"))
    both = own.join(item, "id", "full")
    items = both.agg(
        F.count_if(F.col("binned") > 0).alias("placed"), F.count_if(F.coalesce(F.col("binned"), F.lit(0)) == 0).alias("without_size"), F.count_if(F.col("pieces") > 1).alias("cut"),
        F.count_if(~F.coalesce((F.col("got") == F.greatest("n", F.lit(0))) & ((F.col("pieces") == 1) | (F.col("n") > capacity)), F.lit(False))).alias("wrong"),
    )
    bins = pieces.where("bin is not null").groupBy("bin").agg(F.sum("size").alias("used"))
    use = bins.agg(F.count_if(F.col("used") > capacity).alias("overfull"), F.coalesce(F.count("*") <= F.ceil(F.sum("used") / capacity * 1.05) + 1, F.lit(True)).alias("dense"))
    return items.withColumn("one", F.lit(1)).join(use.withColumn("one", F.lit(1)), "one").drop("one")  # one row each
