"""The same operators on the driver's star schema: joins, windows, sets, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import sequences as S
from ..session import table


#: Labels whose mean vectors may travel in one row.
LABELS = 10_000


def event_idle_sessions(spark, d):
    """Sessions of users: a pause of more than 6 hours begins a new one."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return S.idle_sessions(e, ["user_id"], "t", 6 * 3600 * 1_000_000).groupBy("user_id", "session").agg(F.count("*").alias("events"), ((F.max("t") - F.min("t")) / 1_000_000).cast("bigint").alias("seconds"))


def event_depth_clamped(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return S.clamped_depth(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", -1).otherwise(1)).groupBy("user_id").agg(F.max("depth").alias("deepest"), F.count_if(F.col("depth") == 0).alias("at_zero"))


def event_next_anchor(spark, d):
    """How many of the events of a user have a purchase among the next 20."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    n = S.next_anchor(e, ["user_id"], "event_id", F.col("event_type") == "purchase", within=20)
    return n.groupBy("user_id").agg(F.count("next_anchor").alias("followed"), F.min("next_anchor").alias("first_anchor"))


def event_carry(spark, d):
    """The value of the last purchase before each event, summed per user."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return S.carried(e, ["user_id"], ["event_id"], "v", "last").groupBy("user_id").agg(F.count("last").alias("n"), F.round(F.sum("last"), 4).alias("total"))


def event_longest_run(spark, d):
    e = table(spark, d, "events")
    return S.longest_run(e, ["user_id"], ["event_id"], F.col("event_type") != "purchase")


def event_props_json(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def emb_nearest_margin(spark, d):
    """The label whose mean vector is nearest to a vector, if it is ahead by a margin; queries are the ids divisible by
    100, against the means of all rows.  The labels' means are as few as the labels: each query meets them all in one row,
    an array of labels and means, so vectors never come apart.  More labels than LABELS would be no such table."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    dims = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    mean = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    if mean.count() > LABELS:
        raise ValueError(f"more than {LABELS} labels: their means do not fit in one row")
    means = mean.groupBy().agg(F.collect_list(F.struct("label", "mean")).alias("means")).withColumn("one", F.lit(1))
    q = e.where("vec_id % 100 = 0").withColumn("one", F.lit(1)).join(means, "one")
    far = lambda s: F.aggregate(F.zip_with("x", s["mean"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    each = q.select("vec_id", F.explode(F.transform("means", lambda s: F.struct(s["label"].alias("label"), far(s).alias("d")))).alias("f")).select("vec_id", "f.label", "f.d")
    return M.unique_best(each, ["vec_id"], F.col("d"), 1e9, 1e-3).select("vec_id", "label", F.round("d", 5).alias("d"))


def orders_range_join(spark, d):
    """Orders whose total lies in a customer's band of 100 above the balance, joined by bins instead of a product."""
    o = table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_totalprice").alias("x"), F.lit(1).alias("g"))
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.lit(1).alias("g"), F.col("c_acctbal").alias("low"), (F.col("c_acctbal") + 100).alias("high"))
    return M.range_join(o, c, ["g"], "x", "low", "high", 500.0).groupBy("c_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


def orders_full_outer(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("orders"))
    c = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("key"), F.lit(1).alias("c"))
    return o.join(c, "key", "full_outer").groupBy(F.when(F.col("c").isNull(), "only_orders").when(F.col("orders").isNull(), "only_customer").otherwise("both").alias("side")).agg(F.count("*").alias("n"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"))


def set_path_diff(spark, d):
    """Pairs of part and supplier in common, missing and unexpected between the odd and the even line items of orders."""
    a = table(spark, d, "lineitem").where("l_linenumber % 2 = 1").select("l_partkey", "l_suppkey").distinct()
    b = table(spark, d, "lineitem").where("l_linenumber % 2 = 0").select("l_partkey", "l_suppkey").distinct()
    part = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return part(a.intersect(b), "common").unionByName(part(a.exceptAll(b), "missing")).unionByName(part(b.exceptAll(a), "unexpected"))


def cust_unique_match(spark, d):
    """Suppliers whose nation and rounded balance belong to one customer only."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).cast("bigint").alias("band"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).cast("bigint").alias("band"))
    return s.join(M.only_one(c, ["nation", "band"]), ["nation", "band"]).select("s_suppkey", "c_custkey")


def part_fuzzy_numbers(spark, d):
    """Parts of one brand and type whose sizes are one digit apart, counted from how often each size occurs; parts of one
    key are no pair."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("s")).na.drop()
    key = ["p_brand", "p_type", "p_partkey"]
    again = p.join(p.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), key, "left_semi")
    all_, same = M.one_apart(p, key[:2], "s"), M.one_apart(again, key, "s")
    return all_.select("p_brand", "pairs").unionByName(same.select("p_brand", (-F.col("pairs")).alias("pairs"))).groupBy("p_brand").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def tree_frontier(spark, d):
    """Highest nodes of the tree region / nation / customer without large orders, and how many customers lie below them."""
    o = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(1))
    c = table(spark, d, "customer").join(o, "c_custkey", "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "n_nationkey", "c_custkey", "has")
    up = c.withColumn("nation_has", F.max("has").over(Window.partitionBy("n_nationkey"))).withColumn("region_has", F.max("has").over(Window.partitionBy("n_regionkey")))
    level = F.when(F.col("region_has").isNull(), "region").when(F.col("nation_has").isNull(), "nation").when(F.col("has").isNull(), "customer")
    return up.where(level.isNotNull()).groupBy(level.alias("level")).agg(F.count("*").alias("customers"))


def status_rollup(spark, d):
    """Orders by status, zero for statuses that none has."""
    all_ = spark.createDataFrame([(x,) for x in "FOPX"], "status string")
    n = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return all_.join(n, "status", "left").na.fill(0, ["n"]).na.fill(0.0, ["total"])


def segment_precision(spark, d):
    """Precision and recall of 'large order' as a sign of urgency, 0 on an empty denominator."""
    o = table(spark, d, "orders").select((F.col("o_totalprice") > 200000).alias("said"), (F.col("o_orderpriority") == "1-URGENT").alias("is"))
    tp = F.count_if(F.col("said") & F.col("is"))
    return o.agg(F.round(F.coalesce(tp / F.nullif(F.count_if("said"), F.lit(0)), F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(tp / F.nullif(F.count_if("is"), F.lit(0)), F.lit(0.0)), 6).alias("recall"))


def line_prefix_match(spark, d):
    """Plies before two neighbouring orders' line items first differ in their return flag."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    y = x.select((F.col("l_orderkey") + 1).alias("l_orderkey"), "l_linenumber", F.col("l_returnflag").alias("other"))
    both = x.join(y, ["l_orderkey", "l_linenumber"], "left")
    g = both.groupBy("l_orderkey").agg(F.min(F.when(~F.col("l_returnflag").eqNullSafe(F.col("other")), F.col("l_linenumber"))).alias("first_off"), F.count("*").alias("n"))
    return g.select("l_orderkey", F.coalesce(F.col("first_off") - 1, F.col("n").cast("int")).alias("prefix"), F.col("first_off").isNull().alias("exact"))


def ship_gaps(spark, d):
    """Line numbers of an order that skip a place."""
    return S.gaps(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"], "l_linenumber").agg(F.count("*").alias("gaps"), F.coalesce(F.sum("jump"), F.lit(0)).cast("bigint").alias("skipped"))


def top_parts(spark, d):
    """The three parts of each brand that sold most."""
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_partkey", "qty")
    return M.top_k(s, ["p_brand"], [F.desc("qty"), F.col("p_partkey")], 3)


def row_islands(spark, d):
    """Runs of equal return flags within an order."""
    return S.islands(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_returnflag").groupBy("l_orderkey").agg(F.max("island").alias("runs"))


QUERIES = {f.__name__: f for f in (event_idle_sessions, event_depth_clamped, event_next_anchor, event_carry, event_longest_run, event_props_json, emb_nearest_margin, orders_range_join, orders_full_outer, set_path_diff, cust_unique_match, part_fuzzy_numbers, tree_frontier, status_rollup, segment_precision, line_prefix_match, ship_gaps, top_parts, row_islands)}

SQL = {
    "event_idle_sessions": "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 21600000000 THEN 1 ELSE 0 END AS g FROM e), s AS (SELECT *, CAST(sum(g) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS events, CAST(trunc((max(t) - min(t)) / 1000000.0) AS BIGINT) AS seconds FROM s GROUP BY 1, 2",
    "event_depth_clamped": "WITH s AS (SELECT user_id, event_id, ts, sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events), m AS (SELECT user_id, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS depth FROM s) SELECT user_id, CAST(max(depth) AS BIGINT) AS deepest, count(*) FILTER (depth = 0) AS at_zero FROM m GROUP BY user_id",
    "event_next_anchor": "WITH n AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS a FROM events) SELECT user_id, count(a) AS followed, min(a) AS first_anchor FROM n GROUP BY user_id",
    "event_carry": "WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events), c AS (SELECT user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM e) SELECT user_id, count(l) AS n, round(sum(l), 4) AS total FROM c GROUP BY user_id",
    "event_longest_run": "WITH f AS (SELECT user_id, event_id, event_type <> 'purchase' AS f FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, f ORDER BY event_id) AS g FROM f), r AS (SELECT user_id, f, g, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT user_id, coalesce(max(n) FILTER (f), 0) AS longest FROM r GROUP BY user_id",
    "event_props_json": "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "emb_nearest_margin": "WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2), f AS (SELECT vec_id, m.label, sum((CAST(x AS DOUBLE) - m) * (CAST(x AS DOUBLE) - m)) AS d FROM e JOIN m USING (i) WHERE vec_id % 100 = 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS nx FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY d)) SELECT vec_id, label, round(d, 5) AS d FROM r WHERE k = 1 AND (nx IS NULL OR nx - d >= 0.001)",
    "orders_range_join": "SELECT c_custkey, count(*) AS n, min(o_orderkey) AS first_order FROM orders JOIN customer ON o_totalprice BETWEEN c_acctbal AND c_acctbal + 100 WHERE c_acctbal > 0 GROUP BY c_custkey",
    "orders_full_outer": "WITH o AS (SELECT o_custkey AS key, count(*) AS orders FROM orders GROUP BY 1), c AS (SELECT c_custkey AS key, 1 AS c FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT CASE WHEN c IS NULL THEN 'only_orders' WHEN orders IS NULL THEN 'only_customer' ELSE 'both' END AS side, count(*) AS n, CAST(coalesce(sum(orders), 0) AS BIGINT) AS orders FROM o FULL JOIN c ON o.key = c.key GROUP BY 1",
    "set_path_diff": "WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 1), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 0) SELECT 'common' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'missing', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'unexpected', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "cust_unique_match": "WITH c AS (SELECT c_custkey, c_nationkey AS nation, CAST(floor(c_acctbal / 100) AS BIGINT) AS band, count(*) OVER (PARTITION BY c_nationkey, floor(c_acctbal / 100)) AS n FROM customer) SELECT s_suppkey, c_custkey FROM supplier JOIN c ON s_nationkey = nation AND CAST(floor(s_acctbal / 100) AS BIGINT) = band WHERE n = 1",
    "part_fuzzy_numbers": "SELECT a.p_brand, count(*) AS pairs FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE levenshtein(CAST(a.p_size AS VARCHAR), CAST(b.p_size AS VARCHAR)) = 1 GROUP BY 1",
    "tree_frontier": "WITH c AS (SELECT n_regionkey, n_nationkey, c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS has FROM customer JOIN nation ON c_nationkey = n_nationkey), u AS (SELECT *, bool_or(has) OVER (PARTITION BY n_nationkey) AS nh, bool_or(has) OVER (PARTITION BY n_regionkey) AS rh FROM c) SELECT CASE WHEN NOT rh THEN 'region' WHEN NOT nh THEN 'nation' ELSE 'customer' END AS level, count(*) AS customers FROM u WHERE NOT has GROUP BY 1",
    "status_rollup": "SELECT s.status, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY 1",
    "segment_precision": "WITH o AS (SELECT o_totalprice > 200000 AS said, o_orderpriority = '1-URGENT' AS is_ FROM orders) SELECT round(coalesce(count(*) FILTER (said AND is_) / nullif(count(*) FILTER (said), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (said AND is_) / nullif(count(*) FILTER (is_), 0), 0), 6) AS recall FROM o",
    "line_prefix_match": "WITH b AS (SELECT x.l_orderkey, x.l_linenumber, x.l_returnflag IS NOT DISTINCT FROM y.l_returnflag AS same FROM lineitem x LEFT JOIN lineitem y ON y.l_orderkey + 1 = x.l_orderkey AND y.l_linenumber = x.l_linenumber), g AS (SELECT l_orderkey, min(CASE WHEN NOT same THEN l_linenumber END) AS f, count(*) AS n FROM b GROUP BY 1) SELECT l_orderkey, CAST(coalesce(f - 1, n) AS INT) AS prefix, f IS NULL AS exact FROM g",
    "ship_gaps": "WITH g AS (SELECT l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS j FROM lineitem) SELECT count(*) AS gaps, CAST(coalesce(sum(j), 0) AS BIGINT) AS skipped FROM g WHERE j <> 0",
    "top_parts": "WITH s AS (SELECT p_brand, p_partkey, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT p_brand, p_partkey, qty, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY qty DESC, p_partkey) AS INT) AS rank FROM s QUALIFY rank <= 3",
    "row_islands": "WITH n AS (SELECT l_orderkey, CASE WHEN l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS f FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) SELECT l_orderkey, CAST(sum(f) AS BIGINT) AS runs FROM n GROUP BY 1",
}
