"""Evaluation, reports, matching, boards and sequences run as they stand on the star schema, with the same in SQL.

Orders play games: their lines in order are moves, the fifth line and those after it a side line beside the fourth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import boards as B
from ..operators import evaluation as E
from ..operators import matching as M
from ..operators import nested
from ..operators import pages as P
from ..operators import readings as RD
from ..operators import report as R
from ..operators import sequences as S
from ..session import table
from ..streaming import incremental as I
from . import records as stored

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """(o, n, uci, tok, page, line, l_*): the lines of each order, numbered."""
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    t = table(spark, d, "lineitem").withColumn("n", F.row_number().over(w))
    return t.withColumn("o", F.col("l_orderkey")).withColumn("uci", F.concat(F.lit("m"), F.col("l_suppkey") % 5)).withColumn("tok", F.col("n").cast("bigint"))


def _moves(lines: DataFrame, damaged: bool = False) -> DataFrame:
    """(o, path, uci, comment, starting_comment, nags, tok): ``damaged`` changes the moves of large quantities."""
    n = F.col("n")
    path = F.when(n <= 4, F.array_repeat(F.lit(0), n)).otherwise(F.concat(F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(1)), F.array_repeat(F.lit(0), n - 5)))
    uci = F.when(F.col("l_quantity") > 45, "x").otherwise(F.col("uci")) if damaged else F.col("uci")
    none = F.lit(None).cast("string")
    return lines.select("o", path.alias("path"), uci.alias("uci"), none.alias("comment"), none.alias("starting_comment"), F.array(F.lit(1)).alias("nags"), "tok", F.col("o").alias("game_id"), "l_returnflag")


def _games(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("start_fen"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("incomplete").alias("status"), F.create_map(F.lit("BookGame"), F.col("o_custkey").cast("string")).alias("headers"))


def _paths(spark: SparkSession, d: str, damaged: bool = False) -> DataFrame:
    return E.move_paths(_moves(_lines(spark, d), damaged), _games(spark, d), ["o"])


def order_paths(spark, d):
    """The whole history of each node of an order's tree."""
    return _paths(spark, d).groupBy(F.array_join("history", " ").alias("history")).agg(F.count("*").alias("nodes"), F.countDistinct("o").alias("games"))


def order_precision(spark, d):
    return E.precision_recall(_paths(spark, d, True), _paths(spark, d), ["start_fen", "history"]).select("predicted", "expected", "matched", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def order_prefix(spark, d):
    """Plies up to the first difference of two main lines."""
    x = _lines(spark, d)
    return E.prefix_match(E.mainlines(_moves(x, True), ["o"]), E.mainlines(_moves(x), ["o"]), ["o"])


def order_missing(spark, d):
    missing, extra = E.tree_differences(_paths(spark, d, True), _paths(spark, d), ["o"])
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n(missing, "missing").unionByName(n(extra, "unexpected"))


def order_frontiers(spark, d):
    """The highest missing nodes of each order with the nodes they take along."""
    missing, _ = E.tree_differences(_paths(spark, d, True), _paths(spark, d), ["o"])
    return E.frontiers(missing, ["o"]).select("o", F.array_join("frontier", " ").alias("frontier"), "affected")


def order_signatures(spark, d):
    """How many orders share one start and tree."""
    sig = E.signature(_moves(_lines(spark, d)), _games(spark, d), ["o"])
    return sig.groupBy("signature").agg(F.count("*").alias("orders")).groupBy("orders").agg(F.count("*").alias("trees"))


def order_same_sequence(spark, d):
    """Whether the parts that two orders next to each other have in common stand in the same order."""
    parts = _lines(spark, d).groupBy("o").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "l_suppkey"))), lambda e: e["l_suppkey"] % 10).alias("a")).select("o", F.array_distinct("a").alias("a"))
    both = parts.join(parts.select((F.col("o") - 1).alias("o"), F.col("a").alias("e")), "o")
    return both.groupBy(E.ordered_common(F.col("a"), F.col("e")).alias("same")).agg(F.count("*").alias("n"))


def event_first(spark, d):
    """The first event of each user and type, in the order of events."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return E.first_of(e, ["user_id", "event_type"], ["event_id"])


def order_rollup(spark, d):
    g = R.game_rollup(_games(spark, d).select("o"), _moves(_lines(spark, d)), ["o"])
    return g.select("o", "mainline_plies", "total_plies", "variations")


def part_pages(spark, d):
    """Parts as pages of their brand: characters and line items of each, those without any kept."""
    pages = table(spark, d, "part").select(F.col("p_brand").alias("book_id"), F.col("p_partkey").alias("page"), F.col("p_name").alias("text"))
    moves = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("book_id"), F.col("l_partkey").alias("page"))
    return R.page_rollup(pages, moves)


def word_evidence(spark, d):
    """Evidence of all records, payloads too, per kind."""
    keep = {"kind", "changed", "reading", "style", "symbol"}
    raw, kind = stored.words(spark, d, keep)
    flat = nested.shared_inline(nested.word_records(raw, kind), "word_id", "words", stored.NUMBERS)["records"]
    return R.evidence_rollup(flat, [])


def _issues(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("cust"), F.substring("o_orderpriority", 3, 20).alias("code"), F.when(F.col("o_orderstatus") == "F", "info").otherwise("warning").alias("severity"), F.lit(2).cast("bigint").alias("tok"), F.lit(3).cast("bigint").alias("last"))


def cust_issues(spark, d):
    """Issues of each customer by code, and whether any is more than information."""
    return R.issue_counts(_issues(spark, d), ["cust"]).select("cust", F.to_json("issue_counts").alias("issue_counts"), "status")


def issue_sources(spark, d):
    """Issues with the source lines of the tokens they span."""
    t = _lines(spark, d).select("o", "tok", F.col("l_partkey").alias("page"), F.col("l_suppkey").alias("line"))
    found = R.with_source_lines(_issues(spark, d).select("o", "code", "tok", "last"), t, ["o"], "tok", "last")
    return found.select("o", "code", F.array_join(F.transform("source", lambda s: F.concat_ws("/", s["src_page"], s["src_line"])), " ").alias("source"))


def cust_missing(spark, d):
    """Numbers of headings (customers, counted from 500) for which no order, as game, was found."""
    heads = table(spark, d, "customer").select(F.lit(1).alias("book"), (F.col("c_custkey") + 500).alias("number"))
    return R.missing_sections(heads, _games(spark, d).withColumn("book", F.lit(1)), ["book"]).select("number")


def order_unread(spark, d):
    """Line items between the first and last played one of their order that were not played."""
    x = _lines(spark, d)
    played = _moves(x).where("l_returnflag = 'N'")
    tokens = x.select("o", "tok", F.lit("word").alias("kind"), "uci")
    return R.unread_moves(tokens, played, _games(spark, d), ["o"], F.when(F.col("uci") != "m0", F.col("uci"))).groupBy("o").agg(F.count("*").alias("unread"))


def order_summary(spark, d):
    return R.summary(_games(spark, d), _moves(_lines(spark, d)), _issues(spark, d))


def brand_fingerprint(spark, d):
    parts = table(spark, d, "part").select("p_brand", F.concat_ws("#", "p_name", "p_partkey").alias("name"), F.col("p_type").alias("hash"))
    return R.fingerprint(parts, ["p_brand"])


def order_status_counts(spark, d):
    jobs = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "needs_review").alias("status"))
    return R.status_counts(jobs.where("status is not null"))


def order_batch(spark, d):
    """Orders as jobs of a batch: those done before with the same inputs are reused."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("relpath"), F.col("o_custkey").cast("string").alias("source_sha256"), F.lit("p").alias("pipeline"), F.col("o_orderpriority").alias("options"), F.col("o_orderstatus").alias("s"))
    jobs = o.withColumn("output_sha256", F.col("source_sha256")).withColumn("report_sha256", F.when(F.col("s") != "P", "r"))
    done = jobs.withColumn("status", F.when(F.col("s") == "O", "failed").otherwise("completed")).withColumn("options", F.when(F.col("options") == "1-URGENT", "old").otherwise(F.col("options")))
    reused, todo = R.batch_plan(jobs, done)
    return reused.select(F.lit("reused").alias("plan"), "s").unionByName(todo.select(F.lit("todo").alias("plan"), "s")).groupBy("plan", "s").agg(F.count("*").alias("n"))


# ---- matching ----


def cust_nearest(spark, d):
    """Each customer with the supplier's balance of its nation that is nearest to its own."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("at"))
    return M.nearest(c, s, ["nation"], "x", "at").select("c_custkey", "nearest_at")


def char_boxes(spark, d):
    """Characters of stored records with the record they lie in, where no other character claims it."""
    t = table(spark, d, "bold_source_words").select("word_id", "records").where("records is not null").dropDuplicates(["word_id"])
    box = lambda b: F.when(F.size(b) == 4, F.struct(b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1")))
    r = t.select("word_id", F.posexplode("records").alias("p", "r")).where("r is not null")
    words = r.select(F.col("word_id").alias("page"), (F.col("p") + 1).alias("word_id"), box(F.col("r.bbox")).alias("w")).where("w is not null")
    chars = r.select(F.col("word_id").alias("page"), F.col("p"), F.posexplode("r.characters").alias("q", "c")).where("c is not null")
    glyphs = chars.select("page", (F.col("p") * 1000 + F.col("q")).alias("glyph_id"), box(F.col("c.bbox")).alias("g")).where("g is not null")
    return M.best_boxes(glyphs, words, ["page"]).select("page", "glyph_id", "word_id", F.round("share", 6).alias("share"))


def clip_agreed(spark, d):
    """The split of each printed page on which all its clips agree."""
    t = table(spark, d, "clipped_notation").where("book is not null and file_page is not null")
    return M.agreed(t.select("book", "file_page", "split"), ["book", "file_page"], "split")


def part_mutual(spark, d):
    """Brands and suppliers that are each other's best by quantity, clear of every rival."""
    q = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", (F.col("l_suppkey") % 40).alias("s")).agg(F.sum("l_quantity").alias("q"))
    return M.mutual_best(q, "p_brand", "s", "q", 10.0, 1.0).select("p_brand", "s", "q")


def line_ordinals(spark, d):
    """Returned and accepted line items of an order paired by place where there are as many of both."""
    x = _lines(spark, d)
    side = lambda f: x.where(F.col("l_returnflag") == f).select("o", "n")
    return M.ordinal_pairs(side("A"), side("R"), ["o"], "n").select("o", "place", "n", "n_right")


def event_patterns(spark, d):
    """Sequences of event types that a user has exactly once as consecutive events."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    pat = e.select("user_id").distinct().select("user_id", F.explode(F.array(F.struct(F.lit(1).alias("pattern_id"), F.array(F.lit("click"), F.lit("purchase")).alias("words")), F.struct(F.lit(2).alias("pattern_id"), F.array(F.lit("view"), F.lit("view"), F.lit("click")).alias("words")))).alias("x")).select("user_id", "x.*")
    return M.contiguous_match(e, pat, ["user_id"], "event_id", "event_type")


def event_between(spark, d):
    """Events without value of their own kind with the purchases around them, summed per user."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("anchor"))
    return M.gap_fill(e, ["user_id"], "event_id", "anchor").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("anchor_before").alias("before"), F.sum("anchor_after").alias("after"))


def order_compare(spark, d):
    """Orders of two customer groups as games of one book: paired by their number where unique, else by file order."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("book"), F.col("o_totalprice").cast("bigint").alias("no"), F.col("o_orderkey").alias("k"), "o_orderstatus")
    side = lambda s: o.where(F.col("o_orderstatus") == s).select("book", F.when(F.col("k") % 3 > 0, (F.col("no") % 300)).alias("no"), "k")
    both = M.full_compare(side("O"), side("F"), "no", "k", ["book"])
    return both.select("book", F.col("actual.k").alias("a"), F.col("expected.k").alias("e"))


def part_replaced(spark, d):
    """Parts of the second half of brands stand for those of the same type and size of the first."""
    p = table(spark, d, "part").select("p_type", "p_size", "p_partkey", "p_brand")
    return M.replaced(p.where("p_brand < 'Brand#3'"), p.where("p_brand >= 'Brand#3'"), ["p_type", "p_size"]).groupBy("p_type", "p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def cust_triples(spark, d):
    w = M.triples(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice")
    return w.where("before < o_totalprice and after < o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("peaks"))


def read_improved(spark, d):
    """Whether a second reading of a nation's orders is better and keeps all headings."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("c_custkey").agg(F.count_if(F.col("o_totalprice") > 300000).alias("orphans"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("mixed"), F.count_if(F.col("o_totalprice") < 100000).alias("backtracks"), F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("headings"))
    return RD.improved(side("F"), side("O"), ["c_custkey"])


def line_restored(spark, d):
    """Line items as boxes of a stacked page put back by the one region they lie in."""
    x = _lines(spark, d)
    y = (F.col("l_partkey") % 100).cast("double")
    boxes = x.select("o", "n", F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(5.0).alias("x1"), (y + 10).alias("y1"))
    regions = x.select("o").distinct().select("o", F.explode(F.array(F.struct(F.lit(0.0).alias("top"), F.lit(40.0).alias("bottom"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")), F.struct(F.lit(40.0).alias("top"), F.lit(90.0).alias("bottom"), F.lit(100.0).alias("dx"), F.lit(-40.0).alias("dy")))).alias("r")).select("o", "r.*")
    return RD.restored(boxes, regions, ["o"]).select("o", "n", "x0", "y0", "x1", "y1")


def line_texts(spark, d):
    """Line items as words of printed lines, wide gaps read as dashes."""
    x0 = F.col("l_partkey") + F.col("n") / 64
    w = _lines(spark, d).select("o", F.col("l_returnflag").alias("line"), x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("y1"), F.col("uci").alias("text"), F.lit(2000.0).alias("width"))
    return P.lines_text(w, ["o"]).select("o", "line", "text", "x0", "x1")


def line_source_readings(spark, d):
    """Ranks of long pawn moves that the first reading left open, from the row of the source with the same other move."""
    x = _lines(spark, d)
    file = F.substring(F.lit("abcdefgh"), (F.col("l_suppkey") % 8 + 1).cast("int"), F.lit(1))
    move = lambda rank: F.concat(file, F.lit("7-"), file, rank)
    open_ = F.when(F.col("l_partkey") % 2 == 0, "b").otherwise("d")
    peer = F.when(F.col("l_suppkey") % 3 == 0, "e2-e4").otherwise("d2-d4")
    targets = x.where("l_returnflag = 'A'").select(F.col("o").alias("book"), F.lit(1).alias("page"), F.col("n").cast("double").alias("ord"), F.col("l_linenumber").alias("number"), F.lit(1).alias("side"), move(open_).alias("word"), peer.alias("peer"), F.array(move(F.when(F.col("l_quantity") > 25, "5").otherwise(open_))).alias("readings"))
    source = x.where("l_returnflag = 'R'").select(F.col("o").alias("book"), F.lit(1).alias("page"), F.col("n").cast("double").alias("ord"), F.col("l_linenumber").alias("number"), F.array(peer, move((F.col("l_partkey") % 3 + 4).cast("string"))).alias("words"))
    return RD.source_readings(targets, source).select("book", "ord", "reading", "conflict")


def line_black_rows(spark, d):
    """Two scans of a row with Black's move only, where both are complete and equal."""
    x = _lines(spark, d)
    row = lambda piece, to: F.concat(F.col("n").cast("string"), F.lit(". ... "), piece, F.lit("g8-f"), to.cast("string"), F.when(F.col("l_tax") > 0.05, "!").otherwise(""))
    a, b = row(F.lit("♘"), F.col("l_suppkey") % 9), row(F.when(F.col("l_partkey") % 4 == 0, "KQx").otherwise("§"), F.col("l_linenumber") + 1)
    r = RD.agreed_black_row(a, b)
    return x.where(r.isNotNull()).select("o", "n", r["number"].alias("number"), r["start"].alias("start"), r["end"].alias("end"), r["marks"].alias("marks"))


def line_reading_order(spark, d):
    """Line items as lines of pages with two columns, in reading order."""
    x = _lines(spark, d)
    x0 = F.when(F.col("l_suppkey") % 5 == 0, 0.0).when(F.col("l_suppkey") % 5 < 3, 10.0).otherwise(110.0)
    x1 = F.when(F.col("l_suppkey") % 5 == 0, 200.0).when(F.col("l_suppkey") % 5 < 3, 90.0).otherwise(190.0)
    lines = x.select((F.col("o") % 500).alias("page"), (F.col("o") * 8 + F.col("n")).cast("double").alias("y0"), x0.alias("x0"), x1.alias("x1"))
    gaps = lines.select("page").distinct().where("page % 4 > 0").select("page", F.lit(100.0).alias("gap"))
    return P.reading_order(lines, gaps, ["page"]).select("page", "y0", "band", "side", "ord")


def event_stream_windows(spark, d):
    """Events per day and type, read as a stream of files and worked off until nothing is new."""
    source = f"{d}/events.parquet"
    fs = spark._jvm.org.apache.hadoop.fs.Path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = fs.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(source)).isDirectory()
    reader = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    stream = reader.parquet(source) if whole else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    counts = I.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 day", late="1 day")
    return I.finished(counts, "event_windows").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


# ---- boards and sequences ----


def cust_boards(spark, d):
    """Customers as squares of diagrams, 64 to each, some unread."""
    c = table(spark, d, "customer")
    piece = F.when(F.col("c_nationkey") == 24, None).when(F.col("c_nationkey") > 11, "").otherwise(F.substring(F.lit("PNBRQKpnbrqk"), F.col("c_nationkey") + 1, F.lit(1)))
    piece = F.when(F.floor(F.col("c_custkey") / 64) % 2 == 0, F.coalesce(piece, F.lit(""))).otherwise(piece)
    cells = c.select(F.floor(F.col("c_custkey") / 64).cast("bigint").alias("diagram"), (F.col("c_custkey") % 64).cast("int").alias("square"), piece.alias("piece"))
    return B.assembled(cells, ["diagram"])


def cust_checkered(spark, d):
    c = table(spark, d, "customer")
    square = (F.col("c_custkey") % 64).cast("int")
    dark = (F.floor(square / 8) + square % 8) % 2 == 1
    ink = F.when(dark & (F.floor(F.col("c_custkey") / 64) % 2 == 0), 0.3).otherwise(F.abs(F.col("c_acctbal")) / 100000)
    return B.checkered(c.select(F.floor(F.col("c_custkey") / 64).cast("bigint").alias("diagram"), square.alias("square"), ink.alias("ink")), ["diagram"])


def order_open_fields(spark, d):
    """Fields in which the possible set-ups of a customer differ."""
    fen = F.concat_ws(" ", F.lit("8/8"), F.when(F.col("o_orderstatus") == "F", "w").otherwise("b"), F.when(F.col("o_totalprice") > 400000, "K").otherwise("-"), F.lit("-"))
    return B.open_fields(table(spark, d, "orders").select("o_custkey", fen.alias("fen")), ["o_custkey"]).select("o_custkey", "fen", "candidates", F.array_join("open", " ").alias("open"))


def event_interpolated(spark, d):
    """Event values against the mean of their neighbours, summed per user."""
    e = S.interpolated(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value")
    return e.groupBy("user_id").agg(F.round(F.sum("between"), 4).alias("between"), F.count("between").alias("n"))


def event_sampled(spark, d):
    """The middle event of each third of a user's events."""
    return S.sampled(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])


def order_backtracks(spark, d):
    """How often a customer's order falls more than one below the size class of the one before."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 50000).cast("int").alias("number"))
    return S.backtracks(o, ["o_custkey"], ["o_orderkey"], "number")


def event_ahead(spark, d):
    """What the three events after each purchase are."""
    e = S.ahead(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type", 3)
    return e.where("event_type = 'purchase'").groupBy(F.array_join("ahead", " ").alias("next_events")).agg(F.count("*").alias("n"))


def event_behind(spark, d):
    e = S.behind(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type", 2)
    return e.where("event_type = 'error'").groupBy(F.array_join("behind", " ").alias("before_events")).agg(F.count("*").alias("n"))


def event_islands(spark, d):
    e = S.islands(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")
    return e.groupBy("user_id").agg(F.max("island").alias("islands"))


_L = "l AS (SELECT *, l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(_ORDER) + ") AS n, 'm' || (l_suppkey % 5) AS uci FROM lineitem)"
_ON_PATH = "a.o = b.o AND ((a.n <= 4 AND b.n <= a.n) OR (a.n >= 5 AND (b.n <= 3 OR (b.n >= 5 AND b.n <= a.n))))"
_H = (
    "hist AS (SELECT a.o, a.n, any_value(g.o_orderpriority) AS fen, string_agg(b.uci, ' ' ORDER BY b.n) AS h, string_agg(CASE WHEN b.l_quantity > 45 THEN 'x' ELSE b.uci END, ' ' ORDER BY b.n) AS bad "
    f"FROM l a JOIN l b ON {_ON_PATH} JOIN orders g ON g.o_orderkey = a.o GROUP BY a.o, a.n)"
)
_ISSUES = "i AS (SELECT o_orderkey AS o, o_custkey AS cust, substr(o_orderpriority, 3, 20) AS code, CASE WHEN o_orderstatus = 'F' THEN 'info' ELSE 'warning' END AS severity FROM orders)"
_EV = "(PARTITION BY user_id ORDER BY event_id"
_BEST = "SELECT {a}, {b}, q FROM (SELECT *, row_number() OVER (PARTITION BY {a} ORDER BY q DESC) AS k, lead(q) OVER (PARTITION BY {a} ORDER BY q DESC) AS nx FROM f) WHERE k = 1 AND q >= 10 AND (nx IS NULL OR q - nx >= 1)"
_CELLS = (
    "c AS (SELECT c_custkey // 64 AS diagram, CAST(c_custkey % 64 AS INT) AS square, c_acctbal, CASE WHEN c_nationkey = 24 THEN CASE WHEN (c_custkey // 64) % 2 = 0 THEN '' END WHEN c_nationkey > 11 THEN '' ELSE substr('PNBRQKpnbrqk', c_nationkey + 1, 1) END AS piece FROM customer)"
)
_NUMBERED = "s AS (SELECT c_custkey, o_orderstatus AS s, count(*) FILTER (o_totalprice > 300000) AS orphans, count(*) FILTER (o_orderpriority = '1-URGENT') AS mixed, count(*) FILTER (o_totalprice < 100000) AS backtracks, list(DISTINCT substr(o_orderpriority, 1, 1)) AS headings FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _fen_rank() -> str:
    """Runs of empty squares as their number, longest first."""
    text = "string_agg(CASE WHEN piece = '' THEN '1' ELSE piece END, '' ORDER BY square)"
    for n in range(8, 1, -1):
        text = f"replace({text}, '{'1' * n}', '{n}')"
    return text


SQL = {
    "order_paths": f"WITH {_L}, {_H} SELECT h AS history, count(*) AS nodes, count(DISTINCT o) AS games FROM hist GROUP BY h",
    "order_precision": f"WITH {_L}, {_H}, p AS (SELECT DISTINCT fen, bad AS h FROM hist), e AS (SELECT DISTINCT fen, h FROM hist), m AS (SELECT count(*) AS matched FROM p JOIN e USING (fen, h)) SELECT (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM e) AS expected, matched, round(matched / (SELECT count(*) FROM p), 9) AS precision, round(matched / (SELECT count(*) FROM e), 9) AS recall FROM m",
    "order_prefix": f"WITH {_L}, m AS (SELECT o, min(CASE WHEN l_quantity > 45 THEN n END) AS off, count(*) AS expected FROM l WHERE n <= 4 GROUP BY o) SELECT o, CAST(coalesce(off - 1, expected) AS BIGINT) AS matched, expected, off IS NULL AS exact FROM m",
    "order_missing": f"WITH {_L}, {_H}, m AS (SELECT count(*) AS n FROM hist e WHERE NOT EXISTS (SELECT 1 FROM hist a WHERE a.o = e.o AND a.bad = e.h)), u AS (SELECT count(*) AS n FROM hist a WHERE NOT EXISTS (SELECT 1 FROM hist e WHERE e.o = a.o AND e.h = a.bad)) SELECT 'missing' AS part, n FROM m UNION ALL SELECT 'unexpected', n FROM u",
    "order_frontiers": f"WITH {_L}, {_H}, m AS (SELECT DISTINCT o, h FROM hist e WHERE NOT EXISTS (SELECT 1 FROM hist a WHERE a.o = e.o AND a.bad = e.h)), t AS (SELECT x.o, x.h, arg_min(y.h, length(y.h)) AS frontier FROM m x JOIN m y ON x.o = y.o AND (x.h = y.h OR x.h LIKE y.h || ' %') GROUP BY x.o, x.h) SELECT o, frontier, count(*) AS affected FROM t GROUP BY o, frontier",
    "order_signatures": f"WITH {_L}, g AS (SELECT o_orderkey, any_value(o_orderpriority) || '|' || coalesce(string_agg(uci, ' ' ORDER BY n), '') AS tree FROM orders LEFT JOIN l ON o = o_orderkey GROUP BY o_orderkey), c AS (SELECT tree, count(*) AS orders FROM g GROUP BY tree) SELECT orders, count(*) AS trees FROM c GROUP BY orders",
    "order_same_sequence": f"WITH {_L}, f AS (SELECT o, l_suppkey % 10 AS s, min(n) AS n FROM l GROUP BY 1, 2), b AS (SELECT x.o, x.n AS n, y.n AS k FROM f x JOIN f y ON y.o = x.o + 1 AND y.s = x.s), r AS (SELECT o, rank() OVER (PARTITION BY o ORDER BY n) AS p, rank() OVER (PARTITION BY o ORDER BY k) AS q FROM b), s AS (SELECT o, bool_and(p = q) AS same FROM r GROUP BY o) SELECT coalesce(s.same, true) AS same, count(*) AS n FROM (SELECT DISTINCT o FROM f) x JOIN (SELECT DISTINCT o FROM f) y ON y.o = x.o + 1 LEFT JOIN s ON s.o = x.o GROUP BY 1",
    "event_first": "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2",
    "order_rollup": f"WITH {_L} SELECT o_orderkey AS o, count(n) FILTER (n <= 4) AS mainline_plies, count(n) AS total_plies, count(n) FILTER (n = 5) AS variations FROM orders LEFT JOIN l ON o = o_orderkey GROUP BY 1",
    "part_pages": "SELECT p_brand AS book_id, p_partkey AS page, CAST(length(any_value(p_name)) AS INT) AS characters, count(l_partkey) AS moves FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2",
    "word_evidence": f"WITH {stored._ONCE}, {stored._STORED}, {stored._PAYLOAD}, r AS ({stored._RECORDS}) SELECT CASE WHEN kind IS NOT NULL THEN kind WHEN symbol IS NOT NULL THEN 'figurine' END AS kind, count(*) AS recognized, count(*) FILTER (changed) AS changed, count(*) FILTER (reading = 'whole_word') AS whole_word, count(*) FILTER (reading = 'number_only') AS number_only, count(*) FILTER (style = 'regular') AS regular FROM r GROUP BY 1",
    "cust_issues": f"WITH {_ISSUES}, n AS (SELECT cust, code, count(*) AS n, bool_or(severity <> 'info') AS bad FROM i GROUP BY 1, 2) SELECT cust, '{{' || string_agg('\"' || code || '\":' || n, ',' ORDER BY code) || '}}' AS issue_counts, CASE WHEN bool_or(bad) THEN 'needs_review' ELSE 'completed' END AS status FROM n GROUP BY cust",
    "issue_sources": f"WITH {_L}, {_ISSUES}, s AS (SELECT DISTINCT i.o, i.code, l_partkey, l_suppkey FROM i JOIN l ON l.o = i.o AND l.n BETWEEN 2 AND 3) SELECT o, code, string_agg(l_partkey || '/' || l_suppkey, ' ' ORDER BY l_partkey, l_suppkey) AS source FROM s GROUP BY 1, 2",
    "cust_missing": "SELECT c_custkey + 500 AS number FROM customer WHERE c_custkey + 500 NOT IN (SELECT o_custkey FROM orders)",
    "order_unread": f"WITH {_L}, s AS (SELECT o, min(n) AS a, max(n) AS b FROM l WHERE l_returnflag = 'N' GROUP BY o) SELECT l.o, count(*) AS unread FROM l JOIN s ON s.o = l.o AND n BETWEEN a AND b WHERE l_returnflag <> 'N' AND uci <> 'm0' GROUP BY l.o",
    "order_summary": f"WITH {_L} SELECT (SELECT count(*) FROM orders) AS games, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS incomplete_games, (SELECT count(*) FROM l WHERE n <= 4) AS mainline_plies, (SELECT count(*) FROM l) AS total_plies, (SELECT count(*) FROM orders) AS issues, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS warnings",
    "brand_fingerprint": "SELECT p_brand, sha256(string_agg(p_name || '#' || p_partkey || '=' || p_type, chr(10) ORDER BY p_name || '#' || p_partkey, p_type)) AS fingerprint FROM part GROUP BY p_brand",
    "order_status_counts": "SELECT s.status, count(o.o_orderkey) AS n FROM (VALUES ('completed', 'F'), ('needs_review', 'O'), ('failed', '?')) s(status, f) LEFT JOIN orders o ON o.o_orderstatus = s.f GROUP BY 1",
    "order_batch": "SELECT CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN 'reused' ELSE 'todo' END AS plan, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2",
    "cust_nearest": "SELECT c_custkey, arg_min(s_acctbal, (abs(s_acctbal - c_acctbal), s_acctbal)) AS nearest_at FROM customer JOIN supplier ON s_nationkey = c_nationkey GROUP BY c_custkey",
    "char_boxes": (
        f"WITH {stored._ONCE}, {stored._STORED}, k AS (SELECT word_id AS page, record_no AS word_id, r.bbox AS w FROM s WHERE r IS NOT NULL AND len(r.bbox) = 4), g0 AS (SELECT word_id AS page, record_no, generate_subscripts(r.characters, 1) AS q, unnest(r.characters) AS c FROM s WHERE r IS NOT NULL), "
        "g AS (SELECT page, (record_no - 1) * 1000 + q - 1 AS glyph_id, c.bbox AS g FROM g0 WHERE c IS NOT NULL AND len(c.bbox) = 4), "
        "p AS (SELECT g.page, glyph_id, word_id, greatest(least(g[3], w[3]) - greatest(g[1], w[1]), 0.0) * greatest(least(g[4], w[4]) - greatest(g[2], w[2]), 0.0) / ((g[3] - g[1]) * (g[4] - g[2])) AS share, (w[3] - w[1]) * (w[4] - w[2]) AS area FROM g JOIN k ON k.page = g.page WHERE (g[3] - g[1]) * (g[4] - g[2]) > 0), "
        "b AS (SELECT *, row_number() OVER (PARTITION BY page, glyph_id ORDER BY share DESC, area, word_id) AS r FROM p WHERE share >= 0.45), o AS (SELECT *, count(*) OVER (PARTITION BY page, word_id) AS m FROM b WHERE r = 1) SELECT page, CAST(glyph_id AS INT) AS glyph_id, word_id, round(share, 6) AS share FROM o WHERE m = 1"
    ),
    "clip_agreed": "SELECT book, file_page, min(split) AS split FROM clipped_notation WHERE book IS NOT NULL AND file_page IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2 HAVING min(split) = max(split)",
    "part_mutual": f"WITH f AS (SELECT p_brand, l_suppkey % 40 AS s, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT x.p_brand, x.s, x.q FROM ({_BEST.format(a='p_brand', b='s')}) x JOIN ({_BEST.format(a='s', b='p_brand')}) y ON x.p_brand = y.p_brand AND x.s = y.s",
    "line_ordinals": f"WITH {_L}, f AS (SELECT o, n, l_returnflag AS r, row_number() OVER (PARTITION BY o, l_returnflag ORDER BY n) AS place, count(*) OVER (PARTITION BY o, l_returnflag) AS m FROM l) SELECT x.o, x.place, x.n, y.n AS n_right FROM f x JOIN f y ON x.o = y.o AND x.place = y.place AND x.m = y.m WHERE x.r = 'A' AND y.r = 'R'",
    "event_patterns": f"WITH e AS (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER {_EV}) AS b, lead(event_type, 2) OVER {_EV}) AS c FROM events), h AS (SELECT user_id, 1 AS pattern_id, event_id FROM e WHERE a = 'click' AND b = 'purchase' UNION ALL SELECT user_id, 2, event_id FROM e WHERE a = 'view' AND b = 'view' AND c = 'click') SELECT user_id, pattern_id, min(event_id) AS first FROM h GROUP BY 1, 2 HAVING count(*) = 1",
    "event_between": f"WITH e AS (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER {_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER {_EV} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM events) SELECT user_id, count(*) AS n, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after FROM e WHERE event_type <> 'purchase' GROUP BY user_id",
    "order_compare": (
        "WITH o AS (SELECT o_custkey % 50 AS book, CASE WHEN o_orderkey % 3 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 300 END AS no, o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('O', 'F')), c AS (SELECT *, count(*) OVER (PARTITION BY book, s, no) AS m FROM o), u AS (SELECT x.book, x.no FROM c x JOIN c y ON x.book = y.book AND x.no = y.no WHERE x.s = 'O' AND y.s = 'F' AND x.m = 1 AND y.m = 1), "
        "p AS (SELECT o.*, CASE WHEN u.no IS NOT NULL THEN 'k' || o.no ELSE 'o' || row_number() OVER (PARTITION BY o.book, o.s, u.no IS NULL ORDER BY k) END AS pair FROM o LEFT JOIN u ON u.book = o.book AND u.no = o.no) "
        "SELECT coalesce(x.book, y.book) AS book, x.k AS a, y.k AS e FROM (SELECT * FROM p WHERE s = 'O') x FULL JOIN (SELECT * FROM p WHERE s = 'F') y ON x.book = y.book AND x.pair = y.pair"
    ),
    "part_replaced": "WITH n AS (SELECT * FROM part WHERE p_brand >= 'Brand#3'), a AS (SELECT * FROM n UNION ALL SELECT * FROM part o WHERE p_brand < 'Brand#3' AND NOT EXISTS (SELECT 1 FROM n WHERE n.p_type = o.p_type AND n.p_size = o.p_size)) SELECT p_type, p_size, count(*) AS n, min(p_partkey) AS first FROM a GROUP BY 1, 2",
    "cust_triples": "WITH t AS (SELECT o_custkey, o_totalprice AS x, lag(o_totalprice) OVER w AS a, lead(o_totalprice) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, count(*) AS peaks FROM t WHERE a < x AND b < x GROUP BY 1",
    "read_improved": f"WITH {_NUMBERED} SELECT n.c_custkey, (len(list_filter(b.headings, lambda h: NOT list_contains(n.headings, h))) = 0 AND n.orphans <= b.orphans) AND (n.orphans < b.orphans OR (b.mixed >= 2 AND n.mixed < b.mixed) OR (n.mixed <= b.mixed AND n.backtracks < b.backtracks)) AS improved FROM s n JOIN s b ON n.c_custkey = b.c_custkey WHERE n.s = 'O' AND b.s = 'F'",
    "line_restored": f"WITH {_L}, b AS (SELECT o, n, CAST(l_partkey % 100 AS DOUBLE) AS y FROM l), r AS (SELECT * FROM (VALUES (0.0, 40.0, 0.0, 0.0), (40.0, 90.0, 100.0, -40.0)) v(t, e, dx, dy)), h AS (SELECT o, n, y, dx, dy, count(*) OVER (PARTITION BY o, n) AS m FROM b JOIN r ON y + 5 BETWEEN t AND e) SELECT o, n, CAST(dx AS DOUBLE) AS x0, y + dy AS y0, 5.0 + dx AS x1, y + 10 + dy AS y1 FROM h WHERE m = 1",
    "line_texts": f"WITH {_L}, w AS (SELECT o, l_returnflag AS line, l_partkey + n / 64 AS x0, l_partkey + n / 64 + l_quantity AS x1, uci FROM l), g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY o, line ORDER BY x0) AS gap FROM w) SELECT o, line, string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap > 500 THEN ' – ' ELSE ' ' END || uci, '' ORDER BY x0) AS text, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY 1, 2",
    "line_source_readings": (
        f"WITH {_L}, p AS (SELECT *, substr('abcdefgh', CAST(l_suppkey % 8 + 1 AS INT), 1) AS f, CASE WHEN l_suppkey % 3 = 0 THEN 'e' ELSE 'd' END AS peer FROM l), t AS (SELECT o, n, l_linenumber AS no, f, peer, l_partkey % 2 = 0 AS b, l_quantity > 25 AS five FROM p WHERE l_returnflag = 'A'), s AS (SELECT o, l_linenumber AS no, f, peer, CAST(l_partkey % 3 + 4 AS VARCHAR) AS rank FROM p WHERE l_returnflag = 'R'), "
        "h AS (SELECT t.*, s.f AS sf, s.rank, count(*) OVER (PARTITION BY t.o, t.n) AS m FROM t JOIN s ON s.o = t.o AND s.no = t.no AND s.peer = t.peer) SELECT o AS book, CAST(n AS DOUBLE) AS ord, sf || '7-' || sf || rank AS reading, five AND rank <> '5' AS conflict FROM h WHERE m = 1 AND sf = f AND ((b AND rank IN ('5', '6')) OR (NOT b AND rank IN ('4', '5')))"
    ),
    "line_black_rows": f"WITH {_L} SELECT o, n, CAST(n AS INT) AS number, 'g8' AS start, 'f' || (l_suppkey % 9) AS \"end\", CASE WHEN l_tax > 0.05 THEN '!' ELSE '' END AS marks FROM l WHERE l_suppkey % 9 BETWEEN 1 AND 8 AND l_linenumber + 1 = l_suppkey % 9 AND l_partkey % 4 <> 0",
    "line_reading_order": (
        f"WITH {_L}, p AS (SELECT o % 500 AS page, CAST(o * 8 + n AS DOUBLE) AS y0, l_suppkey % 5 AS k, (o % 500) % 4 > 0 AS two FROM l), s AS (SELECT page, y0, CASE WHEN k = 0 THEN 0.0 WHEN k < 3 THEN 10.0 ELSE 110.0 END AS x0, CASE WHEN NOT two OR k = 0 THEN 0 WHEN k < 3 THEN 1 ELSE 2 END AS side FROM p), "
        "i AS (SELECT *, CASE WHEN (side = 0) IS DISTINCT FROM lag(side = 0) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY page ORDER BY y0, x0)), b AS (SELECT page, y0, x0, side, CAST(sum(new) OVER (PARTITION BY page ORDER BY y0, x0) AS BIGINT) AS band FROM i), c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY page, band) < 3 THEN 0 ELSE side END AS g FROM b) "
        "SELECT page, y0, band, g AS side, CAST(row_number() OVER (PARTITION BY page ORDER BY band, g, y0, x0) AS INT) AS ord FROM c"
    ),
    "event_stream_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "cust_boards": f"WITH {_CELLS}, r AS (SELECT diagram, square // 8 AS rank, {_fen_rank()} AS t, count(piece) AS n FROM c GROUP BY 1, 2), b AS (SELECT diagram, string_agg(t, '/' ORDER BY rank) AS p, sum(n) AS n FROM r GROUP BY 1) SELECT diagram, CASE WHEN n = 64 THEN p END AS placement, CASE WHEN n = 64 THEN 'complete' ELSE 'incomplete' END AS status FROM b",
    "cust_checkered": f"WITH {_CELLS}, i AS (SELECT diagram, (square // 8 + square % 8) % 2 = 1 AS dark, CASE WHEN (square // 8 + square % 8) % 2 = 1 AND diagram % 2 = 0 THEN 0.3 ELSE abs(c_acctbal) / 100000 END AS ink FROM c) SELECT diagram, coalesce(avg(ink) FILTER (dark) - avg(ink) FILTER (NOT dark) >= 0.10 AND count(*) FILTER (dark AND ink > 0.15) >= 24, false) AS is_board FROM i GROUP BY 1",
    "order_open_fields": "WITH f AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'w' ELSE 'b' END AS t, CASE WHEN o_totalprice > 400000 THEN 'K' ELSE '-' END AS c FROM orders) SELECT o_custkey, min('8/8 ' || t || ' ' || c || ' -') AS fen, count(*) AS candidates, concat_ws(' ', CASE WHEN count(DISTINCT t) > 1 THEN 'turn' END, CASE WHEN count(DISTINCT c) > 1 THEN 'castling' END) AS open FROM f GROUP BY 1",
    "event_interpolated": f"WITH e AS (SELECT user_id, lag(value) OVER {_EV}) AS a, lead(value) OVER {_EV}) AS b FROM events) SELECT user_id, round(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b) END), 4) AS between, count(coalesce(a, b)) AS n FROM e GROUP BY 1",
    "event_sampled": f"WITH e AS (SELECT user_id, event_id, row_number() OVER {_EV}) - 1 AS i, greatest(count(*) OVER (PARTITION BY user_id) // 3, 1) AS step FROM events), k AS (SELECT *, row_number() OVER {_EV}) AS k FROM e WHERE (i - step // 2) % step = 0 AND i >= step // 2) SELECT user_id, event_id FROM k WHERE k <= 3",
    "order_backtracks": "WITH o AS (SELECT o_custkey, CAST(floor(o_totalprice / 50000) AS INT) AS n, lag(CAST(floor(o_totalprice / 50000) AS INT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) SELECT o_custkey, count(*) FILTER (n < p - 1) AS backtracks FROM o GROUP BY 1",
    "event_ahead": f"WITH e AS (SELECT event_type, concat_ws(' ', lead(event_type) OVER {_EV}), lead(event_type, 2) OVER {_EV}), lead(event_type, 3) OVER {_EV})) AS a FROM events) SELECT a AS next_events, count(*) AS n FROM e WHERE event_type = 'purchase' GROUP BY 1",
    "event_behind": f"WITH e AS (SELECT event_type, concat_ws(' ', lag(event_type, 2) OVER {_EV}), lag(event_type) OVER {_EV})) AS a FROM events) SELECT a AS before_events, count(*) AS n FROM e WHERE event_type = 'error' GROUP BY 1",
    "event_islands": f"WITH e AS (SELECT user_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER {_EV}) THEN 0 ELSE 1 END AS g FROM events) SELECT user_id, CAST(sum(g) AS BIGINT) AS islands FROM e GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
