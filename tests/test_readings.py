from conftest import rows
from pyspark.sql import functions as F

from galley.functions import moves as R
from galley.functions.chess import Position
from galley.operators import readings as Q

ROWS = "book string, page int, ord int, number int, words array<string>"


def table(spark, data):
    return spark.createDataFrame([("b", 1, i, n, w.split()) for i, (n, w) in enumerate(data)], ROWS)


A = [(11, "e2-e4 e7-e5"), (12, "Nf3-d4 Nc6-a5"), (13, "Bf1-b5 a7-a6"), (14, "Bb5-a4 Ng8-f6")]


def test_number_consensus(spark):
    second = table(spark, A)
    bad = [(18 if n == 13 else n, w) for n, w in A]
    assert rows(Q.number_consensus(table(spark, bad), second)) == [("b", 1, 2, 18, 13)]
    assert Q.number_consensus(second, second).count() == 0
    far = [(77 if n == 13 else n, w) for n, w in A]
    assert Q.number_consensus(table(spark, far), second).count() == 0  # two digits off
    other = [(n, "h2-h4 h7-h5") if n == 18 else (n, w) for n, w in bad]
    assert Q.number_consensus(table(spark, other), second).count() == 0  # another text
    twice = table(spark, A).unionByName(table(spark, A).withColumn("ord", F.col("ord") + 10))
    assert Q.number_consensus(table(spark, bad), twice).count() == 0  # not unique


def test_source_numbers(spark):
    half = [(11, "e2-e4"), (12, "Nf3-d4"), (12, "Nc6-a5")]
    bad = [(11, "e2-e4"), (2, "Nf3-d4"), (12, "Nc6-a5")]
    assert rows(Q.source_numbers(table(spark, bad), table(spark, half))) == [("b", 1, 1, 2, 12)]
    assert Q.source_numbers(table(spark, [(11, "e2-e4"), (2, "h2-h4"), (12, "Nc6-a5")]), table(spark, half)).count() == 0


def test_row_pairs_and_gaps(spark):
    first, second = table(spark, [A[0], A[2]]), table(spark, A)
    pairs = Q.row_pairs(first, second)
    assert rows(pairs, "ord", "other") == [(0, 0), (1, 2)]
    fill = Q.between_anchors(first, second, pairs)
    assert rows(fill, "number", "anchor_before", "anchor_after") == [(12, 0, 1)]
    uneven = Q.row_pairs(table(spark, [(5, "e2-e4 e7-e5")]), table(spark, [(5, "e2-e4 e7-c5"), (5, "e2-e4 e7-e5"), (5, "d2-d4")]))
    assert uneven.count() in (0, 1) and rows(uneven, "other") in ([], [(1,)])
    assert Q.row_pairs(table(spark, [(5, "e2-e4")]), table(spark, [(5, "zzzz")])).count() == 0


def test_recovered_openings(spark):
    full = [(1, "e2-e4 e7-e5"), (2, "Ng1-f3 Nb8-c6"), (3, "Bf1-b5 a7-a6"), (4, "Bb5-a4 Ng8-f6"), (5, "0-0 Bf8-e7")]
    sec = lambda df, h: df.withColumn("section", F.lit(1)).withColumn("heading", F.lit(h))
    first, second = sec(table(spark, full[2:]), 7), sec(table(spark, full), 7)
    assert rows(Q.recovered_openings(first, second), "number") == [(1,), (2,)]
    assert Q.recovered_openings(first, sec(table(spark, full), 8)).count() == 0  # another heading
    assert Q.recovered_openings(first, sec(table(spark, [full[0], *full[2:]]), 7)).count() == 0  # a row is missing
    odd = [full[0], (2, "Ng1-f3"), *full[2:]]
    assert Q.recovered_openings(first, sec(table(spark, odd), 7)).count() == 0  # one move only


def test_source_readings(spark):
    t = spark.createDataFrame([("b", 1, 5, 12, 1, "h7-hb", "e2-e4", None), ("b", 1, 6, 13, 1, "h7-hb", "d2-d4", ["h7-h6"]), ("b", 1, 7, 14, 1, "h7-hb", "zz", None), ("b", 1, 8, 15, 1, "h7-hb", "c2-c4", None)], "book string, page int, ord int, number int, side int, word string, peer string, readings array<string>")
    s = table(spark, [(12, "e2-e4 h7-h5"), (13, "d2-d4 h7-h5"), (14, "e2-e4 h7-h5"), (15, "c2-c4 h7-h8")])
    assert rows(Q.source_readings(t, s), "ord", "reading", "conflict") == [(5, "h7-h5", False), (6, "h7-h5", True)]


def test_rank_consensus_and_blocks():
    p = Position.of("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR b KQkq - 0 1")
    assert R.rank_consensus(p, ["h7-hb", "h7-hd"]).uci() == "h7h5"
    assert R.rank_consensus(p, ["h7-hb"]) is None and R.rank_consensus(p, ["h7-h5", "h7-h6"]) is None and R.rank_consensus(p, ["h7-hb", "g7-gd"]) is None
    q = Position.of()
    assert R.blocked(q, "Сf1-c4") and not R.blocked(q, "e2-e4") and not R.blocked(q, "Сf1-f4") and not R.blocked(q, "word")


def test_black_rows_and_improved(spark):
    df = spark.createDataFrame([("12. . . Kc6-d4+", "12... Кc6—d4+"), ("12...Kc6-d4", "13...Kc6-d4"), ("12.Kc6-d4", "12...Kc6-d4")], "a string, b string")
    assert [r[0] is not None for r in df.select(Q.agreed_black_row(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]
    s = "p int, orphans int, mixed int, backtracks int, headings array<string>"
    old = spark.createDataFrame([(1, 1, 0, 0, ["3"]), (2, 1, 0, 0, ["3"]), (3, 0, 2, 0, [])], s)
    new = spark.createDataFrame([(1, 0, 0, 0, ["3", "4"]), (2, 0, 0, 0, []), (3, 0, 1, 0, [])], s)
    assert rows(Q.improved(old, new, ["p"])) == [(1, True), (2, False), (3, True)]


def tokens(spark, text, page=1):
    out, line = [], 1
    for i, w in enumerate(text.split()):
        kind = {"|": "paragraph", "1-0": "result", "(": "open", ")": "close", "#": "boundary"}.get(w, "num" if w[:-1].isdigit() else "word")
        out.append(("b", i, kind, w, page, line))
    return spark.createDataFrame(out, "book string, tok int, kind string, text string, page int, line int")


def test_closing_comments(spark):
    get = lambda t: [(r["comment"], r["reason"]) for r in Q.closing_comments(tokens(spark, t), ["book"]).collect()]
    assert get("Nf3 1-0 | After 12. Nf3 Nc6 Black is lost | more") == [("After 12. Nf3 Nc6 Black is lost", None)]
    assert get("Nf3 1-0 no end here") == [(None, "no_nearby_boundary")]
    assert get("1-0 ( open | x") == [(None, "unbalanced_brackets")]
    assert get("1-0 12. Nf3 only | x") == [(None, "insufficient_notation")]
    assert get("1-0 " + "w " * 26 + "| x") == [(None, "unbounded_prose_subject")]
    assert get("1-0 " + "w " * 170 + "| x") == [(None, "no_nearby_boundary")]


def test_language_headers_layout(spark):
    s = spark.createDataFrame([("ru", "Кf3 Фd1 Лe1 Сc4 Кe5 Лd8"), ("en", "Nf3 Qd1 Re1 Bc4 Ne5"), ("cy", "простой текст"), ("de", "der und die für ö ü ä"), ("no", "plain"), ("nn", None)], "book string, text string")
    assert rows(Q.page_language(s, ["book"])) == [("cy", "ru"), ("de", "de"), ("en", "en"), ("nn", "en"), ("no", "en"), ("ru", "ru")]
    text = ["far away", "Euwe - Tal", "Zürich, 1953", "", "12", "1. e4 e5"]
    lines = spark.createDataFrame([("b", i, t) for i, t in enumerate(text, 1)], "book string, line_no int, line string")
    h = Q.game_headers(lines, spark.createDataFrame([("b", 6)], "book string, line_no int"), ["book"]).first()
    assert (h["white"], h["black"], h["site"], h["date"], h["event"]) == ("Euwe", "Tal", "Zürich", "1953.??.??", None)
    dot = spark.createDataFrame([("b", 1, "Candidates · Zürich · 1953.08.30"), ("b", 2, "1. e4")], "book string, line_no int, line string")
    h = Q.game_headers(dot, spark.createDataFrame([("b", 2)], "book string, line_no int"), ["book"]).first()
    assert (h["event"], h["site"], h["date"]) == ("Candidates", "Zürich", "1953.08.30")
    p = spark.createDataFrame([(1, 1, 10.0, "It ends."), (1, 2, 22.0, "New one"), (1, 3, 22.0, "not")], "page int, line int, x0 double, text string")
    assert [r["new_paragraph"] for r in Q.paragraphs(p, ["page"]).orderBy("line").collect()] == [False, True, False]
    b = spark.createDataFrame([(1, 0.0, 10.0, 5.0, 20.0), (1, 0.0, 210.0, 5.0, 220.0), (1, 0.0, 900.0, 5.0, 910.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    reg = spark.createDataFrame([(1, 0.0, 100.0, 0.0, 0.0), (1, 200.0, 300.0, 50.0, -200.0)], "page int, top double, bottom double, dx double, dy double")
    assert rows(Q.restored(b, reg, ["page"])) == [(1, 0.0, 10.0, 5.0, 20.0), (1, 50.0, 10.0, 55.0, 20.0)]


def test_source_readings_keys_are_plain(spark):
    """No shape is told for a key: in a sort it would be told again for each comparison."""
    t = spark.createDataFrame([("b", 1, 5, 12, "h7-hb", "e2-e4", None)] * 2 + [("b", 1, None, 12, "h7-hb", "e2-e4", None), ("b", 1, 6, 12, "h7-hb", "e2-e4", None)], "book string, page int, ord int, number int, word string, peer string, readings array<string>").selectExpr("*", "1 AS side")
    found = Q.source_readings(t, table(spark, [(12, "e2-e4 h7-h5")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "regexp" in line and any(x in line for x in ("Join [", "Join(", "Exchange ", "Sort ["))]
    assert rows(found, "ord", "reading", "conflict") == [(6, "h7-h5", False)]  # a target that comes twice has no one row
