import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from galley.operators import boards, evaluation, matching as M, nested, pages as P, report, sequences as S
from galley.operators.games import Fold, games_of, issues_of, moves_of, parse_games
from galley.plans import relational


def test_unique_best(spark):
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.9), ("b", 1, 0.1), ("b", 2, 0.2), ("c", 1, 0.9), ("d", 1, 0.2), ("d", 2, 0.2), ("e", 1, None), ("f", 1, 0.3)], "k string, id int, s double")
    got = M.unique_best(df, ["k"], F.col("s"), 0.5, 0.35)
    assert rows(got, "k", "id") == [("a", 1), ("f", 1)]  # b: margin, c: limit, d: tie, e: no score
    assert rows(M.unique_best(df, ["k"], F.col("s"), 0.85, 0.35, smallest=False), "k", "id") == [("a", 2), ("c", 1)]
    assert M.unique_best(df.limit(0), ["k"], F.col("s"), 1, 0).count() == 0


def test_only_one_and_agreed(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", None), ("c", 4)], "k string, v int")
    assert rows(M.only_one(df, ["k"])) == [("b", 3)]
    assert rows(M.agreed(df, ["k"], "v")) == [("b", 3), ("c", 4)]


def test_range_join_matches_product(spark):
    p = spark.createDataFrame([(i, float(i * 7 % 40)) for i in range(40)], "id int, x double").withColumn("g", F.lit(1))
    r = spark.createDataFrame([(i, float(i * 3), float(i * 3 + i % 9 - 2)) for i in range(12)], "rid int, a double, b double").withColumn("g", F.lit(1))
    want = sorted((x.id, y.rid) for x in p.collect() for y in r.collect() if y.a <= x.x <= y.b)
    assert rows(M.range_join(p, r, ["g"], "x", "a", "b", 5.0), "id", "rid") == sorted(want, key=repr)


def test_boxes_and_nearest(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    g = spark.createDataFrame([(1, 1, (0.0, 0.0, 10.0, 10.0)), (1, 2, (100.0, 0.0, 110.0, 10.0)), (1, 3, (102.0, 0.0, 112.0, 10.0))], f"page int, glyph_id int, g {box}")
    w = spark.createDataFrame([(1, 7, (1.0, 0.0, 30.0, 12.0)), (1, 8, (95.0, 0.0, 130.0, 12.0)), (2, 9, (0.0, 0.0, 10.0, 10.0))], f"page int, word_id int, w {box}")
    assert rows(M.best_boxes(g, w, ["page"]), "glyph_id", "word_id") == [(1, 7)]  # the other word is claimed twice
    items = spark.createDataFrame([(1, 4.0), (1, 6.0), (1, 5.0)], "page int, y double")
    at = spark.createDataFrame([(1, 2.0), (1, 8.0)], "page int, line double")
    assert rows(M.nearest(items, at, ["page"], "y", "line"), "y", "nearest_line") == [(4.0, 2.0), (5.0, 2.0), (6.0, 8.0)]


def test_similar_rows(spark):
    a = spark.createDataFrame([(1, 1, "e2-e4 e7-e5"), (1, 2, "zzzz"), (2, 3, "d4")], "n int, a_id bigint, t string")
    b = spark.createDataFrame([(1, 5, "e2-e4 e7-c5"), (1, 6, "e2-e4 e7-e5"), (3, 7, "d4")], "n int, b_id bigint, u string")
    assert rows(M.similar_rows(a, b, ["n"], "t", "u"), "a_id", "b_id") == [(1, 6)]
    s = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.5), (2, 6, 0.7), (3, 7, 0.8), (3, 8, 0.75)], "a int, b int, s double")
    assert rows(M.mutual_best(s, "a", "b", "s", 0.6, 0.1), "a", "b") == [(1, 5), (2, 6)]


def test_pairs_runs_and_jobs(spark):
    x = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "k string, o int")
    y = spark.createDataFrame([("p", 5), ("p", 9), ("q", 1), ("q", 2)], "k string, o int")
    assert rows(M.ordinal_pairs(x, y, ["k"], "o"), "k", "o", "o_right") == [("p", 1, 5), ("p", 2, 9)]
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b c a b d".split())], "page int, tok int, w string")
    pat = spark.createDataFrame([(1, 1, ["b", "c"]), (1, 2, ["a", "b"]), (1, 3, ["x"])], "page int, pattern_id int, words array<string>")
    assert rows(M.contiguous_match(t, pat, ["page"], "tok", "w")) == [(1, 1, 1)]  # a b occurs twice
    old = spark.createDataFrame([("j1", "h", "completed"), ("j2", "h", "failed"), ("j3", "old", "completed"), ("j4", None, "completed")], "job string, sha string, status string")
    new = spark.createDataFrame([("j1", "h"), ("j2", "h"), ("j3", "h"), ("j4", None), ("j5", "h")], "job string, sha string")
    reused, todo = M.resume(old, new, "job", ["sha"])
    assert rows(reused, "job") == [("j1",)] and rows(todo, "job") == [("j2",), ("j3",), ("j4",), ("j5",)]
    a = spark.createDataFrame([(7, 1), (None, 2), (9, 3)], "no int, o int")
    e = spark.createDataFrame([(7, 1), (8, 2)], "no int, o int")
    got = {(r["actual"] and r["actual"]["o"], r["expected"] and r["expected"]["o"]) for r in M.full_compare(a, e, "no", "o").collect()}
    assert got == {(1, 1), (2, 2), (3, None)}


def test_sequences(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([5, 5, None, None, 7, 5])], "g int, o int, v int")
    assert [r["island"] for r in S.islands(df, ["g"], ["o"], "v").orderBy("o").collect()] == [1, 1, 2, 2, 3, 4]
    assert rows(S.longest_run(df, ["g"], ["o"], F.col("v") == 5)) == [(1, 2)]
    step = spark.createDataFrame([(1, i, s) for i, s in enumerate([-1, -1, 1, 1, -1, -1, -1, 1])], "g int, o int, s int")
    assert [r["depth"] for r in S.clamped_depth(step, ["g"], ["o"], F.col("s")).orderBy("o").collect()] == [0, 0, 1, 2, 1, 0, 0, 1]
    assert [r["x"] for r in S.carried(df, ["g"], ["o"], "v", "x").orderBy("o").collect()] == [None, 5, 5, 5, 5, 7]
    assert [r["x"] for r in S.carried(df, ["g"], ["o"], "v", "x", back=1).orderBy("o").collect()] == [None, 5, 5, None, None, 7]
    idle = spark.createDataFrame([(1, t) for t in (0, 10, 500, 901, 1302)], "g int, t int")
    assert [r["session"] for r in S.idle_sessions(idle, ["g"], "t", 400).orderBy("t").collect()] == [0, 0, 1, 2, 3][:2] + [1, 2, 3]
    assert rows(S.backtracks(spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 2, 5, 3, 2, 9])], "g int, o int, n int"), ["g"], ["o"], "n")) == [(1, 1)]
    assert [r["between"] for r in S.interpolated(df, ["g"], ["o"], "o").orderBy("o").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert S.sampled(spark.createDataFrame([(1, i) for i in range(30)], "g int, o int"), ["g"], ["o"]).count() == 3
    assert S.sampled(df.limit(2), ["g"], ["o"]).count() == 2


def test_pages(spark):
    b = spark.createDataFrame([("b", "one\ftwo", 3), ("c", None, 1)], "book_id string, text string, total_pages int")
    assert rows(P.split_pages(b)) == [("b", 1, "one"), ("b", 2, "two"), ("b", 3, ""), ("c", 1, "")]
    p = spark.createDataFrame([("b", i, t) for i, t in enumerate(["The plan of attack 1\nbody a", "The plan of attack 2\nbody b", "Euwe - Tal\nbody", "Глава первая\nx"], 1)], "book_id string, page int, text string")
    lines = P.explode_lines(p, ["book_id", "page"])
    assert rows(P.running_heads(lines)) == [("b", 1, 1), ("b", 2, 1), ("b", 4, 1)]
    assert P.page_range(p, "2-3").count() == 2 and P.page_range(p, "3-").count() == 2 and P.page_range(p, "4").count() == 1
    for bad in ("0", "5-2", "x"):
        with pytest.raises(ValueError):
            P.page_range(p, bad)
    marks = spark.createDataFrame([("b", 1, 1, "10 - the dark squares"), ("b", 2, 1, "the light squares - 11"), ("b", 9, 1, "other things here - 99")], "book_id string, page int, line_no int, line string")
    assert rows(P.running_heads(marks)) == [("b", 1, 1), ("b", 2, 1)]


def test_sections(spark):
    text = ["№ 1", "Euwe - Tal", "1. e4 e5", "№ 2", "no moves here", "Глава 2", "№ 3", "1. d4 d5", "Draw."]
    lines = spark.createDataFrame([("b", i, t) for i, t in enumerate(text, 1)], "book_id string, line_no int, line string")
    ev = {r["line_no"]: (r["event"], r["number"]) for r in P.section_events(lines, ["book_id"]).collect() if r["event"]}
    assert ev == {1: ("game_boundary", 1), 6: ("game_end", None), 7: ("game_boundary", 3), 9: ("game_result", None)}
    d = P.page_defects(lines, ["book_id"]).first()
    assert (d["orphans"], d["mixed"], d["backtracks"]) == (1, 0, 0)
    w = spark.createDataFrame([("b", 1, "a com-"), ("b", 2, "bination"), ("b", 3, "and well-"), ("b", 4, "known"), ("b", 5, "x-"), ("b", 6, "Upper")], "book_id string, line_no int, line string")
    lex = spark.createDataFrame([("combination",), ("well-known",)], "word string")
    assert rows(P.broken_words(w, ["book_id"], lex), "line_no", "form") == [(1, "joined"), (3, "hyphen")]


def test_layout(spark):
    words = [("b", 1, x, y, x + 30.0, y + 8.0, f"w{x:.0f}", 400.0) for y in [10.0 + 12 * k for k in range(12)] for x in (20.0, 60.0, 120.0, 240.0, 290.0, 340.0)]
    df = spark.createDataFrame(words, "book_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, width double")
    lined = P.visual_lines(df, ["book_id", "page"])
    assert lined.select("line").distinct().count() == 12
    gap = P.column_gap(df, ["book_id", "page"]).first()["gap"]
    assert 150 <= gap <= 240
    text = P.lines_text(lined.where("x0 < 200"), ["book_id", "page"])
    assert text.orderBy("line").first()["text"] == "w20 w60 w120"
    parts = P.lines_text(lined.withColumn("line", F.col("line") * 2 + (F.col("x0") > 200).cast("int")), ["book_id", "page"])
    order = P.reading_order(parts, P.column_gap(df, ["book_id", "page"]), ["book_id", "page"]).orderBy("ord").collect()
    assert [r["text"][:3] for r in order[:12]] == ["w20"] * 12
    none = df.where("x0 < 100")
    assert P.column_gap(none, ["book_id", "page"]).count() == 0


def test_tokens_and_rows(spark):
    lines = spark.createDataFrame([("b", i, t) for i, t in enumerate(["12.e4 e5", "and (12...d5) text", "13. Nf3 Nc6", "Result 1-0"], 1)], "book_id string, line_no int, line string")
    t = P.tokens(lines, ["book_id"])
    assert [(r["kind"], r["text"]) for r in t.where("line_no = 2").orderBy("pos").collect()] == [("word", "and"), ("open", "("), ("num", "12..."), ("word", "d5"), ("close", ")"), ("word", "text")]
    r = {x["line_no"]: x["is_row"] for x in P.table_rows(t, ["book_id"]).collect()}
    assert r == {1: True, 2: False, 3: True, 4: False}
    assert P.table_layout(P.table_rows(t, ["book_id"]), ["book_id"]).first()["is_table"] is False


def tok(text):
    import re

    out = []
    for w in re.sub(r"([()])", r" \1 ", re.sub(r"(\d+\.(?:\.\.)?)(?=\S)", r"\1 ", text)).split():
        m = re.fullmatch(r"(\d+)(\.{1,3})", w)
        kind = "num" if m else {"(": "open", ")": "close"}.get(w, "result" if w in ("1-0", "0-1", "1/2-1/2") else "boundary" if w == "#" else "word")
        out.append({"tok": len(out), "kind": kind, "number": int(m[1]) if m else 1 if w == "#" else None, "black": bool(m and len(m[2]) == 3), "text": w, "page": 1, "line": 1.0, "readings": None})
    return out


def line(rows_):
    return [r["san"] for r in sorted((r for r in rows_ if r["kind"] == "move" and not any(r["path"])), key=lambda r: len(r["path"]))]


def test_fold():
    got = Fold(tok("Intro 1.e4 e5 2.Nf3 (2.f4 exf4 3.Nf3 is the gambit) 2...Nc6 best 3.Bb5 a6 4.Ba4 Nf6 1-0"), ["en"], False).run()
    assert line(got) == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6", "Ba4", "Nf6"]
    side = [r for r in got if r["kind"] == "move" and any(r["path"])]
    assert [(r["path"], r["san"]) for r in side][:1] == [([0, 0, 1], "f4")] and side[-1]["comment"] == "is the gambit"
    assert next(r for r in got if r["kind"] == "move" and r["san"] == "Nc6")["comment"] == "best"
    assert [r["result"] for r in got if r["kind"] == "game"] == ["1-0"]


def test_fold_scanned_and_abstaining():
    got = Fold(tok("1.e4 e5 2.Nf3 2c6 3.Bb5 a6 4.Ba4 Nf6 5.0-0 Be7 Black resigns"), ["en"], True).run()
    assert line(got)[3] == "Nc6" and line(got)[-1] == "Be7" and [r["result"] for r in got if r["kind"] == "game"] == ["1-0"]
    assert any(r.get("code") == "move_corrected" for r in got)
    same = Fold(tok("1.e4 e5 2.2f3 Nc6 3.Bb5 a6 4.Ba4 Nf6 1-0"), ["en"], False).run()
    assert line(same) == [] and [r["code"] for r in same if r["kind"] == "issue"] in ([], ["mainline_move_unresolved"], ["short_fragment"])
    gap = Fold(tok("1.e4 e5 2.Nf3 Nc6 3.Bb5 a6 7.Re1 b5 0-1"), ["en"], False).run()
    g = next(r for r in gap if r["kind"] == "game")
    assert g["result"] == "*" and dict(g["headers"])["SourceResult"] == "0-1" and g["status"] == "incomplete"
    assert [r["code"] for r in gap if r["kind"] == "issue"] == ["move_sequence_gap"]
    assert Fold([], ["en"], True).run() == []


def table(*lines_):
    """Tokens of a table: a line each."""
    out = []
    for k, text in enumerate(lines_):
        out += [x | {"line": float(k)} for x in tok(text)]
    return [x | {"tok": k} for k, x in enumerate(out)]


def codes(rows_):
    return [r["code"] for r in rows_ if r["kind"] == "issue"]


def test_repair_tries_all_legal_moves():
    got = Fold(tok("1.e4 e5 2.Nf3 Nc6 3.A18 a6 4.Ba4 Nf6 5.0-0 Be7 1-0"), ["en"], True).run()
    assert line(got) == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6", "Ba4", "Nf6", "O-O", "Be7"] and codes(got) == ["move_corrected"]
    shown = Fold(tok("1.e4 e5 2.Nf3 Nc6 3.♗88 a6 4.Ba4 Nf6 5.0-0 Be7 1-0"), ["en"], True).run()
    assert line(shown)[4] == "Bb5"
    vague = Fold(tok("1.e4 e5 2.Nf3 Nc6 3.d4 exd4 4.♗?5 a6 5.Nxd4 Nf6 1-0"), ["en"], True).run()
    assert "mainline_move_unresolved" in codes(vague)  # b5 and g5 are open to a bishop: later moves prove neither
    two = Fold(tok("1.e4 e5 2.Nf3 Nc6 3.N?3 Nf6 4.d3 d6 5.Be2 Be7 6.0-0 0-0 1-0"), ["en"], True).run()
    assert line(two)[4] == "Nc3" and len(line(two)) == 12 and codes(two) == ["move_guessed"]
    four = Fold(tok("1.e4 e5 2.d3 N?6 3.Be2 Be7 4.Bd2 d6 5.c3 Bd7 6.h3 Bc8 1-0"), ["en"], True).run()
    assert "mainline_move_unresolved" in codes(four)  # the knights have four fields and nothing tells which


def test_repair_looks_over_the_comments_of_tables():
    note = ["a long note on the plans of both sides here"] * 30
    game = ["1. e4 e5", "2. Nf3 Nc6", "3. A18 a6", *note, "4. Ba4 Nf6", "5. 0-0 Be7", "6. Re1 b5", "7. Bb3 d6"]
    got = Fold(table(*game), ["en"], True).run()
    assert line(got)[4] == "Bb5" and len(line(got)) == 14
    last = Fold(table("1. e4 e5", "2. Nf3 Nc6", "3. Bb5 a6", "4. Ba4 Nf6", "5. 0-0 Be7", "6. Re1 zzb5"), ["en"], True).run()
    assert len(line(last)) == 12 and line(last)[-1] == "b5"


def test_backtrack_reopens_exact_moves():
    got = Fold(tok("1.e4 e6 2.d4 exd4 3.Qxd4 Nc6 4.Qe3 Nf6 5.Nc3 Bb4 6.Bd2 0-0 1-0"), ["en"], True).run()
    assert line(got)[:4] == ["e4", "e5", "d4", "exd4"] and len(line(got)) == 12 and codes(got) == ["move_corrected"]
    sides = Fold(tok("1.e4 e6 2.d4 (2.d3 e5) (2.Nf3 Nc6) 2...exd4 3.Qxd4 Nc6 4.Qe3 Nf6 5.Nc3 Bb4 6.Bd2 0-0 1-0"), ["en"], True).run()
    assert len(line(sides)) == 12 and "discarded_variation" in codes(sides)
    assert [r["san"] for r in sides if r["kind"] == "move" and any(r["path"])] == ["Nf3", "Nc6"]


def test_backtrack_goes_farther_in_tables():
    game = ["1. e4 e6", "2. a3 a6", "3. h3 h6", "4. c3 c6", "5. g3 g6", "6. b3 b6", "7. Bg2 Bb7", "8. d4 exd4", "9. cxd4 Ne7", "10. Nc3 d5", "11. Nge2 Bg7", "12. 0-0 0-0"]
    got = Fold(table(*game), ["en"], True).run()
    assert line(got)[1] == "e5" and len(line(got)) == 24  # e6 is an exact reading fourteen moves before


def test_parse_games(spark):
    data = [(b, t["tok"], t["kind"], t["number"], t["black"], t["text"], 1, 1.0, None) for b in ("x", "y") for t in tok("# 1.e4 e5 2.Nf3 Nc6 3.Bb5 a6 1-0")]
    df = spark.createDataFrame(data, "book_id string, tok bigint, kind string, number int, black boolean, text string, page int, line double, readings array<string>")
    parsed = parse_games(df, ["book_id"]).cache()
    games, moves = games_of(parsed, ["book_id"]), moves_of(parsed, ["book_id"])
    assert rows(games, "book_id", "round", "result") == [("x", 1, "1-0"), ("y", 1, "1-0")] and moves.count() == 12 and issues_of(parsed, ["book_id"]).count() == 0
    roll = report.game_rollup(games, moves, ["book_id", "game_id"]).first()
    assert (roll["mainline_plies"], roll["total_plies"], roll["variations"]) == (6, 6, 0)
    keys = ["book_id", "game_id"]
    paths = evaluation.move_paths(moves, games, keys)
    pr = evaluation.precision_recall(paths.where("book_id = 'x' and size(history) < 6"), paths.where("book_id = 'x'"), ["start_fen", "history"]).first()
    assert (pr["matched"], pr["precision"], round(pr["recall"], 3)) == (5, 1.0, 0.833)
    main = evaluation.mainlines(moves, ["book_id"])
    cut = main.where("book_id = 'x'").withColumn("uci", F.when(F.col("ply") == 4, "a7a5").otherwise(F.col("uci")))
    assert rows(evaluation.prefix_match(cut, main.where("book_id = 'x'"), ["book_id"])) == [("x", 3, 6, False)]
    missing, extra = evaluation.tree_differences(paths.where("size(history) < 4"), paths, ["book_id"])
    assert missing.count() == 6 and extra.count() == 0
    assert rows(evaluation.frontiers(missing, ["book_id"]), "book_id", "affected") == [("x", 3), ("y", 3)]
    sig = evaluation.signature(moves, games, keys).select("signature").distinct().count()
    assert sig == 1
    s = report.summary(games, moves, issues_of(parsed, ["book_id"])).first()
    assert (s["games"], s["total_plies"], s["issues"]) == (2, 12, 0)
    heads = spark.createDataFrame([("x", 1), ("x", 2)], "book_id string, number int")
    assert rows(report.missing_sections(heads, games, ["book_id"])) == [("x", 2)]
    parsed.unpersist()


def test_reports(spark):
    i = spark.createDataFrame([("b", "gap", "error", 3, 5), ("b", "gap", "error", 9, 9), ("c", "note", "info", 1, 1)], "book_id string, code string, severity string, tok bigint, last bigint")
    assert rows(report.issue_counts(i, ["book_id"])) == [("b", {"gap": 2}, "needs_review"), ("c", {"note": 1}, "completed")]
    t = spark.createDataFrame([("b", k, 1, k // 2) for k in range(10)], "book_id string, tok bigint, page int, line int")
    got = {r["tok"]: len(r["source"]) for r in report.with_source_lines(i.where("book_id = 'b'"), t, ["book_id"], "tok", "last").collect()}
    assert got == {3: 2, 9: 1}
    jobs = spark.createDataFrame([("a", "completed"), ("b", "completed")], "relpath string, status string")
    assert rows(report.status_counts(jobs)) == [("completed", 2), ("failed", 0), ("needs_review", 0)]
    f = spark.createDataFrame([("p", "b", "2"), ("p", "a", "1")], "k string, name string, hash string")
    assert report.fingerprint(f, ["k"]).first()["fingerprint"] == report.fingerprint(f.orderBy("name"), ["k"]).first()["fingerprint"]


def test_boards(spark):
    start = "rnbqkbnrpppppppp" + " " * 32 + "PPPPPPPPRNBQKBNR"
    cells = [(1, i, c.strip()) for i, c in enumerate(start)] + [(2, i, None if i == 5 else c.strip()) for i, c in enumerate(start)]
    df = spark.createDataFrame(cells, "d int, square int, piece string")
    assert rows(boards.assembled(df, ["d"])) == [(1, "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR", "complete"), (2, None, "incomplete")]
    ink = spark.createDataFrame([(1, i, 0.3 if (i // 8 + i % 8) % 2 else 0.0) for i in range(64)] + [(2, i, 0.1) for i in range(64)], "d int, square int, ink double")
    assert rows(boards.checkered(ink, ["d"])) == [(1, True), (2, False)]
    fens = spark.createDataFrame([(1, "8/8 w K - 0 1"), (1, "8/8 w KQ - 0 1"), (2, "8/8 w - - 0 1")], "d int, fen string")
    assert rows(boards.open_fields(fens, ["d"]), "d", "open") == [(1, ["castling"]), (2, [])]


def test_shared_inline(spark):
    schema = "id int, one struct<a: int, two struct<b: string>>, many array<struct<x: int, box: array<double>, sub: array<struct<id: int, box: array<double>>>>>"
    df = spark.createDataFrame([(1, (5, ("q",)), [(7, [1.0, None], [(9, [2.0]), None]), None, (8, None, [])]), (2, None, None), (3, (None, None), [])], schema)
    t = nested.shared_inline(df, "id", "top", {"many": "many_no"})
    assert set(t) == {"top", "many", "sub", "box"}
    assert rows(t["top"]) == [(1, 5, "q"), (2, None, None), (3, None, None)]
    assert rows(t["many"]) == [(1, 1, 7), (1, 3, 8)]
    assert rows(t["sub"], "id", "many_no", "sub_no", "sub_id") == [(1, 1, 1, 9)]
    assert rows(t["box"], "id", "parent", "many_no", "sub_no", "place", "value") == [(1, "many", 1, None, 1, 1.0), (1, "many", 1, None, 2, None), (1, "sub", 1, 1, 1, 2.0)]


def test_payload_records(spark):
    import json

    c = {"char": "a", "bbox": [1, 2, 3, 4], "similarity": "0.5"}
    r = {"kind": "coordinate", "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "characters": [c, None, c]}
    cases = [
        (1, json.dumps({"records": [r, None]})), (2, json.dumps({"records": r})), (3, json.dumps({"page": {"words": {"records": [{**r, "characters": {"1": c, "3": c}}]}}})),
        (4, json.dumps({"records": [{**r, "characters": json.dumps([c])}]})), (5, json.dumps({"records": [r]})[:-3]), (6, None), (7, "{}"), (8, json.dumps({"records": []})), (9, json.dumps({"records": [{**r, "characters": None}]})), (10, ""),
        (11, json.dumps({"records": [{**r, "bbox": "1 2 3 4", "characters": "[{"}]})),
    ]
    df = spark.createDataFrame([(i, p, None) for i, p in cases] + [(1, cases[0][1], None)], f"word_id bigint, payload string, records {nested.T.ArrayType(nested.RECORD).simpleString()}")
    flat = nested.shared_inline(nested.word_records(df), "word_id", "words", {"records": "record_no", "characters": "char_no"})
    assert rows(flat["characters"], "word_id", "record_no", "char_no") == [(1, 1, 1), (1, 1, 3), (2, 1, 1), (2, 1, 3), (3, 1, 1), (3, 1, 3), (4, 1, 1)]
    assert rows(flat["records"], "word_id", "record_no") == sorted([(1, 1), (11, 1), (2, 1), (3, 1), (4, 1), (9, 1)], key=repr)
    boxes = flat["bbox"].where("parent = 'records'").groupBy("word_id").agg(F.collect_list("value").alias("v"))
    assert all(sorted(x["v"]) == [1.0, 2.0, 3.0, 4.0] for x in boxes.collect())
    assert {x["similarity"] for x in flat["characters"].collect()} == {0.5}
    assert flat["words"].count() == 11
    # keys as stored (0, far apart, leading zeros, beyond int), records under names nobody foresaw, names that are no places
    odd = [
        (21, {"records": {"0": r, "1": r}}), (22, {"records": {"0": r}}), (23, {"records": {"999999999": r, "7": None, "007": {"characters": {"0": c, "2000000000": c}}}}), (24, {"data": {"x": {"records": [r]}}}),
        (25, {"records": {"99999999999": r, "x": r}}), (26, [r]), (27, {"records": "[1, null, {}]"}),
    ]
    more = spark.createDataFrame([(i, json.dumps(p), None) for i, p in odd], df.schema)
    got = nested.shared_inline(nested.word_records(more), "word_id", "words", {"records": "record_no", "characters": "char_no"})
    assert rows(got["records"], "word_id", "record_no") == sorted([(21, 0), (21, 1), (22, 0), (23, 999999999), (23, 7), (24, 1), (25, None), (27, 3)], key=repr)
    assert rows(got["characters"].where("word_id = 23"), "record_no", "char_no") == sorted([(999999999, 1), (999999999, 3), (7, 0), (7, 2000000000)], key=repr)
    empty = nested.shared_inline(nested.word_records(df.limit(0)), "word_id", "words")
    assert all(x.count() == 0 for x in empty.values())


def test_one_apart(spark, tmp_path):
    """Sizes one digit apart are counted from how often they occur; no pair is made, and parts of one key are none."""
    rnd = random.Random(5)
    apart = lambda a, b: a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(5)))
    parts = [(rnd.randint(1, 300), f"B{rnd.randint(1, 3)}", rnd.choice("xy"), rnd.choice([1, 2, 11, 12, 21, 22, 112, 121, 122, 7, -7, None])) for _ in range(400)] + [(None, "B1", "x", 1), (1, None, "x", 1), (1, "B1", None, 1), (900, "B9", "x", 1), (900, "B9", "x", 2)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    want = {}
    for i, b, t, s in parts:
        for j, c, u, r in parts:
            if None not in (i, b, t, s, j, c, u, r) and i < j and (b, t) == (c, u) and apart(str(s), str(r)):
                want[b] = want.get(b, 0) + 1
    found = relational.part_fuzzy_numbers(spark, str(tmp_path))
    assert "levenshtein" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == sorted(want.items()) and "B9" not in want
