"""Rows reconciled before the fold, and what the fold tells about numbers, diagrams and side lines."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_operators import codes, line, table, tok

from galley.functions import lines as L
from galley.operators import reconcile as C, report
from galley.operators.games import Fold, games_of, moves_of, parse_games

ROWS = "book string, page int, ord double, number int, words array<string>"
GAME = [(1, ["e4", "e5"]), (2, ["Nf3", "Nc6"]), (3, ["Bb5", "a6"]), (4, ["Ba4", "Nf6"]), (5, ["0-0", "Be7"]), (6, ["Re1", "b5"])]


def reading(spark, game, page=1):
    return spark.createDataFrame([("b", page, float(k), n, w) for k, (n, w) in enumerate(game)], ROWS)


def test_numbers_and_gaps(spark):
    first = [GAME[0], (9, GAME[1][1]), GAME[2], GAME[4], GAME[5]]  # one number misread, one row lost
    got, issues = C.reconciled(reading(spark, first), reading(spark, GAME))
    assert [(r["number"], r["words"]) for r in got.orderBy("ord").collect()] == GAME
    assert sorted(r["code"] for r in issues.collect()) == ["missing_rows_recovered", "row_number_ocr_consensus"]
    parsed = Fold([r.asDict() for r in C.row_tokens(got).orderBy("tok").collect()], ["en"], True).run()
    assert len(line(parsed)) == 12
    same, none = C.reconciled(reading(spark, GAME), reading(spark, GAME))
    assert same.count() == 6 and none.count() == 0
    alone, none = C.reconciled(reading(spark, GAME))
    assert alone.count() == 6 and none.count() == 0
    assert C.reconciled(reading(spark, GAME).limit(0), reading(spark, GAME).limit(0))[0].count() == 0


def test_source_ranks(spark):
    first = reading(spark, [(7, ["h2-h3", "h7-hb"]), (8, ["a2-a3", "b7-bb"])])
    source = reading(spark, [(7, ["h2-h3", "h7-h6"]), (8, ["a2-a4", "b7-b5"])])
    got, issues = C.ranked(first, source)
    assert [r["words"] for r in got.orderBy("ord").collect()] == [["h2-h3", "h7-h6"], ["a2-a3", "b7-bb"]]  # the other move of row 8 differs
    assert [(r["code"], r["message"]) for r in issues.collect()] == [("source_row_reading", "h7-h6")]


def test_openings(spark):
    cols = "book string, section int, heading string, page int, ord double, number int, words array<string>"
    side = lambda game: spark.createDataFrame([("b", 1, "№ 7", 1, float(k), n, w) for k, (n, w) in enumerate(game)], cols)
    got, issues = C.opened(side(GAME[2:]), side(GAME))
    assert [r["number"] for r in got.orderBy("ord").collect()] == [1, 2, 3, 4, 5, 6]
    assert [(r["code"], r["message"]) for r in issues.collect()] == [("opening_rows_recovered", "2 rows")]
    assert C.opened(side(GAME[2:]), side([GAME[0], *GAME[2:]]))[1].count() == 0  # a row of the opening is missing there too


def test_rows_cut_apart(spark):
    text = ["12. e2-e4 e7-e5 13. Ng1-f3 Nb8-c6", "14. d2-d4 e5-d4", "in 1998 he won 3. prize", "15.c2-c3 d4-c3", "9. a2-a3 8. b2-b3"]
    df = spark.createDataFrame([("b", 1, k, t) for k, t in enumerate(text)], "book string, page int, line_no int, line string")
    got = [(r["number"], r["words"]) for r in C.rows_of(df, ["book", "page"]).orderBy("ord").collect()]
    assert got[:4] == [(12, ["e2-e4", "e7-e5"]), (13, ["Ng1-f3", "Nb8-c6"]), (14, ["d2-d4", "e5-d4"]), (15, ["c2-c3", "d4-c3"])]
    one = df.select(F.size(L.glued_rows(F.col("line"))).alias("n"), "line_no").orderBy("line_no").collect()
    assert [r["n"] for r in one] == [2, 1, 1, 1, 1]


@pytest.mark.parametrize(
    "text, code",
    [
        ("1.e4 e5 2.Nf3 Nc6 8.Bb5 a6 4.Ba4 Nf6 5.0-0 Be7 1-0", "move_number_recovered"),
        ("1.e4 e5 2.Nf3 2.Nc6 3.Bb5 a6 4.Ba4 Nf6 5.0-0 Be7 1-0", "move_side_recovered"),
        ("1.e4 e5 2.Nf3 Nc6 2.Nxe5 Nxe5 4.d4 Nc6 5.d5 Nb8 1-0", "move_number_repeated"),
    ],
)
def test_numbers_recovered(text, code):
    got = Fold(tok(text), ["en"], True).run()
    assert len(line(got)) == 10 and codes(got) == [code]
    plain = Fold(tok(text), ["en"], False).run()
    assert line(plain) != line(got)  # a text layer's numbers are taken as they are


def test_number_of_a_note_is_not_recovered():
    got = Fold(tok("1.e4 e5 2.Nf3 Nc6 and not 2.f4 exf4 at once 3.Bb5 a6 4.Ba4 Nf6 1-0"), ["en"], True).run()
    assert line(got) == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6", "Ba4", "Nf6"] and codes(got) == []


def board(placement):
    return {"tok": 0, "kind": "board", "number": None, "black": False, "text": "__BOARD_1__", "page": 1, "line": 1.0, "readings": [placement] if placement else None}


def joined(*parts):
    return [x | {"tok": k} for k, x in enumerate(x for p in parts for x in (p if isinstance(p, list) else [p]))]


def test_diagrams():
    shown = "8/8/8/4k3/8/4K3/4P3/8"
    got = Fold(joined(tok("Study"), board(shown), tok("1.Kd3 Kd5 2.e4 Ke5 1/2-1/2")), ["en"], True).run()
    assert line(got) == ["Kd3", "Kd5", "e4+", "Ke5"] or line(got) == ["Kd3", "Kd5", "e4", "Ke5"] or len(line(got)) == 4
    assert "diagram_setup" in codes(got)
    for placement, text, code in ((None, "1.Kd3 Kd5 2.e4 1-0", "diagram_position_unverified"), (shown, "no number here 1-0", "diagram_setup_unresolved"), (shown, "1.Qd3 Kd5 1-0", "diagram_setup_unresolved")):
        assert code in codes(Fold(joined(board(placement), tok(text)), ["en"], True).run())
    start = "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR"
    here = Fold(joined(tok("1.e4 e5"), board(start), tok("2.Nf3 Nc6 3.Bb5 a6 1-0")), ["en"], True).run()
    assert len(line(here)) == 6 and codes(here) == []
    later = Fold(joined(tok("1.e4 e5 2.Nf3"), board(start), tok("2...Nc6 3.Bb5 a6 1-0")), ["en"], True).run()
    assert len(line(later)) == 6 and codes(later) == ["diagram_history_normalized"]


def test_side_lines_and_tails():
    got = Fold(tok("1.e4 e5 2.Nf3 (2.Zz9x d5) 2...Nc6 (2...d6 3.d4 1-0) 3.Bb5 a6 4.Ba4 Nf6 1-0"), ["en"], True).run()
    assert "analysis_result_retained" in codes(got) and len(line(got)) == 8
    tail = Fold(tok("1.e4 e5 2.Nf3 Nc6 3.Bb5 a6 17.Re1 b5 18.Bb3 d6 19.c3 0-0 0-1"), ["en"], False).run()
    assert codes(tail) == ["move_sequence_gap", "excluded_tail"]


def test_second_look(spark):
    data = [("x", t["tok"], t["kind"], t["number"], t["black"], t["text"], None if t["text"] == "a6" else 1, 1.0, ["Bb5", "Rb5"] if t["text"] == "Bb5" else None) for t in tok("# 1.e4 e5 2.Nf3+ Nc6 3.Bb5 a6 1-0")]
    df = spark.createDataFrame(data, "book_id string, tok bigint, kind string, number int, black boolean, text string, page int, line double, readings array<string>")
    parsed = parse_games(df, ["book_id"]).cache()
    games, moves = games_of(parsed, ["book_id"]), moves_of(parsed, ["book_id"])
    moves = moves.withColumn("page", F.when(F.col("san") != "a6", F.col("page")))
    got = report.checks(moves, games, df, ["book_id"])
    assert rows(got, "code", "message") == sorted([("alternate_ocr", "Bb5 Bb5"), ("check_mismatch", "Nf3+ Nf3"), ("missing_provenance", "a6 a6")], key=repr)
    pages = spark.createDataFrame([("x", 1, "text", True, False), ("y", 1, " ", True, True), ("y", 2, None, False, None)], "book_id string, page int, text string, ocr boolean, verified boolean")
    assert rows(report.page_checks(pages, games, ["book_id"]), "book_id", "code", "page") == sorted([("x", "ocr_unverified", 1), ("y", "empty_page", 1), ("y", "empty_page", 2), ("y", "no_games", None)], key=repr)
    parsed.unpersist()


def test_table_number_in_rows():
    game = ["1. e4 e5", "2. Nf3 Nc6", "3. Bb5 a6", "4. Ba4 Nf6", "5. 0-0 Be7", "6. Re1 b5"]
    assert len(line(Fold(table(*game), ["en"], True).run())) == 12
