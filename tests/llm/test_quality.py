import pytest

from galley.llm import quality

COMMON = "the of and to in is was that it on for with as but by at this be not from which had has he his have are or an a after и в на что не с но как так это то у к по из за от если".split()
PROSE = "It was only in the defence of 1958 that he found the weak answer, and the opening is not what it was. " * 3
CASES = {
    "prose": [PROSE, PROSE + "\n1 | a | b\n2 | c | d\n" + PROSE, "Game 71: Tal - Euwe\n\n" + PROSE, "Хорошо известно, что в этом начале атака не должна решаться раньше времени.", "   " + PROSE],
    "list": ["1) Grimish - Wirresz, 1982\n2) Ruz - Fenn, 1985\n3) Hald - Tarn, 1981", "• quiet king\n• weak pawn\n• active plan", "Diagonal weak . . . . . .  5\nAnother one ....... 17", "Hald, 38, 70, 204\nOst, 94\nTarn, 1, 2", "Attack:\nRuz Opening\nHald Gambit\nOst Attack\nTarn System"],
    "table": [" 1  Tal      1  0  ½  2.5\n 2  Euwe     ½  1  0  2.0\n 3  Keres    0  ½  1  1.5", "|1|e4|e5|\n|2|f4|d5|", "1\tNf3\td5\n2\tg3\tc5", "+---+---+\n| r | n |\n+---+---+\n| p |   |\n+---+---+", " 1;A;1;0\n 2;B;0;1"],
    "junk": ["#@ !%^ &*( <>?\n{}[ |~ ^^ %$\n@@ ## !!", "7d3c40ee9078fed090a9a81eb7450cf3\n5ab34156e3965bbe927848f843668f58", "xftq prmpn vq hzcqhn txmg\njvmd hdtnh tznhzcp xsdrh", "Ð\x9fÐ°Ñ\x80Ñ\x82Ð½Ñ\x91Ñ\x80Ñ\x8b Ñ\x81Ð¾Ð³Ð»Ð°Ñ\x81Ð¸Ð»Ð¸Ñ\x81Ñ\x8c", "Scan error: no text layer\n" * 8, "x x x x x\n" * 9, "♟ ♙ □ ♙ ■ ♙ ■ ♟ □ ♙ ♙ □ □ ♟ ♙ ♟ □ ■ ♟ □ ♙ □ ■"],
}


def table(spark, texts):
    common = spark.createDataFrame([("x", w) for w in COMMON] + [("x", None)], "lang string, word string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "'clash' AS kind", "1 AS n_words")
    return {r["doc_id"]: r for r in quality.statistics(df, common).collect()}


@pytest.mark.parametrize("kind", list(CASES))
def test_kinds(spark, kind):
    got = table(spark, CASES[kind])
    assert [got[i]["kind"] for i in range(len(CASES[kind]))] == [kind] * len(CASES[kind])


def test_figures_and_blanks(spark):
    got = table(spark, ["The cat sat.\nOn the mat", None, "", " \n\t ", "\u200b\n\xad\ufeff\x00", "word " * 200_000])
    assert (got[0]["n_words"], got[0]["end_share"], got[0]["symbol_share"]) == (6, 0.5, 0.0)
    assert got[0]["mean_word_length"] == pytest.approx(18 / 6) and got[0]["common_share"] == pytest.approx(3 / 6)
    for i in (1, 2, 3, 4):
        assert got[i]["n_words"] == 0 and got[i]["kind"] is None and got[i]["prose_share"] is None
    assert got[5]["n_words"] == 200_000


def test_viterbi_smooths():
    run, cell = quality.SYMBOLS.index("running"), quality.SYMBOLS.index("cells")
    import numpy as np

    assert set(quality.viterbi(np.array([run, run, run, cell, run, run]))) == {0}
    assert list(quality.viterbi(np.array([run, run, run, *[cell] * 6]))) == [0, 0, 0, *[2] * 6]


def test_fit_learns_what_was_planted():
    """Baum-Welch on drawn sequences comes nearer to the model they were drawn from than the guesses are."""
    import numpy as np

    rnd = np.random.RandomState(4)
    emit = quality.GUESS_EMIT / quality.GUESS_EMIT.sum(1, keepdims=True)
    emit[2] = [0.02, 0.02, 0.02, 0.30, 0.60, 0.01, 0.01, 0.01, 0.01]
    lines = {}
    for _ in range(600):
        state, seq = rnd.choice(4, p=quality.GUESS_START), []
        for _ in range(12):
            seq.append(rnd.choice(9, p=emit[state]))
            state = state if rnd.rand() < 0.97 else rnd.choice(4)
        key = np.array(seq, np.int8).tobytes()
        lines[key] = lines.get(key, 0) + 1
    start, step, got = quality.fit(lines)
    assert abs(got - emit).max() < 0.06 and abs(start.sum() - 1) < 1e-9 and (np.diag(step) > 0.93).all()
    guess = quality.GUESS_EMIT / quality.GUESS_EMIT.sum(1, keepdims=True)
    assert abs(got[2] - emit[2]).sum() < abs(guess[2] - emit[2]).sum() / 2


def test_letters_of_all_planes(spark):
    got = table(spark, ["𝒜𝒷𝒸 \U00010400\U00010428 \U00020000\U00020001"])
    assert got[0]["symbol_share"] == 0.0
