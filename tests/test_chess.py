import pytest

from galley.functions.chess import Position, from_uci, mirrored, perft, possible_passant
from galley.sources import pgn, sinks


@pytest.mark.parametrize(
    "fen, counts",
    [
        ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", [20, 400, 8902]),
        ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", [48, 2039]),
        ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", [14, 191, 2812]),
        ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", [6, 264, 9467]),
    ],
)
def test_perft(fen, counts):
    p = Position.of(fen)
    assert [perft(p, d + 1) for d in range(len(counts))] == counts


def test_fen_round_trip():
    p = Position.of()
    for w in "e4 c5 Nf3 d6 d4 cxd4 Nxd4 Nf6 Nc3 a6 Be2 e5 O-O".split():
        p = p.after(p.read(w))
        assert Position.of(p.fen()).fen() == p.fen()
    for bad in ("", "8/8 w - -", "9/8/8/8/8/8/8/8 w - - 0 1", "8/8/8/8/8/8/8/8 w - - 0 1"):
        with pytest.raises(ValueError):
            Position.of(bad)
    assert mirrored("8/p7/8/8/8/8/P7/K6k") == "k6K/7P/8/8/8/8/7p/8"


def test_san():
    p = Position.of("7k/8/8/8/8/8/8/R3K2R w KQ - 0 1")
    assert p.san(from_uci("e1g1")) == "O-O" and p.read("0-0").uci() == "e1g1" and p.read("Rf1").uci() == "h1f1"
    assert Position.of("6k1/5ppp/8/8/8/8/8/R3K3 w - - 0 1").san(from_uci("a1a8")) == "Ra8#"
    assert Position.of("k7/8/8/2Q5/8/8/8/Q3Q2K w - - 0 1").read("Qe5") is None
    assert [x for x in possible_passant(Position.of("4k3/8/8/3pP3/8/8/8/4K3 w - - 0 1"))] == [43]


TEXT = """[Event "x"]
[White "A \\"B\\""]
[Result "1-0"]

{Intro} 1. e4! e5 (1... c5 {Sicilian} 2. Nf3 (2. c3 d5) 2... d6) 2. Nf3 Nc6 {good} 3. Bb5 a6 $2 1-0

[Event "y"]
[FEN "8/P7/8/8/8/8/k6K/8 w - - 0 1"]
[SetUp "1"]

1. a8=Q+ Kb3 *
"""


def test_pgn_round_trip(spark, tmp_path):
    games = pgn.parse_pgn(TEXT)
    assert [g.error for g in games] == [None, None] and games[0].root.comment == "Intro"
    text = pgn.checked(games)
    assert [pgn.signature(g) for g in pgn.parse_pgn(text)] == [pgn.signature(g) for g in games]
    (tmp_path / "a.pgn").write_bytes(b"\xef\xbb\xbf" + text.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.pgn").write_bytes('[White "M\xfcller"]\n\n1. e4 e4 *\n'.encode("cp1252"))
    got = pgn.read(spark, str(tmp_path)).orderBy("path", "game_no").collect()
    assert len(got) == 3 and got[2]["headers"]["White"] == "Müller" and "no such move" in got[2]["error"]
    assert len(got[0]["moves"]) == 11 and got[0]["moves"][0]["nags"] == [1]
    with pytest.raises(Exception, match="no such move"):
        pgn.read(spark, str(tmp_path), "failfast").collect()


def test_book_page():
    g = pgn.parse_pgn(TEXT)[0]
    text = sinks.movetext(g, "figurine")
    assert text.startswith("1. e4! e5 (1... c5 <i>Sicilian</i> 2. ♘f3") and "2. ♘f3 ♘c6" in text
    assert "<pre>" in sinks.blocks(g, 1) and sinks.comment("a<b [%x]") == "a&lt;b"


def test_sinks(tmp_path):
    path = tmp_path / "x.json"
    sinks.write_json(str(path), {"ü": 1})
    assert path.read_text(encoding="utf-8") == '{\n  "ü": 1\n}\n' and list(tmp_path.iterdir()) == [path]
    with pytest.raises(ValueError):
        sinks.checks("a.pdf", "a.pgn", "a.pgn")
    assert sinks.report_path("a.pgn") == "a.pgn.report.json"
