import datetime
import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from galley.functions import raster
from galley.sources import books, djvu, sinks
from galley.streaming import incremental


def test_folder_and_manifests(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.pdf").write_bytes(b"1")
    (tmp_path / "a" / "b" / "two.djvu").write_bytes(b"2")
    (tmp_path / "a" / "no.txt").write_bytes(b"3")
    got = books.folder(spark, str(tmp_path / "a"))
    assert [r["kind"] for r in got.collect()] == ["djvu", "pdf"]
    (tmp_path / "m.json").write_text(json.dumps({"cases": [{"id": "x"}, {"id": "y"}]}))
    assert books.manifest(spark, str(tmp_path / "m.json")).count() == 2
    (tmp_path / "n.json").write_text(json.dumps({"cases": [{"id": "x"}, {"id": "x"}]}))
    with pytest.raises(ValueError):
        books.manifest(spark, str(tmp_path / "n.json"))
    (tmp_path / "p.json").write_text(json.dumps({"schema_version": 1, "templates": [{"char": "a", "bitmap": "00"}]}))
    assert books.profile(spark, str(tmp_path / "p.json")).count() == 1
    with pytest.raises(ValueError):
        books.profile(spark, str(tmp_path / "p.json"), 2)
    with pytest.raises(FileNotFoundError):
        books.tool("no-such-program-here")


def test_page_reader_isolates_failures(spark):
    def reader(path, page):
        if page == 2:
            raise ValueError("damaged")
        return f"{path}:{page}"

    df = spark.createDataFrame([("b", "x.pdf", p) for p in (1, 2, 3)], "book_id string, path string, page int")
    got = rows(books.read_pages(df, reader), "page", "text", "error")
    assert got == [(1, "x.pdf:1", None), (2, None, "damaged"), (3, "x.pdf:3", None)]
    keyed = books.cache_key(df, ["path"])
    cache = keyed.withColumn("text", F.when(F.col("page") == 1, "t"))
    assert rows(books.cache_misses(keyed, cache), "page") == [(2,), (3,)]


def test_djvu_lines(spark):
    raw = '(page 0 0 100 200\n (line 10 10 90 20\n  (word 10 10 40 20 "one")\n  (word 50 10 90 20 "t\\"wo"))\n (word 5 50 20 60 "alone"))\n(page 0 0 100 200\n (line 1 1 2 2\n  (word 1 1 2 2 "x")))'
    got = rows(djvu.lines(spark.createDataFrame([("b", raw)], "book_id string, raw string"), ["book_id"]), "page", "text", "x0", "x1")
    assert got == [(1, "alone", 5, 20), (1, 'one t"wo', 10, 90), (2, "x", 1, 2)]
    words = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 5.0, "a", 100.0), (1, 1, 1, 12.0, 0.0, 20.0, 5.0, 'b"', 100.0)], "page int, block int, line int, x0 double, y0 double, x1 double, y1 double, text string, height double")
    layer = djvu.text_layer(words, ["page"]).first()["layer"]
    assert layer.startswith("(page 0 0 20 100\n(line 0 95 20 100\n(word 0 95 10 100 \"a\")") and '"b\\""' in layer


def test_raster(spark):
    gray = np.full((20, 20), 255, np.uint8)
    gray[2:6, 2:6] = 0
    gray[6, 6] = 0  # touches by a corner
    gray[12:15, 10:18] = 0
    assert raster.components(gray) == [(2, 2, 7, 7), (10, 12, 18, 15)]
    df = spark.createDataFrame([(1, 20, 20, bytearray(gray.tobytes())), (2, 20, 20, bytearray(b"short")), (3, None, None, None)], "page int, width int, height int, samples binary")
    got = raster.glyphs(df, ["page"]).collect()
    assert [(r["page"], r["box"]) for r in got] == [(1, [2, 2, 7, 7]), (1, [10, 12, 18, 15])] and all(len(r["bitmap"]) == 128 for r in got)
    assert raster.square_distance(np.zeros((16, 16)), np.full((16, 16), 255.0)) == 1.0
    edge = np.full((40, 40), 255, np.uint8)
    edge[5, 5:31] = edge[30, 5:31] = edge[5:31, 5] = edge[5:31, 30] = 0
    assert (5, 5, 31, 30) in raster.frames(edge, 10)
    ones, half = "f" * 256, "f" * 128 + "0" * 128
    t = spark.createDataFrame([("a", ones), ("b", half)], "label string, h string").select("label", raster.hex_words(F.col("h")).alias("words"))
    g = spark.createDataFrame([(1, "0x" + ones.upper()), (2, half), (3, None), (4, "0" * 256)], "id int, h string").select("id", raster.hex_words(F.col("h")).alias("words"))
    assert rows(raster.classify(g, t, ["id"]), "id", "label") == [(1, "a"), (2, "b"), (3, None), (4, None)]
    assert rows(g.where("id < 3").select("id", raster.dice(F.col("words"), F.col("words")).alias("s"))) == [(1, 1.0), (2, 1.0)]
    cols = [[(3, "e", 0.9), (3, "c", 0.8)], [], [], [(6, "4", 0.95)], [], []]
    assert raster.beam(cols, 6)[0] == ("e4", 0.9)
    assert raster.features(np.zeros((32, 32), np.uint8), (0, 0, 32, 32)).shape == (16, 16)


def test_write_games(spark, tmp_path):
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    games = spark.createDataFrame([("b", 1, {"White": "A"}, start, "1-0")], "book_id string, game_id int, headers map<string,string>, start_fen string, result string")
    moves = spark.createDataFrame([("b", 1, [0], "e2e4", [1], "good", ""), ("b", 1, [0, 0], "e7e5", [], "", ""), ("b", 1, [0, 1], "c7c5", [], "", "or")], "book_id string, game_id int, path array<int>, uci string, nags array<int>, comment string, starting_comment string")
    out = tmp_path / "g.pgn"
    assert sinks.write_pgn(games, moves, ["book_id", "game_id"], str(out)) == 1
    assert "1. e4 $1 {good} 1... e5 ({or} 1... c5) 1-0" in out.read_text()
    bad = spark.createDataFrame([("gap", "error")], "code string, severity string")
    with pytest.raises(ValueError):
        sinks.write_pgn(games, moves, ["book_id", "game_id"], str(out), bad)
    with pytest.raises(ValueError):
        sinks.write_pgn(games, moves.withColumn("uci", F.lit("e2e5")), ["book_id", "game_id"], str(out))
    assert "1. e4" in out.read_text()


def test_streams(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    df = spark.createDataFrame([("a", 1, t(1)), ("a", 2, t(2)), ("a", 2, t(2)), ("a", 5, t(50)), ("b", 1, t(3))], "k string, n int, at timestamp")
    src = str(tmp_path / "src")
    df.coalesce(1).write.parquet(src)
    stream = incremental.pages(spark, src, "k string, n int, at timestamp")

    def collect(s, name, mode="append"):
        q = s.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert collect(incremental.once_per_row(stream, ["k", "n"], "at"), "s1").count() == 4
    assert rows(collect(incremental.windowed_counts(stream, "at", ["k"], "30 minutes"), "s2", "complete"), "k", "n") == [("a", 1), ("a", 3), ("b", 1)]
    assert rows(collect(incremental.session_counts(stream, "at", "k"), "s3", "complete"), "k", "n") == [("a", 1), ("a", 3), ("b", 1)]
    assert rows(collect(incremental.gapless(stream.withColumn("n", F.col("n").cast("bigint")), "k", "n"), "s4"), "k", "n", "expected") == [("a", 2, 3), ("a", 5, 3)]
    seen = []
    incremental.run(stream, lambda d, i: seen.append(d.count()), "once").awaitTermination()
    incremental.run(stream, lambda d, i: seen.append(d.count()), "once").awaitTermination()
    assert sum(seen) == 5


def test_classify_counts_the_sign_bit(spark):
    from galley.functions import raster

    t = spark.createDataFrame([("a", [-1] * 16), ("b", [1] * 16)], "label string, words array<bigint>")
    g = spark.createDataFrame([(1, [-1] * 15 + [-2]), (2, [1] * 15 + [3])], "id int, words array<bigint>")
    assert rows(raster.classify(g, t, ["id"]), "id", "label") == [(1, "a"), (2, "b")]
    assert rows(raster.classify(g, t.limit(0), ["id"]), "id", "label") == [(1, None), (2, None)]
