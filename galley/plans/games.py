"""Queries on notation that need rules, pixels or a fold; SQL cannot say them, tests compare them with small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import moves as R
from ..functions import notation as N
from ..functions import raster
from ..functions.chess import START
from ..operators import games as G
from ..operators import pages as P
from ..operators import report
from ..session import table, written
from . import words as _w

KEYS = ["book_id"]


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "joined_notation").where("raw is not null").select(F.col("note_id").cast("string").alias("book_id"), F.coalesce("source_page", F.lit(0)).alias("page"), F.col("raw").alias("text")).distinct()


def _note_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of notes as a scan is read: damage repaired, rows that ran together cut apart."""
    lines = P.explode_lines(_notes(spark, d), ["book_id", "page"]).withColumn("line", N.repair_scanned(F.col("line")))
    parts = lines.select("book_id", "page", "line_no", F.posexplode(L.glued_rows(F.col("line"))).alias("part", "line"))
    w = Window.partitionBy("book_id").orderBy("line_no", "part")
    return parts.select("book_id", "page", F.row_number().over(w).alias("line_no"), "line")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    lines = _note_lines(spark, d)
    t = P.tokens(lines, ["book_id", "page"])
    heads = lines.where(F.col("line").rlike(r"^\s*(Game|Партия|Partie|Partida) [0-9]+$")).select("book_id", "page", "line_no", F.lit(0).alias("pos"), F.lit("boundary").alias("kind"), F.regexp_extract("line", "([0-9]+)$", 1).cast("int").alias("number"), F.lit(False).alias("black"), F.col("line").alias("text"))
    both = t.join(heads.select("book_id", "line_no"), ["book_id", "line_no"], "left_anti").unionByName(heads)
    tok = F.row_number().over(Window.partitionBy("book_id").orderBy("line_no", "pos")).cast("bigint")
    return both.select("book_id", tok.alias("tok"), "kind", "number", "black", "text", "page", F.col("line_no").cast("double").alias("line"), F.lit(None).cast("array<string>").alias("readings"))


def note_games(spark, d):
    """Games, moves and issues of all scanned notes: one row per issue code, and one for games and moves."""
    parsed = written(G.parse_games(_tokens(spark, d), KEYS, "en+ru", scanned=True), "parsed")
    return parsed.groupBy("kind", F.coalesce("code", F.lit("")).alias("code")).agg(F.count("*").alias("n"), F.countDistinct("book_id").alias("notes"))


def note_report(spark, d):
    """Issue counts and status of each note with any issue."""
    parsed = G.parse_games(_tokens(spark, d), KEYS, "en+ru", scanned=True)
    return report.issue_counts(G.issues_of(parsed, KEYS), KEYS).select("book_id", F.to_json("issue_counts").alias("issue_counts"), "status")


def note_quality(spark, d):
    """Issues of all notes by code and severity: those of the fold, of the second look at played moves, of pages, and of printed
    moves that no game took."""
    tokens = written(_tokens(spark, d), "tokens")
    parsed = written(G.parse_games(tokens, KEYS, "en+ru", scanned=True), "parsed")
    games, moves = G.games_of(parsed, KEYS), G.moves_of(parsed, KEYS)
    loose = report.unread_moves(tokens, moves, games, KEYS, N.move_code(F.col("text")))
    parts = [G.issues_of(parsed, KEYS), report.checks(moves, games, tokens, KEYS), report.page_checks(_notes(spark, d), games, KEYS), loose.select(F.lit("unparsed_move_candidate").alias("code"), F.lit("warning").alias("severity"))]
    out = None
    for x in parts:
        x = x.select("code", "severity")
        out = x if out is None else out.unionByName(x)
    return out.groupBy("code", "severity").agg(F.count("*").alias("n"))


def note_token_kinds(spark, d):
    return _tokens(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


def note_heads(spark, d):
    """Running heads that pages of a book share, and headed sections."""
    notes = table(spark, d, "joined_notation").where("raw is not null and book is not null").select(F.col("book").alias("book_id"), F.coalesce("source_page", F.lit(0)).alias("page"), F.col("raw").alias("text")).distinct()
    return P.running_heads(P.explode_lines(notes, ["book_id", "page"])).groupBy("book_id").agg(F.count("*").alias("heads"), F.countDistinct("page").alias("pages"))


def note_defects(spark, d):
    lines = P.explode_lines(_notes(spark, d), ["book_id", "page"])
    return P.page_defects(lines, ["book_id", "page"]).where("orphans + mixed + backtracks > 0")


def doc_move_rows(spark, d):
    """Documents that hold rows of a table of moves, and whether they are such a table as a whole."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    lines = P.explode_lines(docs, ["doc_id"]).withColumn("line", F.regexp_replace("line", r"^[ |]*(\d{1,3})[ |.\t]+(?=\S)", "$1. ")).where(F.col("line").rlike(r"^\s*\d{1,3}(\.|…)"))
    return P.table_layout(P.table_rows(P.tokens(lines, ["doc_id"]), ["doc_id"]), ["doc_id"]).where("rows > 0")


#: Public positions for counting move sequences (perft), with castling, promotions, pins and captures in passing.
POSITIONS = {
    "start": START,
    "castling": "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1",
    "passant": "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1",
    "promotion": "r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1",
    "mixed": "rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8",
}


def chess_perft(spark, d):
    """Numbers of legal move sequences of one to three moves, counted on tables of positions."""
    at = spark.createDataFrame(list(POSITIONS.items()), "name string, fen string")
    out = None
    for depth in (1, 2, 3):
        moves = at.select("name", "fen", F.explode(R.legal_moves(F.col("fen"))).alias("uci"))
        n = moves.groupBy("name").agg(F.count("*").alias("nodes")).select("name", F.lit(depth).alias("depth"), "nodes")
        out = n if out is None else out.unionByName(n)
        at = moves.select("name", R.position_after(F.col("fen"), F.array("uci")).alias("fen"))
        if depth == 2:
            at = at.where("name in ('start', 'passant', 'promotion')")
    return out


def word_first_moves(spark, d):
    """Distinct scanned words that are legal first moves of a game."""
    t = table(spark, d, "bold_source_words").where("text is not null").select(F.regexp_replace("text", r"^1\.(?=\S)", "").alias("word")).distinct().where(N.move_code(F.col("word")).isNotNull())
    return t.select("word", R.move_of(F.lit(START), F.col("word"), "en+ru").alias("uci")).where("uci is not null")


def word_repairs(spark, d):
    """How far scanned words are from the words that were meant, by the weighted distance of print."""
    t = table(spark, d, "bold_source_words").where("text is not null and expected is not null").select("text", "expected").distinct()
    return t.select("text", "expected", F.round(R.ocr_distance(N.shape(F.col("text")), N.shape(F.col("expected"))), 2).alias("distance")).where("distance > 0")


def word_components(spark, d):
    """Components of ink in the kept pictures of words."""
    t = table(spark, d, "bold_source_words").where("samples is not null").select("word_id", "width", "height", "samples").dropDuplicates(["word_id"])
    pics = t.select("word_id", "width", "height", raster.unpacked(F.col("samples")).alias("samples"))
    return raster.glyphs(pics, ["word_id"], 1).groupBy("word_id").agg(F.count("*").alias("components"))


def template_consensus(spark, d):
    """For every label, the bits that most of its train templates have: a profile whose size is that of the alphabet."""
    t = table(spark, d, "coordinates").where("split = 'train' and label is not null").select("template_id", "label", raster.hex_words(F.col("bitmap")).alias("w")).where("w is not null").dropDuplicates(["template_id"])
    # votes per bit stay arrays of 1,024 counts per label and salt before they meet
    bits = t.select("label", F.pmod("template_id", F.lit(16)).alias("salt"), F.posexplode("w").alias("i", "x"))
    ones = [F.sum(F.call_function("shiftrightunsigned", F.col("x"), F.lit(k)).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64)]
    part = bits.groupBy("label", "salt", "i").agg(F.count("*").alias("n"), *ones).groupBy("label", "i").agg(F.sum("n").alias("n"), *(F.sum(f"b{k}").alias(f"b{k}") for k in range(64)))
    word = F.aggregate(F.array(*(F.when(F.col(f"b{k}") * 2 > F.col("n"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)) for k in range(64))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))
    return part.select("label", "i", word.alias("w")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda e: e["w"]).alias("words"))


def template_classify(spark, d):
    """Templates outside train classified by the consensus of train, with abstention: counts of right, wrong and none."""
    profile = written(template_consensus(spark, d), "profile")
    t = table(spark, d, "coordinates").where("split <> 'train' and label is not null").select("template_id", F.col("label").alias("truth"), raster.hex_words(F.col("bitmap")).alias("words")).where("words is not null").dropDuplicates(["template_id"])
    got = raster.classify(t, profile, ["template_id", "truth"])
    return got.groupBy(F.when(F.col("label").isNull(), "none").when(F.col("label") == F.col("truth"), "right").otherwise("wrong").alias("verdict")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (chess_perft, note_games, note_report, note_quality, note_token_kinds, note_heads, note_defects, doc_move_rows, word_first_moves, word_repairs, word_components, template_consensus, template_classify)}
_COST = "CASE WHEN {a} = {b} THEN 0.0 WHEN {a} = '?' THEN 0.3 " + " ".join(f"WHEN {{a}} || {{b}} IN ({', '.join(_w._q(x) for p in v.split() for x in (p, p[::-1]))}) THEN {k}" for k, v in N.CONFUSED.items()) + " ELSE 1.0 END"
# a row of the distance matrix from the one before: the least of all places up to each, with what is lost on the way
_STEP = "list_transform(range(1, m + 2), lambda j: c[j] + list_min(list_transform(range(1, j + 1), lambda k: CASE WHEN k = 1 THEN r[1] + 1 ELSE least(r[k] + 1, r[k - 1] + " + _COST.format(a="a[i + 1]", b="b[k - 1]") + ") END - c[k])))"
_PARTS = "^([KQRBN]?)([a-h]?)([1-8]?)([-x:]?)([a-h][1-8])$"
_FIRST = (
    "legal AS (SELECT '' AS piece, f, '2' AS r, f || y AS goal, f || '2' || f || y AS uci FROM (VALUES ('a'), ('b'), ('c'), ('d'), ('e'), ('f'), ('g'), ('h')) a(f), (VALUES ('3'), ('4')) b(y) "
    "UNION ALL SELECT 'N', f, '1', g, f || '1' || g FROM (VALUES ('b', 'a3'), ('b', 'c3'), ('g', 'f3'), ('g', 'h3')) n(f, g))"
)
_HEX = "regexp_replace(regexp_replace(lower(trim(bitmap)), '^0x', ''), '[\\s:_,-]+', '', 'g')"
# the bits that most train templates of a label have, as characters and as signed words of 64
_CONSENSUS = (
    f"tr AS (SELECT template_id, any_value(label) AS label, any_value(CAST(CAST(unhex({_HEX}) AS BIT) AS VARCHAR)) AS x FROM coordinates WHERE split = 'train' AND label IS NOT NULL AND regexp_full_match({_HEX}, '[0-9a-f]{{256}}') GROUP BY template_id), "
    "bits AS (SELECT label, pos, substr(x, CAST(pos AS INT), 1) = '1' AS b FROM tr, range(1, 1025) r(pos)), major AS (SELECT label, pos, CASE WHEN 2 * count(*) FILTER (b) > count(*) THEN '1' ELSE '0' END AS b FROM bits GROUP BY 1, 2), "
    "unsigned AS (SELECT label, (pos - 1) // 64 AS i, sum(CASE WHEN b = '1' THEN CAST(1 AS HUGEINT) << CAST(63 - (pos - 1) % 64 AS INT) ELSE 0 END) AS u FROM major GROUP BY 1, 2), words AS (SELECT label, i, CAST(CASE WHEN u >= CAST(9223372036854775808 AS HUGEINT) THEN u - CAST(18446744073709551616 AS HUGEINT) ELSE u END AS BIGINT) AS w FROM unsigned)"
)
SQL: dict[str, str] = {
    # published numbers of move sequences
    "chess_perft": "SELECT * FROM (VALUES ('start', 1, 20), ('start', 2, 400), ('start', 3, 8902), ('castling', 1, 48), ('castling', 2, 2039), ('passant', 1, 14), ('passant', 2, 191), ('passant', 3, 2812), ('promotion', 1, 6), ('promotion', 2, 264), ('promotion', 3, 9467), ('mixed', 1, 44), ('mixed', 2, 1486)) v(name, depth, nodes)",
    "word_first_moves": (
        f"WITH w AS (SELECT DISTINCT CASE WHEN regexp_matches(text, '^1\\.\\S') THEN substr(text, 3) ELSE text END AS word FROM bold_source_words WHERE text IS NOT NULL), c AS (SELECT word, {_w._core_sql("regexp_replace(word, '[.,;]+$', '')")} AS k FROM w WHERE {_w._code_sql('word')} IS NOT NULL), "
        f"e AS (SELECT word, 1 AS i, {_w._english_sql('k', 'en')} AS t FROM c UNION ALL SELECT word, 2, {_w._english_sql('k', 'ru')} FROM c), s AS (SELECT word, i, regexp_replace(t, '[+#!?]+$', '') AS t FROM e), "
        f"p AS (SELECT word, i, regexp_extract(t, '{_PARTS}', 1) AS piece, regexp_extract(t, '{_PARTS}', 2) AS f, regexp_extract(t, '{_PARTS}', 3) AS r, regexp_extract(t, '{_PARTS}', 4) AS sign, regexp_extract(t, '{_PARTS}', 5) AS goal FROM s WHERE regexp_matches(t, '{_PARTS}')), "
        f"{_FIRST}, m AS (SELECT word, i, min(legal.uci) AS uci FROM p JOIN legal ON legal.piece = p.piece AND legal.goal = p.goal AND p.f IN ('', legal.f) AND p.r IN ('', legal.r) WHERE p.sign NOT IN ('x', ':') AND NOT (p.piece = '' AND p.r <> '' AND p.f = '') GROUP BY word, i HAVING count(*) = 1) "
        "SELECT word, arg_min(uci, i) AS uci FROM m GROUP BY word"
    ),
    "doc_move_rows": (
        f"WITH lines0 AS (SELECT doc_id AS note_id, generate_subscripts(l, 1) AS line_no, regexp_replace(unnest(l), '^[ |]*(\\d{{1,3}})[ |.\\t]+(\\S)', '\\1. \\2') AS line FROM (SELECT doc_id, string_split(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL)), "
        f"lines AS (SELECT * FROM lines0 WHERE regexp_matches(line, '^\\s*\\d{{1,3}}(\\.|…)')), {_w._TOKENS}, {_w._ROWS}, a AS (SELECT note_id AS doc_id, count(*) FILTER (is_row) AS rows, count(*) FILTER (number IS NOT NULL) AS numbered FROM tr GROUP BY note_id) SELECT doc_id, rows, numbered, rows >= 5 AND rows >= 0.3 * numbered AS is_table FROM a WHERE rows > 0"
    ),
    "note_heads": "SELECT book_id, count(*) AS heads, count(DISTINCT page) AS pages FROM ("
    + _w._heads_sql("lines AS (SELECT doc_id, book_id, page, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT DISTINCT hash(raw) AS doc_id, book AS book_id, coalesce(source_page, 0) AS page, string_split(replace(replace(raw, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM joined_notation WHERE raw IS NOT NULL AND book IS NOT NULL))")
    + ") GROUP BY book_id",
    "note_defects": "SELECT book_id, page, orphans, mixed, backtracks FROM ("
    + _w._defects_sql("notes AS (SELECT DISTINCT CAST(note_id AS VARCHAR) AS book_id, coalesce(source_page, 0) AS page, raw FROM joined_notation WHERE raw IS NOT NULL), lines AS (SELECT {'book_id': book_id, 'page': page} AS doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT book_id, page, string_split(replace(replace(raw, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM notes))").replace("SELECT q.doc_id, coalesce", "SELECT q.doc_id.book_id AS book_id, q.doc_id.page AS page, coalesce")
    + ") WHERE orphans + mixed + backtracks > 0",
    "template_consensus": f"WITH {_CONSENSUS} SELECT label, list(w ORDER BY i) AS words FROM words GROUP BY label",
    "template_classify": (
        f"WITH {_CONSENSUS}, m AS (SELECT label, CAST(string_agg(b, '' ORDER BY pos) AS BIT) AS y FROM major GROUP BY label), t AS (SELECT template_id, any_value(label) AS truth, any_value(CAST(unhex({_HEX}) AS BIT)) AS x FROM coordinates WHERE split <> 'train' AND label IS NOT NULL AND regexp_full_match({_HEX}, '[0-9a-f]{{256}}') GROUP BY template_id), "
        "s AS (SELECT template_id, truth, m.label, 2 * bit_count(x & y) / greatest(bit_count(x) + bit_count(y), 1) AS d FROM t CROSS JOIN m), r AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS nx FROM s WINDOW w AS (PARTITION BY template_id ORDER BY d DESC, label)), v AS (SELECT truth, CASE WHEN d >= 0.86 AND (nx IS NULL OR d - nx >= 0.07) THEN label END AS label FROM r WHERE k = 1) "
        "SELECT CASE WHEN label IS NULL THEN 'none' WHEN label = truth THEN 'right' ELSE 'wrong' END AS verdict, count(*) AS n FROM v GROUP BY 1"
    ),
    "word_repairs": (
        f"WITH RECURSIVE t AS (SELECT DISTINCT text, expected FROM bold_source_words WHERE text IS NOT NULL AND expected IS NOT NULL), s AS (SELECT text, expected, string_split({_w._shape_sql('text')}, '') AS a, string_split({_w._shape_sql('expected')}, '') AS b FROM t), "
        "z AS (SELECT *, len(b) AS m, list_transform(range(0, len(b) + 1), lambda j: coalesce(list_sum(list_transform(b[1:j], lambda x: CASE WHEN x = 'f' THEN 0.5 ELSE 1.0 END)), 0.0)) AS c FROM s), "
        f"d AS (SELECT text, expected, a, b, m, c, 0 AS i, list_transform(c, lambda x: CAST(x AS DOUBLE)) AS r FROM z UNION ALL SELECT text, expected, a, b, m, c, i + 1, {_STEP} FROM d WHERE i < len(a)) SELECT text, expected, round(r[m + 1], 2) AS distance FROM d WHERE i = len(a) AND r[m + 1] > 0"
    ),
}
