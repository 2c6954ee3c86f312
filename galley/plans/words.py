"""Functions of notation, lines and pages run as they stand on the scanned words, notes and documents, with the same in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import notation as N
from ..functions import raster
from ..operators import pages as P
from ..operators import readings as RD
from ..operators import sequences as S
from ..session import table

def _words(spark: SparkSession, d: str) -> DataFrame:
    """(w, n): every distinct scanned word or extract, and how often it is there."""
    t = table(spark, d, "bold_source_words").where("text is not null").select("word_id", F.col("text").alias("w")).distinct()
    return t.groupBy("w").agg(F.count("*").alias("n"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "joined_notation").where("raw is not null").select("note_id", F.col("raw").alias("text")).distinct()


def _note_words(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select(F.explode(L.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return P.explode_lines(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


def word_clean_forms(spark, d):
    return _words(spark, d).select("w", N.spaces_and_dashes(F.col("w")).alias("plain"), N.clean_text(F.col("w")).alias("clean"), N.join_symbols(F.col("w")).alias("joined"))


def note_clean_text(spark, d):
    return _notes(spark, d).select("note_id", F.md5(N.clean_text(F.col("text"))).alias("clean"), F.md5(N.spaces_and_dashes(F.col("text"))).alias("plain"))


def word_english(spark, d):
    """Words with the piece letters of English, read as Russian and as German print."""
    return _words(spark, d).select("w", N.to_english(F.col("w"), "ru").alias("ru"), N.to_english(F.col("w"), "de").alias("de"))


def word_codes(spark, d):
    """The shape of each word, and its move code."""
    return _words(spark, d).select("w", N.shape(F.col("w")).alias("shape"), N.move_code(F.col("w")).alias("code"))


def word_marks(spark, d):
    return _words(spark, d).select("w", N.move_core(F.col("w")).alias("core"), N.suffix(F.col("w")).alias("marks"), N.nag(F.col("w")).alias("nag"), N.evaluation(F.col("w")).alias("evaluation"))


def note_results(spark, d):
    """Results and castlings among the words of notes."""
    t = _note_words(spark, d).select("n", N.result(F.col("w")).alias("result"), N.castling(F.col("w")).alias("castling"))
    return t.where("result is not null or castling is not null").groupBy("result", "castling").agg(F.sum("n").alias("n"))


def word_splits(spark, d):
    """Glued evaluations and glued promotions cut apart."""
    return _words(spark, d).select("w", F.array_join(N.split_evaluation(F.col("w")), "|").alias("evaluation"), F.array_join(N.split_promotion(F.col("w")), "|").alias("promotion"))


def word_repaired(spark, d):
    """Single scanned words repaired."""
    return _words(spark, d).select("w", N.repair_word(F.col("w")).alias("repaired"))


def note_word_repaired(spark, d):
    t = _note_words(spark, d).select("w", N.repair_word(F.col("w")).alias("repaired"), "n")
    return t.where("w <> repaired")


def word_predicates(spark, d):
    return _words(spark, d).select(
        "w", N.valid_notation(F.col("w")).alias("valid"), N.ambiguous_pawn_rank(F.col("w")).alias("vague_rank"), N.resigns(F.col("w")).alias("resigns"), N.says_check(F.col("w")).alias("check"), N.replaced_prefix(F.col("w"), F.lit("♗")).alias("bishop"),
        N.other_line_cue(F.col("w")).alias("cue"), F.size(N.fens(F.col("w"))).alias("fens"), L.sentence_end(F.col("w")).alias("ends"), N.renders_pieces(F.col("w"), "ru").alias("ru"), N.renders_comment(F.col("w")).alias("html"), N.quoted(F.col("w")).alias("quoted"),
    )


def word_conflicts(spark, d):
    """Why the expected reading of a word contradicts the scanned one."""
    t = table(spark, d, "bold_source_words").where("text is not null and expected is not null").select("word_id", "text", "expected").distinct()
    return t.select("word_id", N.alternate_conflict(F.col("text"), F.col("expected")).alias("conflict"), N.alternate_conflict(F.col("expected"), F.col("text")).alias("back"))


def part_number_pairs(spark, d):
    """Row numbers of which one may be a misreading of the other."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("a"), F.floor(F.col("p_retailprice")).cast("bigint").alias("b"))
    return p.select("a", "b", N.digits_off_by_one(F.col("a"), F.col("b")).alias("off_by_one"), N.digits_confusable(F.col("a") % 100 + 10, F.col("b") % 100 + 10).alias("confusable"))


def book_ranges(spark, d):
    b = table(spark, d, "books").select("book_id", F.col("total_pages").alias("t"))
    half = F.floor(F.col("t") / 2).cast("int")
    return b.select("book_id", N.plural(F.col("t"), "page").alias("pages"), N.range_text(F.lit(1), half, F.col("t")).alias("first"), N.range_text(half, F.lit(None).cast("int"), F.col("t")).alias("last"))


def doc_line_flags(spark, d):
    """How many lines of each document are what."""
    x = F.col("line")
    flags = {
        "junk": L.junk_line(x), "numbers": L.page_number_line(x), "headings": L.heading_number(x).isNotNull(), "titles": L.title_number(x).isNotNull(), "chapters": L.chapter_line(x), "credits": L.credit_line(x),
        "draws": L.draw_line(x), "ends": L.sentence_end(x), "outcomes": L.tells_outcome(x), "rows": L.long_rows(x).isNotNull(), "mixed": L.mixed_row(x), "players": L.players(x).isNotNull(),
    }
    return _lines(spark, d).groupBy("doc_id").agg(*(F.count_if(v).alias(k) for k, v in flags.items()))


def doc_players(spark, d):
    """Lines that are two names."""
    p = L.players(F.col("line"))
    return _lines(spark, d).where(p.isNotNull()).select("doc_id", "line_no", p["white"].alias("white"), p["black"].alias("black"))


def doc_head_keys(spark, d):
    """Lines without page numbers and dashes at their ends."""
    k = _lines(spark, d).select(L.head_key(F.col("line")).alias("key"))
    return k.groupBy("key").agg(F.count("*").alias("n"))


def doc_needs_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", L.needs_scan(F.col("text")).alias("needs_scan"))


def doc_language_order(spark, d):
    """Languages of each document by words that look like moves."""
    h = L.language_hits(F.col("text"))
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", *(n.alias(k) for k, n in h.items()), F.array_join(L.language_order(h), " ").alias("languages"))


def book_language(spark, d):
    """The language of each book from three sample pages."""
    p = table(spark, d, "documents").where("text is not null and book_id is not null and file_page is not null").select("book_id", "file_page", "doc_id", "text")
    return RD.page_language(S.sampled(p, ["book_id"], ["file_page", "doc_id"]), ["book_id"])


def note_running_heads(spark, d):
    """Running heads of the scanned pages of each book, as logs name it."""
    p = table(spark, d, "joined_notation").where("raw is not null and book is not null and source_page is not null").select("note_id", F.col("book").alias("book_id"), F.col("source_page").alias("page"), F.col("raw").alias("text")).distinct()
    return P.running_heads(P.explode_lines(p, ["note_id", "book_id", "page"]))


def doc_defects(spark, d):
    """Signs of columns that ran together in documents: headings without a game, mixed rows, row numbers that fall back."""
    return P.page_defects(_lines(spark, d), ["doc_id"])


def doc_sections(spark, d):
    """Events of the lines of documents and the numbered sections they make."""
    return P.numbered_sections(_lines(spark, d), ["doc_id"]).groupBy("doc_id").agg(F.max("section").alias("sections"), F.count_if(F.col("event") == "game_boundary").alias("games"), F.count_if(F.col("event") == "game_result").alias("results"), F.sum("number").alias("numbers"))


def doc_pages(spark, d):
    """Pages of texts with form feeds, three to each, and those from the second on."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.regexp_replace("text", "\n\n", "\f").alias("text"), F.lit(3).alias("total_pages"))
    return P.page_range(P.split_pages(t), "2-").groupBy("page").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("text") == "").alias("blank"))


def note_tokens(spark, d):
    """Tokens of notes by kind."""
    t = P.tokens(P.explode_lines(_notes(spark, d), ["note_id"]), ["note_id"])
    return t.groupBy("note_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("num", "open", "close", "result", "word", "diagram")), F.sum("number").alias("numbers"), F.count_if("black").alias("black"), F.max("pos").alias("last"))


def note_table_rows(spark, d):
    """Lines of notes that are rows of a table of moves."""
    r = P.table_rows(P.tokens(P.explode_lines(_notes(spark, d), ["note_id"]), ["note_id"]), ["note_id"])
    return r.where("is_row").select("note_id", "line_no", "number", "moves")


def note_layout(spark, d):
    r = P.table_rows(P.tokens(P.explode_lines(_notes(spark, d), ["note_id"]), ["note_id"]), ["note_id"])
    return P.table_layout(r, ["note_id"])


def doc_broken_words(spark, d):
    """Words hyphenated across lines of notes, spelled as the words of the documents have it."""
    lex = table(spark, d, "documents").select(F.explode(L.words(F.col("text"))).alias("word")).where(r"word rlike '^\\p{L}+(-\\p{L}+)?$'").distinct()
    return P.broken_words(P.explode_lines(_notes(spark, d), ["note_id"]), ["note_id"], lex).select("note_id", "line_no", "left", "right", "form", "word")


def doc_paragraphs(spark, d):
    """Lines that begin a paragraph: indented after the end of a sentence."""
    x = _lines(spark, d).select("doc_id", F.col("line_no").alias("line"), F.col("line").alias("text"), (F.length("line") - F.length(F.ltrim("line"))).cast("double").alias("x0"))
    return RD.paragraphs(x, ["doc_id"]).groupBy("doc_id").agg(F.count_if("new_paragraph").alias("paragraphs"))


def note_row_context(spark, d):
    """Tokens of notes with the row word and row number that follow within 200."""
    t = P.tokens(P.explode_lines(_notes(spark, d), ["note_id"]), ["note_id"])
    w = Window.partitionBy("note_id").orderBy("line_no", "pos")
    t = t.withColumn("tok", F.row_number().over(w)).withColumn("in_row", F.col("line_no") % 2 == 0)
    c = RD.row_context(t, ["note_id"])
    return c.groupBy("note_id").agg(F.sum("next_row_word").alias("words"), F.sum("next_row").alias("rows"), F.count("*").alias("n"))


def template_dice(spark, d):
    """Each template against the first of its profile and label."""
    t = table(spark, d, "coordinates").where("bitmap is not null and label is not null").select("template_id", "profile", "label", "bitmap").distinct()
    first = t.groupBy("profile", "label").agg(F.min_by("bitmap", F.struct("template_id", "bitmap")).alias("first"))
    s = t.join(first, ["profile", "label"]).select("template_id", F.round(raster.dice(raster.hex_words(F.col("bitmap")), raster.hex_words(F.col("first"))), 9).alias("dice"))
    return s.distinct()


# ---- the same in SQL ----


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tr(c: str, pair: tuple[str, str]) -> str:
    return f"translate({c}, {_q(pair[0])}, {_q(pair[1])})"


def _case(c: str, table_: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {_q(k)} THEN {_q(v) if isinstance(v, str) else v}" for k, v in table_.items()) + " END"


_SHAPE = tuple("".join(x) for x in zip(*((c, k) for k, v in N.SHAPE_OF.items() for c in v)))
_WORDS = "wt AS (SELECT DISTINCT word_id, text FROM bold_source_words WHERE text IS NOT NULL), ws AS (SELECT text AS w FROM wt GROUP BY text)"
_BLANKS = r"[ \t\n\v\f\r]+"
_RAW = "notes AS (SELECT DISTINCT note_id, raw AS text FROM joined_notation WHERE raw IS NOT NULL)"
_SPLIT = "list_filter(regexp_split_to_array({}, '" + _BLANKS + "'), lambda x: x <> '')"
_RAW_WORDS = f"{_RAW}, nw AS (SELECT unnest({_SPLIT.format('text')}) AS w FROM notes)"
_LINES = "lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
_NOTE_LINES = f"{_RAW}, lines AS (SELECT note_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT note_id, string_split(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM notes))"
_MARKS = "[!?+#‡†]*"


def _plain_sql(c: str) -> str:
    return _tr(_tr(c, N.SPACES), N.DASHES)


def _clean_sql(c: str) -> str:
    c = f"replace({c}, chr(173) || chr(10), '')"
    for _ in range(2):
        c = rf"regexp_replace({c}, '([a-hасе][1-8]|[KQRBNКФЛСрCp]) *: +([a-hасе][1-8])', '\1:\2', 'g')"
    return _tr(f"translate({c}, chr(173) || 'ꞏ', '-·')", N.SPACES)


def _english_sql(c: str, lang: str) -> str:
    plain = lambda x: _tr(_tr(_tr(x, N.FIGURINES), N.LOOKALIKES), N.DASHES)
    head = "CASE " + " ".join(f"WHEN starts_with({c}, {_q(s)}) THEN {_q(t)} || substr({c}, {len(s) + 1})" for s, t in N.PIECES[lang]) + f" ELSE {c} END"
    tail = "CASE " + " ".join(f"WHEN regexp_matches(h, '(?:[18]|[a-hасеЬь][:xх]?[a-hасеЬь])=?{s}$') THEN substr(h, 1, length(h) - {len(s)}) || {_q(t)}" for s, t in N.PIECES[lang] if t != "K") + " ELSE h END"
    return f"CASE WHEN regexp_matches({c}, '[♔-♟]') THEN {plain(c)} ELSE {plain(f'(SELECT {tail} FROM (SELECT {head} AS h))')} END"


def _shape_sql(c: str) -> str:
    return f"regexp_replace({_tr(c, _SHAPE)}, '[^\\p{{L}}\\p{{N}}x-]', '?', 'g')"


def _core_sql(c: str) -> str:
    return f"substr({c}, 1, length({c}) - length(regexp_extract({c}, '{_MARKS}$')))"


def _code_sql(c: str) -> str:
    k = _shape_sql(_core_sql(f"regexp_replace({c}, '[.,;]+$', '')"))
    return f"(SELECT CASE WHEN length(k) BETWEEN 2 AND 9 AND (regexp_matches(k, '{N.SQUARE_LIKE}') OR regexp_full_match(k, '{N.LONG_LIKE}')) THEN k END FROM (SELECT {k} AS k))"


def _repair_sql(c: str) -> str:
    """The single-word repairs, one after the other, as nested queries."""
    marked = "^(.*[a-hасе][1-8]|.*9[1-8])([?!17]*[?!][?!17]*)$"
    rook = "^(?:J[17ITil|]{0,2}|1[1Il])([a-hx:i])"
    either = lambda x: "|".join(map(re.escape, sorted(x, key=len, reverse=True)))
    check = rf"([\w\p{{Cyrillic}}?!])(?:{either(N.CHECK_READ)})$"
    digits = "".join(N.NUMBER_READ)
    number = rf"^([0-9{re.escape(digits)}]{{1,3}})([.,]{{1,3}}|…)((?s:.)*)$"
    one = {k: v for k, v in N.NUMBER_READ.items() if len(v) == 1}
    a = f"CASE WHEN regexp_matches({c}, '{marked}') THEN regexp_extract({c}, '{marked}', 1) || translate(regexp_extract({c}, '{marked}', 2), '71', '?!') ELSE {c} END"
    b = rf"regexp_replace(a, '{rook}', 'Л\1')"
    # one of the two check repairs at the end of the word
    e = rf"CASE WHEN regexp_matches(b, '{check}') THEN regexp_replace(b, '{check}', '\1+') WHEN regexp_matches(b, '([1-8])(?:{either(N.CHECK_AFTER_RANK_READ)})$') THEN regexp_replace(b, '([1-8])(?:{either(N.CHECK_AFTER_RANK_READ)})$', '\1+') ELSE b END"
    raw = f"regexp_extract(e, '{number}', 1)"
    f = f"CASE WHEN regexp_matches(e, '{number}') AND regexp_matches({raw}, '[0-9ЗзбИ]') THEN replace(translate({raw}, '{''.join(one)}', '{''.join(one.values())}'), 'И', '11') || translate(regexp_extract(e, '{number}', 2), ',', '.') || regexp_extract(e, '{number}', 3) ELSE e END"
    return f"(SELECT {f} FROM (SELECT {e} AS e FROM (SELECT {b} AS b FROM (SELECT {a} AS a))))"


_STAR = r"\d{1,3}\.{1,3}"
_VALID = rf"^(?:{_STAR})?(?:[a-h][1-8](?:[-:x][a-h][1-8])?|[a-h][x:]?[a-h][1-8]|[a-h][x:]?[a-h][18]=?[QRBN♕♖♗♘]|[KQRBN♔♕♖♗♘][a-h]?[1-8]?[-:x]?[a-h][1-8]|0-0(?:-0)?|{_STAR})[+#]?[!?]*$"
_PROM = rf"^(?:{_STAR})?([a-h])[x:]?([a-h])[18]=?[QRBN♕♖♗♘]"
_RESIGN = ["сдались", "сдался", "сдалась", "сдаются", "сдается", "resigns", "resigned", "resign", "aufgegeben"]
_PREFIX = r"^((?:\d{1,3}\.{1,3})?)[^\p{L}\d_:]{0,2}[^\s\da-h]{0,3}?((?:[a-h]?[1-8]?[x:-])?[a-h][1-8][+#!?.,;]*)$"
_LAST = "([a-h])([1-8])[+#!?.,;]*$"
_FEN = r"((?:[rnbqkpRNBQKP1-8]{1,8}/){7}[rnbqkpRNBQKP1-8]{1,8} [wb] (?:-|[KQkq]{1,4}) (?:-|[a-h][36])(?: \d+ \d+)?)"
_CONFLICT = "CASE WHEN NOT regexp_matches({a}, '" + _LAST + "') OR NOT regexp_matches({b}, '" + _LAST + "') THEN NULL WHEN regexp_matches({a}, '[x:×]') AND NOT regexp_matches({b}, '[x:×]') THEN 'lost_capture' WHEN regexp_extract({a}, '" + _LAST + "', 1) <> regexp_extract({b}, '" + _LAST + "', 1) THEN 'changed_file' WHEN regexp_extract({a}, '" + _LAST + "', 2) <> regexp_extract({b}, '" + _LAST + "', 2) THEN 'changed_rank' END"
_PAIRS = [p for v in N.CONFUSED.values() for p in v.split()]
_BOTH = "[" + ", ".join(_q(x) for p in _PAIRS for x in (p, p[::-1])) + "]"

_LW = _SPLIT.format("line")
_TRIM = "trim(line, ' ')"
_SIGNS = "|".join(re.escape(s).replace("°", "°") for s in sorted(L.GAME_SIGNS, key=len, reverse=True))
_HEADING = rf"^(?i:{_SIGNS})\.?\s*(\d{{1,4}})(?:\.?(?:\s|$))"
_MOVE = r"[\p{L}♔-♟]?[a-hа-н][1-8][—–:-][a-hа-н][1-8][+!?]*"
_PLAINW = r"regexp_replace(x, '^[()\[\]{},;]+|[()\[\]{},;]+$', '', 'g')"
_JUNK = (
    f"len(ws) BETWEEN 1 AND 4 AND len(list_filter(ws, lambda x: regexp_matches(x, '[a-zа-яäöüß]{{4,}}') OR {_tr(_PLAINW, N.DASHES)} IN ({', '.join(map(_q, N.RESULTS))}) OR regexp_matches({_PLAINW}, '^\\d{{1,3}}(?:\\.{{1,3}}|…)') "
    f"OR (length({_PLAINW}) >= 2 AND list_contains(cl, {_PLAINW})))) = 0"
)
_KIND = "CASE WHEN regexp_matches(x, '^\\p{Lu}\\.$') THEN 'I' WHEN list_contains([" + ", ".join(map(_q, L.PARTICLES)) + "], lower(x)) THEN 'P' WHEN x IN ('-', '–', '—') THEN 'D' WHEN regexp_matches(x, '^\\p{Lu}[\\p{L}''’-]{1,30}$') THEN 'S' ELSE 'X' END"
_NAME = "I{0,2}P?S"
_APART = r"regexp_replace(regexp_replace(line, '(^|[^\p{L}\p{N}_])(\p{Lu}\.)(\p{Lu})', '\1\2 \3', 'g'), '( \p{Lu}\.)(\p{Lu})', '\1 \2', 'g')"
_PLAYERS = f"pw AS (SELECT doc_id, line_no, {_SPLIT.format(_APART)} AS w FROM lines), pk AS (SELECT *, list_aggregate(list_transform(w, lambda x: {_KIND}), 'string_agg', '') AS k FROM pw), pl AS (SELECT *, length(regexp_extract(k, '^({_NAME})D?{_NAME}$', 1)) AS a, length(regexp_extract(k, '^{_NAME}D?({_NAME})$', 1)) AS b FROM pk WHERE regexp_full_match(k, '{_NAME}D?{_NAME}'))"
_TOKENS = (
    "ct AS (SELECT note_id, line_no, " + _clean_sql("line") + " AS t FROM lines), "
    "pt AS (SELECT note_id, line_no, replace(replace(replace(t, '[#]', chr(1)), '{#}', chr(2)), '(#)', chr(3)) AS t FROM ct), "
    r"st AS (SELECT note_id, line_no, replace(replace(replace(regexp_replace(t, '([()\[\]{}])', ' \1 ', 'g'), chr(1), '[#]'), chr(2), '{#}'), chr(3), '(#)') AS t FROM pt), "
    r"ut AS (SELECT note_id, line_no, regexp_replace(regexp_replace(regexp_replace(t, '(\d{1,3}(?:\.{1,3}|…))([^\s.…])', '\1 \2', 'g'), '(\d{1,3}(?:\.{1,3}|…))([^\s.…])', '\1 \2', 'g'), '(\d{1,3}(?:\.{1,3}|…))([^\s.…])', '\1 \2', 'g') AS t FROM st), "
    "tk0 AS (SELECT note_id, line_no, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS w FROM (SELECT note_id, line_no, " + _SPLIT.format("t") + " AS l FROM ut)), "
    r"tk AS (SELECT *, CASE WHEN regexp_full_match(w, '\d{1,3}(\.{1,3}|…)') THEN 'num' WHEN w IN ('(', '[', '{') THEN 'open' WHEN w IN (')', ']', '}') THEN 'close' WHEN w IN ('[#]', '(D)', '{#}') THEN 'diagram' WHEN starts_with(w, '__BOARD_') THEN 'board' WHEN "
    + _tr("regexp_replace(w, '[.,;]+$', '')", N.DASHES) + " IN (" + ", ".join(map(_q, N.RESULTS)) + r") THEN 'result' ELSE 'word' END AS kind, CASE WHEN regexp_matches(w, '^\d{1,3}(\.{1,3}|…)') THEN CAST(regexp_extract(w, '^(\d{1,3})', 1) AS INT) END AS number, CASE WHEN regexp_matches(w, '^\d{1,3}(\.{1,3}|…)') THEN regexp_extract(w, '^\d{1,3}(\.{1,3}|…)', 1) IN ('...', '…') END AS black FROM tk0)"
)
_ROWS = (
    "cd AS (SELECT w, " + _code_sql("w") + " AS code FROM (SELECT DISTINCT w FROM tk WHERE kind = 'word')), "
    "rw AS (SELECT note_id, line_no, arg_min(number, pos) FILTER (number IS NOT NULL OR true) AS number0, list(number ORDER BY pos)[1] AS number, count(*) FILTER (kind = 'num') AS nums, arg_min(kind, pos) AS first, count(*) FILTER (kind = 'word') AS words, count(*) FILTER (kind IN ('open', 'close')) AS brackets, "
    "bool_and(kind <> 'word' OR code IS NOT NULL OR length(w) <= 3) AS fit, count(*) FILTER (kind = 'word' AND code IS NOT NULL) AS moves FROM tk LEFT JOIN cd USING (w) GROUP BY note_id, line_no), "
    "tr AS (SELECT *, first = 'num' AND nums = 1 AND words BETWEEN 1 AND 4 AND fit AND moves >= 1 AND brackets = 0 AS is_row FROM rw)"
)
_TOP = "top AS (SELECT DISTINCT d.book_id, d.file_page AS page, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT book_id, file_page, string_split(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL AND book_id IS NOT NULL AND file_page IS NOT NULL) d)"

_OUTCOME = "regexp_matches(lower({}), 'сдал|resign|ничья|draw')"


def _is_players(c: str) -> str:
    parts = _SPLIT.format(_APART.replace("line", c))
    return f"coalesce(regexp_full_match(list_aggregate(list_transform({parts}, lambda x: {_KIND}), 'string_agg', ''), '{_NAME}D?{_NAME}'), false)"


_IS_CHAPTER = f"coalesce((lower(ws[1]) = 'глава' AND (regexp_matches(lower(ws[2]), '^[ivxlc\\d]+$') OR lower(ws[2]) IN ({', '.join(map(_q, L.ORDINALS))}))) OR (lower(ws[1]) IN ('chapter', 'kapitel', 'capítulo') AND len(ws) >= 2), false)"
_OPENING = "(?:^|[^0-9])" + L.OPENING.removeprefix(r"(?<!\d)")
_EVENTS = (
    f"x AS (SELECT doc_id, line_no, line, {_LW} AS ws, regexp_matches({_TRIM}, '{_HEADING}') AS head FROM lines), y AS (SELECT *, {_IS_CHAPTER} AND NOT head AND NOT {_is_players('line')} AS chapter FROM x), "
    "h AS (SELECT doc_id, line_no, (SELECT min(s.line_no) FROM y s WHERE s.doc_id = y.doc_id AND s.line_no > y.line_no AND (s.head OR s.chapter)) AS stop FROM y WHERE head), "
    "f AS (SELECT h.doc_id, h.line_no, string_agg(n.line, ' ' ORDER BY n.line_no) AS t FROM h LEFT JOIN lines n ON n.doc_id = h.doc_id AND n.line_no > h.line_no AND n.line_no <= h.line_no + 25 AND (h.stop IS NULL OR n.line_no < h.stop) GROUP BY 1, 2), "
    f"b AS (SELECT doc_id, line_no, coalesce(regexp_matches(t, '{_OPENING}') OR contains(t, '__BOARD_') OR regexp_matches(t, '{_FEN}'), false) AS game FROM f)"
)
_CREDIT = f"coalesce(ws[1] IN ({', '.join(map(_q, L.CREDIT_WORDS))}) AND (regexp_matches(ws[2], '^\\p{{Lu}}') OR ws[2] = 'автора'), false)"
_DRAW = f"lower(regexp_replace(trim(line), '[.!?]$', '')) IN ({', '.join(map(_q, L.DRAW_LINES))})"
_PAGE_LINES = "lines AS (SELECT doc_id, book_id, page, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT DISTINCT note_id AS doc_id, book AS book_id, source_page AS page, string_split(replace(replace(raw, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM joined_notation WHERE raw IS NOT NULL AND book IS NOT NULL AND source_page IS NOT NULL))"


def _kept(k: str) -> str:
    return f"(length({k}) >= 80 OR regexp_matches({k}, '{_HEADING}') OR regexp_matches({k}, '\\d+\\s*\\.') OR {_OUTCOME.format(k)} OR {_is_players(k)})"



def _defects_sql(lines: str) -> str:
    return f"WITH {lines}, {_EVENTS}, o AS (SELECT doc_id, count(*) FILTER (NOT game) AS orphans FROM b GROUP BY doc_id), q AS (SELECT doc_id, count(*) FILTER (len(list_filter(ws, lambda x: regexp_full_match(x, '\\d{{1,3}}\\.'))) >= 2 AND len(list_filter(ws, lambda x: regexp_matches(x, '{_MOVE}'))) >= 3) AS mixed FROM x GROUP BY doc_id), s AS (SELECT doc_id, line_no, ws, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec FROM x), r AS (SELECT doc_id, sec, line_no, CAST(regexp_extract(ws[1], '\\d+') AS INT) AS n FROM s WHERE regexp_matches(ws[1], '^\\d{{1,3}}\\.$') AND len(list_filter(ws[2:], lambda x: regexp_matches(x, '{_MOVE}'))) > 0 AND len(list_filter(ws[2:], lambda x: NOT regexp_full_match(x, '(?:{_MOVE})[.!?…]*') AND NOT regexp_full_match(x, '[.!?…—–-]+'))) = 0), t AS (SELECT doc_id, n, lag(n) OVER (PARTITION BY doc_id, sec ORDER BY line_no) AS p FROM r), k AS (SELECT doc_id, count(*) FILTER (n < p - 1) AS backtracks FROM t GROUP BY doc_id) SELECT q.doc_id, coalesce(orphans, 0) AS orphans, mixed, coalesce(backtracks, 0) AS backtracks FROM q LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)"


def _heads_sql(lines: str) -> str:
    """Running heads of ``lines`` (doc_id, book_id, page, line_no, line)."""
    return (
        f"WITH {lines}, top AS (SELECT doc_id, book_id, page, line_no, line, trim(line, '0123456789–—- ' || chr(9)) AS key, {_LW} AS w FROM lines WHERE line_no <= 2 AND trim(line, ' ') <> ''), "
        "often AS (SELECT book_id, key FROM top WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2), "
        f"r AS (SELECT top.*, {_SPLIT.format('key')} AS ws FROM top), c AS (SELECT book_id, page, line_no, key FROM r WHERE (EXISTS (SELECT 1 FROM often o WHERE o.book_id = r.book_id AND o.key = r.key) AND len(ws) >= 2) OR {_IS_CHAPTER}), "
        f"k AS (SELECT book_id, page, line_no FROM c WHERE NOT {_kept('key')}), "
        "m0 AS (SELECT *, regexp_full_match(w[1], '\\d{1,4}') AND w[2] IN ('-', '–', '—') AS front, regexp_full_match(w[len(w)], '\\d{1,4}') AND w[len(w) - 1] IN ('-', '–', '—') AS back FROM top WHERE len(w) >= 4), "
        "m1 AS (SELECT *, CAST(CASE WHEN front THEN w[1] ELSE w[len(w)] END AS INT) AS counter, array_to_string(CASE WHEN front THEN w[3:] ELSE w[1:len(w) - 2] END, ' ') AS title FROM m0 WHERE front OR back), "
        f"m AS (SELECT * FROM m1 WHERE len({_SPLIT.format('title')}) >= 2 AND NOT {_is_players('title')} AND NOT regexp_matches(title, '\\d') AND NOT {_OUTCOME.format('title')}), "
        "g AS (SELECT book_id, page, line_no, page - lag(page) OVER v AS b, lead(page) OVER v - page AS a FROM m WINDOW v AS (PARTITION BY book_id, counter - page ORDER BY page)) "
        "SELECT DISTINCT book_id, page, CAST(line_no AS INT) AS line_no FROM (SELECT * FROM k UNION ALL SELECT book_id, page, line_no FROM g WHERE b BETWEEN 1 AND 2 OR a BETWEEN 1 AND 2)"
        )


SQL = {
    "note_running_heads": _heads_sql(_PAGE_LINES),
    "doc_defects": _defects_sql(_LINES),
    "doc_sections": f"WITH {_LINES}, {_EVENTS}, e AS (SELECT y.doc_id, y.line_no, coalesce(b.game, false) AS game, y.chapter OR (NOT head AND NOT {_is_players('y.line')} AND NOT chapter AND {_CREDIT}) AS ends, NOT head AND NOT {_is_players('y.line')} AND NOT chapter AND NOT {_CREDIT} AND {_DRAW} AS draw, CASE WHEN b.game THEN CAST(regexp_extract({_TRIM.replace('line', 'y.line')}, '{_HEADING}', 1) AS INT) END AS number FROM y LEFT JOIN b ON b.doc_id = y.doc_id AND b.line_no = y.line_no) SELECT doc_id, count(*) FILTER (game OR ends) AS sections, count(*) FILTER (game) AS games, count(*) FILTER (draw) AS results, CAST(sum(number) AS BIGINT) AS numbers FROM e GROUP BY doc_id",
    "word_clean_forms": f"WITH {_WORDS} SELECT w, {_plain_sql('w')} AS plain, {_clean_sql('w')} AS clean, regexp_replace(w, '([♔-♟]) +([a-h]?[1-8]?x?[a-h][1-8])', '\\1\\2', 'g') AS joined FROM ws",
    "note_clean_text": f"WITH {_RAW} SELECT note_id, md5({_clean_sql('text')}) AS clean, md5({_plain_sql('text')}) AS plain FROM notes",
    "word_english": f"WITH {_WORDS} SELECT w, {_english_sql('w', 'ru')} AS ru, {_english_sql('w', 'de')} AS de FROM ws",
    "word_codes": f"WITH {_WORDS} SELECT w, {_shape_sql('w')} AS shape, {_code_sql('w')} AS code FROM ws",
    "word_marks": f"WITH {_WORDS} SELECT w, {_core_sql('w')} AS core, regexp_extract(w, '{_MARKS}$') AS marks, {_case(f'''regexp_replace(regexp_extract(w, '{_MARKS}$'), '[+#‡†]', '', 'g')''', N.NAGS)} AS nag, {_case('w', N.NAGS | N.EVALUATIONS)} AS evaluation FROM ws",
    "note_results": f"WITH {_RAW_WORDS}, r AS (SELECT {_case(_tr('w', N.DASHES), N.RESULTS)} AS result, CASE WHEN regexp_full_match({_tr('w', N.DASHES)}, '[0OОо]-[0OОо]-[0OОо]') THEN 'O-O-O' WHEN regexp_full_match({_tr('w', N.DASHES)}, '[0OОо]-[0OОо]') THEN 'O-O' END AS castling FROM nw) SELECT result, castling, count(*) AS n FROM r WHERE result IS NOT NULL OR castling IS NOT NULL GROUP BY 1, 2",
    "word_splits": (
        f"WITH {_WORDS}, d AS (SELECT w, {_tr('w', N.DASHES)} AS t FROM ws) SELECT w, CASE WHEN regexp_matches(t, '^(.*[a-hасе][1-8][!?+#]*)(\\+-|-\\+)([.,;)\\]}}]*)$') THEN substr(w, 1, length(regexp_extract(t, '^(.*[a-hасе][1-8][!?+#]*)(\\+-|-\\+)([.,;)\\]}}]*)$', 1))) || '|' || regexp_extract(t, '^(.*[a-hасе][1-8][!?+#]*)(\\+-|-\\+)([.,;)\\]}}]*)$', 2) || regexp_extract(t, '^(.*[a-hасе][1-8][!?+#]*)(\\+-|-\\+)([.,;)\\]}}]*)$', 3) ELSE w END AS evaluation, "
        "regexp_replace(w, '^((?:\\d{1,3}\\.{1,3})?[a-hасе](?:[27]?[-x:][a-hасе])?[18]=?[QRBN♕♛♖♜♗♝♘♞][!?+#]*)(\\d{1,3}\\.{1,3}[KQRBN♔♚♕♛♖♜♗♝♘♞]?[a-hасе1-8]?[x:]?[a-hасе][1-8][!?+#]*[.,;]?)$', '\\1|\\2') AS promotion FROM d"
    ),
    "word_repaired": f"WITH {_WORDS} SELECT w, {_repair_sql('w')} AS repaired FROM ws",
    "note_word_repaired": f"WITH {_RAW_WORDS}, g AS (SELECT w, count(*) AS n FROM nw GROUP BY w), r AS (SELECT w, {_repair_sql('w')} AS repaired, n FROM g) SELECT * FROM r WHERE w <> repaired",
    "word_predicates": (
        f"WITH {_WORDS}, c AS (SELECT w, lower(regexp_replace(w, '[^\\p{{L}}-]+', '', 'g')) AS low FROM ws) SELECT w, regexp_matches(w, '{_VALID}') AND (NOT regexp_matches(w, '{_PROM}') OR abs(ascii(regexp_extract(w, '{_PROM}', 1)) - ascii(regexp_extract(w, '{_PROM}', 2))) = 1) AS valid, "
        f"regexp_matches(w, '^(?:{_STAR})?[a-h][1-8][-—–:][a-h][^1-8\\s]$') AND regexp_extract(w, '([a-h])[1-8][-—–:]', 1) = regexp_extract(w, '[1-8][-—–:]([a-h])', 1) AS vague_rank, "
        f"list_contains([{', '.join(map(_q, _RESIGN))}], low) OR (ends_with(low, '-') AND length(regexp_replace(low, '-$', '')) >= 3 AND len(list_filter([{', '.join(map(_q, _RESIGN))}], lambda x: starts_with(x, regexp_replace(low, '-$', '')))) > 0) AS resigns, "
        f"contains(w, '+') OR contains(substr(w, 2, 1000), '#') AS check, CASE WHEN regexp_matches(w, '{_PREFIX}') THEN regexp_extract(w, '{_PREFIX}', 1) || '♗' || regexp_extract(w, '{_PREFIX}', 2) END AS bishop, "
        "regexp_matches(lower(w), '(однако|но|однако после|вместо|but|however|instead|jedoch|aber|stattdessen)[^A-Za-z0-9_]*(?:\\S+[^A-Za-z0-9_]*){0,2}$') AS cue, "
        f"CAST(len(regexp_extract_all(w, '{_FEN}')) AS INT) AS fens, regexp_matches(w, '[.!?…][\"''»”)]?\\s*$') AS ends, replace(translate(w, 'QRBN', 'ФЛСК'), 'K', 'Кр') AS ru, trim(replace(replace(replace(replace(replace(regexp_replace(w, '\\[%[^\\]]*\\]', '', 'g'), '[#]', ''), '{{#}}', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html, '\"' || replace(replace(w, '\\', '\\\\'), '\"', '\\\"') || '\"' AS quoted FROM c"
    ),
    "word_conflicts": f"WITH t AS (SELECT DISTINCT word_id, text, expected FROM bold_source_words WHERE text IS NOT NULL AND expected IS NOT NULL) SELECT word_id, {_CONFLICT.format(a='text', b='expected')} AS conflict, {_CONFLICT.format(a='expected', b='text')} AS back FROM t",
    "part_number_pairs": f"WITH p AS (SELECT p_partkey AS a, CAST(floor(p_retailprice) AS BIGINT) AS b, CAST(p_partkey % 100 + 10 AS VARCHAR) AS x, CAST(CAST(floor(p_retailprice) AS BIGINT) % 100 + 10 AS VARCHAR) AS y FROM part) SELECT a, b, abs(length(CAST(a AS VARCHAR)) - length(CAST(b AS VARCHAR))) <= 1 AND levenshtein(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) <= 1 AND (length(CAST(a AS VARCHAR)) = length(CAST(b AS VARCHAR)) OR levenshtein(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) = 1) AS off_by_one, length(x) = length(y) AND len(list_filter(range(1, CAST(length(x) AS BIGINT) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1) AND NOT list_contains({_BOTH}, substr(x, i, 1) || substr(y, i, 1)))) = 0 AS confusable FROM p",
    "book_ranges": "WITH b AS (SELECT book_id, total_pages AS t, total_pages // 2 AS h FROM books) SELECT book_id, t || ' page' || CASE WHEN t = 1 THEN '' ELSE 's' END AS pages, CASE WHEN h >= t THEN 'all pages' WHEN h = 1 THEN 'page 1' ELSE 'pages 1-' || h END AS first, CASE WHEN h <= 1 THEN 'all pages' WHEN h = t THEN 'page ' || h ELSE 'pages ' || h || '-' || t END AS last FROM b",
    "doc_line_flags": (
        f"WITH {_LINES}, k0 AS (SELECT doc_id, line_no, line, {_LW} AS ws FROM lines), codes AS (SELECT w FROM (SELECT DISTINCT {_PLAINW.replace('x,', 'u,')} AS w FROM (SELECT unnest(ws) AS u FROM k0 WHERE len(ws) BETWEEN 1 AND 4)) WHERE {_code_sql('w')} IS NOT NULL), {_PLAYERS}, "
        f"cls AS (SELECT coalesce(list(w), []) AS cl FROM codes), k AS (SELECT k0.*, {_JUNK} AS junk, pl.k IS NOT NULL AS pair FROM k0 JOIN cls ON true LEFT JOIN pl ON pl.doc_id = k0.doc_id AND pl.line_no = k0.line_no) SELECT doc_id, count(*) FILTER (junk) AS junk, count(*) FILTER (regexp_matches(line, '^\\s*\\d+\\s*$')) AS numbers, count(*) FILTER (regexp_matches({_TRIM}, '{_HEADING}')) AS headings, "
        "count(*) FILTER (regexp_matches(ws[1], '^\\d{1,3}\\.$') AND regexp_matches(trim(substr(trim(line), length(ws[1]) + 1)), '^\\p{Lu}') AND NOT regexp_matches(trim(substr(trim(line), length(ws[1]) + 1)), '\\d') AND length(trim(substr(trim(line), length(ws[1]) + 1))) BETWEEN 4 AND 91) AS titles, "
        f"count(*) FILTER ((lower(ws[1]) = 'глава' AND (regexp_matches(lower(ws[2]), '^[ivxlc\\d]+$') OR lower(ws[2]) IN ({', '.join(map(_q, L.ORDINALS))}))) OR (lower(ws[1]) IN ('chapter', 'kapitel', 'capítulo') AND len(ws) >= 2)) AS chapters, "
        f"count(*) FILTER (ws[1] IN ({', '.join(map(_q, L.CREDIT_WORDS))}) AND (regexp_matches(ws[2], '^\\p{{Lu}}') OR ws[2] = 'автора')) AS credits, count(*) FILTER (lower(regexp_replace(trim(line), '[.!?]$', '')) IN ({', '.join(map(_q, L.DRAW_LINES))})) AS draws, "
        "count(*) FILTER (regexp_matches(line, '[.!?…][\"''»”)]?\\s*$')) AS ends, count(*) FILTER (regexp_matches(lower(line), 'сдал|resign|ничья|draw')) AS outcomes, "
        f"count(*) FILTER (regexp_matches(ws[1], '^\\d{{1,3}}\\.$') AND len(list_filter(ws[2:], lambda x: regexp_matches(x, '{_MOVE}'))) > 0 AND len(list_filter(ws[2:], lambda x: NOT regexp_full_match(x, '(?:{_MOVE})[.!?…]*') AND NOT regexp_full_match(x, '[.!?…—–-]+'))) = 0) AS rows, "
        f"count(*) FILTER (len(list_filter(ws, lambda x: regexp_full_match(x, '\\d{{1,3}}\\.'))) >= 2 AND len(list_filter(ws, lambda x: regexp_matches(x, '{_MOVE}'))) >= 3) AS mixed, count(*) FILTER (pair) AS players FROM k GROUP BY doc_id"
    ),
    "doc_players": f"WITH {_LINES}, {_PLAYERS} SELECT doc_id, CAST(line_no AS INT) AS line_no, array_to_string(w[1:a], ' ') AS white, array_to_string(w[len(w) - b + 1:], ' ') AS black FROM pl",
    "doc_head_keys": f"WITH {_LINES} SELECT trim(line, '0123456789–—- ' || chr(9)) AS key, count(*) AS n FROM lines GROUP BY 1",
    "doc_needs_scan": "WITH b AS (SELECT doc_id, text, length(regexp_replace(text, '[^\\x{FFFD}\\x{E000}-\\x{F8FF}]', '', 'g')) AS bad FROM documents) SELECT doc_id, text IS NULL OR trim(text, ' ') = '' OR (bad >= 3 AND bad > length(text) * 0.05) AS needs_scan FROM b",
    "doc_language_order": f"WITH t AS (SELECT doc_id, {_SPLIT.format('text')} AS ws FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, " + ", ".join(f"CAST(len(list_filter(ws, lambda x: regexp_matches(x, '{p}'))) AS INT) AS {k}" for k, p in N.HINTS.items()) + " FROM t) SELECT doc_id, en, ru, de, CASE WHEN en >= ru AND en >= de THEN CASE WHEN ru >= de THEN 'en ru de' ELSE 'en de ru' END WHEN ru >= de THEN CASE WHEN en >= de THEN 'ru en de' ELSE 'ru de en' END WHEN en >= ru THEN 'de en ru' ELSE 'de ru en' END AS languages FROM h",
    "book_language": (
        "WITH p AS (SELECT book_id, text, row_number() OVER w - 1 AS i, greatest(count(*) OVER (PARTITION BY book_id) // 3, 1) AS step FROM documents WHERE text IS NOT NULL AND book_id IS NOT NULL AND file_page IS NOT NULL WINDOW w AS (PARTITION BY book_id ORDER BY file_page, doc_id)), "
        f"s AS (SELECT book_id, text, row_number() OVER (PARTITION BY book_id ORDER BY i) AS k FROM p WHERE i >= step // 2 AND (i - step // 2) % step = 0), t AS (SELECT book_id, text, {_SPLIT.format('text')} AS ws FROM s WHERE k <= 3), "
        "a AS (SELECT book_id, " + ", ".join(f"sum(len(list_filter(ws, lambda x: regexp_matches(x, '{p}')))) AS {k}" for k, p in N.HINTS.items()) + ", sum(length(regexp_replace(text, '[^\\p{L}]', '', 'g'))) AS letters, sum(length(regexp_replace(text, '[^\\p{Cyrillic}]', '', 'g'))) AS cyrillic, sum(len(list_filter(ws, lambda x: lower(x) IN ('und', 'der', 'die', 'nicht') OR regexp_matches(x, '[äöüß]')))) AS german FROM t GROUP BY book_id), "
        "b AS (SELECT *, greatest(en, ru, de) AS m, en + ru + de - greatest(en, ru, de) - least(en, ru, de) AS s FROM a) SELECT book_id, CASE WHEN m >= 5 AND m > 2 * s THEN CASE WHEN en = m THEN 'en' WHEN ru = m THEN 'ru' ELSE 'de' END WHEN letters > 0 AND cyrillic > 0.2 * letters THEN 'ru' WHEN german >= 3 THEN 'de' ELSE 'en' END AS lang FROM b"
    ),
    "doc_pages": "WITH t AS (SELECT string_split(replace(text, chr(10) || chr(10), chr(12)), chr(12)) AS l FROM documents), p AS (SELECT g AS page, coalesce(l[g], '') AS text FROM t, (VALUES (2), (3)) v(g)) SELECT page, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (text = '') AS blank FROM p GROUP BY page",
    "note_tokens": f"WITH {_NOTE_LINES}, {_TOKENS} SELECT note_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS \"{k}\"" for k in ("num", "open", "close", "result", "word", "diagram")) + ", CAST(sum(number) AS BIGINT) AS numbers, count(*) FILTER (black) AS black, CAST(max(pos) AS INT) AS last FROM tk GROUP BY note_id",
    "note_table_rows": f"WITH {_NOTE_LINES}, {_TOKENS}, {_ROWS} SELECT note_id, CAST(line_no AS INT) AS line_no, number, moves FROM tr WHERE is_row",
    "note_layout": f"WITH {_NOTE_LINES}, {_TOKENS}, {_ROWS}, a AS (SELECT note_id, count(*) FILTER (is_row) AS rows, count(*) FILTER (number IS NOT NULL) AS numbered FROM tr GROUP BY note_id) SELECT note_id, rows, numbered, rows >= 5 AND rows >= 0.3 * numbered AS is_table FROM a",
    "doc_broken_words": (
        f"WITH {_NOTE_LINES}, lex AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest({_SPLIT.format('text')}) AS w FROM documents) WHERE regexp_full_match(w, '\\p{{L}}+(-\\p{{L}}+)?')), "
        "p AS (SELECT note_id, line_no, regexp_extract(line, '(\\p{L}+)-\\s*$', 1) AS l, regexp_extract(lead(line) OVER (PARTITION BY note_id ORDER BY line_no), '^\\s*(\\p{Ll}\\p{L}*)', 1) AS r FROM lines), f AS (SELECT note_id, line_no, l, r, 'joined' AS form, lower(l || r) AS word FROM p WHERE l <> '' AND r <> '' UNION ALL SELECT note_id, line_no, l, r, 'hyphen', lower(l || '-' || r) FROM p WHERE l <> '' AND r <> '') "
        "SELECT note_id, CAST(line_no AS INT) AS line_no, l AS \"left\", r AS \"right\", min(form) AS form, min(f.word) AS word FROM f JOIN lex ON lex.word = f.word GROUP BY 1, 2, 3, 4 HAVING count(*) = 1"
    ),
    "doc_paragraphs": f"WITH {_LINES}, x AS (SELECT doc_id, line_no, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS p, length(line) - length(ltrim(line, ' ')) AS x0 FROM lines), m AS (SELECT *, x0 - min(x0) OVER (PARTITION BY doc_id) AS i FROM x) SELECT doc_id, count(*) FILTER (regexp_matches(p, '[.!?…][\"''»”)]?\\s*$') AND i BETWEEN 7 AND 22) AS paragraphs FROM m GROUP BY doc_id",
    "note_row_context": (
        f"WITH {_NOTE_LINES}, {_TOKENS}, cd AS (SELECT w, {_code_sql('w')} AS code FROM (SELECT DISTINCT w FROM tk WHERE kind = 'word')), n AS (SELECT note_id, kind, code, line_no % 2 = 0 AS in_row, row_number() OVER (PARTITION BY note_id ORDER BY line_no, pos) AS tok FROM tk LEFT JOIN cd USING (w)), "
        "c AS (SELECT note_id, min(CASE WHEN kind = 'word' AND code IS NOT NULL AND in_row THEN tok END) OVER w AS a, min(CASE WHEN kind = 'num' AND in_row THEN tok END) OVER w AS b FROM n WINDOW w AS (PARTITION BY note_id ORDER BY tok ROWS BETWEEN 1 FOLLOWING AND 200 FOLLOWING)) SELECT note_id, CAST(sum(a) AS BIGINT) AS words, CAST(sum(b) AS BIGINT) AS rows, count(*) AS n FROM c GROUP BY note_id"
    ),
    "template_dice": (
        "WITH t AS (SELECT DISTINCT template_id, profile, label, bitmap FROM coordinates WHERE bitmap IS NOT NULL AND label IS NOT NULL), f AS (SELECT profile, label, arg_min(bitmap, (template_id, bitmap)) AS first FROM t GROUP BY 1, 2), "
        "h AS (SELECT template_id, regexp_replace(regexp_replace(lower(trim(bitmap)), '^0x', ''), '[\\s:_,-]+', '', 'g') AS a, regexp_replace(regexp_replace(lower(trim(first)), '^0x', ''), '[\\s:_,-]+', '', 'g') AS b FROM t JOIN f ON t.profile IS NOT DISTINCT FROM f.profile AND t.label = f.label WHERE t.profile IS NOT NULL), "
        "g AS (SELECT template_id, CASE WHEN regexp_full_match(a, '[0-9a-f]{256}') AND regexp_full_match(b, '[0-9a-f]{256}') THEN CAST(unhex(a) AS BIT) END AS x, CASE WHEN regexp_full_match(a, '[0-9a-f]{256}') AND regexp_full_match(b, '[0-9a-f]{256}') THEN CAST(unhex(b) AS BIT) END AS y FROM h) "
        "SELECT DISTINCT template_id, CASE WHEN bit_count(x) + bit_count(y) > 0 THEN round(2.0 * bit_count(x & y) / (bit_count(x) + bit_count(y)), 9) END AS dice FROM g"
    ),
}
QUERIES = {name: globals()[name] for name in SQL}
