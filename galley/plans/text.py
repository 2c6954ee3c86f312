"""Queries on page text: lines, running heads, tokens, languages, damage, sections, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import notation as N
from ..operators import matching as M
from ..operators import nested
from ..operators import pages as P
from ..operators import sequences as S
from ..session import table
from . import records as stored

BLANK = r"[ \n\t\r]+"


def _words(c):
    return F.filter(F.split(c, BLANK), lambda w: w != "")


def _doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return P.explode_lines(table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "text"), ["doc_id", "lang"])


_LINES = "lines AS (SELECT doc_id, lang, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, lang, string_split(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
_NWORDS = r"len(list_filter(regexp_split_to_array({}, '[ \n\t\r]+'), lambda w: w <> ''))"


def doc_lines_profile(spark, d):
    return _doc_lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.regexp_replace("line", "[ \t]+", "") != "").alias("n_text_lines"), F.sum(F.size(_words(F.col("line")))).alias("n_words"), F.max(F.length("line")).alias("longest"))


def doc_header_clean(spark, d):
    """Lines left per language after repeated first lines went, the shape of a book without running heads.  Texts are cut into
    lines once; only the first two lines of each meet the repeated ones."""
    split = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "lang", split.alias("l"))
    top = docs.select("doc_id", F.posexplode(F.slice("l", 1, 2)).alias("at", "line")).withColumn("key", F.regexp_replace("line", "^[0-9 ]+|[0-9 ]+$", ""))
    head = top.where((F.length("key") < 80) & (F.size(_words(F.col("key"))) >= 2))
    often = head.groupBy("key").agg(F.countDistinct("doc_id").alias("docs")).where("docs >= 2").select("key")
    drop = head.join(often, "key").groupBy("doc_id").agg(F.count("*").alias("gone"), F.sum(F.size(_words(F.col("line")))).alias("gone_words"))
    left = docs.select("doc_id", "lang", F.size("l").alias("n"), F.aggregate(F.transform("l", lambda x: F.size(_words(x))), F.lit(0), lambda s, n: s + n).alias("w")).join(drop, "doc_id", "left").na.fill(0, ["gone", "gone_words"])
    kept = left.where("n > gone").withColumn("lines", F.col("n") - F.col("gone")).withColumn("words", F.col("w") - F.col("gone_words"))
    return kept.groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.countDistinct("doc_id").alias("docs"), F.sum("lines").alias("lines"), F.sum("words").alias("words"))


def doc_token_kinds(spark, d):
    w = _doc_lines(spark, d).select(F.explode(_words(F.col("line"))).alias("w"))
    kind = F.when(w.w.rlike(r"^\d{1,3}(\.{1,3}|…)$"), "number").when(w.w.rlike("^(1-0|0-1|1/2-1/2|½-½)$"), "result").when(w.w.rlike(r"^\d+$"), "digits").when(w.w.rlike(r"^(\d{1,3}\.{1,3})?[KQRBN♔♕♖♗♘]?[a-h]?[1-8]?[x:-]?[a-h][1-8][+#!?.,]*$"), "move").when(w.w.rlike(r"[a-zа-яäöüß]{4,}"), "word").otherwise("other")
    return w.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def doc_lang_vote(spark, d):
    """Words that look like moves, per language hint, and the language that a document's text speaks for."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "text")
    # what runs of letters leave over: a run is one replacement
    letters = lambda c: F.length("text") - F.length(F.regexp_replace("text", f"[{c}]+", ""))
    share = letters("а-яА-ЯёЁ") / F.greatest(letters("a-zA-Zа-яА-ЯёЁ"), F.lit(1))
    count = lambda own: F.size(F.filter("ws", lambda w: w.isin(*own.split())))
    hits = {k: count(own) for k, own in (("en", "the and of that was"), ("de", "der die und das nicht"), ("es", "la de el que con"))}
    vote = F.when(share > 0.2, "ru").when((hits["de"] > hits["en"]) & (hits["de"] >= hits["es"]), "de").when((hits["es"] > hits["en"]) & (hits["es"] > hits["de"]), "es").when(hits["en"] > 0, "en").otherwise("none")
    return docs.withColumn("ws", F.split("text", BLANK)).groupBy(F.coalesce("lang", F.lit("?")).alias("lang"), vote.alias("vote")).agg(F.count("*").alias("n"))


def doc_junk_lines(spark, d):
    """Lines of one to four words none of which is a real word, a number or a result."""
    real = lambda w: w.rlike("[a-zа-яäöüß]{4,}") | w.rlike(r"^\d{1,3}(\.{1,3}|…)") | w.rlike("^(1-0|0-1|1/2-1/2|½-½)$")
    ws = _words(F.col("line"))
    return _doc_lines(spark, d).groupBy("doc_id").agg(F.count_if(F.size(ws).between(1, 4) & ~F.exists(ws, real)).alias("junk"), F.count("*").alias("n")).where("junk > 0")


def doc_damage_ratio(spark, d):
    t = table(spark, d, "documents")
    bad = F.length(F.regexp_replace("text", "[^�]", ""))
    return t.select("doc_id", F.coalesce(bad, F.lit(0)).alias("damaged"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), (F.col("text").isNull() | (F.col("text") == "") | ((bad >= 3) & (bad > F.length("text") * 0.05))).alias("needs_scan"))


def doc_wrap_candidates(spark, d):
    """Lines that stop inside a sentence: no end mark, and the next line goes on in lower case."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = _doc_lines(spark, d).withColumn("next", F.lead("line").over(w))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("line").rlike("[a-zа-яёäöüßáéíóúñ,]$") & F.col("next").rlike("^[a-zа-яёäöüßáéíóúñ]")).alias("wraps")).where("wraps > 0")


def doc_fingerprint_dups(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def doc_resume_plan(spark, d):
    """Documents of the second half of sources, of which those with known text need no work."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"), "source")
    done = t.where("source like 'scan/%'").select(F.col("doc_id").alias("job"), "sha", F.lit("completed").alias("status"))
    reused, todo = M.resume(done, t.select(F.col("doc_id").alias("job"), "sha", "source"), "job", ["sha"])
    return reused.select(F.lit("reused").alias("plan"), "source").unionByName(todo.select(F.lit("todo").alias("plan"), "source")).groupBy("plan", "source").agg(F.count("*").alias("n"))


def doc_quality_issues(spark, d):
    """Issues of documents by code, with zero for codes that nothing has."""
    t = table(spark, d, "documents")
    codes = F.array(F.when(F.col("text").isNull(), "missing_text"), F.when(F.col("text") == "", "empty_page"), F.when(F.col("lang").isNull() | (F.col("lang") == "und"), "unknown_language"), F.when(F.length("text") != F.col("n_chars"), "length_mismatch"), F.when(F.col("book_id").isNull(), "missing_provenance"))
    found = t.select(F.explode(F.array_compact(codes)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    all_ = spark.createDataFrame([(c,) for c in ("missing_text", "empty_page", "unknown_language", "length_mismatch", "missing_provenance", "parser_exception")], "code string")
    return all_.join(found, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def note_sections(spark, d):
    """Headed sections of scanned notes: line counts per section."""
    notes = table(spark, d, "joined_notation").where("raw is not null").select("note_id", "raw").distinct()
    rows = P.explode_lines(notes, ["note_id"], "raw")
    return S.sections(rows, ["note_id"], ["line_no"], F.col("line").rlike(r"^\s*(Game|Партия|Partie|Partida) [0-9]+$")).groupBy("note_id", "section").agg(F.count("*").alias("lines"))


def note_page_numbers(spark, d):
    notes = table(spark, d, "joined_notation").where("raw is not null").select("note_id", "source_page", "raw").distinct()
    rows = P.explode_lines(notes, ["note_id", "source_page"], "raw")
    n = F.regexp_extract("line", r"^[ \[(—-]*([0-9]{1,4})[ \])—-]*$", 1)
    return rows.where(n != "").select("note_id", "line_no", n.cast("int").alias("number"), (n.cast("int") - F.col("source_page")).alias("off"))


def note_depth(spark, d):
    """Deepest bracket nesting of each note, never below zero."""
    notes = table(spark, d, "joined_notation").where("raw is not null").select("note_id", "raw").distinct()
    chars = notes.select("note_id", F.posexplode(F.split(F.regexp_replace("raw", r"[^()\[\]]", ""), "")).alias("pos", "c")).where("c <> ''")
    step = F.when(F.col("c").isin("(", "["), 1).otherwise(-1)
    return S.clamped_depth(chars, ["note_id"], ["pos"], step).groupBy("note_id").agg(F.max("depth").alias("deepest"), F.count("*").alias("brackets"))


def word_number_black(spark, d):
    """Move numbers of scanned words and whose move they head."""
    t = table(spark, d, "bold_source_words").where("text is not null").select("word_id", "text").distinct()
    num = N.move_number(F.col("text"))
    return t.where(num.isNotNull()).select("word_id", num["number"].alias("number"), num["black"].alias("black"), num["rest"].alias("rest"))


def word_nags(spark, d):
    t = table(spark, d, "bold_source_words").where("text is not null").select("word_id", F.regexp_replace("text", "[.]$", "").alias("text")).distinct()
    return t.select(N.nag(F.col("text")).alias("nag")).where("nag is not null").groupBy("nag").agg(F.count("*").alias("n"))


def word_shapes(spark, d):
    """How many different words print with one shape."""
    t = table(spark, d, "bold_source_words").where("text rlike '^[0-9A-Za-z.:+!?-]+$'").select("text").distinct()
    return t.groupBy(F.translate("text", "OolI|tqSi", "00111fg5f").alias("shape")).agg(F.count("*").alias("words"), F.min("text").alias("first")).where("words > 1")


def word_evidence_rollup(spark, d):
    """Recognised, applied and changed readings per kind and style, of stored records and of payloads; a word sent again
    counts once."""
    keep = {"kind", "style", "changed", "reading", "symbol"}
    raw, kind = stored.words(spark, d, keep)
    r = nested.shared_inline(nested.word_records(raw, kind), "word_id", "words", stored.NUMBERS)["records"]
    return r.groupBy(F.coalesce("kind", F.lit("figurine")).alias("kind"), F.coalesce("style", F.lit("none")).alias("style")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("changed"), F.lit(False))).alias("changed"), F.count_if(F.coalesce(F.col("reading") == "whole_word", F.lit(False))).alias("whole"), F.count_if(F.col("symbol").isNotNull()).alias("figurines"))


def word_source_pages(spark, d):
    """Pages of each book that have words, and their longest run of consecutive pages."""
    p = table(spark, d, "bold_source_words").where("source.file_page is not null and source.book is not null").select(F.col("source.book").alias("book"), F.col("source.file_page").alias("page")).distinct()
    run = p.withColumn("g", F.col("page") - F.row_number().over(Window.partitionBy("book").orderBy("page")))
    return run.groupBy("book", "g").agg(F.count("*").alias("n")).groupBy("book").agg(F.sum("n").alias("pages"), F.max("n").alias("longest_run"))


def template_votes(spark, d):
    """The profile that clearly has most templates of a label; a lead of 2 is needed."""
    t = table(spark, d, "coordinates").select("template_id", "profile", "label").distinct()
    n = t.where("label is not null").groupBy("profile", "label").agg(F.count("*").alias("n"))
    return M.unique_best(n, ["label"], F.col("n").cast("double"), 1, 2, smallest=False)


def clip_splits(spark, d):
    t = table(spark, d, "clipped_notation").select("clip_id", "split", "dpi", F.size("bit_rows").alias("height")).distinct()
    return t.groupBy("split").agg(F.count("*").alias("clips"), F.count_if(F.col("height") > 0).alias("with_picture"), F.count_if(F.col("dpi") == 600).alias("double"))


def notation_forms(spark, d):
    """Moves of scanned words with English letters: figurines and look-alikes translated."""
    t = table(spark, d, "bold_source_words").where("text is not null").select("text").distinct()
    plain = F.translate(F.translate(F.translate("text", *N.FIGURINES), *N.LOOKALIKES), *N.DASHES)
    return t.where(plain.rlike("^[KQRBN][a-h]?[1-8]?x?[a-h][1-8][+#!?]*$")).groupBy(F.regexp_replace(plain, "[+#!?]+$", "").alias("move")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (doc_lines_profile, doc_header_clean, doc_token_kinds, doc_lang_vote, doc_junk_lines, doc_damage_ratio, doc_wrap_candidates, doc_fingerprint_dups, doc_resume_plan, doc_quality_issues, note_sections, note_page_numbers, note_depth, word_number_black, word_nags, word_shapes, word_evidence_rollup, word_source_pages, template_votes, clip_splits, notation_forms)}

_W = _NWORDS.format("line")
_NOTE = "notes AS (SELECT DISTINCT note_id, source_page, raw FROM joined_notation WHERE raw IS NOT NULL), lines AS (SELECT note_id, source_page, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT note_id, source_page, string_split(replace(replace(raw, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM notes))"
_SPLIT = r"list_filter(regexp_split_to_array({}, '[ \n\t\r]+'), lambda w: w <> '')"
_REALW = r"regexp_matches(w, '[a-zа-яäöüß]{4,}') OR regexp_matches(w, '^\d{1,3}(\.{1,3}|…)') OR regexp_matches(w, '^(1-0|0-1|1/2-1/2|½-½)$')"
SQL = {
    "doc_lines_profile": f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_replace(line, '[ \\t]+', '', 'g') <> '') AS n_text_lines, CAST(sum({_W}) AS BIGINT) AS n_words, CAST(max(length(line)) AS INT) AS longest FROM lines GROUP BY doc_id",
    "doc_header_clean": f"WITH {_LINES}, top AS (SELECT *, regexp_replace(line, '^[0-9 ]+|[0-9 ]+$', '', 'g') AS key FROM lines), head AS (SELECT * FROM top WHERE line_no <= 2 AND length(key) < 80 AND {_NWORDS.format('key')} >= 2), often AS (SELECT key FROM head GROUP BY key HAVING count(DISTINCT doc_id) >= 2) SELECT coalesce(lang, '?') AS lang, count(DISTINCT doc_id) AS docs, count(*) AS lines, CAST(sum({_W}) AS BIGINT) AS words FROM top WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.doc_id = top.doc_id AND h.line_no = top.line_no AND h.key IN (SELECT key FROM often)) GROUP BY 1",
    "doc_token_kinds": f"WITH {_LINES}, w AS (SELECT unnest({_SPLIT.format('line')}) AS w FROM lines) SELECT CASE WHEN regexp_matches(w, '^\\d{{1,3}}(\\.{{1,3}}|…)$') THEN 'number' WHEN regexp_matches(w, '^(1-0|0-1|1/2-1/2|½-½)$') THEN 'result' WHEN regexp_matches(w, '^\\d+$') THEN 'digits' WHEN regexp_matches(w, '^(\\d{{1,3}}\\.{{1,3}})?[KQRBN♔♕♖♗♘]?[a-h]?[1-8]?[x:-]?[a-h][1-8][+#!?.,]*$') THEN 'move' WHEN regexp_matches(w, '[a-zа-яäöüß]{{4,}}') THEN 'word' ELSE 'other' END AS kind, count(*) AS n FROM w GROUP BY 1",
    "doc_lang_vote": f"WITH t AS (SELECT lang, length(regexp_replace(text, '[^а-яА-ЯёЁ]', '', 'g')) / greatest(length(regexp_replace(text, '[^a-zA-Zа-яА-ЯёЁ]', '', 'g')), 1) AS share, {_SPLIT.format('text')} AS ws FROM documents WHERE text IS NOT NULL), h AS (SELECT lang, share, len(list_filter(ws, lambda w: regexp_matches(w, '^(the|and|of|that|was)$'))) AS en, len(list_filter(ws, lambda w: regexp_matches(w, '^(der|die|und|das|nicht)$'))) AS de, len(list_filter(ws, lambda w: regexp_matches(w, '^(la|de|el|que|con)$'))) AS es FROM t) SELECT coalesce(lang, '?') AS lang, CASE WHEN share > 0.2 THEN 'ru' WHEN de > en AND de >= es THEN 'de' WHEN es > en AND es > de THEN 'es' WHEN en > 0 THEN 'en' ELSE 'none' END AS vote, count(*) AS n FROM h GROUP BY 1, 2",
    "doc_junk_lines": f"WITH {_LINES}, k AS (SELECT doc_id, {_SPLIT.format('line')} AS ws FROM lines) SELECT doc_id, count(*) FILTER (len(ws) BETWEEN 1 AND 4 AND len(list_filter(ws, lambda w: {_REALW})) = 0) AS junk, count(*) AS n FROM k GROUP BY doc_id HAVING junk > 0",
    "doc_damage_ratio": "SELECT doc_id, CAST(coalesce(length(regexp_replace(text, '[^�]', '', 'g')), 0) AS INT) AS damaged, CAST(coalesce(length(text), 0) AS INT) AS chars, (text IS NULL OR text = '' OR (length(regexp_replace(text, '[^�]', '', 'g')) >= 3 AND length(regexp_replace(text, '[^�]', '', 'g')) > length(text) * 0.05)) AS needs_scan FROM documents",
    "doc_wrap_candidates": f"WITH {_LINES}, n AS (SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nx FROM lines) SELECT doc_id, count(*) FILTER (regexp_matches(line, '[a-zа-яёäöüßáéíóúñ,]$') AND regexp_matches(nx, '^[a-zа-яёäöüßáéíóúñ]')) AS wraps FROM n GROUP BY doc_id HAVING wraps > 0",
    "doc_fingerprint_dups": "SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "doc_resume_plan": "SELECT CASE WHEN source LIKE 'scan/%' THEN 'reused' ELSE 'todo' END AS plan, source, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "doc_quality_issues": "WITH f AS (SELECT unnest([CASE WHEN text IS NULL THEN 'missing_text' END, CASE WHEN text = '' THEN 'empty_page' END, CASE WHEN lang IS NULL OR lang = 'und' THEN 'unknown_language' END, CASE WHEN length(text) <> n_chars THEN 'length_mismatch' END, CASE WHEN book_id IS NULL THEN 'missing_provenance' END]) AS code FROM documents) SELECT c.code, count(f.code) AS n FROM (VALUES ('missing_text'), ('empty_page'), ('unknown_language'), ('length_mismatch'), ('missing_provenance'), ('parser_exception')) c(code) LEFT JOIN f ON f.code = c.code GROUP BY c.code",
    "note_sections": f"WITH {_NOTE} SELECT note_id, section, count(*) AS lines FROM (SELECT note_id, CAST(sum(CASE WHEN regexp_matches(line, '^\\s*(Game|Партия|Partie|Partida) [0-9]+$') THEN 1 ELSE 0 END) OVER (PARTITION BY note_id ORDER BY line_no) AS BIGINT) AS section FROM lines) GROUP BY 1, 2",
    "note_page_numbers": f"WITH {_NOTE} SELECT note_id, CAST(line_no AS INT) AS line_no, CAST(n AS INT) AS number, CAST(n AS INT) - source_page AS off FROM (SELECT *, regexp_extract(line, '^[ \\[(—-]*([0-9]{{1,4}})[ \\])—-]*$', 1) AS n FROM lines) WHERE n <> ''",
    "note_depth": "WITH notes AS (SELECT DISTINCT note_id, raw FROM joined_notation WHERE raw IS NOT NULL), c AS (SELECT note_id, generate_subscripts(l, 1) AS pos, unnest(l) AS c FROM (SELECT note_id, string_split(regexp_replace(raw, '[^()\\[\\]]', '', 'g'), '') AS l FROM notes)), s AS (SELECT note_id, pos, sum(CASE WHEN c IN ('(', '[') THEN 1 ELSE -1 END) OVER w AS s FROM c WHERE c <> '' WINDOW w AS (PARTITION BY note_id ORDER BY pos)), m AS (SELECT note_id, s - least(0, min(s) OVER (PARTITION BY note_id ORDER BY pos)) AS depth FROM s) SELECT note_id, CAST(max(depth) AS BIGINT) AS deepest, count(*) AS brackets FROM m GROUP BY note_id",
    "word_number_black": "SELECT DISTINCT word_id, CAST(regexp_extract(text, '^(\\d{1,3})(\\.{1,3}|…)(.*)$', 1) AS INT) AS number, regexp_extract(text, '^(\\d{1,3})(\\.{1,3}|…)(.*)$', 2) IN ('...', '…') AS black, regexp_extract(text, '^(\\d{1,3})(\\.{1,3}|…)(.*)$', 3) AS rest FROM bold_source_words WHERE regexp_matches(text, '^(\\d{1,3})(\\.{1,3}|…)(.*)$')",
    "word_nags": "WITH t AS (SELECT DISTINCT word_id, regexp_replace(text, '[.]$', '') AS text FROM bold_source_words WHERE text IS NOT NULL), m AS (SELECT regexp_replace(regexp_extract(text, '[!?+#‡†]*$', 0), '[+#‡†]', '', 'g') AS s FROM t) SELECT CASE s WHEN '!' THEN 1 WHEN '?' THEN 2 WHEN '!!' THEN 3 WHEN '??' THEN 4 WHEN '!?' THEN 5 WHEN '?!' THEN 6 END AS nag, count(*) AS n FROM m WHERE s IN ('!', '?', '!!', '??', '!?', '?!') GROUP BY 1",
    "word_shapes": "SELECT translate(text, 'OolI|tqSi', '00111fg5f') AS shape, count(*) AS words, min(text) AS first FROM (SELECT DISTINCT text FROM bold_source_words WHERE regexp_matches(text, '^[0-9A-Za-z.:+!?-]+$')) GROUP BY 1 HAVING count(*) > 1",
    "word_evidence_rollup": f"WITH {stored._ONCE}, {stored._STORED}, {stored._PAYLOAD}, r AS ({stored._RECORDS}) SELECT coalesce(kind, 'figurine') AS kind, coalesce(style, 'none') AS style, count(*) AS n, count(*) FILTER (changed) AS changed, count(*) FILTER (reading = 'whole_word') AS whole, count(*) FILTER (symbol IS NOT NULL) AS figurines FROM r GROUP BY 1, 2",
    "word_source_pages": "WITH p AS (SELECT DISTINCT source.book AS book, source.file_page AS page FROM bold_source_words WHERE source.file_page IS NOT NULL AND source.book IS NOT NULL), g AS (SELECT book, page - row_number() OVER (PARTITION BY book ORDER BY page) AS g FROM p), r AS (SELECT book, g, count(*) AS n FROM g GROUP BY 1, 2) SELECT book, CAST(sum(n) AS BIGINT) AS pages, max(n) AS longest_run FROM r GROUP BY book",
    "template_votes": "WITH t AS (SELECT DISTINCT template_id, profile, label FROM coordinates), n AS (SELECT profile, label, count(*) AS n FROM t WHERE label IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS nx FROM n WINDOW w AS (PARTITION BY label ORDER BY n DESC, profile)) SELECT profile, label, n FROM r WHERE k = 1 AND (nx IS NULL OR n - nx >= 2)",
    "clip_splits": "WITH t AS (SELECT DISTINCT clip_id, split, dpi, len(bit_rows) AS height FROM clipped_notation) SELECT split, count(*) AS clips, count(*) FILTER (height > 0) AS with_picture, count(*) FILTER (dpi = 600) AS double FROM t GROUP BY split",
    "notation_forms": "WITH t AS (SELECT DISTINCT text FROM bold_source_words WHERE text IS NOT NULL), p AS (SELECT translate(translate(translate(text, '♔♚♕♛♖♜♗♝♘♞♙♟', 'KKQQRRBBNN'), 'асеЬьх×:', 'acebbxxx'), '—–−‑‐' || chr(173), '------') AS p FROM t) SELECT regexp_replace(p, '[+#!?]+$', '') AS move, count(*) AS n FROM p WHERE regexp_matches(p, '^[KQRBN][a-h]?[1-8]?x?[a-h][1-8][+#!?]*$') GROUP BY 1",
}
