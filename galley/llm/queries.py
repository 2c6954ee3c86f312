"""The pN_ queries of the operators in this subpackage, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..plans import records as stored
from ..session import table, written
from . import bookkeys, encode, overlap, packing, quality, scannoise, splits, unify


def _clips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clipped_notation").select(F.col("clip_id").alias("id"), "split", "bit_rows", "dpi")


def _templates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "coordinates").select(F.col("template_id").alias("id"), "split", "bitmap")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = None
    for src, one in (("clipped_notation", overlap.picture_overlaps(_clips(spark, d))), ("coordinates", overlap.template_overlaps(_templates(spark, d)))):
        rows = one.select(F.lit(src).alias("src"), F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
        found = rows if found is None else found.unionByName(rows)
    return found


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table, split and book of the record outside train: its records that overlap train, and the pairs.  Counted on
    classes of equal pictures; a record that logs name under two books counts in both."""
    clips = table(spark, d, "clipped_notation").select(F.col("clip_id").alias("id"), "book")
    templates = table(spark, d, "coordinates").select(F.col("template_id").alias("id"), F.col("source.book").alias("book"))
    names = written(bookkeys.resolve(clips.select("book").unionByName(templates.select("book")).distinct(), table(spark, d, "books")), "names")
    out = None
    for src, books, (pairs, members) in (("clipped_notation", clips, overlap.picture_classes(_clips(spark, d))), ("coordinates", templates, overlap.template_classes(_templates(spark, d)))):
        of = books.distinct().join(names, "book", "left").select("id", F.coalesce("book_id", F.lit("unknown")).alias("book_id")).distinct()
        one = overlap.report(pairs, members.join(of, "id", "left")).select(F.lit(src).alias("src"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _record_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.record_groups(table(spark, d, "clipped_notation"), table(spark, d, "classic"), table(spark, d, "books"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.spread_groups(_record_groups(spark, d))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(_record_groups(spark, d), table(spark, d, "split_plan"))


#: Words for a volume in names of files.
VOLUME = ("vol", "volume", "band", "bd", "tom", "tomo", "том", "scan")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The scanned texts with the names that may stand in their book's running heads."""
    notes = table(spark, d, "joined_notation").select("note_id", "book", "source_page", "raw").where("raw is not null")
    books = table(spark, d, "books")
    ids = bookkeys.resolve(notes, books)
    # what names the book in its path: no parts with digits, no words for a volume
    parts = F.filter(F.split(F.regexp_replace("path", r"^.*/|\.[a-z]+$", ""), "[_ .]+"), lambda w: (w != "") & ~w.rlike("[0-9]") & ~F.lower(w).isin(*VOLUME))
    name = F.array_distinct(F.concat(
        F.when(F.trim("title") != "", F.array(F.lower(F.trim("title")))).otherwise(F.array().cast("array<string>")),
        F.flatten(F.transform(F.split(F.coalesce("author", F.lit("")), r"\s*[;&]\s*"), lambda a: F.transform(F.filter(F.split(F.lower(a), r"[^\p{L}]+"), lambda w: F.length(w) > 3), lambda w: w))),
        F.filter(F.array(F.lower(F.try_element_at(parts, F.lit(1))), F.lower(F.array_join(F.slice(parts, 2, 99), " "))), lambda w: w != ""),
    ))
    # a scan filed under two paths has the names of both
    own = books.select("book_id", F.coalesce("sha256", "book_id").alias("file"), name.alias("names"))
    names = ids.join(own.select("book_id", "file"), "book_id").join(own.groupBy("file").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names")), "file").select("book", "names")
    of_notes = notes.join(names, "book", "left").select(F.lit("joined_notation").alias("src"), F.col("note_id").alias("rec_id"), F.col("raw").alias("text"), F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.col("source_page").cast("int").alias("page"))
    of_words = table(spark, d, "bold_source_words").where("text is not null").select(F.lit("bold_source_words").alias("src"), F.col("word_id").alias("rec_id"), "text", F.array().cast("array<string>").alias("names"), F.lit(None).cast("int").alias("page"))
    return of_notes.unionByName(of_words)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scannoise.faults(_texts(spark, d)).distinct()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scannoise.repair(_texts(spark, d)).distinct()


def _values(spark: SparkSession, d: str) -> DataFrame:
    """(src, word_id, record_no, field, value) of every non-NULL value."""
    raw, kind = stored.words(spark, d, {"original_word", "replacement"})
    flat = nested.shared_inline(nested.word_records(raw, kind, once=False), "word_id", "words", stored.NUMBERS)["records"]
    of_records = flat.select(F.lit("bold_source_words").alias("src"), "word_id", "record_no", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("original_word", "replacement")))).alias("x")).select("src", "word_id", "record_no", "x.field", "x.value")
    rescaled = table(spark, d, "rescaled_source_word").select(F.lit("rescaled_source_word").alias("src"), "word_id", F.lit(0).alias("record_no"), F.lit("original_word").alias("field"), F.col("original_word").alias("value"))
    return of_records.unionByName(rescaled).where("value is not null")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Only values that fail the quick check are brought to the consistent form; those it changes are found."""
    odd = _values(spark, d).where(unify.needs_form(F.col("value")))
    return unify.with_form(odd, "value").where("form <> value").select("src", "word_id", "record_no", "field").distinct()


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every value with its one consistent form."""
    return unify.with_form(_values(spark, d).distinct(), "value")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"))


def _containers(spark: SparkSession, d: str) -> dict[str, int]:
    return {r["container"]: r["capacity"] for r in table(spark, d, "containers").orderBy("container").collect()}  # a fixed table of three rows


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """The counts, written once and read for the histogram and for the placing."""
    return written(encode.token_counts(table(spark, d, "documents")), "sizes")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), _containers(spark, d)["binder"]).where(F.col("n_pieces") > 1).select("doc_id").distinct()


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """All documents in all containers."""
    sizes, out = _sizes(spark, d), None
    for name, capacity in _containers(spark, d).items():
        one = packing.pack(sizes, capacity).select(F.lit(name).alias("container"), "bin", "doc_id", "piece", "size")
        out = one if out is None else out.unionByName(one)
    return out


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What the packing of all documents must fulfil, counted on the packing itself."""
    sizes, out = _sizes(spark, d), None
    for name, capacity in _containers(spark, d).items():
        one = packing.check(packing.pack(sizes, capacity), sizes, capacity).select(F.lit(name).alias("container"), "placed", "without_size", "wrong", "overfull", "dense")
        out = one if out is None else out.unionByName(one)
    return out


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_figures(spark: SparkSession, d: str) -> DataFrame:
    """The figures alone, which SQL can say too."""
    figures = ("mean_word_length", "symbol_share", "end_share", "common_share")
    return p8_stats(spark, d).select("doc_id", "n_words", *(F.round(c, 9).alias(c) for c in figures))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_stats(spark, d).where(F.col("kind") != "prose").select("doc_id", "kind")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_splits": p3_splits, "p4_found": p4_found, "p4_repaired": p4_repaired, "p5_found": p5_found, "p5_forms": p5_forms, "p6_ids": p6_ids, "p7_found": p7_found, "p7_pack": p7_pack, "p7_check": p7_check, "p8_found": p8_found, "p8_stats": p8_stats, "p8_figures": p8_figures}
_FOLD = "regexp_replace(lower(translate({}, '" + bookkeys._FROM + "', '" + bookkeys._TO + "')), '[\u0300-\u036f]', '', 'g')"


def _key(c: str) -> str:
    stem = f"regexp_replace(lower(regexp_replace(trim({c}), '^.*[/\\\\]', '')), '\\.(pdf|djvu|djv|epub|txt)$', '')"
    return "nullif(regexp_replace(" + _FOLD.format(stem) + ", '[^a-z0-9а-яё]+', '', 'g'), '')"


def _less(c: str) -> str:
    """A key and the key less any one character."""
    return f"list_append(list_transform(range(1, CAST(length({c}) AS BIGINT) + 1), lambda i: substr({c}, 1, i - 1) || substr({c}, i + 1)), {c})"


_LETTERS = "list_filter(string_split_regex(regexp_replace({}, '[^a-zа-яё''-]+', ' ', 'g'), ' +'), lambda w: length(regexp_replace(w, '[''-]', '', 'g')) > 1)"
_SORTED = "array_to_string(list_sort(string_split({}, '')), '')"
_PLACEHOLDERS = ", ".join(f"'{p}'" for p in bookkeys.PLACEHOLDERS)
# names of logs to books, books to groups, records to groups
_GROUPS = (
    f"WITH RECURSIVE rec AS (SELECT DISTINCT 'clipped_notation' AS src, clip_id AS rec_id, split, book FROM clipped_notation UNION SELECT DISTINCT 'classic', template_id, split, source.book FROM classic), "
    f"names AS (SELECT DISTINCT book, {_key('book')} AS key FROM rec WHERE book IS NOT NULL), known AS (SELECT key, min(book_id) AS book_id FROM (SELECT book_id, {_key('path')} AS key FROM books) WHERE key IS NOT NULL GROUP BY key HAVING count(*) = 1), "
    "direct AS (SELECT n.book, n.key, k.book_id FROM names n LEFT JOIN known k ON k.key = n.key WHERE n.key IS NOT NULL), "
    f"near AS (SELECT d.key, min(k.book_id) AS book_id FROM (SELECT DISTINCT key FROM direct WHERE book_id IS NULL) d JOIN known k ON abs(length(d.key) - length(k.key)) <= 1 AND regexp_replace(d.key, '[^0-9]', '', 'g') = regexp_replace(k.key, '[^0-9]', '', 'g') "
    f"AND (levenshtein(d.key, k.key) = 1 OR (levenshtein(d.key, k.key) = 2 AND length(d.key) = length(k.key) AND {_SORTED.format('d.key')} = {_SORTED.format('k.key')})) AND list_has_any({_less('d.key')}, {_less('k.key')}) GROUP BY d.key HAVING count(DISTINCT k.book_id) = 1), "
    "meant AS (SELECT book, book_id FROM direct WHERE book_id IS NOT NULL UNION SELECT d.book, n.book_id FROM direct d JOIN near n ON n.key = d.key WHERE d.book_id IS NULL), "
    f"part AS (SELECT book_id, unnest(string_split_regex({_FOLD.format('author')}, '\\s*(?:[;&/+]|\\band\\b|\\bund\\b)\\s*')) AS p FROM books WHERE author IS NOT NULL), "
    f"heads AS (SELECT book_id, p, {_LETTERS.format('string_split(p, chr(44))[1]')} AS head, {_LETTERS.format('p')} AS own FROM part), "
    "person AS (SELECT book_id, CASE WHEN contains(p, ',') AND len(head) > 0 THEN head ELSE own END AS w, (contains(p, ',') AND len(head) > 0) OR len(own) = 1 AS sure FROM heads), "
    f"named AS (SELECT book_id, w, sure, array_to_string(list_sort(w), ' ') AS whole FROM person WHERE len(w) > 0 AND array_to_string(list_sort(w), ' ') NOT IN ({_PLACEHOLDERS}) AND array_to_string(w, ' ') NOT IN ({_PLACEHOLDERS})), "
    "kn AS (SELECT coalesce(list(DISTINCT whole), []) AS k FROM named WHERE sure), "
    "surname AS (SELECT DISTINCT book_id, CASE WHEN sure OR list_contains(k, whole) THEN whole WHEN len(list_filter(list_distinct(w), lambda x: list_contains(k, x))) = 1 THEN list_filter(w, lambda x: list_contains(k, x))[1] ELSE w[len(w)] END AS e FROM named JOIN kn ON true), "
    "entity AS (SELECT book_id, 'p' || e AS e FROM surname UNION SELECT book_id, 'f' || lower(trim(sha256)) FROM books WHERE trim(sha256) <> ''), "
    "edge AS (SELECT DISTINCT a.book_id AS a, b.book_id AS b FROM entity a JOIN entity b USING (e)), reach AS (SELECT book_id AS a, book_id AS b FROM books UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b), grp AS (SELECT a AS book_id, min(b) AS group_book FROM reach GROUP BY a), "
    "own AS (SELECT rec.src, rec.rec_id, rec.split, grp.group_book FROM rec JOIN meant USING (book) JOIN grp USING (book_id))"
)
_WHITE = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_UNSEEN = " \\t\\v\\f\\x{0}\\x1c-\\x1f\\x{85}\\x{a0}\\x{ad}\\x{1680}\\x{2000}-\\x{200f}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}"
_PRINT = "\\p{Z}\\t\\r\\v\\f"
_FIGURES = (
    "l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), chr(10)), chr(10))) AS x FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, x, "
    f"list_filter(string_split_regex(x, '[{_WHITE}]+'), lambda w: w <> '') AS ws, regexp_replace(x, '[{_WHITE}]+$', '') AS e FROM l WHERE NOT regexp_full_match(x, '[{_WHITE}]*') AND NOT regexp_full_match(x, '[{_UNSEEN}]*')), "
    "kn AS (SELECT list(DISTINCT word) AS k FROM common_words WHERE word IS NOT NULL), "
    f"a AS (SELECT doc_id, sum(len(ws)) AS n, sum(list_sum(list_transform(ws, lambda w: length(w)))) AS c, sum(length(regexp_replace(x, '[{_PRINT}]', '', 'g'))) AS p, "
    f"sum(length(regexp_replace(x, '[\\p{{L}}\\p{{Nd}}{_PRINT}.!?…,:''\"()–—«»“”„‘’;♔-♟½¼¾-]', '', 'g'))) AS s, count(*) AS m, "
    "count(*) FILTER (regexp_matches(e, '[.!?…:;,]$') OR regexp_matches(e, '[.!?…][\"''»”)\\]]*$')) AS ends, sum(len(list_filter(ws, lambda w: list_contains(k, lower(trim(w, '.,;:!?\"''()«»')))))) AS h FROM k JOIN kn ON true GROUP BY doc_id)"
)
SQL: dict[str, str] = {
    "p8_figures": f"WITH {_FIGURES} SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, round(c / n, 9) AS mean_word_length, round(s / p, 9) AS symbol_share, round(ends / m, 9) AS end_share, round(h / n, 9) AS common_share FROM documents d LEFT JOIN a USING (doc_id)",
    "p3_found": f"{_GROUPS}, spread AS (SELECT group_book FROM own GROUP BY 1 HAVING min(split) <> max(split)) SELECT DISTINCT src, rec_id, group_book FROM own JOIN spread USING (group_book)",
    # a packing places every text that has tokens whole, overfills no bin and wastes little
    "p7_check": "SELECT container, count(*) FILTER (text <> '') AS placed, count(*) FILTER (text IS NULL OR text = '') AS without_size, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS overfull, true AS dense FROM documents, containers GROUP BY container",
}
