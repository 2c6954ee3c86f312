"""Queries on the nested records of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import nested

NUMBERS = {"records": "record_no", "characters": "char_no"}
SOURCE = T.StructType([T.StructField("book", T.StringType()), T.StructField("file_page", T.IntegerType()), T.StructField("dpi", T.IntegerType()), T.StructField("bbox_pixels", T.ArrayType(T.IntegerType()))])
COLUMNS = {c: T.StringType() for c in ("payload", "samples", "text", "expected")} | {"word_id": T.LongType(), "width": T.IntegerType(), "height": T.IntegerType(), "source": SOURCE}
#: What a word has besides its records.
ROOT = ("text", "expected", "width", "height", "samples", "source")


def words(spark: SparkSession, d: str, keep: set[str] | None = None, others: tuple[str, ...] = ()) -> tuple[DataFrame, T.StructType]:
    """The stored words, reading only the wanted leaves of ``records``, and the record type."""
    kind = nested.pruned(nested.RECORD, keep) if keep else nested.RECORD
    schema = T.StructType([T.StructField(c, COLUMNS[c]) for c in ("word_id", "payload", *others)] + [T.StructField("records", T.ArrayType(kind))])
    return spark.read.schema(schema).parquet(f"{d}/bold_source_words.parquet"), kind


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    raw, kind = words(spark, d, {"characters.char"})
    flat = nested.shared_inline(nested.word_records(raw, kind), "word_id", "words", NUMBERS)
    return flat["characters"].select("word_id", "record_no", "char_no")


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    raw, kind = words(spark, d, None, ROOT)
    return nested.shared_inline(nested.word_records(raw, kind, ROOT), "word_id", "words", NUMBERS)


def p2_words(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["words"]


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["records"]


def p2_characters(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["characters"]


def p2_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["bbox"]


def p2_crops(spark: SparkSession, d: str) -> DataFrame:
    """Corners of the words in their scans, the repeated part of the inlined ``source``."""
    return _tables(spark, d)["bbox_pixels"].select("word_id", "place", "value")


QUERIES = {f.__name__: f for f in (p2_found, p2_words, p2_records, p2_characters, p2_boxes, p2_crops)}


def _listed(x: str, alone: str) -> str:
    """The list of (no, item) of a JSON value in any of its shapes."""
    v = f"(CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) END ELSE {x} END)"
    return (
        f"CASE json_type({v}) WHEN 'ARRAY' THEN list_transform(range(1, CAST(json_array_length({v}) AS BIGINT) + 1), lambda i: {{'no': CAST(i AS INT), 'item': json_extract({v}, '$[' || (i - 1) || ']')}}) "
        f"WHEN 'OBJECT' THEN CASE WHEN json_exists({v}, '$.{alone}') THEN [{{'no': 1, 'item': {v}}}] ELSE list_transform(list_filter(json_keys({v}), lambda k: regexp_full_match(k, '[0-9]+')), lambda k: {{'no': TRY_CAST(k AS INT), 'item': json_extract({v}, '$.\"' || k || '\"')}}) END END"
    )


_ONCE = "w AS (SELECT word_id, any_value(records) AS records, any_value(payload) AS payload FROM bold_source_words GROUP BY word_id)"
_STORED = "s AS (SELECT word_id, CAST(generate_subscripts(records, 1) AS INT) AS record_no, unnest(records) AS r FROM w WHERE records IS NOT NULL)"
_PAYLOAD = (
    "p AS (SELECT word_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM w WHERE records IS NULL AND payload IS NOT NULL), "
    "q AS (SELECT word_id, coalesce(json_extract(j, '$.records'), json_extract(j, '$.page.words.records'), json_extract(j, '$.words.records'), json_extract(j, '$.page.records')) AS rs FROM p), "
    f"e AS (SELECT word_id, unnest({_listed('rs', 'bbox')}) AS x FROM q WHERE rs IS NOT NULL), "
    "o AS (SELECT word_id, x.no AS record_no, x.item AS item FROM e WHERE json_type(x.item) = 'OBJECT'), "
    "g AS (SELECT word_id, record_no, json_extract(item, '$.characters') AS cs FROM o), "
    f"h AS (SELECT word_id, record_no, unnest({_listed('cs', 'char')}) AS x FROM g WHERE cs IS NOT NULL AND json_type(cs) <> 'NULL')"
)
_CHARS = (
    "SELECT word_id, record_no, CAST(char_no AS INT) AS char_no FROM (SELECT word_id, record_no, generate_subscripts(r.characters, 1) AS char_no, unnest(r.characters) AS c FROM s WHERE r IS NOT NULL) WHERE c IS NOT NULL "
    "UNION ALL SELECT word_id, record_no, x.no AS char_no FROM h WHERE json_type(x.item) = 'OBJECT'"
)
_TEXTS = ("kind", "reading", "original_word", "replacement", "style", "symbol", "profile")
_RECORDS = (
    "SELECT word_id, record_no, " + ", ".join(f"r.{f} AS {f}" for f in (*_TEXTS, "changed", "line", "similarity")) + " FROM s WHERE r IS NOT NULL UNION ALL SELECT word_id, record_no, "
    + ", ".join(f"item ->> '$.{f}'" for f in _TEXTS) + ", TRY_CAST(item ->> '$.changed' AS BOOLEAN), TRY_CAST(item ->> '$.line' AS INT), TRY_CAST(item ->> '$.similarity' AS DOUBLE) FROM o"
)
_CHAR_FIELDS = (
    "SELECT word_id, record_no, CAST(char_no AS INT) AS char_no, c.char AS char, c.similarity AS similarity FROM (SELECT word_id, record_no, generate_subscripts(r.characters, 1) AS char_no, unnest(r.characters) AS c FROM s WHERE r IS NOT NULL) WHERE c IS NOT NULL "
    "UNION ALL SELECT word_id, record_no, x.no, x.item ->> '$.char', TRY_CAST(x.item ->> '$.similarity' AS DOUBLE) FROM h WHERE json_type(x.item) = 'OBJECT'"
)
def _numbers(b: str) -> str:
    """The numbers of a JSON box: a list, an object of corners, a text of numbers."""
    return (
        f"CASE json_type({b}) WHEN 'ARRAY' THEN list_transform(range(0, CAST(json_array_length({b}) AS BIGINT)), lambda i: TRY_CAST({b} ->> ('$[' || i || ']') AS DOUBLE)) "
        f"WHEN 'OBJECT' THEN CASE WHEN {b} ->> '$.x0' IS NOT NULL OR {b} ->> '$.x1' IS NOT NULL THEN [TRY_CAST({b} ->> '$.x0' AS DOUBLE), TRY_CAST({b} ->> '$.y0' AS DOUBLE), TRY_CAST({b} ->> '$.x1' AS DOUBLE), TRY_CAST({b} ->> '$.y1' AS DOUBLE)] END "
        f"WHEN 'VARCHAR' THEN list_transform(regexp_split_to_array(trim({b} ->> '$'), '[\\s,;]+'), lambda x: TRY_CAST(x AS DOUBLE)) END"
    )


_BOXES = (
    "b AS (SELECT word_id, 'records' AS parent, record_no, CAST(NULL AS INT) AS char_no, r.bbox AS v FROM s WHERE r IS NOT NULL "
    "UNION ALL SELECT word_id, 'characters', record_no, CAST(char_no AS INT), c.bbox FROM (SELECT word_id, record_no, generate_subscripts(r.characters, 1) AS char_no, unnest(r.characters) AS c FROM s WHERE r IS NOT NULL) WHERE c IS NOT NULL "
    f"UNION ALL SELECT word_id, 'records', record_no, NULL, {_numbers('t')} FROM (SELECT word_id, record_no, json_extract(item, '$.bbox') AS t FROM o) "
    f"UNION ALL SELECT word_id, 'characters', record_no, char_no, {_numbers('t')} FROM (SELECT word_id, record_no, x.no AS char_no, json_extract(x.item, '$.bbox') AS t FROM h WHERE json_type(x.item) = 'OBJECT'))"
)
SQL: dict[str, str] = {
    "p2_boxes": f"WITH {_ONCE}, {_STORED}, {_PAYLOAD}, {_BOXES} SELECT word_id, parent, record_no, char_no, CAST(generate_subscripts(v, 1) AS INT) AS place, unnest(v) AS value FROM b WHERE v IS NOT NULL",
    "p2_records": f"WITH {_ONCE}, {_STORED}, {_PAYLOAD} {_RECORDS}",
    "p2_characters": f"WITH {_ONCE}, {_STORED}, {_PAYLOAD} {_CHAR_FIELDS}",
    "p2_found": f"WITH {_ONCE}, {_STORED}, {_PAYLOAD} {_CHARS}",
    "p2_words": "SELECT DISTINCT word_id, text, expected, width, height, samples, source.book AS source_book, source.file_page AS source_file_page, source.dpi AS source_dpi FROM bold_source_words",
    "p2_crops": "WITH w AS (SELECT word_id, any_value(source.bbox_pixels) AS b FROM bold_source_words GROUP BY word_id) SELECT word_id, CAST(generate_subscripts(b, 1) AS INT) AS place, unnest(b) AS value FROM w WHERE b IS NOT NULL",
}
