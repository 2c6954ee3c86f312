"""Several readings of a book's rows made one before the fold: numbers, missing rows, openings and unclear ranks.

Rows are (book, page, ord, number, words array<string>) as in ``readings``; every change is told as an issue
(book, page, ord, code, severity, message).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import notation as N
from . import matching as M
from . import readings as R

ON = R.ON
ISSUE = "book string, page int, ord double, code string, severity string, message string"


def _issues(df: DataFrame, code: str, message: Column, severity: str = "info") -> DataFrame:
    return df.select(F.col("book").cast("string").alias("book"), F.col("page").cast("int").alias("page"), F.col("ord").cast("double").alias("ord"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))


def rows_of(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., ord, number, words) of lines (keys..., line_no, line) that are a row number and one to four words; lines on
    which rows ran together are cut apart, the parts standing at fractions of the line's place."""
    parts = lines.select(*keys, "line_no", F.posexplode(L.glued_rows(F.col("line"))).alias("at", "part"))
    w = L.words(F.regexp_replace("part", r"^\s*(\d{1,3}\.{1,3})(?=\S)", "$1 "))
    number = F.regexp_extract(F.try_element_at(w, F.lit(1)), r"^(\d{1,3})\.{1,3}$", 1).try_cast("int")
    rows = parts.select(*keys, (F.col("line_no") + F.col("at") / 10).alias("ord"), number.alias("number"), w.alias("w"))
    return rows.where(F.col("number").isNotNull() & F.size("w").between(2, 5)).select(*keys, "ord", "number", F.slice("w", 2, 4).alias("words"))


def numbered(first: DataFrame, second: DataFrame | None, source: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): row numbers of the first reading as the others have them, where they agree on one."""
    found = None
    for other, f, code in ((second, R.number_consensus, "row_number_ocr_consensus"), (source, R.source_numbers, "source_row_number")):
        if other is not None:
            one = f(first, other).withColumn("code", F.lit(code))
            found = one if found is None else found.unionByName(one)
    if found is None:
        return first, first.sparkSession.createDataFrame([], ISSUE)
    agreed = M.agreed(found, [*ON, "ord"], "number").join(found.groupBy(*ON, "ord").agg(F.min("code").alias("code"), F.min("printed").alias("printed")), [*ON, "ord"])
    fixed = first.join(agreed.select(*ON, "ord", F.col("number").alias("__n")), [*ON, "ord"], "left").withColumn("number", F.coalesce("__n", "number")).drop("__n")
    told = F.concat_ws(" ", F.col("printed").cast("string"), F.lit("read as"), F.col("number").cast("string"))
    issues = _issues(agreed.where("code = 'row_number_ocr_consensus'"), "row_number_ocr_consensus", told).unionByName(_issues(agreed.where("code = 'source_row_number'"), "source_row_number", told))
    return fixed, issues


def filled(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): rows of the second reading that stand between paired rows and that the first one lacks."""
    pairs = R.row_pairs(first, second)
    new = R.between_anchors(first, second, pairs).select(*ON, F.col("line").cast("double").alias("ord"), "number", "words")
    # only numbers that the first reading has not on that page, and that lie between those of the anchors
    have = first.select(*ON, "number").distinct()
    lack = new.join(have, [*ON, "number"], "left_anti")
    rows = first.withColumn("ord", F.col("ord").cast("double")).unionByName(lack)
    w = Window.partitionBy(*ON).orderBy("ord")
    fits = rows.withColumn("b", F.lag("number").over(w)).withColumn("a", F.lead("number").over(w)).join(lack.select(*ON, "ord"), [*ON, "ord"], "left_semi")
    good = fits.where("(b is null or b < number) and (a is null or number < a)").select(*ON, "ord", "number", "words")
    return first.withColumn("ord", F.col("ord").cast("double")).unionByName(good), _issues(good, "missing_rows_recovered", F.concat(F.lit("row "), F.col("number").cast("string"), F.lit(" from the second reading")))


def opened(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): the rows before the first printed one of a section, from the second reading.  Rows also carry
    (section, heading); recovered rows come before the first row of their section."""
    new = R.recovered_openings(first, second)
    at = first.groupBy("book", "section").agg(F.min_by("page", "ord").alias("page"), F.min("ord").alias("__o"), F.first("heading").alias("heading"))
    rows = new.join(at, ["book", "section"]).select("book", "section", "heading", "page", (F.col("__o") - 1 + F.col("number") / 1000).alias("ord"), "number", "words")
    n = rows.groupBy("book", "section", "page").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    both = first.withColumn("ord", F.col("ord").cast("double")).unionByName(rows.select(*first.columns))
    return both, _issues(n, "opening_rows_recovered", F.concat(F.col("n").cast("string"), F.lit(" rows")))


def ranked(first: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): ranks that the first reading leaves open as the source has them, unless another reading contradicts."""
    unclear = lambda w: N.move_code(w).rlike(r"^([a-h])[2-7]-\1[bd]$")
    two = first.where(F.size("words") == 2).select(*ON, "ord", "number", F.posexplode("words").alias("side", "word"), F.col("words").alias("__w"))
    targets = two.where(unclear(F.col("word"))).select(*ON, "ord", "number", "side", "word", F.element_at("__w", 2 - F.col("side")).alias("peer"), F.array("word").alias("readings"))
    found = R.source_readings(targets, source)
    use = found.where("not conflict").groupBy(*ON, "ord").agg(F.map_from_entries(F.collect_list(F.struct("side", "reading"))).alias("__r"))
    rows = first.join(use, [*ON, "ord"], "left").withColumn("words", F.when(F.col("__r").isNull(), F.col("words")).otherwise(F.transform("words", lambda w, i: F.coalesce(F.try_element_at("__r", i), w)))).drop("__r")
    issues = _issues(found.where("not conflict"), "source_row_reading", F.col("reading")).unionByName(_issues(found.where("conflict"), "source_row_conflict", F.col("reading"), "warning"))
    return rows, issues


def reconciled(first: DataFrame, second: DataFrame | None = None, source: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of all steps in their order: numbers, missing rows, ranks."""
    rows, issues = numbered(first, second, source)
    if second is not None:
        rows, more = filled(rows, second)
        issues = issues.unionByName(more)
    if source is not None:
        rows, more = ranked(rows, source)
        issues = issues.unionByName(more)
    return rows, issues


def row_tokens(rows: DataFrame) -> DataFrame:
    """Rows as tokens for the fold: a number and its words, in the order of the rows of a book."""
    w = Window.partitionBy("book").orderBy("page", "ord", "pos")
    word = F.concat(F.array(F.struct(F.lit("num").alias("kind"), F.concat(F.col("number").cast("string"), F.lit(".")).alias("text"))), F.transform("words", lambda x: F.struct(F.lit("word").alias("kind"), x.alias("text"))))
    t = rows.select("book", "page", "ord", "number", F.posexplode(word).alias("pos", "x"))
    return t.select(
        "book", (F.row_number().over(w) - 1).cast("bigint").alias("tok"), F.col("x.kind").alias("kind"), F.when(F.col("x.kind") == "num", F.col("number")).alias("number"), F.lit(False).alias("black"), F.col("x.text").alias("text"),
        "page", F.col("ord").cast("double").alias("line"), F.lit(None).cast("array<string>").alias("readings"),
    )
