"""Quality reports and batches: roll-ups, issues with their source lines, fingerprints, what to do again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import matching as M

STATUSES = ("completed", "needs_review", "failed")


def game_rollup(games: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., mainline_plies, total_plies, variations); games without moves are kept."""
    n = moves.groupBy(*keys).agg(F.count_if(F.forall("path", lambda x: x == 0)).alias("mainline_plies"), F.count("*").alias("total_plies"), F.count_if(F.element_at("path", -1) > 0).alias("variations"))
    return games.join(n, keys, "left").na.fill(0, ["mainline_plies", "total_plies", "variations"])


def page_rollup(pages: DataFrame, moves: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, page, characters, ocr, moves); pages without moves are kept."""
    n = moves.groupBy(book, "page").agg(F.count("*").alias("moves"))
    return pages.select(book, "page", F.coalesce(F.length("text"), F.lit(0)).alias("characters"), *(["ocr"] if "ocr" in pages.columns else [])).join(n, [book, "page"], "left").na.fill(0, ["moves"])


def evidence_rollup(records: DataFrame, keys: list[str]) -> DataFrame:
    kind = F.coalesce(F.col("kind"), F.when(F.col("symbol").isNotNull(), "figurine"))
    return records.groupBy(*keys, kind.alias("kind")).agg(F.count("*").alias("recognized"), F.count_if(F.coalesce(F.col("changed"), F.lit(False))).alias("changed"), F.count_if(F.col("reading") == "whole_word").alias("whole_word"), F.count_if(F.col("reading") == "number_only").alias("number_only"), F.count_if(F.col("style") == "regular").alias("regular"))


def issue_counts(issues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., issue_counts map, status): needs_review if any issue is more than information."""
    n = issues.groupBy(*keys, "code").agg(F.count("*").alias("n"), F.max(F.col("severity") != "info").alias("bad"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("issue_counts"), F.when(F.max("bad"), "needs_review").otherwise("completed").alias("status"))


def with_source_lines(issues: DataFrame, tokens: DataFrame, keys: list[str], first: str = "tok", last: str = "tok") -> DataFrame:
    """Issues with the distinct (page, line) of the tokens they span."""
    spans = issues.withColumn("__a", F.col(first)).withColumn("__b", F.col(last))
    t = tokens.select(*keys, F.col("tok").alias("__t"), F.col("page").alias("src_page"), F.col("line").alias("src_line"))
    return M.range_join(t, spans, keys, "__t", "__a", "__b", 256.0).groupBy(*[c for c in issues.columns]).agg(F.array_sort(F.collect_set(F.struct("src_page", "src_line"))).alias("source"))


def missing_sections(headings: DataFrame, games: DataFrame, keys: list[str]) -> DataFrame:
    """Headings (keys..., number) for which no game was found."""
    have = games.select(*keys, F.col("headers")["BookGame"].try_cast("int").alias("number")).where("number is not null")
    return headings.join(have, [*keys, "number"], "left_anti")


def unread_moves(tokens: DataFrame, moves: DataFrame, games: DataFrame, keys: list[str], code: Column) -> DataFrame:
    """Tokens that look like moves, lie between the first and last move of a game, and were not played."""
    spans = moves.groupBy(*keys, "game_id").agg(F.min("tok").alias("__a"), F.max("tok").alias("__b"))
    loose = tokens.where(code.isNotNull() & (F.col("kind") == "word")).join(moves.select(*keys, "tok").distinct(), [*keys, "tok"], "left_anti")
    return M.range_join(loose, spans, keys, "tok", "__a", "__b", 256.0).drop("__a", "__b").distinct()


def summary(games: DataFrame, moves: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of counts over a run."""
    names = ("games", "incomplete_games", "mainline_plies", "total_plies", "issues", "warnings")
    zero = lambda own: [F.lit(0).cast("bigint").alias(n) if n not in own else own[n].cast("bigint").alias(n) for n in names]
    one = F.lit(1)
    g = games.select(*zero({"games": one, "incomplete_games": (F.col("status") != "complete").cast("int")}))
    m = moves.select(*zero({"total_plies": one, "mainline_plies": F.forall("path", lambda x: x == 0).cast("int")}))
    i = issues.select(*zero({"issues": one, "warnings": (F.col("severity") != "info").cast("int")}))
    return g.unionByName(m).unionByName(i).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))


def checks(moves: DataFrame, games: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., game_id, code, severity, tok, page, message) of what a second look at played moves tells: a printed number that
    is not the move's (move_number_mismatch), several readings of which one was taken (alternate_ocr), print that claims check
    where none is given (check_mismatch), a move without a page (missing_provenance)."""
    t = tokens.select(*keys, "tok", "kind", "text", "number", "black", "readings")
    num = t.where("kind = 'num'").select(*keys, (F.col("tok") + 1).alias("tok"), F.col("number").alias("__n"), F.col("black").alias("__b"))
    at = moves.select(*keys, "game_id", "tok", "page", "ply", "san").join(t.select(*keys, "tok", "text", "readings"), [*keys, "tok"]).join(num, [*keys, "tok"], "left")
    due = F.floor((F.col("ply") + 1) / 2)
    other = F.size(F.filter(F.coalesce("readings", F.array().cast("array<string>")), lambda r: r.isNotNull() & (r != F.col("text")))) > 0
    claims = F.col("text").contains("+") | F.substring("text", 2, 1000).contains("#")
    found = F.array(
        F.when((F.col("__n") != due) | (F.col("__b") & (F.col("ply") % 2 == 1)), F.struct(F.lit("move_number_mismatch").alias("code"), F.lit("warning").alias("severity"))),
        F.when(other, F.struct(F.lit("alternate_ocr").alias("code"), F.lit("info").alias("severity"))),
        F.when(claims & ~F.col("san").rlike("[+#]"), F.struct(F.lit("check_mismatch").alias("code"), F.lit("warning").alias("severity"))),
        F.when(F.col("page").isNull(), F.struct(F.lit("missing_provenance").alias("code"), F.lit("warning").alias("severity"))),
    )
    return at.select(*keys, "game_id", "tok", "page", F.explode(F.array_compact(found)).alias("c"), F.concat_ws(" ", "text", "san").alias("message")).select(*keys, "game_id", "c.code", "c.severity", "tok", "page", "message")


def page_checks(pages: DataFrame, games: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., code, severity, page): pages without text (empty_page), scanned pages without a second reading
    (ocr_unverified, if pages have ``ocr`` and ``verified``), and books without games (no_games)."""
    flags = [F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.lit("empty_page"))]
    if {"ocr", "verified"} <= set(pages.columns):
        flags.append(F.when(F.col("ocr") & ~F.coalesce(F.col("verified"), F.lit(False)), F.lit("ocr_unverified")))
    told = pages.select(*keys, F.explode(F.array_compact(F.array(*flags))).alias("code"), F.lit("warning").alias("severity"), "page")
    none = pages.select(*keys).distinct().join(games.select(*keys), keys, "left_anti").select(*keys, F.lit("no_games").alias("code"), F.lit("error").alias("severity"), F.lit(None).cast("int").alias("page"))
    return told.unionByName(none)


def fingerprint(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., fingerprint): an ordered hash of (name, hash) parts."""
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "hash"))), lambda e: F.concat_ws("=", e["name"], e["hash"])), "\n"), 256).alias("fingerprint"))


def batch_plan(sources: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, to do) of sources (relpath, source_sha256, pipeline, options, output_sha256, report_sha256) against a
    manifest of earlier jobs; a changed source, pipeline, option or output makes a job anew."""
    return M.resume(manifest, sources, "relpath", ["source_sha256", "pipeline", "options", "output_sha256", "report_sha256"])


def status_counts(jobs: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """Jobs by status, zero-filled."""
    all_ = jobs.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return all_.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").na.fill(0, ["n"])
