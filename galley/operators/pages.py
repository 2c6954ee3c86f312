"""Pages to lines, lines to sections and rows; words to lines and columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import notation as N
from ..session import ship
from . import sequences as S


def split_pages(books: DataFrame, text: str = "text", total: str = "total_pages") -> DataFrame:
    """(book_id, page, text) of texts with form feeds between pages; missing pages are '', surplus ones are cut."""
    pages = F.split(F.col(text), "\f")
    return books.select("book_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.col(total), F.lit(1))), lambda k: F.coalesce(F.try_element_at(pages, k), F.lit("")))).alias("p", "text")).select("book_id", (F.col("p") + 1).alias("page"), "text")


def explode_lines(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., line_no from 1, line).  NULL texts have no lines, '' has one."""
    return pages.select(*keys, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("p", "line")).select(*keys, (F.col("p") + 1).alias("line_no"), "line")


def page_range(pages: DataFrame, spec: str) -> DataFrame:
    """Pages of a range such as 5-20, 5-, -20 or 7; ends are clamped by what there is, a bad range is an error."""
    first, dash, last = spec.strip().partition("-")
    low = int(first) if first.strip() else 1
    high = int(last) if last.strip() else None if dash else low
    if low < 1 or high is not None and high < low:
        raise ValueError(f"no such range of pages: {spec}")
    return pages.where(F.col("page") >= low) if high is None else pages.where(F.col("page").between(low, high))


def running_heads(lines: DataFrame, book: str = "book_id", page: str = "page") -> DataFrame:
    """(book, page, line_no) of running heads among the first two lines of pages: chapter titles, normal forms that two
    pages share, and titles with a counter set off by a dash at either end that counts on with a page at most two away."""
    top = lines.where((F.col("line_no") <= 2) & (F.trim("line") != "")).withColumn("key", L.head_key(F.col("line"))).withColumn("w", L.words(F.col("line")))
    often = top.where("key <> ''").groupBy(book, "key").agg(F.countDistinct(page).alias("pages")).where("pages >= 2").select(book, "key")
    repeated = top.join(often, [book, "key"], "left_semi").where(F.size(L.words(F.col("key"))) >= 2)
    chapter = top.where(L.chapter_line(F.col("key")))
    # the counter: the first word before a dash, or the last one behind a dash
    n = F.size("w")
    at = lambda i: F.coalesce(F.try_element_at("w", i.cast("int")), F.lit(""))
    counts, dash = lambda x: x.rlike(r"^\d{1,4}$"), lambda x: x.isin("-", "–", "—")
    front, back = counts(at(F.lit(1))) & dash(at(F.lit(2))), counts(at(n)) & dash(at(n - 1))
    title = F.when(front, F.slice("w", 3, n)).when(back, F.slice("w", 1, n - 2))
    marks = top.where((n >= 4) & (front | back)).withColumn("counter", F.when(front, at(F.lit(1))).otherwise(at(n)).cast("int")).withColumn("title", F.array_join(title, " "))
    marks = marks.where((F.size(L.words(F.col("title"))) >= 2) & L.players(F.col("title")).isNull() & ~F.col("title").rlike(r"\d") & ~L.tells_outcome(F.col("title")))
    # pages at most two apart whose counters differ as much: the difference of page and counter is the same
    w = Window.partitionBy(book, F.col("counter") - F.col(page)).orderBy(page)
    gap = lambda c: c.between(1, 2)
    agreed = marks.withColumn("b", F.col(page) - F.lag(page).over(w)).withColumn("a", F.lead(page).over(w) - F.col(page)).where(gap(F.col("b")) | gap(F.col("a")))
    keep = lambda df: df.select(book, page, "line_no")
    return keep(repeated.unionByName(chapter).where(~L.kept_heading(F.col("key")))).unionByName(keep(agreed)).distinct()


def without(lines: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    return lines.join(heads, keys, "left_anti")


def section_events(lines: DataFrame, on: list[str]) -> DataFrame:
    """Lines with ``event``: game_boundary (a heading with an opening or diagram within the next 25 lines and before the
    next heading), game_result (a draw line), game_end (credit or chapter), NULL otherwise."""
    rows = lines.withColumn("kind", L.line_kind(F.col("line")))
    rows = S.ahead(S.ahead(rows, on, ["line_no"], "line", 25, "next_lines"), on, ["line_no"], "kind", 25, "next_kinds")
    stop = F.array_position("next_kinds", F.lit("heading"))
    stop2 = F.array_position("next_kinds", F.lit("chapter"))
    cut = F.least(F.when(stop > 0, stop - 1).otherwise(25), F.when(stop2 > 0, stop2 - 1).otherwise(25)).cast("int")
    following = F.array_join(F.slice("next_lines", F.lit(1), cut), " ")
    opening = following.rlike(L.OPENING) | following.rlike("__BOARD_") | (F.size(N.fens(following)) > 0)
    event = F.when((F.col("kind") == "heading") & opening, "game_boundary").when(F.col("kind") == "draw", "game_result").when(F.col("kind").isin("credit", "chapter"), "game_end")
    return rows.withColumn("event", event).withColumn("number", F.when(event == "game_boundary", L.heading_number(F.col("line")))).drop("next_lines", "next_kinds")


def numbered_sections(lines: DataFrame, on: list[str]) -> DataFrame:
    """Every line with the number of its section (0 before the first heading)."""
    return S.sections(section_events(lines, on), on, ["line_no"], F.col("event").isin("game_boundary", "game_end"))


def page_defects(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., orphans, mixed, backtracks): signs that columns ran together."""
    events = section_events(lines, keys)
    rows = lines.withColumn("row", L.long_rows(F.col("line"))).withColumn("head", L.heading_number(F.col("line")).isNotNull())
    sect = S.sections(rows, keys, ["line_no"], F.col("head"))
    back = S.backtracks(sect.where("row is not null"), [*keys, "section"], ["line_no"], "row").groupBy(*keys).agg(F.sum("backtracks").alias("backtracks"))
    flags = events.groupBy(*keys).agg(F.count_if((F.col("kind") == "heading") & F.col("event").isNull()).alias("orphans"), F.count_if(L.mixed_row(F.col("line"))).alias("mixed"))
    return flags.join(back, keys, "left").na.fill(0, ["backtracks"])


def broken_words(lines: DataFrame, on: list[str], lexicon: DataFrame) -> DataFrame:
    """Words hyphenated across lines with the spelling the lexicon knows: joined or with the hyphen, if exactly one of
    both is known; ``dictionary_unavailable`` where the lexicon is empty is for the caller to say."""
    w = Window.partitionBy(*on).orderBy("line_no")
    left, right = F.regexp_extract("line", r"(\p{L}+)-\s*$", 1), F.regexp_extract(F.lead("line").over(w), r"^\s*(\p{Ll}\p{L}*)", 1)
    pairs = lines.select(*on, "line_no", left.alias("left"), right.alias("right")).where("left <> '' and right <> ''")
    both = pairs.select("*", F.explode(F.array(F.struct(F.lit("joined").alias("form"), F.lower(F.concat("left", "right")).alias("word")), F.struct(F.lit("hyphen").alias("form"), F.lower(F.concat_ws("-", "left", "right")).alias("word")))).alias("f")).select(*on, "line_no", "left", "right", "f.form", "f.word")
    known = both.join(lexicon.select(F.lower("word").alias("word")).distinct(), "word")
    return known.groupBy(*on, "line_no", "left", "right").agg(F.count("*").alias("n"), F.first("form").alias("form"), F.first("word").alias("word")).where("n = 1").drop("n")


def visual_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a page (x0, y0, x1, y1, text) with ``line``: clustered by their middles against running means of the last
    four lines, then each given to the nearest line.  A page is one small group."""
    ship(words.sparkSession)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "x0"], kind="stable").reset_index(drop=True)
        mid, high = ((pdf["y0"] + pdf["y1"]) / 2).to_numpy(float), (pdf["y1"] - pdf["y0"]).to_numpy(float)
        lines: list[list[float]] = []  # middle, height, count
        for m, h in zip(mid, high):
            for ln in reversed(lines[-4:]):
                if abs(m - ln[0]) <= 0.45 * (h + ln[1]) / 2:
                    ln[0] += (m - ln[0]) / (ln[2] + 1)
                    ln[1] += (h - ln[1]) / (ln[2] + 1)
                    ln[2] += 1
                    break
            else:
                lines.append([m, h, 1])
        centre = np.array(sorted(ln[0] for ln in lines))
        pdf["line"] = np.abs(mid[:, None] - centre[None, :]).argmin(1) + 1 if len(pdf) else []
        return pdf

    fields = ", ".join(f"`{n}` {t}" for n, t in words.dtypes)
    return words.groupBy(*keys).applyInPandas(cluster, f"{fields}, line bigint")


def lines_text(words: DataFrame, keys: list[str], width: str = "width") -> DataFrame:
    """(keys..., line, text): words of a line from left to right; a gap of more than a quarter of the page reads as a dash."""
    w = Window.partitionBy(*keys, "line").orderBy("x0")
    gap = F.col("x0") - F.lag("x1").over(w)
    part = words.withColumn("sep", F.when(gap.isNull(), "").when(gap > 0.25 * F.col(width), " – ").otherwise(" "))
    return part.groupBy(*keys, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", F.concat("sep", "text").alias("t")))), lambda e: e["t"]), "").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def column_gap(words: DataFrame, keys: list[str], width: str = "width") -> DataFrame:
    """(keys..., gap): the middle of the free band between two columns of a page; no row where there is none: either side
    needs a fifth of the words, and enough lines must have words on both sides of the gap."""
    ship(words.sparkSession)
    out_keys = ", ".join(f"`{k}` {dict(words.dtypes)[k]}" for k in keys)

    def find(key, pdf: pd.DataFrame) -> pd.DataFrame:
        none = pdf[keys].head(0).assign(gap=pd.Series(dtype=float))
        page = float(pdf[width].iloc[0])
        x0, x1, y = pdf["x0"].to_numpy(float), pdf["x1"].to_numpy(float), ((pdf["y0"] + pdf["y1"]) / 2).to_numpy(float)
        xs = np.arange(int(page * 0.3), int(page * 0.7) + 1)
        left, right = (x1[None, :] <= xs[:, None] + 4).sum(1), (x0[None, :] >= xs[:, None] - 4).sum(1)
        inside = len(pdf) - (x1[None, :] <= xs[:, None]).sum(1) - (x0[None, :] >= xs[:, None]).sum(1)
        ok = (left >= 0.2 * len(pdf)) & (right >= 0.2 * len(pdf))
        if not ok.any():
            return none
        best = min((int(n), abs(x - page / 2), int(x)) for n, x, good in zip(inside, xs, ok) if good)[2]
        rows = np.unique(np.round(y / 4))
        pairs = [((x1[np.round(y / 4) == r] <= best + 4).any() and (x0[np.round(y / 4) == r] >= best - 4).any()) for r in rows]
        run = longest = 0
        for p in pairs:
            run = run + 1 if p else 0
            longest = max(longest, run)
        n = sum(pairs)
        if not (n >= max(5, 0.3 * len(rows)) or n >= 8 and longest >= 5):
            return none
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "gap": [float(best)]})

    return words.groupBy(*keys).applyInPandas(find, f"{out_keys}, gap double")


def reading_order(lines: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (x0, y0, x1, y1) in reading order: inside a band of two-column lines the left column comes first;
    full-width lines stay in place; bands of fewer than three lines count as full width."""
    g = lines.join(gaps, keys, "left")
    side = F.when(F.col("gap").isNull() | (F.col("x0") < F.col("gap") - 4) & (F.col("x1") > F.col("gap") + 4), 0).when(F.col("x1") <= F.col("gap") + 4, 1).otherwise(2)
    rows = S.islands(g.withColumn("side", side).withColumn("wide", F.col("side") == 0), keys, ["y0", "x0"], "wide", "band")
    n = F.count("*").over(Window.partitionBy(*keys, "band"))
    rows = rows.withColumn("side", F.when(n < 3, 0).otherwise(F.col("side")))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("band", "side", "y0", "x0"))).drop("wide", "gap")


def tokens(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., line_no, pos, kind, number, black, text): words of lines as tokens num, open, close, result, fen, diagram
    or word.  A number glued to a move is split from it, brackets stand alone."""
    spaced = F.regexp_replace(F.regexp_replace(N.clean_text(F.col("line")), r"([(\[{])(?!#)|(?<!#)([)\]}])", " $1$2 "), r"(\d{1,3}(?:\.{1,3}|…))(?=[^\s.…])", "$1 ")
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")
    rows = lines.select(*keys, "line_no", F.posexplode(words).alias("pos", "text"))
    num = N.move_number(F.col("text"))
    kind = (
        F.when(num.isNotNull() & (num["rest"] == ""), "num").when(F.col("text").isin("(", "[", "{"), "open").when(F.col("text").isin(")", "]", "}"), "close")
        .when(F.col("text").isin("[#]", "(D)", "{#}"), "diagram").when(F.col("text").startswith("__BOARD_"), "board").when(N.result(F.regexp_replace("text", "[.,;]+$", "")).isNotNull(), "result").otherwise("word")
    )
    return rows.select(*keys, "line_no", "pos", kind.alias("kind"), num["number"].alias("number"), num["black"].alias("black"), "text")


def table_rows(tok: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., line_no, number, moves, is_row): lines that are a number and one to four words, all of them moves or at
    most three characters long, one a move at least."""
    move = F.when(F.col("kind") == "word", N.move_code(F.col("text")).isNotNull())
    agg = tok.groupBy(*keys, "line_no").agg(
        F.count_if(F.col("kind") == "num").alias("nums"), F.min_by("kind", "pos").alias("first"), F.min_by("number", "pos").alias("number"), F.count_if(F.col("kind") == "word").alias("words"),
        F.count_if(F.col("kind").isin("open", "close")).alias("brackets"),
        F.bool_and(F.coalesce(move | (F.length("text") <= 3), F.lit(True))).alias("fit"), F.count_if(F.coalesce(move, F.lit(False))).alias("moves"),
    )
    return agg.select(*keys, "line_no", "number", "moves", ((F.col("first") == "num") & (F.col("nums") == 1) & F.col("words").between(1, 4) & F.col("fit") & (F.col("moves") >= 1) & (F.col("brackets") == 0)).alias("is_row"))


def table_layout(rows: DataFrame, book: list[str]) -> DataFrame:
    """(book..., is_table): a book of rows: five rows at least that are 30 % of its numbered lines."""
    return rows.groupBy(*book).agg(F.count_if("is_row").alias("rows"), F.count_if(F.col("number").isNotNull()).alias("numbered")).withColumn("is_table", (F.col("rows") >= 5) & (F.col("rows") >= 0.3 * F.col("numbered")))
