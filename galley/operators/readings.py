"""Several readings of one source brought together: rows, numbers, openings, ranks; everything abstains on doubt.

Rows are (book, page, ord, number, words array<string>), one per printed table row, of each reading.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import notation as N
from . import matching as M
from . import sequences as S

ON = ["book", "page"]


def seq_ratio(a: Column, b: Column) -> Column:
    """Share of matching characters of two texts; NULL for a NULL."""

    @F.arrow_udf("double")
    def f(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else M.ratio(p, q) for p, q in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    return f(a, b)


def _shapes(c: Column) -> Column:
    return F.array_join(F.transform(c, N.shape), " ")


def _triples(rows: DataFrame, prefix: str) -> DataFrame:
    w = Window.partitionBy(*ON).orderBy("ord")
    t = rows.withColumn("text", _shapes(F.col("words")))
    out = t.select(*ON, "ord", F.lag("number").over(w).alias("n0"), F.col("number").alias("n1"), F.lead("number").over(w).alias("n2"), F.lag("text").over(w).alias("t0"), F.col("text").alias("t1"), F.lead("text").over(w).alias("t2")).where("n0 is not null and n2 is not null")
    return out.select(*ON, *(F.col(c).alias(f"{prefix}{c}") for c in out.columns if c not in ON))


def row_pairs(first: DataFrame, second: DataFrame, least: float = 0.4) -> DataFrame:
    """(book, page, number, ord, other, ratio): rows of equal page and number paired one to one.  Groups of equal size pair
    by place; others by mutual best with 0.6 and a lead of 0.1 over every rival."""
    keys = [*ON, "number"]
    n = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    even = n(first, "a").join(n(second, "b"), keys).withColumn("even", F.col("a") == F.col("b"))
    by_place = M.ordinal_pairs(first.select(*keys, "ord"), second.select(*keys, "ord"), keys, "ord").select(*keys, "ord", F.col("ord_right").alias("other"))
    text = lambda df, o, t: df.select(*keys, F.col("ord").alias(o), _shapes(F.col("words")).alias(t))
    both = text(first, "ord", "t").join(text(second, "other", "u"), keys).withColumn("ratio", seq_ratio(F.col("t"), F.col("u")))
    same = by_place.join(even.where("even").select(*keys), keys, "left_semi").join(both.select(*keys, "ord", "other", "ratio"), [*keys, "ord", "other"]).where(F.col("ratio") >= least)
    uneven = both.join(even.where("not even").select(*keys), keys, "left_semi")
    best = uneven.where("ratio >= 0.6")
    lead = lambda side: Window.partitionBy(*keys, side).orderBy(F.desc("ratio"))
    ranked = best.withColumn("ra", F.row_number().over(lead("ord"))).withColumn("na", F.lead("ratio").over(lead("ord"))).withColumn("rb", F.row_number().over(lead("other"))).withColumn("nb", F.lead("ratio").over(lead("other")))
    clear = ranked.where("ra = 1 and rb = 1 and (na is null or ratio - na >= 0.1) and (nb is null or ratio - nb >= 0.1)")
    return same.select(*keys, "ord", "other", "ratio").unionByName(clear.select(*keys, "ord", "other", "ratio"))


def number_consensus(first: DataFrame, second: DataFrame, least: float = 0.65) -> DataFrame:
    """(book, page, ord, printed, number): row numbers of the first reading that the second corrects: the rows before and
    after bear the neighbouring numbers in both, all three texts agree, the printed number is one digit off, and the second
    reading has that run of three once on the page."""
    a, b = _triples(first, "a_"), _triples(second, "b_").where("b_n0 = b_n1 - 1 and b_n2 = b_n1 + 1")
    once = M.only_one(b, [*ON, "b_n1"])
    hit = a.join(once, ON).where("a_n0 = b_n0 and a_n2 = b_n2 and a_n1 <> b_n1").where(N.digits_off_by_one(F.col("a_n1"), F.col("b_n1")))
    for k in "012":
        hit = hit.where(seq_ratio(F.col(f"a_t{k}"), F.col(f"b_t{k}")) >= least)
    return hit.select(*ON, F.col("a_ord").alias("ord"), F.col("a_n1").alias("printed"), F.col("b_n1").alias("number"))


def source_numbers(first: DataFrame, source: DataFrame) -> DataFrame:
    """As ``number_consensus`` for half rows: the number before is one less, the half row after bears the same number; the
    middle text must agree by 0.8, the others by 0.65, and only one place of the page may fit."""
    a = _triples(first, "a_").where("a_n2 = a_n0 + 1 and a_n1 > 0 and a_n1 < a_n2 - 1").where(N.digits_off_by_one(F.col("a_n1"), F.col("a_n2")))
    b = _triples(source, "b_").where("b_n1 = b_n0 + 1 and b_n2 = b_n1")
    hit = a.join(b, ON).where("a_n0 = b_n0 and a_n2 = b_n2")
    for k, least in (("0", 0.65), ("1", 0.8), ("2", 0.65)):
        hit = hit.where(seq_ratio(F.col(f"a_t{k}"), F.col(f"b_t{k}")) >= least)
    return M.only_one(hit, [*ON, "a_ord"]).select(*ON, F.col("a_ord").alias("ord"), F.col("a_n1").alias("printed"), F.col("b_n1").alias("number"))


def recovered_openings(first: DataFrame, second: DataFrame, least: float = 0.6) -> DataFrame:
    """Rows 1..k-1 of the second reading of a section whose first reading starts at row k >= 3: the headings agree, rows k
    and k + 1 agree in both readings, and the missing rows are all there, in order, with two moves each.  Rows carry
    (book, section, heading) besides the usual fields."""
    on = ["book", "section"]
    w = Window.partitionBy(*on).orderBy("ord")
    head = lambda df, p: df.withColumn("r", F.row_number().over(w)).withColumn("text", _shapes(F.col("words"))).select(*on, F.col("heading").alias(f"{p}h"), F.col("r").alias(f"{p}r"), F.col("number").alias(f"{p}n"), F.col("text").alias(f"{p}t"), F.col("words").alias(f"{p}w"), F.col("ord").alias(f"{p}o"))
    a, b = head(first, "a"), head(second, "b")
    start = a.where("ar = 1 and an >= 3").select(*on, F.col("ah").alias("h"), F.col("an").alias("k"))
    # the two anchors of each reading
    anchors = a.where("ar <= 2").join(start, on).join(b, on).where("an = bn and ah = bh and bn - k + 1 = ar and br = bn").where(seq_ratio(F.col("at"), F.col("bt")) >= least)
    sure = anchors.groupBy(*on).agg(F.count("*").alias("n")).where("n = 2").select(*on)
    pre = b.join(start, on).where("bn < k and bh = h and br = bn and size(bw) = 2")
    full = pre.groupBy(*on, "k").agg(F.count("*").alias("n")).where("n = k - 1").select(*on)
    return pre.join(sure, on, "left_semi").join(full, on, "left_semi").select(*on, F.col("bn").alias("number"), F.col("bw").alias("words"), F.col("bo").alias("ord"))


def between_anchors(first: DataFrame, second: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the second reading without a pair that lie between two paired rows: they fill the place between those rows of
    the first reading, at a fractional ``line``."""
    mark = second.join(pairs.select(*ON, F.col("other").alias("ord"), F.col("ord").alias("mine")), [*ON, "ord"], "left")
    rows = M.gap_fill(mark, ON, "ord", "mine").where("anchor_before is not null and anchor_after is not null")
    place = F.row_number().over(Window.partitionBy(*ON, "anchor_before").orderBy("ord"))
    return rows.withColumn("line", F.col("anchor_before") + 0.5 + place / 1000).drop("mine")


#: A rank read as a letter, and the ranks it may be.
UNCLEAR_RANK = {"b": "56", "d": "45"}


def source_readings(targets: DataFrame, source: DataFrame) -> DataFrame:
    """(book, page, ord, side, reading, conflict): a rank that the first reading left unclear, from the one row of the source
    with the same page, number and other move.  Targets: (book, page, ord, number, side 0|1, word, peer, readings).
    ``conflict`` tells that an earlier clear reading says something else; then nothing is to be replaced."""
    s = source.where(F.size("words") == 2).select(*ON, "number", "words")
    both = targets.join(s, [*ON, "number"]).where("ord is not null and side is not null").withColumn("reading", F.element_at("words", F.col("side") + 1))
    other = F.element_at("words", F.when(F.col("side") == 0, 2).otherwise(1))
    # a shape is costly, and as a key or in a filter it would be told again for each comparison of a sort and each use: it is
    # a column of the rows that met, and what is chosen is chosen behind the count
    same = both.withColumn("same", N.move_code(other) == N.move_code(F.col("peer")))
    row = F.struct("readings", "reading", N.move_code(F.col("reading")).alias("code"), N.move_code(F.col("word")).alias("old"))
    one = same.groupBy(*ON, "ord", "side").agg(F.count_if("same").alias("n"), F.first(F.when(F.col("same"), row), True).alias("row")).where("n = 1").select(*ON, "ord", "side", "row.*")
    code, old = F.col("code"), F.col("old")
    p = r"^([a-h])([2-7])-([a-h])(.)$"
    ranks = F.create_map(*(F.lit(x) for kv in UNCLEAR_RANK.items() for x in kv))
    fits = code.rlike(r"^([a-h])[2-7]-\1[1-8]$") & old.rlike(r"^([a-h])[2-7]-\1[bd]$") & (F.regexp_extract(code, p, 1) == F.regexp_extract(old, p, 1)) & (F.regexp_extract(code, p, 2) == F.regexp_extract(old, p, 2)) & F.try_element_at(ranks, F.regexp_extract(old, p, 4)).contains(F.regexp_extract(code, p, 4))
    clear = F.filter(F.transform(F.coalesce("readings", F.array().cast("array<string>")), N.move_code), lambda c: c.rlike("^[a-h][1-8]-[a-h][1-8]$"))
    return one.where(fits).select(*ON, "ord", "side", "reading", F.exists(clear, lambda c: c != code).alias("conflict"))


def black_row(text: Column) -> Column:
    """struct<number, start, end, marks> of a row that holds Black's long move only (12... or 12. ...), its piece perhaps
    misread."""
    p = r"^\s*(\d{1,3})\s*(?:\.\s*){3,4}[^\s\d.]{1,2}?([a-h][1-8])[—–-]([a-h][1-8])([+!?]*)\s*[|\]]?\s*$"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).cast("int").alias("number"), F.regexp_extract(text, p, 2).alias("start"), F.regexp_extract(text, p, 3).alias("end"), F.regexp_extract(text, p, 4).alias("marks")))


def agreed_black_row(a: Column, b: Column) -> Column:
    """The reading of two scans of one row if both are complete and equal; NULL otherwise."""
    return F.when(black_row(a) == black_row(b), black_row(a))


def improved(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., improved) of two readings' defects (keys..., orphans, mixed, backtracks, headings array): the new one keeps all
    headings and is better in one respect without being worse in orphans."""
    b = before.select(*keys, *(F.col(c).alias(f"b_{c}") for c in ("orphans", "mixed", "backtracks", "headings")))
    both = after.join(b, keys)
    kept = (F.size(F.array_except("b_headings", "headings")) == 0) & (F.col("orphans") <= F.col("b_orphans"))
    better = (F.col("orphans") < F.col("b_orphans")) | (F.col("b_mixed") >= 2) & (F.col("mixed") < F.col("b_mixed")) | (F.col("mixed") <= F.col("b_mixed")) & (F.col("backtracks") < F.col("b_backtracks"))
    return both.select(*keys, (kept & better).alias("improved"))


def closing_comments(tokens: DataFrame, on: list[str]) -> DataFrame:
    """(on..., tok, comment, reason) for each result token: the paragraph after it, if a boundary ends it within 160 tokens and 12
    lines of the same page, its brackets are balanced, it holds no structure, and it has two moves if it has a number; else why not.
    Rows: (on..., tok, kind, text, page, line)."""
    w = Window.partitionBy(*on).orderBy("tok")
    ahead = w.rowsBetween(1, 160)
    stop = F.struct("tok", "kind", "page", "line")
    marks = tokens.withColumn("next", F.min(F.when(F.col("kind").isin("paragraph", "boundary", "end", "result", "fen", "board", "diagram"), stop)).over(ahead))
    # a blank line right after the result belongs to it
    after = F.lead("kind").over(w)
    second = F.min(F.when(F.col("kind").isin("paragraph", "boundary", "end", "result", "fen", "board", "diagram"), stop)).over(w.rowsBetween(2, 160))
    res = marks.withColumn("stop", F.when(after == "paragraph", second).otherwise(F.col("next"))).where("kind = 'result'")
    res = res.select(*on, "tok", "page", "line", "stop")
    near = F.coalesce(F.col("stop.kind").isin("paragraph", "boundary", "end") & (F.col("stop.page") == F.col("page")) & (F.col("stop.line") - F.col("line") <= 12), F.lit(False))
    spans = res.where(near).select(*on, F.col("tok").alias("at"), (F.col("tok") + 1).alias("a"), (F.col("stop.tok") - 1).alias("b"))
    t = tokens.select(*on, "tok", "kind", "text")
    inside = M.range_join(t, spans, on, "tok", "a", "b", 256.0).where("kind <> 'paragraph'")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    deep = inside.withColumn("d", F.sum(step).over(Window.partitionBy(*on, "at").orderBy("tok")))
    agg = deep.groupBy(*on, "at").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok", "text"))), lambda e: e["text"]), " ").alias("comment"), F.min("d").alias("low"), F.max_by("d", "tok").alias("end"),
        F.count_if(~F.col("kind").isin("num", "word", "open", "close")).alias("other"), F.count_if(F.col("kind") == "num").alias("nums"), F.count_if((F.col("kind") == "word") & N.move_code(F.col("text")).isNotNull() & F.col("text").rlike("[a-h][1-8]|0-0")).alias("moves"), F.count("*").alias("n"),
    )
    out = res.withColumn("near", near).join(agg.withColumnRenamed("at", "tok"), [*on, "tok"], "left")
    reason = (
        F.when(~F.col("near"), "no_nearby_boundary").when(F.col("n").isNull(), "empty").when((F.col("low") < 0) | (F.col("end") != 0), "unbalanced_brackets").when(F.col("other") > 0, "unsupported_structure")
        .when((F.col("nums") > 0) & (F.col("moves") < 2), "insufficient_notation").when((F.col("nums") == 0) & (F.col("n") > 25), "unbounded_prose_subject")
    )
    return out.select(*on, "tok", F.when(reason.isNull(), F.col("comment")).alias("comment"), reason.alias("reason"))


# Words by which German prose is known.
GERMAN_WORDS = ("und", "der", "die", "nicht")


def page_language(samples: DataFrame, book: list[str]) -> DataFrame:
    """(book..., lang): the language of a book from sample pages: by its moves if one language has five hits and more than
    twice the next, else by the share of Cyrillic letters (above 0.2), else by German (three umlauts or words)."""
    text = F.col("text")
    hits = L.language_hits(text)
    letters = lambda c: F.sum(F.length(F.regexp_replace(text, f"[^{c}]", "")))
    german = F.size(F.filter(L.words(text), lambda w: F.lower(w).isin(*GERMAN_WORDS) | w.rlike("[äöüß]")))
    a = samples.groupBy(*book).agg(*(F.sum(n).alias(k) for k, n in hits.items()), letters(r"\p{L}").alias("letters"), letters(r"\p{IsCyrillic}").alias("cyrillic"), F.sum(german).alias("german"))
    order = L.language_order({k: F.col(k) for k in hits})
    counts = F.sort_array(F.array(*(F.col(k) for k in hits)), asc=False)
    clear = (counts[0] >= 5) & (counts[0] > 2 * counts[1])
    lang = F.when(clear, order[0]).when((F.col("letters") > 0) & (F.col("cyrillic") > 0.2 * F.col("letters")), "ru").when(F.col("german") >= 3, "de").otherwise("en")
    return a.select(*book, lang.alias("lang"))


def game_headers(lines: DataFrame, starts: DataFrame, on: list[str]) -> DataFrame:
    """(on..., line_no, white, black, event, site, date, eco) from at most four lines with text among the twelve above a game's first
    line.  Rows: lines (on..., line_no, line), starts (on..., line_no)."""
    spans = starts.select(*on, F.col("line_no").alias("at"), (F.col("line_no") - 12).alias("a"), (F.col("line_no") - 1).alias("b"))
    near = M.range_join(lines.select(*on, F.col("line_no").alias("n"), "line"), spans, on, "n", "a", "b", 16.0)
    text = near.where((F.trim("line") != "") & ~F.col("line").rlike(r"^\s*\d+\s*$") & (F.size(N.fens(F.col("line"))) == 0)).withColumn("r", F.row_number().over(Window.partitionBy(*on, "at").orderBy(F.desc("n")))).where("r <= 4")
    # notation above ends the search
    text = text.withColumn("stopped", F.max((F.col("line").rlike(L.OPENING) & ~F.col("line").contains("·")).cast("int")).over(Window.partitionBy(*on, "at").orderBy("r"))).where("stopped = 0")
    venue = r"^(.{2,60}?)(?:,\s*|\s+)((?:18|19|20)\d{2})(?:\s*г\.?)?\s*$"
    dots = F.transform(F.split("line", "·"), lambda x: F.trim(x))
    dotted = F.col("line").contains("·")
    date = F.element_at(dots, -1)
    first = lambda c, ok: F.min_by(F.when(ok, c), F.when(ok, F.col("r")))
    both = L.players(F.col("line"))
    names = both.isNotNull() & ~F.col("line").rlike(r"\d")
    isvenue = F.col("line").rlike(venue) & ~dotted
    dated = dotted & date.rlike(r"^\d{4}(\.(\d\d|\?\?)){0,2}$")
    return text.groupBy(*on, "at").agg(
        first(both["white"], names).alias("white"), first(both["black"], names).alias("black"), first(F.element_at(dots, 1), dotted).alias("event"),
        F.coalesce(first(F.when(F.size(dots) >= 3, F.element_at(dots, 2)), dotted), first(F.regexp_extract("line", venue, 1), isvenue)).alias("site"),
        F.coalesce(first(date, dated), first(F.concat(F.regexp_extract("line", venue, 2), F.lit(".??.??")), isvenue)).alias("date"), first(F.regexp_extract("line", r"\b([A-E][0-9]{2})\b", 1), F.col("line").rlike(r"\b[A-E][0-9]{2}\b")).alias("eco"),
    ).withColumnRenamed("at", "line_no")


def paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (x0, text) with ``new_paragraph``: the line before ends a sentence and this one is indented by 7 to 22 points."""
    w = Window.partitionBy(*keys).orderBy("line")
    indent = F.col("x0") - F.min("x0").over(Window.partitionBy(*keys))
    return lines.withColumn("new_paragraph", F.coalesce(L.sentence_end(F.lag("text").over(w)) & indent.between(7, 22), F.lit(False)))


def restored(boxes: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of a stacked page back at their place: each lies in exactly one region (keys..., top, bottom, dx, dy), else it is left
    out.  Rows: (keys..., x0, y0, x1, y1).  A page's regions are few and travel as one array."""
    own = regions.groupBy(*keys).agg(F.collect_list(F.struct("top", "bottom", "dx", "dy")).alias("__r"))
    mid = (F.col("y0") + F.col("y1")) / 2
    hit = boxes.join(own, keys).withColumn("__r", F.filter("__r", lambda r: mid.between(r["top"], r["bottom"]))).where(F.size("__r") == 1).withColumn("__r", F.col("__r")[0])
    moved = [(F.col(c) + F.col(f"__r.{d}")).alias(c) for c, d in (("x0", "dx"), ("y0", "dy"), ("x1", "dx"), ("y1", "dy"))]
    return hit.select(*[c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")], *moved)


def row_context(tok: DataFrame, on: list[str]) -> DataFrame:
    """Tokens with the next row word and whether an exact row follows within 200, for folds that look ahead."""
    move = (F.col("kind") == "word") & N.move_code(F.col("text")).isNotNull()
    return S.next_anchor(S.next_anchor(tok, on, "tok", move & F.col("in_row"), "next_row_word", 200), on, "tok", F.col("in_row") & (F.col("kind") == "num"), "next_row", 200)
