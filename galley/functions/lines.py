"""Lines and pages of text as column expressions.

Headings, players, chapters and credits are told by what kinds of words a line is made of, not by one pattern each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import notation

# The words that head games, chapters, credits, draws and results in print.
GAME_SIGNS = ("№", "No", "Nо", "Ne", "Nе", "N°", "Nº", "N")
SCANNED_SIGNS = ("M", "М")
CHAPTER_WORDS = ("глава", "chapter", "kapitel", "capítulo")
ORDINALS = ("первая", "вторая", "третья", "четвертая", "пятая", "шестая", "седьмая", "восьмая", "девятая", "десятая")
CREDIT_WORDS = ("Примечания", "Комментарии")
AUTHOR_WORD = "автора"
DRAW_LINES = ("ничья", "согласились на ничью", "draw", "draw agreed", "remis")
OUTCOME_STEMS = ("сдал", "resign", "ничья", "draw")
PARTICLES = ("van", "von", "de", "ван", "де", "фон")
#: A title above moves may have so many characters; a running head fewer.
TITLE_LENGTH, HEAD_LENGTH = (4, 91), 80

_BLANK = r"\s+"
#: The first move of a game, as it stands at the beginning of notation.
OPENING = r"(?<!\d)1\s*\.\s*(?:" + notation._FILE + notation._RANK + "|" + notation._PIECE + ")"
#: A long move in any writing, with an unread file of Cyrillic print.
LONG_MOVE = rf"[\p{{L}}♔-♟]?[a-hа-н]{notation._RANK}[—–:-][a-hа-н]{notation._RANK}[+!?]*"


def words(c: Column) -> Column:
    return F.filter(F.split(c, _BLANK), lambda w: w != "")


def needs_scan(text: Column) -> Column:
    """A page without text, or with at least 3 damaged characters (unknown or of private use) that are more than a
    twentieth of it."""
    damaged = F.length(F.regexp_replace(text, r"[^\x{FFFD}\x{E000}-\x{F8FF}]", ""))
    return text.isNull() | (F.trim(text) == "") | ((damaged >= 3) & (damaged > F.length(text) * 0.05))


def page_number_line(line: Column) -> Column:
    return line.rlike(r"^\s*\d+\s*$")


def junk_line(line: Column) -> Column:
    """One to four words, and none that is a real word, a result, a number or a move."""
    plain = lambda w: F.regexp_replace(w, r"^[()\[\]{},;]+|[()\[\]{},;]+$", "")
    real = lambda w: (
        w.rlike("[a-zа-яäöüß]{4,}") | notation.result(plain(w)).isNotNull() | plain(w).rlike(r"^\d{1,3}(?:\.{1,3}|…)") | ((F.length(plain(w)) >= 2) & notation.move_code(plain(w)).isNotNull())
    )
    return F.size(words(line)).between(1, 4) & ~F.exists(words(line), real)


def head_key(line: Column) -> Column:
    """A line without page numbers and dashes at its ends."""
    return F.btrim(line, F.lit("0123456789–—- \t"))


def heading_number(line: Column, scanned: bool = False) -> Column:
    """The number of a game that the line heads: a sign for "number" and the number; NULL for other lines.  ``scanned``
    also takes what scans make of that sign, if nothing but a title follows."""
    signs = "|".join(re.escape(s) for s in sorted(GAME_SIGNS, key=len, reverse=True))
    found = F.regexp_extract(F.trim(line), rf"^(?i:{signs})\.?\s*(\d{{1,4}})(?:\.?(?:\s|$))", 1)
    if scanned:
        other = F.regexp_extract(F.trim(line), rf"^(?:{'|'.join(SCANNED_SIGNS)})\s+(\d{{1,4}})(?:\.?(?:\s|$))", 1)
        found = F.when(found == "", other).otherwise(found)
    return F.when(found != "", found.cast("int"))


def title_number(line: Column) -> Column:
    """The number of a plain numbered title (12. A title without further digits); NULL for other lines."""
    first = F.coalesce(F.try_element_at(words(line), F.lit(1)), F.lit(""))
    rest = F.trim(F.substring(F.trim(line), F.length(first) + 1, F.length(line)))
    good = first.rlike(r"^\d{1,3}\.$") & rest.rlike(r"^\p{Lu}") & ~rest.rlike(r"\d") & F.length(rest).between(*TITLE_LENGTH)
    return F.when(good, F.regexp_extract(first, r"\d+", 0).cast("int"))


def chapter_line(line: Column) -> Column:
    """A chapter word and what counts it: a number, a Roman number, an ordinal; other languages than Russian take any word."""
    w = F.transform(words(line), F.lower)
    first, second = F.try_element_at(w, F.lit(1)), F.coalesce(F.try_element_at(w, F.lit(2)), F.lit(""))
    counted = second.rlike(r"^[ivxlc\d]+$") | second.isin(*ORDINALS)
    return F.coalesce(F.when(first == CHAPTER_WORDS[0], counted).otherwise(first.isin(*CHAPTER_WORDS[1:]) & (second != "")), F.lit(False))


def credit_line(line: Column) -> Column:
    """Who wrote the notes: a credit word and a name, or the word for the author."""
    w = words(line)
    second = F.coalesce(F.try_element_at(w, F.lit(2)), F.lit(""))
    return F.coalesce(F.try_element_at(w, F.lit(1)).isin(*CREDIT_WORDS) & (second.rlike(r"^\p{Lu}") | (second == AUTHOR_WORD)), F.lit(False))


def draw_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(line), "[.!?]$", "")).isin(*DRAW_LINES)


def tells_outcome(line: Column) -> Column:
    low = F.lower(line)
    return F.exists(F.array(*map(F.lit, OUTCOME_STEMS)), lambda s: low.contains(s))


def players(line: Column) -> Column:
    """struct<white, black> of a line that is two names: each up to two initials, perhaps a particle, one surname; a dash may
    stand between them.  NULL for other lines.  Each word gives one letter (I, P, S, D, else X); the letters decide."""
    w = words(F.regexp_replace(line, r"(?<=\b\p{Lu}\.)(?=\p{Lu})", " "))
    kind = lambda x: (
        F.when(x.rlike(r"^\p{Lu}\.$"), "I").when(F.lower(x).isin(*PARTICLES), "P").when(x.isin("-", "–", "—"), "D").when(x.rlike(r"^\p{Lu}[\p{L}'’-]{1,30}$"), "S").otherwise("X")
    )
    shape = F.array_join(F.transform(w, kind), "")
    name = "I{0,2}P?S"
    white = F.length(F.regexp_extract(shape, f"^({name})D?{name}$", 1))
    black = F.length(F.regexp_extract(shape, f"^{name}D?({name})$", 1))
    join = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    found = F.struct(join(F.lit(1), white).alias("white"), join(F.size(w) - black + 1, black).alias("black"))
    return F.when(shape.rlike(f"^{name}D?{name}$"), found)


def kept_heading(key: Column) -> Column:
    """Lines that are never running heads: game headings, players, notation, results."""
    numbered = heading_number(key).isNotNull() | title_number(key).isNotNull() | key.rlike(r"\d+\s*\.")
    return (F.length(key) >= HEAD_LENGTH) | numbered | players(key).isNotNull() | tells_outcome(key)


def line_kind(line: Column) -> Column:
    """heading, players, chapter, credit, draw, number, junk or text."""
    return (
        F.when(heading_number(line).isNotNull(), "heading").when(players(line).isNotNull(), "players").when(chapter_line(line), "chapter").when(credit_line(line), "credit")
        .when(draw_line(line), "draw").when(page_number_line(line), "number").when(junk_line(line), "junk").otherwise("text")
    )


def long_rows(line: Column) -> Column:
    """The row number of a line that is one number and long moves only; NULL otherwise."""
    w = words(line)
    rest = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
    only = F.forall(rest, lambda x: x.rlike(f"^(?:{LONG_MOVE})[.!?…]*$") | x.rlike("^[.!?…—–-]+$"))
    good = F.try_element_at(w, F.lit(1)).rlike(r"^\d{1,3}\.$") & F.exists(rest, lambda x: x.rlike(LONG_MOVE)) & only
    return F.when(good, F.regexp_extract(F.try_element_at(w, F.lit(1)), r"\d+", 0).cast("int"))


def mixed_row(line: Column) -> Column:
    """Two numbered rows and three long moves on one line: columns ran together."""
    w = words(line)
    return (F.size(F.filter(w, lambda x: x.rlike(r"^\d{1,3}\.$"))) >= 2) & (F.size(F.filter(w, lambda x: x.rlike(LONG_MOVE))) >= 3)


def glued_rows(line: Column) -> Column:
    """The rows of a line on which several ran together, as array of lines: a cut before every row number that is higher
    than the first, if each part has a number and one or two moves; else the line alone."""
    parts = F.split(F.trim(line), r"\s+(?=\d{1,3}\.\s)")
    number = lambda p: F.regexp_extract(p, r"^(\d{1,3})\.\s", 1).try_cast("int")
    moves = lambda p: F.size(F.filter(words(p), lambda x: notation.move_code(x).isNotNull() & ~x.rlike(r"^\d{1,3}\.$")))
    rows = F.forall(parts, lambda p: number(p).isNotNull() & moves(p).between(1, 2) & (F.size(words(p)) <= 4))
    rising = F.forall(F.sequence(F.lit(1), F.size(parts)), lambda i: (i == 1) | (number(F.get(parts, i - 1)) > number(F.get(parts, F.lit(0)))))
    return F.when((F.size(parts) >= 2) & F.coalesce(rows & rising, F.lit(False)), parts).otherwise(F.array(line))


def language_hits(text: Column) -> dict[str, Column]:
    """How many words look like moves with the piece letters of each language."""
    count = lambda h: F.size(F.filter(words(text), lambda w: w.rlike(h)))
    return {k: count(h) for k, h in notation.HINTS.items()}


def language_order(hits: dict[str, Column]) -> Column:
    """Languages by falling hits; ties in the order en, ru, de."""
    rows = F.array(*(F.struct((-n).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, n) in enumerate(hits.items())))
    return F.transform(F.array_sort(rows), lambda r: r["k"])


def sentence_end(line: Column) -> Column:
    return line.rlike(r"[.!?…][\"'»”)]?\s*$")
