"""One consistent form for text that looks right but is made of other characters.

The quick-check properties of normalization, derived here from the character database for all assigned code points, tell
which characters of a text are unstable: those that normalization replaces, those that reorder or join with what stands
before them, and those that print nothing.  Only the runs of unstable characters, each with the stable starter before it as
context, are normalized and spliced back between the untouched parts.  Then letters of a script that their word does not
belong to are exchanged for their twins, with the neighbours as context.

Compatibility characters become plain where both look alike: full and half width, fonts, presentation forms, ligatures, Roman
numerals, spaces.  Characters that look different from their compatibility form stay: fractions, superscripts, subscripts,
circled and squared ones, and signs such as the ellipsis and the numero sign.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Letters that look like a Latin letter, by script.
CYRILLIC_TWINS = dict(zip("аеорсухѕіјһԁԛԝАВЕКМНОРСТУХЅІЈ", "aeopcyxsijhdqwABEKMHOPCTYXSIJ"))
GREEK_TWINS = dict(zip("αονρικΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲ", "aovpikABEZHIKMNOPTYXc"))
ARMENIAN_TWINS = dict(zip("հոսօցՍՕ", "hnuogUO"))
CHEROKEE_TWINS = dict(zip("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"))
SMALL_CAPITAL_TWINS = dict(zip("ᴄᴏꜱᴠᴡᴢ", "cosvwz"))
OTHER_TWINS = dict(zip("ɑɡıⅼ", "agil"))
TO_LATIN = CYRILLIC_TWINS | GREEK_TWINS | ARMENIAN_TWINS | CHEROKEE_TWINS | SMALL_CAPITAL_TWINS | OTHER_TWINS
TO_RUSSIAN = {v: k for k, v in CYRILLIC_TWINS.items() if k in "аеорсухАВЕКМНОРСТУХ"} | {g: c for g, c in zip("αορχΑΒΕΗΚΜΟΡΤΥΧϲɑ", "аорхАВЕНКМОРТУХса")}
#: Twins that belong to no word in the consistent form.
NEVER = {k: v for k, v in TO_LATIN.items() if k not in "аеорсухАВЕКМНОРСТУХ"}
DASHES = dict.fromkeys("‐‑‒−", "-")
RUSSIAN = frozenset("абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ")
# What prints nothing though it is no format character, and format characters that do print.
FILLERS = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000))
PRINTED_FORMAT = (*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD, *range(0x13430, 0x13440))
#: Kinds of compatibility that look alike; ``<compat>`` does for letters, Roman numerals and spaces only.
ALIKE = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")


def _properties() -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Invisible characters; compatibility characters that are replaced; and all characters the quick check does not let
    pass (these two, what is not canonical, and what may join or reorder with the character before)."""
    invisible, compatible, unstable = set(map(chr, FILLERS)), set(), set()
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if kind == "Cf" and i not in PRINTED_FORMAT:
            invisible.add(c)
        if unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c:
            unstable.add(c)
        tag, *rest = unicodedata.decomposition(c).split() or [""]
        if tag[:1] == "<":
            if c not in TO_LATIN and (tag in ALIKE or tag == "<compat>" and (kind[0] == "L" or kind in ("Nl", "Zs"))):
                compatible.add(c)
        elif len(rest) == 1 and unicodedata.normalize("NFC", c) == c:
            unstable.add(chr(int(rest[0], 16)))  # joins with what stands before it
    # characters that canonically are a compatibility character (two spaces)
    compatible |= {c for c in unstable if unicodedata.normalize("NFC", c) in compatible}
    unstable |= set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))  # vowels and finals of Hangul syllables
    return frozenset(invisible), frozenset(compatible), frozenset(unstable | invisible | compatible)


INVISIBLE, COMPATIBLE, UNSTABLE = _properties()


def ranges(chars) -> str:
    """Characters as the inside of a character class."""
    out, codes = [], sorted(map(ord, chars))
    first = last = None
    for i in [*codes, None]:
        if last is None or i != last + 1:
            if last is not None:
                out.append(re.escape(chr(first)) + ("-" + re.escape(chr(last)) if last > first else ""))
            first = i
        last = i
    return "".join(out)


_unstable = re.compile(f"[{ranges(UNSTABLE)}]")
#: A run of unstable characters with the starter before it.
_run_of = re.compile(f"[^{ranges(UNSTABLE)}]?[{ranges(UNSTABLE)}]+", re.S)
_twin = re.compile(f"[{ranges(set(TO_LATIN) - RUSSIAN)}{''.join(DASHES)}]")
TWINS = "".join(sorted(set(TO_LATIN) - RUSSIAN)) + "".join(DASHES)
#: Characters that need no look at the tables: stable, no twins; everything else is looked at in Python.
SAFE = r"\n\r\t -~¡-§©«®°±·»¿À-ÖØ-öø-İĴ-ľŁ-ňŊ-žА-яЁё–—‘-‟•…½¼¾№♔-♟"
PLAIN, CYRILLIC = "[A-Za-zÀ-ɏ0-9♔-♟]", "[а-яёА-ЯЁ]"
_plain, _cyrillic = re.compile(PLAIN), re.compile(CYRILLIC)
_square, _run = re.compile(r"[a-h]\d|\d[a-h]|0-0|[a-h][:x][a-h]"), re.compile(r"[^\W\d_]+")
_segment = re.compile(r"[^ \t\r\n]+")


def _mixed(text: str) -> bool:
    return bool(_cyrillic.search(text) and _plain.search(text))


def is_stable(text: str) -> bool:
    """True only if ``text`` is surely in the consistent form already."""
    if text.isascii():
        return True
    if _unstable.search(text) or _twin.search(text):
        return False
    return not (_mixed(text) and any(map(_mixed, text.split())))


def normalized(text: str) -> str:
    """``text`` with its unstable runs normalized: what prints nothing goes, compatibility characters become plain, the rest
    is composed with the starter before the run.  NFC; the parts between the runs are spliced in as they are."""

    def run(m: re.Match) -> str:
        plain = "".join(unicodedata.normalize("NFKC", c) if c in COMPATIBLE else c for c in m[0] if c not in INVISIBLE)
        return unicodedata.normalize("NFC", plain)

    return _run_of.sub(run, text) if _unstable.search(text) else text


def _script(letters: str) -> int:
    """Above 0: more letters only Russian has; below 0: more letters only Latin writing has."""
    score = 0
    for c in letters:
        if c in RUSSIAN:
            score += c not in CYRILLIC_TWINS
        elif c.isalpha() and c not in TO_RUSSIAN and TO_LATIN.get(c, c) not in TO_RUSSIAN:
            score -= 1
    return score


def _as(text: str, table: dict[str, str]) -> str:
    return "".join(table.get(c, c) for c in text)


def _segment_form(plain: str, around: int) -> str:
    """The consistent form of a normalized segment.  ``around`` is the script score of its neighbours."""
    latin = _as(plain, TO_LATIN | DASHES)
    runs = _run.findall(latin)
    longest = max(map(len, runs), default=0)
    russian = any(c in RUSSIAN and c.islower() and c not in CYRILLIC_TWINS and c != "ф" for c in plain)
    if longest <= 3 and (_square.search(latin) or any(map(str.isdigit, latin)) and not russian) or any("♔" <= c <= "♟" for c in plain):
        return latin  # notation: Latin but for the piece letters that have no Latin twin

    def word(m: re.Match) -> str:
        w = m[0]
        score = _script(w)
        if score == 0 and any(c in NEVER and c not in TO_RUSSIAN for c in w):
            score = -1
        if score == 0:  # only letters both scripts have: the majority, then the neighbours
            score = sum(c in RUSSIAN for c in w) * 2 - len(w)
            if score and abs(score) == len(w) and not set(w) & set(TWINS):
                return w
            score = score or around or -1
        return _as(_as(w, TO_RUSSIAN), NEVER) if score > 0 else _as(w, TO_LATIN)

    return _run.sub(word, _as(plain, DASHES))


def consistent(text: str | None) -> str | None:
    """The consistent form of a text; NULL stays NULL, '' stays ''.  Idempotent."""
    if not text or is_stable(text):
        return text
    plain = normalized(text)
    if _twin.search(plain) or _mixed(plain):
        around = _script(plain)
        plain = _segment.sub(lambda m: m[0] if is_stable(m[0]) else _segment_form(m[0], around), plain)
        plain = normalized(plain)  # a twin may join with the mark after it
    return plain


def needs_form(c: Column) -> Column:
    """The quick check as a JVM expression, linear in the text: False for texts of SAFE characters without letters of two
    scripts, which are surely consistent; NULL for NULL."""
    return c.rlike(f"[^{SAFE}]") | (c.rlike(CYRILLIC) & c.rlike(PLAIN))


def with_form(df: DataFrame, text_col: str, out: str = "form") -> DataFrame:
    """``df`` with the consistent form of ``text_col`` in ``out`` (an existing column of that name is replaced).
    Only values that fail the quick check go through Python, in Arrow batches; NULL and '' stay as they are."""
    ship(df.sparkSession)

    @F.arrow_udf("string")
    def form(v: pa.Array) -> pa.Array:
        return pa.array([consistent(x) for x in v.to_pylist()], pa.string())

    c = F.col(text_col)
    # the UDF sees NULL where the quick check passes, and is not run for such batches' texts
    return df.withColumn(out, F.coalesce(form(F.when(needs_form(c), c)), c))
