"""Text from scanned pages: broken words, misread characters, running heads and page numbers; found and repaired.

1. Words of all texts are counted (words broken at line ends are put together first).
2. Every word that some other word is frequent enough to explain is looked up in tries of the vocabulary with a Levenshtein
   automaton whose edits are weighted: a known confusion of print (``rn`` for ``m``) costs little, any other edit 1.  Words
   and entries meet by a zone: the first or the last letters of the entry.  Of the at most three edits within the bound one
   zone or the other holds one at most, so asking with every zone one edit away misses no entry (``routes``).
3. A word is a misreading if a much more frequent word lies near it.  Cost ranks the candidates; among equals the context of
   the occurrence decides (how often the neighbour stands beside each candidate elsewhere), then frequency.
4. Lines are told apart (running head, page number, body) with the names of the book, and body lines are searched
   for misread words, for moves that break the rules of notation, and for words broken by a mark.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written

#: What print is misread as, and what it was.
CONFUSIONS = [
    ("c", "e"), ("€", "e"), ("f", "t"), ("t", "f"), ("ri", "n"), ("n", "r"), ("i", "r"), ("ii", "u"), ("0", "o"), ("rn", "m"), ("li", "h"), ("l", "i"), ("1", "l"), ("1", "i"),
    ("5", "s"), ("|", "l"), ("cl", "d"), ("!", "i"), ("!", "l"), ("vv", "w"), ("q", "g"), ("g", "q"), ("9", "g"), ("lo", "b"), ("6", "b"), ("6", "ó"), ("fi", "h"), ("fi", "n"), ("|c", "k"), ("v", "y"), ("y", "v"),
    ("u", "ii"), ("e", "c"), ("h", "b"), ("b", "h"), ("a", "o"), ("o", "a"), ("u", "n"), ("n", "u"), ("m", "rn"), ("d", "cl"), ("h", "li"), ("8", "b"), ("@", "a"), ("$", "s"), ("ß", "b"), ("tl", "d"), ("nn", "m"), ("in", "m"), ("m", "in"), ("l", "t"), ("t", "l"), ("r", "t"), ("n", "fi"), ("ll", "tt"), ("h", "fi"),
    ("г", "т"), ("н", "и"), ("с", "е"), ("л", "д"), ("0", "о"), ("п", "н"), ("п", "л"), ("н", "п"), ("4", "ч"), ("т", "ш"), ("к", "в"), ("го", "ю"), ("3", "з"), ("и", "н"), ("е", "с"), ("о", "с"), ("6", "б"), ("ш", "щ"), ("щ", "ш"), ("ь", "ы"), ("ъ", "ь"), ("з", "э"), ("э", "з"), ("ц", "и"), ("и", "й"), ("й", "и"), ("в", "н"), ("ш", "т"), ("т", "г"), ("н", "к"), ("к", "н"), ("а", "я"), ("в", "к"), ("л", "п"), ("ьт", "ы"), ("ьі", "ы"),
]
CHEAP, DEAR, BOUND = 0.3, 1.0, 1.0
#: A misreading is at least this many times rarer than the word it stands for.
RARER = 8
#: Vocabulary entries and looked-up words of one task at most, about; the number of tasks follows the data.
SHARD_ENTRIES, SHARD_WORDS = 50_000, 20_000
#: A table of misread words of at most this many rows goes to every worker; a larger one is joined by shuffling.
SMALL = 200_000

#: Edits within the bound, and letters by which a word and its right form may differ in length.
EDITS = int(BOUND / CHEAP + 1e-9)
GROWTH = EDITS * max(1, *(abs(len(a) - len(b)) for a, b in CONFUSIONS))
#: Letters of an entry's zone, if the entry is long enough for two that no edit of two letters can touch at once.
ZONE = 3

_by_read: dict[str, list[str]] = {}
for _a, _b in CONFUSIONS:
    _by_read.setdefault(_a, []).append(_b)
_by_read_back = {k[::-1]: [v[::-1] for v in vs] for k, vs in _by_read.items()}


def zone_of(size: int) -> int:
    """Letters of the zones of an entry of ``size`` letters."""
    return min(ZONE, (size - 1) // 2) if size > 2 else 0


def reach(word: str, k: int, reads: dict[str, list[str]]) -> set[str]:
    """The first ``k`` letters of all entries from which ``word`` differs there by one cheap edit at most."""
    out = {word[:k]} if len(word) >= k else set()
    for i in range(min(k, len(word))):
        for read in {word[i], word[i : i + 2]}:
            for was in reads.get(read, ()):
                made = word[:i] + was + word[i + len(read) :]
                if len(made) >= k:
                    out.add(made[:k])
    return out


def routes(word: str) -> list[str]:
    """Where a word is looked up: f (front) or b (back), the zone's letters, the zone.  With EDITS = 3 edits of at most two
    letters and zones that no edit spans, one zone is touched by one cheap edit at most, or no dear one."""
    sizes = {zone_of(n) for n in range(max(1, len(word) - GROWTH), len(word) + GROWTH + 1)}
    back = word[::-1]
    return [f"f{k}{z}" for k in sizes for z in reach(word, k, _by_read)] + [f"b{k}{z}" for k in sizes if k for z in reach(back, k, _by_read_back)]


def entry_routes(entry: str) -> list[str]:
    k = zone_of(len(entry))
    return [f"f{k}{entry[:k]}"] + ([f"b{k}{entry[::-1][:k]}"] if k else [])


class Trie:
    """A vocabulary as nested dictionaries; '' holds the count at the end of a word.  ``reads``: for each misread sign or two
    what it was."""

    def __init__(self, words, reads: dict[str, list[str]] = _by_read):
        self.root: dict = {}
        self.reads = reads
        for w, n in words:
            at = self.root
            for c in w:
                at = at.setdefault(c, {})
            at[""] = n

    def near(self, word: str, bound: float = BOUND) -> list[tuple[str, float, int]]:
        """All (entry, cost, count) within ``bound``: the states (place in ``word``, node, cost so far) of the
        weighted automaton are followed through the trie, the cheapest cost per state."""
        found: dict[str, tuple[float, int]] = {}
        seen: dict[tuple[int, str], float] = {}
        todo = [(0, "", self.root, 0.0)]
        n = len(word)
        while todo:
            i, made, node, cost = todo.pop()
            key = (i, made)
            if seen.get(key, 9.0) <= cost:
                continue
            seen[key] = cost
            if i == n and "" in node and cost < found.get(made, (9.0, 0))[0]:
                found[made] = (cost, node[""])
            if i < n:
                c = word[i]
                if c in node:
                    todo.append((i + 1, made + c, node[c], cost))
                if cost + CHEAP <= bound:
                    for read in (c, word[i : i + 2]):
                        for was in self.reads.get(read, ()):
                            at = node
                            for x in was:
                                at = at.get(x)
                                if at is None:
                                    break
                            else:
                                todo.append((i + len(read), made + was, at, cost + CHEAP))
                if cost + DEAR <= bound:
                    todo.append((i + 1, made, node, cost + DEAR))
                    for x, at in node.items():
                        if x and x != c:
                            todo.append((i + 1, made + x, at, cost + DEAR))
            if cost + DEAR <= bound:
                for x, at in node.items():
                    if x:
                        todo.append((i, made + x, at, cost + DEAR))
        return [(w, c, k) for w, (c, k) in found.items()]


# ---- tokens ----

_edge = "\"'“”„«»‘’()[]{}.,;:!?…*"
_letters = re.compile(r"[^\W\d_]")
_word = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*\Z")
_square = r"[a-h][1-8]"
_core = rf"(?:[KQRBNФЛ♔♕♖♗♘][a-h]?[1-8]?[x:-]?{_square}|{_square}|[a-h][x:]{_square}|{_square}[x:-]{_square})(?:=?[QRBN♕♖♗♘ФЛ])?|0-0(?:-0)?"
_move = re.compile(rf"[(\[\"«“„]*(?:\d{{1,3}}(?:\.\.\.|\.|…))?(?:{_core})(?:[+#]|x)?[!?]{{0,2}}(?:[+=±∓]|\+-|-\+)?[)\]\"»”.,;:!?…]*\Z")
_number = re.compile(r"[(\[\"«“„№]*(?:\d{1,4}(?:[-–—/]\d{1,4})?(?:\.\.\.|…)?|1-0|0-1|½[-–—]½|1/2-1/2|\d{1,2}½)%?(?:-?[а-яa-z]{1,2})?[)\]\"»”.,;:!?…]*\Z")
_plain = re.compile(r"[-–—|•·*№&/+=]+\Z")
_mark = re.compile(r"(?:-[­¬]?|[­‐¬‑]+|-)[ \t]*\Z")


def core(token: str) -> str:
    return token.strip(_edge)


_damaged = re.compile(
    r"(?:\d{1,3}(?:\.\.\.|\.|…)[ ]?)?(?:"
    r"[KQRBNФЛ♔♕♖♗♘]?[a-h]?[1-8]?[x:-]?[a-h]A"  # a letter for a digit
    r"|[KQRBNФЛ♔♕♖♗♘][a-h]?[x:]?[a-h]\?|[a-h][x:][a-h]\?|[a-h]\?"  # ? for a digit
    r"|[KQRBNФЛ♔♕♖♗♘]?[x:]?\([1-8]"  # ( for a letter
    r")[+#]?[!?]{0,2}[.,]?\Z"
)


_dots = re.compile(r"\d{1,3}\.?[,;_]\.{1,2}\Z")


@lru_cache(maxsize=200_000)
def shape(token: str) -> str:
    """What a token is by itself: word, move, number, sign, ``odd`` (a word with strange signs in it) or ``bad``
    (neither word nor correct notation)."""
    c = core(token)
    if not c:
        return "sign"
    if _damaged.match(token) or _dots.match(token):
        return "bad"
    if _number.match(token):
        return "move"
    if token[0] == "!" and len(c) >= 3:
        return "odd"  # a letter read as a mark
    if _word.match(c):
        if len(c) <= 2 and c.islower() and len(token) == len(c) and c in ("li", "ii"):
            return "bad"
        return "word"
    if _move.match(token):
        return "move"
    if _plain.match(c):
        return "sign"
    n = len(_letters.findall(c))
    longest = max((len(x) for x in re.findall(r"[^\W\d_]+", c)), default=0)
    if n >= 3 and longest >= 3 or n >= 3 and n * 2 > len(c) and not re.search(r"[a-h][1-8]|[♔♕♖♗♘]", c):
        return "odd"
    return "bad"


def odd_key(token: str) -> str:
    """An odd word without the marks around it that are not part of it; a leading or trailing sign may be a letter."""
    return token.strip("\"'“”„«»‘’()[]{}.,;:?…*").rstrip("!").lower()


def key_of(token: str) -> str:
    """What a token is counted and looked up by."""
    return core(token).lower() if shape(token) == "word" else odd_key(token)


def lines_of(text: str) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n")]


# ---- furniture ----

_chapter = re.compile(r"^\W*(?:(\S{4,9})\s+\S{1,3}?|([^\W\d_]{5,9})\d{1,2})\s*[.:]\s*\S")
_chapter_words = ("chapter", "глава", "kapitel", "capitulo")
_number_line = re.compile(r"^[\s\[\]()<>{}.·•\-–—~=*_'|]*(?:p\.?|pp\.?|page|s\.|seite|с\.|стр\.|pág\.?)?\s*([\dOolI|](?:\s?[\dOolI|]){0,3})[\s\[\]()<>{}.·•\-–—~=*_'|]*$", re.I)
_digits = str.maketrans("OolI|", "00111")
_page_end = re.compile(r"^\W*[\dol|]{1,4}\b[\s|.·•\-–—]*(?=\S{3})|(?<=\S)[\s|.·•\-–—']+(?:p\.\s*)?[\dol|]{1,4}\W*$")


def near_text(a: str, b: str, most: int) -> bool:
    """Levenshtein distance at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


_flat = str.maketrans({chr(i): base for i in range(0xC0, 0x250) if (base := unicodedata.normalize("NFD", chr(i))[0]) != chr(i)})


@lru_cache(maxsize=50_000)
def squeeze(text: str) -> str:
    """Letter-spaced text put together (its words lie two or more blanks apart); other text with single spaces;
    lower case, without accents."""
    words = text.split()
    if len(words) >= 4 and sum(len(w) == 1 for w in words) * 4 >= len(words) * 3:
        text = " ".join("".join(x.split()) for x in re.split(r"\s{2,}", text.strip()))
    return " ".join(text.split()).lower().translate(_flat)


def head_name(line: str) -> str:
    """A line without a page number at either end."""
    return _page_end.sub("", squeeze(line.strip())).strip(" |.·•-–—\t,'\"")


def is_head(line: str, names: list[str]) -> bool:
    t = line.strip()
    if not t or len(t) > 90:
        return False
    if len(t) > 24 + max(map(len, names), default=40) and t.count(" ") * 5 < len(t) * 2:
        return False  # longer than any head that is not letter-spaced
    flat = squeeze(t)
    m = _chapter.match(flat)
    if m and any(near_text(m[1] or m[2], w, 1) for w in _chapter_words):
        return True
    name = head_name(t)
    if len(name) < 4 or not names:
        return False
    flat = name.replace(" ", "")
    for n in map(squeeze, names):
        most = 1 if len(n) < 9 else 2
        if near_text(name, n, most) or near_text(flat, n.replace(" ", ""), most):
            return True
    return False


def furniture(lines: list[str], names: list[str], page: int | None) -> list[str]:
    """For each line: ``header``, ``page_number``, ``blank`` or ``body``."""
    out = []
    for line in lines:
        if not line.strip():
            out.append("blank")
            continue
        m = _number_line.match(line)
        if m and any(map(str.isdigit, m[1])):
            n = int(re.sub(r"\s", "", m[1]).translate(_digits))
            out.append("page_number" if page is None or abs(n - page) <= 3 else "body")
        else:
            out.append("header" if is_head(line, names) else "body")
    return out


def breaks(lines: list[str], kinds: list[str]) -> list[tuple[int, int, str, str, str]]:
    """(line, next body line, left part, mark, right part) where a body line ends with a mark after a letter and the
    next body line begins with a letter; next is -1 at the end of the text."""
    body = [i for i, k in enumerate(kinds) if k == "body"]
    out = []
    for i, j in zip(body, [*body[1:], -1]):
        m = _mark.search(lines[i])
        if not m:
            continue
        left = lines[i][: m.start()].split(" ")[-1]
        if not left or not left[-1].isalpha():
            continue
        right = lines[j].split()[0] if j >= 0 and lines[j].split() else ""
        if right and not right.lstrip(_edge)[:1].isalpha():
            continue
        out.append((i, j, left, m[0].strip(), right))
    return out


def joined(left: str, right: str, hyphen: bool) -> str:
    return core(left + ("-" if hyphen else "") + right).lower()


def tokens_of(lines: list[str], kinds: list[str]):
    """(line, token, line of its end) of all body tokens, broken words put together without their mark."""
    cut = {i: (j, left, mark, right) for i, j, left, mark, right in breaks(lines, kinds) if j >= 0}
    skip: dict[int, int] = {}
    body = [i for i, k in enumerate(kinds) if k == "body"]
    after = dict(zip(body, body[1:]))
    for i in body:
        words = lines[i].split()
        first = skip.pop(i, 0)
        if i in cut:
            j, left, mark, right = cut[i]
            # a line that is one fragment in the middle of a word cannot be told; its parts stay apart
            for w in words[first : len(words) - 1 if words else 0]:
                yield i, w, i
            yield i, (left, right), j
            skip[j] = 1
        else:
            words = words[first:]
            j = after.get(i, -1)
            if words and j >= 0 and words[-1][-1] in "-:x" and words[-1][-2:-1].isdigit() and lines[j].split() and _move.match(words[-1] + lines[j].split()[0]):
                skip[j] = 1  # a move broken after a sign of its own
                words = [*words[:-1], words[-1] + lines[j].split()[0]]
            for w in words:
                yield i, w, i


def count_words(text: str | None, names: list[str], page: int | None, into: Counter) -> None:
    if not text:
        return
    lines = lines_of(text)
    kinds = furniture(lines, names, page) if len(lines) > 1 else ["body"]
    for _, w, _ in tokens_of(lines, kinds):
        if isinstance(w, tuple):
            into[joined(*w, False)] += 1
        else:
            s = shape(w)
            if s == "word":
                into[core(w).lower()] += 1
            elif s == "odd":
                into[odd_key(w)] += 1


#: Signs and digits that stand in no word.
_strange = re.compile(r"[^\W\d_][^\w\s'’.,;:/()-]+[^\W\d_]|\d[^\W\d_]{2}|[^\W\d_]{2}\d|[€$^&@£§¥#<>~|\\{}]|!(?=\w)")


def line_faults(text: str | None, names: list[str], page: int | None, bad: dict[str, str] | set, compounds) -> list[tuple[int, str]]:
    """(line from 1, kind) of a text.  ``bad``: misread words; ``compounds``: words with a hyphen of their own."""
    if not text:
        return []
    lines = lines_of(text)
    kinds = furniture(lines, names, page) if len(lines) > 1 else ["body"]
    out = {(i + 1, k) for i, k in enumerate(kinds) if k in ("header", "page_number")}
    if len(lines) == 1:
        words = lines[0].split()
        # in a text that is one move, a bare number is a damaged square, and the number takes no comma
        if len(words) == 1 and re.fullmatch(r"[69][1-8](?:[+#!?]+\.?)?", words[0]) or len(words) == 2 and re.fullmatch(r"\d{1,3}\.?[,;_]", words[0]) and shape(words[1]) == "move":
            out.add((1, "char"))
    for i, j, left, mark, right in breaks(lines, kinds):
        if j >= 0 and (mark != "-" or joined(left, right, True) not in compounds):
            out.add((i + 1, "hyphen"))
    for i, w, j in tokens_of(lines, kinds):
        if isinstance(w, tuple):
            whole = joined(*w, False)
            if whole in bad:
                out |= {(k + 1, "char") for k in _where(w, bad, i, j)}
            continue
        s = shape(w)
        if s == "bad" or s == "odd" and (odd_key(w) in bad or _strange.search(core(w))) or s == "word" and core(w).lower() in bad:
            out.add((i + 1, "char"))
    return sorted(out)


def _where(w: tuple[str, str], bad, i: int, j: int) -> list[int]:
    """The line on which a broken word is misread: where it first differs from the right word."""
    right = bad.get(joined(*w, False)) if isinstance(bad, dict) else None
    if not right:
        return [i]
    left = core(w[0]).lower()
    whole = joined(*w, False)
    k = next((n for n, (x, y) in enumerate(zip(whole, right)) if x != y), min(len(whole), len(right)))
    return [i] if k < len(left) else [j]


def repaired(text: str | None, names: list[str], page: int | None, bad: dict[str, str], compounds, beside: dict | None = None) -> str | None:
    """Continuous paragraphs: no page furniture, broken words whole, misread words right: as the neighbours on either side
    have it (``beside``: (word, neighbour) to right word), else as ``bad`` has it.  NULL stays NULL.  Damaged moves stay as
    read: their right form cannot be told from the text alone."""
    if not text:
        return text
    lines = lines_of(text)
    kinds = furniture(lines, names, page) if len(lines) > 1 else ["body"]
    cuts = {i: (j, left, mark, right) for i, j, left, mark, right in breaks(lines, kinds) if j >= 0}
    widest = max((len(x.rstrip()) for x, k in zip(lines, kinds) if k == "body"), default=0)
    paragraphs: list[list[str]] = [[]]
    glue = None
    for i, k in enumerate(kinds):
        if k == "blank" and glue is None:
            paragraphs.append([])
        if k != "body":
            continue
        words = lines[i].split()
        indent = lines[i][:1] in " \t" and len(lines[i]) - len(lines[i].lstrip()) >= 2
        last = paragraphs[-1][-1] if paragraphs[-1] else ""
        if glue is None and last and last[-1:] in ".!?…\"»”" and (indent or i and len(lines[i - 1].rstrip()) < 0.6 * widest):
            paragraphs.append([])
        if i in cuts:
            j, left, mark, right = cuts[i]
            keep = mark == "-" and joined(left, right, True) in compounds
            words = [*words[:-1], left + ("-" if keep else "")]
        if glue is not None and words:
            paragraphs[-1][-1] += words[0]
            words = words[1:]
            glue = None
        paragraphs[-1] += words
        if i in cuts:
            glue = True

    def fix(w: str, before: str, after: str) -> str:
        key = key_of(w)
        right = bad.get(key)
        if right is None:
            return w
        if beside:
            told = [x for x in (beside.get((key, key_of(y))) for y in (before, after) if y) if x]
            right = told[0] if told and told.count(told[0]) == len(told) else right
        at = w.lower().find(key)
        head, old, tail = w[:at], w[at : at + len(key)], w[at + len(key) :]
        return head + (right.upper() if old.isupper() and len(old) > 1 else right.capitalize() if old[:1].isupper() else right) + tail

    return "\n\n".join(" ".join(map(fix, p, ["", *p], [*p[1:], ""])) for p in paragraphs if p)


# ---- over all texts ----

TEXTS = "src string, rec_id bigint, text string, names array<string>, page int"


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n) over whole texts; counted per batch before the shuffle."""
    ship(texts.sparkSession)

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for t, names, page in zip(b.column("text").to_pylist(), b.column("names").to_pylist(), b.column("page").to_pylist()):
                count_words(t, names or [], page, total)
            if len(total) > 500_000:
                yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})
                total = Counter()
        if total:
            yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def bound_of(word: str) -> float:
    """What the best explanation of a word may cost: a short plain word takes one known confusion."""
    return CHEAP if len(word) < 7 and _word.match(word) else BOUND


def explains(word: str, n: int, right: str, cost: float, k: int) -> bool:
    """A word seen ``n`` times is a misreading of ``right``, seen ``k`` times: only if that is much more frequent, the more so
    the dearer or the shorter."""
    if right == word or k < RARER * n or cost > bound_of(word):
        return False
    plain = _word.match(word) is not None
    if cost >= DEAR and plain and len(right) != len(word) or cost > CHEAP and plain and k < 40 * n:
        return False
    return len(word) > 3 or cost <= CHEAP and k >= 20 * n


def candidates(words: DataFrame) -> DataFrame:
    """(word, right, cost, k, n): every word of (word, n) with all that explain it; complete within the bound.  Words and
    entries are sent to their routes; the routes of a task are searched trie by trie.  A route asked by very many words is
    cut into parts that all have its entries."""
    ship(words.sparkSession)
    top = words.where(F.col("word").rlike(r"^\p{L}+([-'’]\p{L}+)*$") & (F.length("word") >= 2)).agg(F.max("n").alias("top")).head()["top"] or 0

    def send(batches):
        for b in batches:
            rows: dict[str, list] = {"route": [], "asked": [], "word": [], "n": []}
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                entry = n >= RARER and len(w) >= 2 and _word.match(w)
                for asked, ways in ((True, routes(w) if RARER * n <= top else []), (False, entry_routes(w) if entry else [])):
                    rows["route"] += ways
                    rows["asked"] += [asked] * len(ways)
                    rows["word"] += [w] * len(ways)
                    rows["n"] += [n] * len(ways)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("route", pa.string()), ("asked", pa.bool_()), ("word", pa.string()), ("n", pa.int64())]))

    sent = words.mapInArrow(send, "route string, asked boolean, word string, n bigint")
    load = sent.groupBy("route").agg(F.count_if("asked").alias("asks"), F.count_if(~F.col("asked")).alias("entries")).where("asks > 0 and entries > 0")
    # routes that nobody asks or answers fall away here; of the others, the parts
    ways = written(load.select("route", F.ceil(F.col("asks") / SHARD_WORDS).cast("int").alias("parts"), "entries"), "routes")
    total = ways.agg(F.sum(F.col("entries") * F.col("parts")).alias("e")).head()["e"] or 0
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, -(-int(total) // SHARD_ENTRIES))
    met = sent.join(ways.select("route", "parts"), "route")
    part = F.when(F.col("asked"), F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = met.select("route", F.explode(part).alias("part"), "asked", "word", "n").withColumn("task", F.pmod(F.xxhash64("route", "part"), F.lit(tasks)).cast("int"))

    def search(table: pa.Table) -> pa.Table:
        own: dict[tuple[str, int], tuple[list, list]] = {}
        for way, k, asked, w, n in zip(*(table.column(c).to_pylist() for c in ("route", "part", "asked", "word", "n"))):
            own.setdefault((way, k), ([], []))[0 if asked else 1].append((w, n))
        out: dict[str, list] = {"word": [], "right": [], "cost": [], "k": [], "n": []}
        for (way, _), (asked, entries) in own.items():
            turn = 1 if way[0] == "f" else -1
            trie = Trie(((v[::turn], k) for v, k in entries), _by_read if turn == 1 else _by_read_back)
            for w, n in asked:
                for v, cost, k in trie.near(w[::turn], bound_of(w)):
                    if explains(w, n, v[::turn], cost, k):
                        for c, x in zip(out, (w, v[::turn], cost, k, n)):
                            out[c].append(x)
        return pa.Table.from_pydict(out, schema=pa.schema([("word", pa.string()), ("right", pa.string()), ("cost", pa.float64()), ("k", pa.int64()), ("n", pa.int64())]))

    found = spread.groupBy("task").applyInArrow(search, "word string, right string, cost double, k bigint, n bigint")
    return found.groupBy("word", "right").agg(F.min("cost").alias("cost"), F.max("k").alias("k"), F.max("n").alias("n"))


def misreadings(words: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(word, right, n): every word that a much more frequent word explains, with the best explanation without regard to
    context: least cost, then most frequent, then first in order."""
    found = candidates(words) if found is None else found
    best = F.min_by("right", F.struct("cost", (-F.col("k")).alias("k"), "right"))
    return found.groupBy("word").agg(best.alias("right"), F.max("n").alias("n"))


def neighbours(texts: DataFrame) -> DataFrame:
    """(word, near, n): how often words stand side by side in body text, each pair from both sides."""
    ship(texts.sparkSession)

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for t, names, page in zip(b.column("text").to_pylist(), b.column("names").to_pylist(), b.column("page").to_pylist()):
                lines = lines_of(t or "")
                kinds = furniture(lines, names or [], page) if len(lines) > 1 else ["body"]
                row = [key_of(joined(*w, False) if isinstance(w, tuple) else w) for _, w, _ in tokens_of(lines, kinds)]
                for x, y in zip(row, row[1:]):
                    total[x, y] += 1
                    total[y, x] += 1
            if len(total) > 500_000:
                yield pa.RecordBatch.from_pydict({"word": [x for x, _ in total], "near": [y for _, y in total], "n": list(total.values())})
                total = Counter()
        if total:
            yield pa.RecordBatch.from_pydict({"word": [x for x, _ in total], "near": [y for _, y in total], "n": list(total.values())})

    return texts.mapInArrow(run, "word string, near string, n bigint")


def in_context(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(word, near, right): for words with several explanations of least cost, the one that stands beside ``near`` most often
    elsewhere; only where some does.  ``found``: (word, right, cost, k, n)."""
    least = found.groupBy("word").agg(F.min("cost").alias("cost"))
    even = found.join(least, ["word", "cost"]).select("word", "right", "k")
    several = even.groupBy("word").agg(F.count("*").alias("m")).where("m > 1").select("word")
    open_ = written(even.join(several, "word"), "open")
    if open_.isEmpty():
        return open_.select("word", F.lit("").alias("near"), "right")
    wanted = open_.select("word").union(open_.select("right")).distinct()
    beside = written(neighbours(texts).join(wanted, "word", "left_semi").groupBy("word", "near").agg(F.sum("n").alias("n")), "beside")
    ask = open_.join(beside.select("word", "near"), "word")
    told = ask.join(beside.select(F.col("word").alias("right"), "near", F.col("n").alias("often")), ["right", "near"])
    return told.groupBy("word", "near").agg(F.max_by("right", F.struct("often", "k", "right")).alias("right"))


def _lists(texts: DataFrame, words: DataFrame, context: bool) -> DataFrame:
    """(word, right, near): misread words with their right forms, those that a neighbour decides with it; compounds of
    their own with right NULL."""
    found = written(candidates(words), "explained")
    bad = misreadings(words, found)
    own = words.where(F.col("word").contains("-") & (F.col("n") >= 2)).join(found.select("word").distinct(), "word", "left_anti")
    none = F.lit(None).cast("string")
    out = bad.select("word", "right", none.alias("near")).unionByName(own.select("word", none.alias("right"), none.alias("near")))
    if context:
        out = out.unionByName(in_context(texts, found).select("word", "right", "near"))
    return written(out, "misread")


def _known(rows) -> tuple[dict[str, str], set[str], dict[tuple[str, str], str]]:
    bad, own, beside = {}, set(), {}
    for r in rows:
        if r["right"] is None:
            own.add(r["word"])
        elif r["near"] is None:
            bad[r["word"]] = r["right"]
        else:
            beside[r["word"], r["near"]] = r["right"]
    return bad, own, beside


def _apply(texts: DataFrame, words: DataFrame, f, kind: str, context: bool = False) -> DataFrame:
    """``f(text, names, page, bad, compounds)`` for each text, with the contexts as well if ``context``.  The lists go to all
    workers if they are small (their rows are counted first); else each text gets its own part of them by a join."""
    spark = texts.sparkSession
    ship(spark)
    lists = _lists(texts, words, context)
    fields = ["src", "rec_id"]
    if lists.limit(SMALL + 1).count() <= SMALL:
        shared = spark.sparkContext.broadcast(_known(lists.collect()))  # at most SMALL rows
        rows = texts

        def run(batches):
            known = shared.value[: 3 if context else 2]
            for b in batches:
                yield from _batch(b, [f(t, n or [], p, *known) for t, n, p in zip(*(b.column(x).to_pylist() for x in ("text", "names", "page")))], kind)
    else:
        each = texts.select("src", "rec_id", F.explode(F.array_distinct(keys_of(texts))).alias("word")).distinct()
        part = each.join(lists, "word").groupBy("src", "rec_id").agg(F.collect_list(F.struct("word", "right", "near")).alias("lists"))
        rows = texts.join(part, fields, "left")

        def run(batches):
            for b in batches:
                out = []
                for t, n, p, x in zip(*(b.column(c).to_pylist() for c in ("text", "names", "page", "lists"))):
                    out.append(f(t, n or [], p, *_known(x or [])[: 3 if context else 2]))
                yield from _batch(b, out, kind)

    return rows.mapInArrow(run, f"src string, rec_id bigint, {kind}")


def keys_of(texts: DataFrame):
    """All words of a text that the lists may hold, as a column."""

    @F.arrow_udf("array<string>")
    def keys(text: pa.Array, names: pa.Array, page: pa.Array) -> pa.Array:
        out = []
        for t, n, p in zip(text.to_pylist(), names.to_pylist(), page.to_pylist()):
            c: Counter = Counter()
            count_words(t, n or [], p, c)
            lines = lines_of(t or "")
            c.update(joined(left, right, True) for _, _, left, _, right in breaks(lines, furniture(lines, n or [], p)))
            out.append(list(c))
        return pa.array(out, pa.list_(pa.string()))

    return keys("text", "names", "page")


def _batch(b: pa.RecordBatch, results: list, kind: str):
    if kind.startswith("line_no"):
        take = [i for i, r in enumerate(results) for _ in r]
        flat = [x for r in results for x in r]
        part = b.select(["src", "rec_id"]).take(pa.array(take, pa.int64()))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.string())], ["src", "rec_id", "line_no", "kind"])
    else:
        yield pa.RecordBatch.from_arrays([b.column("src"), b.column("rec_id"), pa.array(results, pa.string())], ["src", "rec_id", "text"])


def faults(texts: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(src, rec_id, line_no, kind) of rows (src, rec_id, text, names, page); NULL and empty texts have none."""
    words = words if words is not None else written(vocabulary(texts), "vocabulary")
    return _apply(texts, words, line_faults, "line_no int, kind string")


def repair(texts: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(src, rec_id, text) with every text repaired."""
    words = words if words is not None else written(vocabulary(texts), "vocabulary")
    return _apply(texts, words, repaired, "text string", context=True)
