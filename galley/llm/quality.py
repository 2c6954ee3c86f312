"""Per-document text statistics, and prose told from lists, tables and junk.

Every line gets an observation (one of SYMBOLS) from counts of its characters and words; a hidden Markov model
over the lines of a document, with the states prose, list, table and junk, finds the likeliest sequence of
states; a document's kind is the state that holds most of its characters, prose only with at least half.  The model's
probabilities were fitted by Baum-Welch (``fit``) on the line symbols of one bounded sample.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .encode import parts

STATES = ("prose", "list", "table", "junk")
SYMBOLS = ("running", "tail", "entry", "short", "cells", "debris", "code", "decoding", "repeat")
#: Where fitting begins: what each state is meant to show.  Rows: states; columns: symbols.
GUESS_START = np.array([0.55, 0.2, 0.15, 0.1])
GUESS_STEP = np.where(np.eye(4, dtype=bool), 0.9, 0.1 / 3)
GUESS_EMIT = np.array([
    [0.700, 0.130, 0.020, 0.080, 0.020, 0.004, 0.012, 0.004, 0.020],
    [0.050, 0.020, 0.560, 0.330, 0.010, 0.002, 0.012, 0.002, 0.004],
    [0.010, 0.010, 0.050, 0.050, 0.850, 0.010, 0.010, 0.002, 0.002],
    [0.008, 0.004, 0.004, 0.020, 0.020, 0.290, 0.290, 0.170, 0.190],
])
PARTS = 1_000_000
#: A list of common words may be so long; it goes to all workers.
MOST_COMMON = 100_000
#: White space and characters that print nothing; a line of these is blank.
UNSEEN = " \t\v\f\x00\x1c\x1d\x1e\x1f\x85\xa0\xad\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u200e\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"

LOWER, UPPER, DIGIT, SPACE, NEWLINE, STOP, CELL, COMMA, SIGN, MARK, WRONG, HIGH, VOWEL = (1 << k for k in range(13))


#: Code points with classes of their own: all planes that hold letters; beyond them everything is a sign.
KNOWN = 0x40000


def _classes() -> np.ndarray:
    """A bit set of character classes for each code point below KNOWN, and one for all others."""
    out = np.zeros(KNOWN + 1, np.uint16)
    out[KNOWN] = SIGN
    for i in range(KNOWN):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            out[i] = LOWER if kind in ("Ll", "Lo", "Lm") else UPPER
        elif kind == "Nd":
            out[i] = DIGIT
        elif c == "\n":
            out[i] = NEWLINE
        elif kind in ("Zs", "Zl", "Zp") or c in "\t\r\v\f":
            out[i] = SPACE
        elif c in ".!?…":
            out[i] = STOP
        elif c in ",:'\"()-–—«»“”„‘’;":
            out[i] = COMMA
        else:
            out[i] = SIGN
    for c in "|;\t¦│║┃":
        out[ord(c)] |= CELL
    for c in "aeiouyáéíóúäöüаеёиоуыэюяAEIOUYÁÉÍÓÚÄÖÜАЕЁИОУЫЭЮЯ":
        out[ord(c)] |= VOWEL
    for i in [0xFFFD, *range(0x80, 0xA0), *map(ord, "ÐÑÃÂ")]:
        out[i] |= WRONG
    for i in range(0xA0, 0x100):
        out[i] |= HIGH
    for i in range(0x2654, 0x2660):
        out[i] = UPPER
    for c in "½¼¾":
        out[ord(c)] = DIGIT
    # a mark that can open an entry: a bullet, a dash, a numero sign
    for c in "•–—*-·▪◦‣№§":
        out[ord(c)] |= MARK
    return out


def fit(lines: dict[bytes, int], rounds: int = 12, weight: float = 20.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, step and emission probabilities by Baum-Welch from symbol sequences of documents (int8 bytes) and their counts;
    the guesses count as ``weight`` observations a row, so that nothing becomes impossible."""
    start, step, emit = GUESS_START, GUESS_STEP, GUESS_EMIT / GUESS_EMIT.sum(1, keepdims=True)
    prior = [weight * x for x in (start, step, emit)]
    for _ in range(rounds):
        s, t, e = (x.copy() for x in prior)
        for key, n in lines.items():
            x = np.frombuffer(key, np.int8)
            ahead, behind, scale = np.zeros((len(x), 4)), np.ones((len(x), 4)), np.zeros(len(x))
            for i in range(len(x)):
                a = (ahead[i - 1] @ step if i else start) * emit[:, x[i]]
                scale[i] = a.sum()
                ahead[i] = a / scale[i]
            for i in range(len(x) - 2, -1, -1):
                behind[i] = step @ (emit[:, x[i + 1]] * behind[i + 1]) / scale[i + 1]
            state = ahead * behind
            s += n * state[0]
            for k in range(4):
                e[k] += n * np.bincount(x, weights=state[:, k], minlength=emit.shape[1])
            t += n * np.einsum("ti,ij,tj->ij", ahead[:-1], step, emit[:, x[1:]].T * behind[1:] / scale[1:, None])
        start, step, emit = s / s.sum(), t / t.sum(1, keepdims=True), e / e.sum(1, keepdims=True)
    return start, step, emit


def sequences(texts: list[str | None], common: frozenset[str]) -> dict[bytes, int]:
    """Symbol sequences of texts with their counts, for ``fit``."""
    m, doc = measure(texts, common)
    out: dict[bytes, int] = {}
    if len(doc):
        symbols = observe(m).astype(np.int8)
        for part in np.split(symbols, np.flatnonzero(np.diff(doc)) + 1):
            out[part.tobytes()] = out.get(part.tobytes(), 0) + 1
    return out


#: Fitted on all 10,000 documents of one synthetic table, a bounded sample; see ``fit``.
START = np.log(np.array([0.5748, 0.1594, 0.1449, 0.1209]))
STEP = np.log(np.array([
    [0.9975, 0.0001, 0.0025, 0.0001],
    [0.0001, 0.9999, 0.0001, 0.0001],
    [0.0097, 0.0001, 0.9902, 0.0001],
    [0.0001, 0.0001, 0.0001, 0.9997],
]))
EMIT = np.log(np.array([
    [0.9078, 0.0684, 0.0001, 0.0232, 0.0001, 0.0001, 0.0001, 0.0001, 0.0005],
    [0.0001, 0.0001, 0.8105, 0.1892, 0.0001, 0.0001, 0.0001, 0.0001, 0.0002],
    [0.0001, 0.0001, 0.0001, 0.0002, 0.9995, 0.0002, 0.0001, 0.0001, 0.0001],
    [0.0001, 0.0001, 0.0001, 0.0045, 0.0075, 0.365, 0.3764, 0.0291, 0.2174],
]))


_table: list[np.ndarray] = []


def measure(texts: list[str | None], common: frozenset[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts of every non-blank line of a batch, and the document each line belongs to."""
    if not _table:
        _table.append(_classes())
    lines: list[str] = []
    owner: list[int] = []
    for k, t in enumerate(texts):
        if t:
            own = [x for x in t.replace("\r", "\n").split("\n") if x.strip() and x.strip(UNSEEN)]
            lines += own
            owner += [k] * len(own)
    doc = np.array(owner, np.int64)
    if not lines:
        return {}, doc
    code = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _table[0][np.minimum(code, KNOWN)]
    end = np.flatnonzero(kind & NEWLINE)
    begin = np.concatenate([[0], end[:-1] + 1])

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[end] - total[begin]

    space = (kind & (SPACE | NEWLINE)) != 0
    before = np.concatenate([[True], space[:-1]])
    # a gap: a second white space after text, inside the line
    gap = space & before & ~np.concatenate([[True, True], space[:-2]]) & ((kind & NEWLINE) == 0) & (np.concatenate([[10], code[:-1]]) != 10)
    trail = np.concatenate([space[1:], [True]])
    inner = gap & ~(trail & (np.concatenate([(kind[1:] & NEWLINE) != 0, [True]])))
    letter = (kind & (LOWER | UPPER)) != 0
    words = [x.split() for x in lines]
    out = {
        "chars": (end - begin).astype(np.int64), "letters": per_line(letter), "digits": per_line((kind & DIGIT) != 0), "spaces": per_line((kind & SPACE) != 0),
        "cells": per_line((kind & CELL) != 0), "tabs": per_line(code == 9), "signs": per_line((kind & SIGN) != 0), "commas": per_line((kind & COMMA) != 0),
        "wrong": per_line((kind & WRONG) != 0), "high": per_line(letter & ((kind & HIGH) != 0)), "vowels": per_line((kind & VOWEL) != 0),
        "gaps": per_line(inner), "upper": per_line((kind & UPPER) != 0), "dots": per_line(code == 46),
        "words": np.fromiter(map(len, words), np.int64, len(words)),
        "common": np.fromiter((sum(w.strip(".,;:!?\"'()«»").lower() in common for w in x) for x in words), np.int64, len(words)),
        "word_chars": np.fromiter((sum(map(len, x)) for x in words), np.int64, len(words)),
    }
    last = np.array([x.rstrip()[-1:] for x in lines])
    inside = np.array([x.rstrip().rstrip("\"'»”)]")[-1:] for x in lines])
    out["ends"] = np.isin(inside, list(".!?…")) | np.isin(last, list(".!?…"))
    out["ends_mark"] = out["ends"] | np.isin(last, list(":;,"))
    out["leader"] = np.fromiter(map(_leader, words), bool, len(words))
    out["marker"] = np.fromiter(map(_marker, words), bool, len(words))
    out["rule"] = np.fromiter((len(x) >= 3 and _RULE.issuperset(x) for x in lines), bool, len(lines))
    out["longest"] = np.fromiter((max(map(len, x)) for x in words), np.int64, len(words))
    # lines that the same document has at least three times, and words that it has over and over
    ids: dict[tuple[int, str], int] = {}
    number = np.fromiter((ids.setdefault((k, x), len(ids)) for k, x in zip(owner, map(str.strip, lines))), np.int64, len(lines))
    often = np.bincount(number)[number] >= 3
    # a document that is few lines over and over
    n_lines, different = np.bincount(doc, minlength=len(texts)), np.bincount(np.array([k for k, _ in ids], np.int64), minlength=len(texts))
    out["mono"] = often & ((n_lines >= 4) & (different * 4 <= n_lines))[doc]
    same = np.array([len(x) >= 16 and len(set(x)) * 5 <= len(x) and len(set(x)) <= 12 and any(map(str.isalpha, "".join(x[:8]))) for x in words])
    out["repeat"] = often | same
    return out, doc


_RULE = frozenset("+-|=_─━═┼┬┴├┤│┌┐└┘:*. \t")


def _marker(words: list[str]) -> bool:
    """A bullet or a counter in front."""
    first = words[0]
    if len(words) < 2:
        return False
    if first in ("•", "–", "—", "-", "*", "·", "▪", "◦", "‣", "№", "§") or first[-1] == ")" and len(first) <= 5 and first.strip("()").isalnum():
        return True
    return first[-1] == "." and first[:-1].isdigit() and len(first) <= 4


def _leader(words: list[str]) -> bool:
    """A leader to a page number, or a name and page numbers."""
    if len(words) < 2 or not words[-1].isdigit():
        return False
    return words[-2].strip(".…_") == "" or words[-2][-1] == "," or "..." in words[-2]


def observe(m: dict[str, np.ndarray]) -> np.ndarray:
    """The symbol of each line; the first rule that holds decides."""
    chars = np.maximum(m["chars"] - m["spaces"], 1)
    letters = np.maximum(m["letters"], 1)
    text = m["letters"] / chars
    vowel = m["vowels"] / letters
    common = m["common"] / np.maximum(m["words"], 1)
    columns = (m["cells"] >= 2) | (m["tabs"] >= 1) | (m["gaps"] >= 1)
    sentence = (m["words"] >= 5) & (text >= 0.55) & (vowel >= 0.25)
    speech = sentence & (m["words"] >= 8) & (common >= 0.12)
    odd = (m["signs"] - m["cells"]) / chars
    rules = [
        ("decoding", (m["wrong"] / chars > 0.15) | (m["high"] / letters > 0.5) & (m["letters"] >= 6) & (m["high"] >= 5)),
        ("cells", m["rule"]),
        ("repeat", (m["repeat"] & (m["letters"] >= 8) | m["mono"] & (m["letters"] >= 1)) & (m["digits"] <= 2)),
        ("debris", (m["words"] >= 16) & (m["word_chars"] <= m["words"] * 1.1) & (m["cells"] < 2)),
        ("entry", m["leader"]),
        ("debris", (odd > 0.25) & (m["letters"] + m["digits"] < 0.75 * chars)),
        ("cells", columns & ~speech),
        ("entry", m["marker"]),
        ("code", ((m["longest"] >= 24) & (m["words"] <= 3) & ((m["digits"] >= 6) | (vowel < 0.2))) | (m["letters"] >= 8) & (vowel < 0.16) & (common < 0.1) & (text > 0.6)),
        ("running", sentence & (m["words"] >= 6) & ((common >= 0.1) | m["ends"] | (m["words"] >= 9))),
        ("tail", m["ends"] & (text >= 0.5)),
        ("running", sentence & (common >= 0.1)),
    ]
    out = np.full(len(chars), SYMBOLS.index("short"))
    free = np.ones(len(chars), bool)
    for name, holds in rules:
        out[free & holds] = SYMBOLS.index(name)
        free &= ~holds
    return out


def viterbi(symbols: np.ndarray) -> np.ndarray:
    """The likeliest states of one document's lines; ties go to the earlier state."""
    score = START + EMIT[:, symbols[0]]
    back = np.zeros((len(symbols), 4), np.int8)
    for t in range(1, len(symbols)):
        all_ = score[:, None] + STEP
        back[t] = all_.argmax(0)
        score = all_.max(0) + EMIT[:, symbols[t]]
    state = np.zeros(len(symbols), np.int8)
    state[-1] = score.argmax()
    for t in range(len(symbols) - 1, 0, -1):
        state[t - 1] = back[t, state[t]]
    return state


def label(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """States of the lines of a batch.  Documents whose lines all have one symbol, most of them, are settled at
    once by that symbol; documents of equal symbols are worked out once."""
    known: dict[bytes, np.ndarray] = {}
    out = np.zeros(len(symbols), np.int8)
    if not len(symbols):
        return out
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
    small = symbols.astype(np.int8)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        key = small[a:b].tobytes()
        got = known.get(key)
        if got is None:
            got = viterbi(symbols[a:b])
            if b - a <= 40:
                known[key] = got
        out[a:b] = got
    return out


FIELDS = "n_words bigint, mean_word_length double, symbol_share double, end_share double, common_share double, prose_share double, list_share double, table_share double, junk_share double, kind string"


def statistics(df: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: word count, mean word length, share of symbols among the characters that
    are not white space, share of lines that end in punctuation, share of common words, the shares of characters in
    lines labelled prose, list, table and junk, and ``kind``.  NULL and blank texts have no words, NULL shares and
    kind NULL; long texts are read whole.  ``common`` is a fixed word list (lang, word); words of all languages
    count, since ``lang`` is often wrong.  One pass, no shuffle."""
    spark = df.sparkSession
    ship(spark)
    words = common.select("word").where("word is not null").distinct().limit(MOST_COMMON + 1).collect()
    if len(words) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words: a list of common words is fixed and short")
    known = frozenset(r["word"] for r in words)
    shared = spark.sparkContext.broadcast(known)
    pairs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in parts(texts, PARTS):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *_rows(texts[i:j], shared.value)], ["id", *(x.split()[0] for x in FIELDS.split(", "))])

    return pairs.mapInArrow(run, f"id {dict(pairs.dtypes)['id']}, {FIELDS}").withColumnRenamed("id", id_col)


def _rows(texts: list[str | None], common: frozenset[str]) -> list[pa.Array]:
    m, doc = measure(texts, common)
    n = len(texts)
    if not len(doc):
        none = pa.nulls(n, pa.float64())
        return [pa.array(np.zeros(n, np.int64)), *[none] * 8, pa.nulls(n, pa.string())]
    state = label(observe(m), doc)

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=n)

    lines, words, chars = total(np.ones(len(doc))), total(m["words"]), total(m["chars"] - m["spaces"])
    blank = lines == 0
    shares = np.stack([total((m["chars"] - m["spaces"]) * (state == k)) for k in range(4)])
    with np.errstate(all="ignore"):
        rest = shares[1:].argmax(0) + 1
        kind = np.where(shares[0] * 2 >= chars, 0, rest)
        cols = [total(m["word_chars"]) / words, total(m["signs"]) / chars, total(m["ends_mark"]) / lines, total(m["common"]) / words, *(shares / chars)]
    names = np.array(STATES, object)[kind]
    return [pa.array(words.astype(np.int64)), *(pa.array(c, mask=blank) for c in cols), pa.array(names, pa.string(), mask=blank)]
