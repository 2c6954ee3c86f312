"""Pixels: components of ink, bitmaps of glyphs, similarity, area features; numpy inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

INK = 150


def components(gray: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1) of the 8-connected components of ink (gray < 150), by union of runs of neighbouring rows."""
    runs: list[tuple[int, int, int]] = []
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before: list[int] = []
    for y, row in enumerate(gray < INK):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            k = len(runs)
            runs.append((y, a, b))
            parent.append(k)
            for j in before:
                if runs[j][1] <= b and runs[j][2] >= a:
                    parent[root(j)] = root(k)
            now.append(k)
        before = now
    boxes: dict[int, list[int]] = {}
    for k, (y, a, b) in enumerate(runs):
        r = root(k)
        box = boxes.setdefault(r, [a, y, b, y + 1])
        box[0], box[1], box[2], box[3] = min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], y + 1)
    return sorted(tuple(b) for b in boxes.values())


def bitmap(gray: np.ndarray, box: tuple[int, int, int, int], size: int = 32) -> bytes:
    """A glyph as size * size bits, nearest sampling."""
    x0, y0, x1, y1 = box
    ys = y0 + (np.arange(size) * (y1 - y0)) // size
    xs = x0 + (np.arange(size) * (x1 - x0)) // size
    return np.packbits(gray[np.ix_(ys, xs)] < INK).tobytes()


def features(gray: np.ndarray, box: tuple[int, int, int, int], size: int = 16) -> np.ndarray:
    """A square as size * size area means, rounded half to even."""
    x0, y0, x1, y1 = box
    ys, xs = np.linspace(y0, y1, size + 1).round().astype(int), np.linspace(x0, x1, size + 1).round().astype(int)
    return np.array([[np.rint(gray[a : max(b, a + 1), c : max(d, c + 1)].mean()) for c, d in zip(xs, xs[1:])] for a, b in zip(ys, ys[1:])])


def square_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Mean squared difference over the best shift of at most one, as a share of white."""
    best = np.inf
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            d = (np.roll(a, (dy, dx), (0, 1)) - b)[1:-1, 1:-1]
            best = min(best, float((d * d).mean()) / 255**2)
    return best


def frames(gray: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Squares drawn by lines: pairs of long horizontal edges of equal place and width whose distance is their width, with
    ink along 93 % of the sides."""
    ink = gray < INK
    edges = []
    for y in range(ink.shape[0]):
        e = np.flatnonzero(np.diff(np.concatenate([[0], ink[y].astype(np.int8), [0]])))
        edges += [(int(a), int(b), y) for a, b in zip(e[::2], e[1::2]) if b - a >= least]
    out = []
    for i, (a, b, y) in enumerate(edges):
        for c, d, z in edges[i + 1 :]:
            if z - y >= least and abs(a - c) <= 2 and abs(b - d) <= 2 and abs((z - y) - (b - a)) <= 0.05 * (b - a):
                left, right = ink[y:z, max(0, a - 1) : a + 2].any(1).mean(), ink[y:z, max(0, b - 2) : b + 1].any(1).mean()
                if min(left, right) >= 0.93:
                    out.append((a, y, b, z))
    return out


def dice(a: Column, b: Column) -> Column:
    """Similarity of two bitmaps given as arrays of 64-bit words: twice the common bits over all bits; NULL for empty ones."""
    count = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + F.bit_count(x))
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    total = count(a) + count(b)
    return F.when(total > 0, 2 * both / total)


def hex_words(c: Column) -> Column:
    """A bitmap of 1,024 bits in hexadecimal digits as 16 words of 64 bits; NULL for anything else."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^0x", ""), r"[\s:_,-]+", "")
    # a word from two halves: conv of 16 digits would be unsigned
    part = lambda t, i: F.shiftleft(F.conv(F.substring(t, i * 16 + 1, F.lit(8)), 16, 10).cast("bigint"), 32).bitwiseOR(F.conv(F.substring(t, i * 16 + 9, F.lit(8)), 16, 10).cast("bigint"))
    return F.element_at(F.transform(F.array(digits), lambda t: F.when(t.rlike("^[0-9a-f]{256}$"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: part(t, i)))), 1)


def glyphs(rasters: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys..., box array<int>, bitmap binary) of every component of rasters (keys..., width, height, samples); samples
    shorter than the picture give no rows."""
    ship(rasters.sparkSession)
    types = dict(rasters.dtypes)

    def run(batches):
        for b in batches:
            take, boxes, maps = [], [], []
            for i, (w, h, s) in enumerate(zip(*(b.column(c).to_pylist() for c in ("width", "height", "samples")))):
                if not s or not w or not h or len(s) < w * h:
                    continue
                gray = np.frombuffer(s, np.uint8)[: w * h].reshape(h, w)
                for box in components(gray):
                    if box[2] - box[0] >= least and box[3] - box[1] >= least:
                        take.append(i)
                        boxes.append(list(box))
                        maps.append(bitmap(gray, box))
            part = b.select(keys).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(boxes, pa.list_(pa.int32())), pa.array(maps, pa.binary())], [*keys, "box", "bitmap"])

    return rasters.select(*keys, "width", "height", "samples").mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", box array<int>, bitmap binary")


def unpacked(samples: Column) -> Column:
    """base64 of zlib of gray pixels as binary; NULL for what is damaged."""
    import base64
    import zlib

    @F.arrow_udf("binary")
    def f(v: pa.Array) -> pa.Array:
        out = []
        for x in v.to_pylist():
            try:
                out.append(zlib.decompress(base64.b64decode(x)) if x else None)
            except (ValueError, zlib.error):
                out.append(None)
        return pa.array(out, pa.binary())

    return f(samples)


#: A profile has some dozens of templates; a larger one is refused, as every glyph is compared with all of it.
MOST_TEMPLATES = 10_000


def classify(glyph: DataFrame, templates: DataFrame, keys: list[str], least: float = 0.86, margin: float = 0.07) -> DataFrame:
    """(keys..., label, similarity): the label of the template most like a glyph; NULL label unless it is alike enough and
    clearly ahead of every other label.  Rows: (keys..., words array<bigint>), (label, words)."""
    rows = templates.where("label is not null and words is not null").select("label", "words").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"a profile has at most {MOST_TEMPLATES} templates")
    labels = sorted({r["label"] for r in rows})
    bits = np.array([r["words"] for r in rows], np.int64).reshape(len(rows), -1 if rows else 16).view(np.uint64)  # counts of signed words would be those of their absolute values
    of = np.array([labels.index(r["label"]) for r in rows], np.int64)
    ink = np.bitwise_count(bits).sum(1)
    ship(glyph.sparkSession)

    types = dict(glyph.dtypes)

    def best(w) -> tuple[str | None, float | None]:
        if not w or not len(rows):
            return None, None
        g = np.array(w, np.int64).view(np.uint64)
        both = np.bitwise_count(bits & g).sum(1)
        s = 2 * both / np.maximum(ink + np.bitwise_count(g).sum(), 1)
        top = np.full(len(labels), -1.0)
        np.maximum.at(top, of, s)
        order = np.argsort(-top, kind="stable")
        ahead = len(order) == 1 or top[order[0]] - top[order[1]] >= margin
        return labels[order[0]] if top[order[0]] >= least and ahead else None, float(top[order[0]])

    def run(batches):
        for b in batches:
            found = [best(w) for w in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.select(keys).columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*keys, "label", "similarity"])

    return glyph.select(*keys, "words").mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", label string, similarity double")


def beam(columns: list[list[tuple[int, str, float]]], width: int, beam_size: int = 4, most: int = 18) -> list[tuple[str, float]]:
    """Readings of a word as chains of glyph candidates.  ``columns[x]`` holds (end, char, similarity) of the candidates that
    begin at column x; blank columns hold none and are passed.  The best ``beam_size`` states by least, then mean, similarity
    are kept at each column.  Returned best first."""
    states: dict[int, list[tuple[float, float, str]]] = {0: [(1.0, 0.0, "")]}
    for x in range(width):
        here = sorted(states.pop(x, []), key=lambda s: (-s[0], -(s[1] / max(1, len(s[2])))))[:beam_size]
        if not here:
            continue
        if not columns[x]:
            states.setdefault(x + 1, []).extend(here)
            continue
        for low, total, text in here:
            if len(text) < most:
                for end, c, s in columns[x]:
                    states.setdefault(end, []).append((min(low, s), total + s, text + c))
    done = sorted(states.get(width, []), key=lambda s: (-s[0], -(s[1] / max(1, len(s[2])))))
    return [(t, low) for low, _, t in done]
