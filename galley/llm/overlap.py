"""The same printed spot in the training split and in another split.

A picture is brought to ink on blank at 300 dpi.  Equal rasters form one class, so that copies cost one row however many
there are.  A class becomes bit fingerprints: a window around the centre of mass, cut into permuted blocks, which are joined
across the splits.  A pair counts as a candidate if at least AGREE blocks of one alignment are equal and at most RADIUS bits
differ; this rule, and nothing about the load of the join, decides.  By pigeonhole no pair of up to BLOCKS - AGREE differing
bits is missed; beyond that the share of missed pairs is stated at the radius and tested.  Candidates are then verified on
the whole pictures by their common ink.

Pictures carry no text of their own (``word.text`` is a reading, often wrong), so the verification compares print; neither
does ``file_page`` enter, because a log's page is often missing: spots are told by their pixels alone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, written

#: The window of a picture, in pixels of 300 dpi, around its centre of mass; BLOCKS * BITS of its bits are used.
ROWS, COLS = 11, 33
BLOCKS, BITS = 17, 21
#: Blocks of one alignment that a pair must have in common.
AGREE = 2
#: Bits in which two windows of one spot may differ.  Pairs of up to 15 bits are all found, of 20 bits 99.7 %, of 26 bits
#: 93 % (random bits, see the tests).
WINDOW_RADIUS = 26
#: The least share of common ink of whole pictures.
SAME_INK = 0.86
#: A picture whose ink share is this near one half is looked up in both polarities.
UNSURE = 0.1
#: Alignments of a looked-up picture around the rounded centre (rows, columns): all pairs whose centres of mass are less than
#: half a pixel apart in height and less than one in width are looked up at a common alignment.
SHIFTS = [(y, x) for y in (0, 1) for x in (-1, 0, 1)]
#: Templates: 51 blocks of 20 permuted bits; pairs of up to 49 bits are all found, of 63 bits more than 99.99 %.
TEMPLATE_BLOCKS, TEMPLATE_BITS, TEMPLATE_RADIUS = 51, 20, 63
#: Rows of a block value with more pairs than this are joined by that block and one more; the result is the same, and the
#: cost is that of as many rows, not pairs.
HOT_PAIRS = 4_000
#: Which values those are is estimated on every so many classes.
HOT_EVERY = 64

_order = np.random.RandomState(20_26).permutation(ROWS * COLS)[: BLOCKS * BITS]
_bit = (np.int64(1) << np.arange(BITS, dtype=np.int64))[::-1]


def picture(rows: list[str | None] | None, dpi: int | None) -> np.ndarray | None:
    """A picture as 0/1 array of 300 dpi with ink as 1; None without ink.  Short or missing rows count as blank."""
    if not rows:
        return None
    width = max((len(r) for r in rows if r), default=0)
    if not width:
        return None
    text = "".join((r or "").ljust(width, "0") for r in rows).encode("ascii", "replace")
    a = (np.frombuffer(text, np.uint8).reshape(len(rows), width) == 49).astype(np.uint8)
    if a.mean() > 0.5:
        a = 1 - a
    f = max(1, round(dpi / 300)) if dpi and dpi > 0 else (2 if len(rows) >= 24 else 1)
    if f > 1 and min(a.shape) >= f:
        best = None
        for y in range(f):
            for x in range(f):
                b = a[y : y + (a.shape[0] - y) // f * f, x : x + (a.shape[1] - x) // f * f]
                if b.size:
                    cell = b.reshape(b.shape[0] // f, f, b.shape[1] // f, f).sum((1, 3), dtype=np.int64)
                    pure = np.abs(cell * 2 - f * f).sum()
                    if best is None or pure > best[0]:
                        best = (pure, (cell * 2 > f * f).astype(np.uint8))
        a = best[1] if best else a
    return a if a.any() else None


def block_codes(stack: np.ndarray, looked_up: bool) -> np.ndarray:
    """(n, alignments, BLOCKS) block codes of ``n`` pictures of one size: one alignment for kept pictures, all SHIFTS for
    looked-up ones."""
    n, h, w = stack.shape
    ink = np.maximum(stack.sum((1, 2)), 1)
    cy = (stack.sum(2) * np.arange(h)).sum(1) / ink
    cx = (stack.sum(1) * np.arange(w)).sum(1) / ink
    big = np.pad(stack, ((0, 0), (ROWS, ROWS), (COLS, COLS)))
    out = []
    for dy, dx in SHIFTS if looked_up else [(None, 0)]:
        y = (np.floor(cy) + dy if dy is not None else np.round(cy)).astype(int) + ROWS - ROWS // 2
        x = np.round(cx).astype(int) + dx + COLS - COLS // 2
        rows = y[:, None, None] + np.arange(ROWS)[None, :, None]
        cols = x[:, None, None] + np.arange(COLS)[None, None, :]
        seen = big[np.arange(n)[:, None, None], rows, cols].reshape(n, ROWS * COLS)[:, _order]
        out.append((seen.reshape(n, BLOCKS, BITS).astype(np.int64) * _bit).sum(2))
    return np.stack(out, 1)


def rasters(df: DataFrame) -> DataFrame:
    """(id, split, mark, ink, height, width) of rows (id, split, bit_rows, dpi): the upright raster and its hash; pictures
    without ink give no row."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            keep, mark, ink, high, wide = [], [], [], [], []
            for k, (rows, dpi) in enumerate(zip(b.column("bit_rows").to_pylist(), b.column("dpi").to_pylist())):
                a = picture(rows, dpi)
                if a is not None:
                    bits = np.packbits(a).tobytes()
                    keep.append(k)
                    mark.append(hashlib.md5(bits + b"%dx%d" % a.shape, usedforsecurity=False).digest())
                    ink.append(bits)
                    high.append(a.shape[0])
                    wide.append(a.shape[1])
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("split"), pa.array(mark, pa.binary()), pa.array(ink, pa.binary()), pa.array(high, pa.int32()), pa.array(wide, pa.int32())],
                ["id", "split", "mark", "ink", "height", "width"],
            )

    return df.select("id", "split", "bit_rows", "dpi").mapInArrow(run, "id bigint, split string, mark binary, ink binary, height int, width int")


def _unpacked(ink: list[bytes], h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(ink), np.uint8).reshape(len(ink), -1), axis=1, count=h * w).reshape(-1, h, w)


def fingerprints(classes: DataFrame) -> DataFrame:
    """(rep, looked_up, codes) of classes (rep, ink, height, width, in_train, in_other): the block codes of a train class, and
    those of a looked-up one in all its alignments, in both polarities if its ink share leaves them open."""
    ship(classes.sparkSession)

    def run(batches):
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("rep", "ink", "height", "width", "in_train", "in_other")}
            sizes: dict[tuple[int, int], list[int]] = {}
            for i, hw in enumerate(zip(cols["height"], cols["width"])):
                sizes.setdefault(hw, []).append(i)
            rep, side, code = [], [], []
            for (h, w), at in sizes.items():
                stack = _unpacked([cols["ink"][i] for i in at], h, w)
                share = stack.mean((1, 2))
                for looked_up, flag in ((False, "in_train"), (True, "in_other")):
                    here = np.array([cols[flag][i] for i in at])
                    for some, pick in ((stack, here), (1 - stack, here & looked_up & (np.abs(share - 0.5) < UNSURE))):
                        if pick.any():
                            got = block_codes(some[pick], looked_up)
                            rep += [cols["rep"][i] for i, p in zip(at, pick) if p]
                            side += [looked_up] * len(got)
                            code += list(got.reshape(len(got), -1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep, pa.int64()), pa.array(side, pa.bool_()), pa.array(code, pa.list_(pa.int64()))], ["rep", "looked_up", "codes"]
            )

    return classes.mapInArrow(run, "rep bigint, looked_up boolean, codes array<bigint>")


def candidates(prints: DataFrame, blocks: int, bits: int) -> DataFrame:
    """Distinct (a, b) of a kept and a looked-up row of ``prints`` (rep, looked_up, codes) that agree in AGREE = 2 blocks of
    one alignment or more.  ``codes`` holds the blocks of one alignment after those of the other.  Equal blocks are joined
    and counted.  Rows of a hot block value (many pairs) are joined by that value and the value of any second block instead:
    pairs that agree twice are met either way, so hotness never changes the result."""

    def keyed(looked_up: bool) -> DataFrame:
        at = prints.where(F.col("looked_up") == looked_up).select("rep", F.posexplode("codes").alias("at", "code"))
        return at.select("rep", F.floor(F.col("at") / blocks).cast("int").alias("turn"), (F.shiftleft((F.col("at") % blocks).cast("bigint"), bits) + F.col("code")).alias("key"))

    left, right = keyed(False), keyed(True)
    part = lambda df: df.where(F.pmod(F.xxhash64("rep"), F.lit(HOT_EVERY)) == 0).groupBy("key")
    load = part(left).agg(F.count("*").alias("n")).join(part(right).agg(F.count("*").alias("k")), "key")
    hot = written(load.where(F.col("n") * F.col("k") * HOT_EVERY**2 > HOT_PAIRS).select("key"), "hot")
    a, b = F.col("rep").alias("a"), F.col("rep").alias("b")

    def twice(left: DataFrame, right: DataFrame) -> DataFrame:
        met = left.select(a, "key").join(right.select(b, "turn", "key"), "key")
        return met.groupBy("a", "b", "turn").agg(F.count("*").alias("n")).where(F.col("n") >= AGREE).select("a", "b")

    if hot.isEmpty():
        return twice(left, right).distinct()

    def deep(looked_up: bool, name: Column) -> DataFrame:
        """Rows of hot values once for every further block of the alignment, keyed by both values."""
        rows = prints.where(F.col("looked_up") == looked_up).select("rep", "codes", F.posexplode("codes").alias("at", "code"))
        rows = rows.withColumn("key", F.shiftleft((F.col("at") % blocks).cast("bigint"), bits) + F.col("code")).join(hot, "key")
        first = (F.floor(F.col("at") / blocks) * blocks + 1).cast("int")
        others = F.transform(F.slice("codes", first, blocks), lambda x, j: F.struct(j.alias("j"), x.alias("x")))
        second = F.filter(others, lambda e: e["j"] != F.col("at") % blocks)
        return rows.select(name, "key", F.explode(F.transform(second, lambda e: F.shiftleft(e["j"].cast("bigint"), bits) + e["x"])).alias("second"))

    cool = lambda df: df.join(hot, "key", "left_anti")
    return twice(cool(left), cool(right)).union(deep(False, a).join(deep(True, b), ["key", "second"]).select("a", "b")).distinct()


def same_ink(a: np.ndarray, b: np.ndarray, reach: int = 3) -> float:
    """The greatest share of common ink (Dice) of two pictures over small shifts of their centres of mass."""
    ya, xa = np.nonzero(a)
    yb, xb = np.nonzero(b)
    if not len(ya) or not len(yb):
        return 0.0
    dy, dx = round(ya.mean() - yb.mean()), round(xa.mean() - xb.mean())
    # b is laid on a blank sheet that holds every shift of a
    h, w = max(a.shape[0], b.shape[0]) + 2 * reach + abs(dy), max(a.shape[1], b.shape[1]) + 2 * reach + abs(dx)
    sheet = np.zeros((3 * h, 3 * w), np.int32)
    sheet[h : h + a.shape[0], w : w + a.shape[1]] = a
    best = 0
    for y in range(h + dy - reach, h + dy + reach + 1):
        for x in range(w + dx - reach, w + dx + reach + 1):
            best = max(best, int((sheet[y : y + b.shape[0], x : x + b.shape[1]] * b).sum()))
    return 2 * best / (len(ya) + len(yb))


def near_windows(kept: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """True for pairs (n, 1, BLOCKS) and (n, alignments, BLOCKS) that meet the AGREE rule within WINDOW_RADIUS."""
    off = np.bitwise_count(kept ^ asked)
    return (((off == 0).sum(2) >= AGREE) & (off.sum(2, dtype=np.int64) <= WINDOW_RADIUS)).any(1)


def _verify(batches):
    """Pairs (a, b, x, y) of classes as pairs (a, b, similarity) that pass the window and the ink test."""
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("x", "y"))))
        sims = np.zeros(len(rows))
        sizes: dict[tuple, list[int]] = {}
        for i, (p, q) in enumerate(rows):
            sizes.setdefault((p["height"], p["width"], q["height"], q["width"]), []).append(i)
        for (h, w, k, v), at in sizes.items():
            own, other = _unpacked([rows[i][0]["ink"] for i in at], h, w), _unpacked([rows[i][1]["ink"] for i in at], k, v)
            unsure = np.abs(other.mean((1, 2)) - 0.5) < UNSURE
            codes = block_codes(own, False)
            for some, may in ((other, np.ones(len(at), bool)), (1 - other, unsure)):
                good = may.copy()
                good[may] = near_windows(codes[may], block_codes(some[may], True))
                for j in np.flatnonzero(good):
                    sims[at[j]] = max(sims[at[j]], same_ink(own[j], some[j]))
        keep = np.flatnonzero(sims >= SAME_INK)
        part = batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sims[keep], pa.float64())], ["a", "b", "similarity"])


def _classed(rows: DataFrame, mark: str, fields: list[str], train: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Members (id, split, rep) and classes (rep, fields..., in_train, in_other) of rows with equal ``mark``; the class is
    named by its smallest id."""
    inside = F.col("split") == train
    classes = written(
        rows.groupBy(mark).agg(F.min("id").alias("rep"), *(F.first(f).alias(f) for f in fields), F.bool_or(inside).alias("in_train"), F.bool_or(~inside).alias("in_other")),
        name,
    )
    members = rows.select("id", "split", mark).distinct().join(classes.select(mark, "rep"), mark).select("id", "split", "rep")
    return members, classes


def picture_classes(rows: DataFrame, train: str = "train") -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b, similarity), a with train records and b with others, and the members (id, split, rep) of all
    classes.  Rows: (id, split, bit_rows, dpi).  NULL splits and pictures without ink are in no class."""
    upright = written(rasters(rows.where("split is not null")), "rasters")
    members, classes = _classed(upright, "mark", ["ink", "height", "width"], train, "classes")
    prints = written(fingerprints(classes.select("rep", "ink", "height", "width", "in_train", "in_other")), "prints")
    pairs = candidates(prints, BLOCKS, BITS)
    side = lambda n, v: classes.select(F.col("rep").alias(n), F.struct("ink", "height", "width").alias(v))
    near = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return near.select("a", "b", "x", "y").mapInArrow(_verify, "a bigint, b bigint, similarity double"), members


def expanded(pairs: DataFrame, members: DataFrame, train: str = "train") -> DataFrame:
    """(a, b, similarity): every train record and record of another split whose classes are paired."""
    own = members.where(F.col("split") == train).select(F.col("rep").alias("a"), F.col("id").alias("x"))
    rest = members.where(F.col("split") != train).select(F.col("rep").alias("b"), F.col("id").alias("y"))
    return pairs.join(own, "a").join(rest, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"), "similarity").distinct()


def picture_overlaps(rows: DataFrame, train: str = "train") -> DataFrame:
    """(a, b, similarity): a train picture and one of another split that show one spot.  A row sent again counts once."""
    return expanded(*picture_classes(rows, train), train)


_noise = re.compile(r"[\s:_,-]+")
_bits_of = np.random.RandomState(51).permutation(1024)


def template_codes(bitmaps: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are bitmaps of 1,024 bits in hexadecimal digits, however written (prefix, case, white space, separators),
    and their codes: TEMPLATE_BLOCKS blocks of permuted bits, and the bits left over as one more code."""
    raw, good = [], np.zeros(len(bitmaps), bool)
    for i, text in enumerate(bitmaps):
        digits = _noise.sub("", (text or "").strip().lower().removeprefix("0x"))
        if len(digits) == 256:
            try:
                raw.append(bytes.fromhex(digits))
                good[i] = True
            except ValueError:
                pass
    bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 128), axis=1)[:, _bits_of].astype(np.int64)
    used = TEMPLATE_BLOCKS * TEMPLATE_BITS
    blocks = (bits[:, :used].reshape(-1, TEMPLATE_BLOCKS, TEMPLATE_BITS) << np.arange(TEMPLATE_BITS)).sum(2)
    return good, np.concatenate([blocks, (bits[:, used:] << np.arange(1024 - used)).sum(1, keepdims=True)], 1)


def coded_templates(df: DataFrame) -> DataFrame:
    """(id, split, mark, codes) of rows (id, split, bitmap); what is no bitmap gives no row."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            good, codes = template_codes(b.column("bitmap").to_pylist())
            part = b.select(["id", "split"]).filter(pa.array(good))
            mark = [hashlib.md5(c.tobytes(), usedforsecurity=False).digest() for c in codes]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(mark, pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))], ["id", "split", "mark", "codes"])

    return df.select("id", "split", "bitmap").mapInArrow(run, "id bigint, split string, mark binary, codes array<bigint>")


def template_classes(rows: DataFrame, train: str = "train") -> tuple[DataFrame, DataFrame]:
    """As ``picture_classes``, for rows (id, split, bitmap); the verification counts the differing bits of all 1,024."""
    members, classes = _classed(written(coded_templates(rows.where("split is not null")), "coded"), "mark", ["codes"], train, "templates")
    side = lambda flag, up: classes.where(flag).select("rep", F.lit(up).alias("looked_up"), F.slice("codes", 1, TEMPLATE_BLOCKS).alias("codes"))
    pairs = candidates(side("in_train", False).union(side("in_other", True)), TEMPLATE_BLOCKS, TEMPLATE_BITS)
    both = pairs.join(classes.select(F.col("rep").alias("a"), F.col("codes").alias("x")), "a").join(classes.select(F.col("rep").alias("b"), F.col("codes").alias("y")), "b")
    off = F.zip_with("x", "y", lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    counted = both.select("a", "b", off.alias("off")).select("a", "b", F.aggregate("off", F.lit(0), lambda s, n: s + n).alias("far"), F.size(F.filter(F.slice("off", 1, TEMPLATE_BLOCKS), lambda n: n == 0)).alias("equal"))
    near = counted.where((F.col("far") <= TEMPLATE_RADIUS) & (F.col("equal") >= AGREE))
    return near.select("a", "b", (1 - F.col("far") / 1024).alias("similarity")), members


def template_overlaps(rows: DataFrame, train: str = "train") -> DataFrame:
    """(a, b, similarity) as in ``picture_overlaps``, for rows (id, split, bitmap)."""
    return expanded(*template_classes(rows, train), train)


def report(pairs: DataFrame, members: DataFrame, train: str = "train") -> DataFrame:
    """(split, book_id, pairs, records, train_records) counted on classes, without writing the pairs of their members out.
    ``members`` holds (id, split, book_id, rep)."""
    kept = members.where(F.col("split") == train).groupBy(F.col("rep").alias("a")).agg(F.countDistinct("id").alias("na"))
    asked = members.where(F.col("split") != train).groupBy("split", "book_id", F.col("rep").alias("b")).agg(F.countDistinct("id").alias("nb"))
    hit = written(pairs.select("a", "b").join(kept, "a").join(asked, "b"), "hits")
    group = ["split", "book_id"]
    total = hit.groupBy(*group).agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"))
    records = hit.select(*group, "b", "nb").distinct().groupBy(*group).agg(F.sum("nb").alias("records"))
    trained = hit.select(*group, "a", "na").distinct().groupBy(*group).agg(F.sum("na").alias("train_records"))
    return total.join(records, group).join(trained, group)
