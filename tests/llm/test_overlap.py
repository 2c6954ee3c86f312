import numpy as np
import pytest

from galley.llm import overlap


def glyphs(rnd, n):
    return (rnd.rand(11, 7 * n) < 0.5).astype(np.uint8)


def cut(rnd, a, pad=1, flips=0):
    b = np.pad(a, ((pad, rnd.randint(1, 4)), (rnd.randint(1, 5), rnd.randint(1, 5)))).copy()
    for _ in range(flips):
        b[rnd.randint(b.shape[0]), rnd.randint(b.shape[1])] ^= 1
    return b


def text(a):
    return ["".join(map(str, r)) for r in a]


def fixture(seed):
    rnd = np.random.RandomState(seed)
    data, spots = [], []
    for s in range(40):
        a = glyphs(rnd, rnd.randint(5, 9))
        for k in range(rnd.randint(1, 4)):
            b = cut(rnd, a, 1 + k % 3, (0, 6, 9)[k % 3])
            dpi = 300
            if k == 1 and s % 3 == 0:
                b, dpi = np.kron(b, np.ones((2, 2), np.uint8)), 600
            if k == 2 and s % 4 == 0:
                b = 1 - b
            spots.append(s)
            data.append((len(data), ["train", "holdout", "development", None][rnd.randint(4)], text(b), dpi))
    return data, spots


def wanted(data, spots):
    return {(x[0], y[0]) for x in data for y in data if x[1] == "train" and y[1] not in ("train", None) and spots[x[0]] == spots[y[0]]}


SCHEMA = "id bigint, split string, bit_rows array<string>, dpi int"


@pytest.mark.parametrize("seed, hot", [(1, 200_000), (2, 0)])
def test_pictures(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(overlap, "HOT_PAIRS", hot)
    monkeypatch.setattr(overlap, "HOT_EVERY", 1)
    data, spots = fixture(seed)
    extra = [(1000, "holdout", None, 300), (1001, "train", [], 300), (1002, "train", ["000", "000"], None), (1003, "holdout", [None, "", "111"], 300), (1004, "train", ["1"], 0), data[0]]
    got = {(r["a"], r["b"]) for r in overlap.picture_overlaps(spark.createDataFrame(data + extra, SCHEMA)).collect()}
    assert {p for p in got if p[0] < 1000} == wanted(data, spots)


def test_no_pictures(spark):
    assert overlap.picture_overlaps(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("hot", [200_000, 0])
def test_templates(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT_PAIRS", hot)
    monkeypatch.setattr(overlap, "HOT_EVERY", 1)
    rnd = np.random.RandomState(4)
    data, bits = [], []
    for s in range(30):
        a = (rnd.rand(1024) < 0.5).astype(np.uint8)
        for k in range(3):
            b = a.copy()
            b[rnd.permutation(1024)[: (0, 45, 63)[k]]] ^= 1
            h = np.packbits(b).tobytes().hex()
            bits.append(b)
            data.append((len(data), ["train", "holdout", None, "train"][rnd.randint(4)], [h, h.upper(), "0x" + h][k]))
    data += [(900, "train", None), (901, "holdout", "zz"), (902, "train", "0x12"), (0, data[0][1], data[0][2])]
    want = {(x[0], y[0]) for x in data[:90] for y in data[:90] if x[1] == "train" and y[1] == "holdout" and (bits[x[0]] != bits[y[0]]).sum() <= overlap.TEMPLATE_RADIUS}
    got = {(r["a"], r["b"]) for r in overlap.template_overlaps(spark.createDataFrame(data, "id bigint, split string, bitmap string")).collect()}
    assert got == want and want
    assert overlap.template_overlaps(spark.createDataFrame([], "id bigint, split string, bitmap string")).count() == 0


def flipped(rnd, bits, n):
    b = bits.copy()
    b[rnd.permutation(len(b))[:n]] ^= 1
    return b


@pytest.mark.parametrize("far, least", [(12, 1.0), (15, 1.0), (20, 0.97), (26, 0.9)])
def test_recall_by_distance(far, least):
    """Blocks of windows against brute force: complete up to BLOCKS - AGREE bits, 0.9 at the radius."""
    rnd = np.random.RandomState(far)
    window = (rnd.rand(1500, overlap.BLOCKS, overlap.BITS) < 0.35).astype(np.int64)
    other = np.stack([flipped(rnd, w.reshape(-1), far).reshape(w.shape) for w in window])
    code = lambda w: (w * overlap._bit).sum(2)[:, None]
    assert overlap.near_windows(code(window), code(other)).mean() >= least


def test_hotness_never_changes_the_result(spark, monkeypatch):
    """Pairs 13 to 26 bits apart: the plain way and the way of hot values agree on every pair of the AGREE rule."""
    rnd = np.random.RandomState(8)
    blocks, bits = overlap.BLOCKS, overlap.BITS
    rows, truth = [], set()
    for k in range(60):
        w = (rnd.rand(blocks * bits) < 0.35).astype(np.int64)
        for looked_up in (False, True):
            v = flipped(rnd, w, (0, 13, 18, 26)[k % 4]) if looked_up else w
            code = (v.reshape(blocks, bits) * overlap._bit).sum(1)
            rows.append((2 * k + looked_up, looked_up, [int(c) for c in code]))
        if sum(p == q for p, q in zip(rows[-2][2], rows[-1][2])) >= overlap.AGREE:
            truth.add((2 * k, 2 * k + 1))
    prints = spark.createDataFrame(rows, "rep bigint, looked_up boolean, codes array<bigint>")
    monkeypatch.setattr(overlap, "HOT_EVERY", 1)
    codes = {r[0]: r[2] for r in rows}
    for hot in (0, 10**9):
        monkeypatch.setattr(overlap, "HOT_PAIRS", hot)
        got = {(r["a"], r["b"]) for r in overlap.candidates(prints, blocks, bits).collect()}
        assert {(a, b) for a, b in got if sum(p == q for p, q in zip(codes[a], codes[b])) >= overlap.AGREE} == truth


def test_half_ink_and_copies(spark):
    """Pictures near half ink are found in either polarity; copies form one class and the report counts them all."""
    rnd = np.random.RandomState(3)
    data, n = [], 0
    for k in range(20):
        a = (rnd.rand(11, 40) < 0.5).astype(np.uint8)
        b = flipped(rnd, a.reshape(-1), 6).reshape(a.shape)
        data += [(n, "train", text(a), 300), (n + 1, "holdout", text(b), 300)]
        n += 2
    data += [(100 + k, "train", data[0][2], 300) for k in range(5)] + [(200 + k, "holdout", data[1][2], 300) for k in range(7)]
    rows = spark.createDataFrame(data, SCHEMA)
    got = {(r["a"], r["b"]) for r in overlap.picture_overlaps(rows).collect()}
    want = {(2 * k, 2 * k + 1) for k in range(1, 20)} | {(a, b) for a in (0, *range(100, 105)) for b in (1, *range(200, 207))}
    assert got == want
    pairs, members = overlap.picture_classes(rows)
    assert pairs.count() == 20
    from pyspark.sql import functions as F

    told = overlap.report(pairs, members.withColumn("book_id", F.lit("b"))).collect()
    assert [tuple(r) for r in told] == [("holdout", "b", len(want), 27, 25)]
