import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley.llm import encode, packing, tokens

pytestmark = pytest.mark.skipif(not Path(encode.TOKENIZER).exists(), reason="no tokenizer files")


@pytest.fixture(scope="module")
def mine():
    return tokens.Encoder(tokens.load_merges(Path(encode.TOKENIZER).read_bytes()))


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.TOKENIZER)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def split(mine, texts):
    flat, at = mine.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_same_ids_as_the_library(mine, theirs, texts):
    assert split(mine, texts) == theirs(texts)


def test_pieces_side_by_side(mine, theirs):
    rnd = random.Random(3)
    words = [p.decode() for p in mine.pieces if p and p.isascii()]
    texts = ["".join(rnd.choices(words, k=5)) for _ in range(3000)] + ["a" * 3000, "=" * 2999, "ab" * 900, "<|endoftext|>", "", "\n\n  x"]
    assert split(mine, texts) == theirs(texts)
    assert mine.sizes(texts).tolist() == [len(x) for x in theirs(texts)]


def test_pair_test_agrees_with_merging(mine):
    rnd = np.random.RandomState(5)
    a, b = rnd.randint(0, 50256, 4000), rnd.randint(0, 50256, 4000)
    own = [mine.exact(mine.pieces[i]) == [i] for i in range(2000)]
    assert all(own)
    want = [mine.exact(mine.pieces[x] + mine.pieces[y]) == [x, y] for x, y in zip(a, b)]
    assert mine.compatible(a.astype(np.int64), b.astype(np.int64)).tolist() == want


def test_small_cache(theirs):
    e = tokens.Encoder(tokens.load_merges(Path(encode.TOKENIZER).read_bytes()), cache_words=50)
    texts = [f"word{i} and other{i * 7} things" for i in range(200)]
    got = []
    for i in range(0, 200, 10):
        got += split(e, texts[i : i + 10])
    assert got == theirs(texts) and len(e.word) <= 60


def test_table(spark, theirs):
    texts = [(1, "The knight"), (2, None), (3, ""), (4, " \n"), (4, " \n"), (5, "слон " * 3000), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r["doc_id"], r["ids"]) for r in encode.token_ids(df).collect()), key=repr)
    assert got == sorted(((i, theirs([t or ""])[0]) for i, t in texts), key=repr)
    counts = {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(df).collect()}
    assert counts == {i: len(theirs([t or ""])[0]) for i, t in texts}
    assert encode.token_ids(df.limit(0)).count() == 0


def best_padding(sizes, counts, k):
    """Least padding by trying all boundaries."""
    from itertools import combinations

    n = len(sizes)
    best = None
    for cut in combinations(range(n - 1), min(k, n) - 1):
        bounds = [sizes[i] for i in cut] + [sizes[-1]]
        cost = sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, counts))
        best = cost if best is None else min(best, cost)
    return best


def test_buckets_are_optimal():
    rnd = random.Random(1)
    for _ in range(60):
        n, k = rnd.randint(1, 9), rnd.randint(1, 4)
        sizes = np.array(sorted(rnd.sample(range(1, 60), n)))
        counts = np.array([rnd.randint(1, 9) for _ in range(n)])
        b = packing.optimal_buckets(sizes, counts, k)
        assert len(b) <= max(k, 1) or n <= k
        cost = sum(c * (b[b >= s].min() - s) for s, c in zip(sizes, counts))
        assert cost == best_padding(sizes.tolist(), counts.tolist(), k)


@pytest.mark.parametrize("capacity", [7, 64, 1000])
def test_pack(spark, capacity):
    rnd = random.Random(capacity)
    data = [(i, rnd.choice([1, 3, capacity - 1, capacity, capacity + 1, 3 * capacity + 2, rnd.randint(1, capacity)])) for i in range(400)] + [(900, None), (901, 0), (902, -3), (903, 5), (903, 5)]
    df = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint")
    got = packing.pack(df, capacity).collect()
    whole = [r for r in got if r["bin"] is not None]
    use = {}
    for r in whole:
        use[r["bin"]] = use.get(r["bin"], 0) + r["size"]
    assert max(use.values()) <= capacity
    total = {}
    for r in whole:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["size"]
    assert total == {i: n * (2 if i == 903 else 1) for i, n in data if n and n > 0}
    assert {r["doc_id"] for r in got if r["bin"] is None} == {900, 901, 902}
    assert {r["doc_id"] for r in got if r["n_pieces"] > 1} == {i for i, n in data if n and n > capacity}
    assert sum(use.values()) / (len(use) * capacity) > 0.8
    assert packing.pack(df.limit(0), capacity).count() == 0


def first_fit(sizes, capacity):
    """Bins of first-fit decreasing, which is at most 11/9 of the best and one."""
    free = []
    for s in sorted(sizes, reverse=True):
        for i, f in enumerate(free):
            if f >= s:
                free[i] -= s
                break
        else:
            free.append(capacity - s)
    return len(free)


def test_pack_against_first_fit_and_check(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)  # several salts
    rnd = random.Random(9)
    data = [(i, max(1, int(rnd.lognormvariate(4, 1)))) for i in range(1500)] + [(9000, None), (9001, 0)]
    df = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint")
    got = packing.pack(df, 512)
    pieces = [p for _, n in data if n for p in [512] * (n // 512) + [n % 512] * (n % 512 > 0)]
    bins = got.where("bin is not null").select("bin").distinct().count()
    assert bins <= 1.03 * first_fit(pieces, 512)
    row = packing.check(got, df, 512).first()
    assert (row["placed"], row["without_size"], row["wrong"], row["overfull"], row["dense"]) == (1500, 2, 0, 0, True)
    broken = got.where("doc_id <> 7").withColumn("bin", F.when(F.col("bin") == 1, 0).otherwise(F.col("bin")))
    row = packing.check(broken, df, 512).first()
    assert row["wrong"] == 1 and row["overfull"] == 1
