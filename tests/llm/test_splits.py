import random

import pytest

from galley.llm import bookkeys, splits


def union_find(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is None or b is None:
            for x in (a, b):
                if x is not None:
                    root(x)
            continue
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


@pytest.mark.parametrize("seed, hot", [(1, 100_000), (2, 3), (3, 1)])
def test_components(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(splits, "HOT", hot)
    monkeypatch.setattr(splits, "SALTS", 4)
    rnd = random.Random(seed)
    name = lambda: f"n{rnd.randint(0, 60):02d}"
    links = [(name(), name()) for _ in range(35)] + [("hub", f"leaf{i}") for i in range(30)] + [(f"chain{i:02d}", f"chain{i + 1:02d}") for i in range(20)] + [("alone", None), (None, None), ("self", "self"), ("hub", "leaf1")]
    got = {r["node"]: r["component"] for r in splits.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == union_find(links)


def test_short_lists_take_no_rounds(spark, monkeypatch):
    """A list without hot nodes is one task and one write, however long its chains: each round takes driver memory."""
    names, write = [], splits.written
    monkeypatch.setattr(splits, "written", lambda df, name: (names.append(name), write(df, name))[1])
    links = [(i, i + 1) for i in range(300)] + [(1000, None), (2000, 2000), (3001, 3000), (3000, 3001)]
    got = {r["node"]: r["component"] for r in splits.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == union_find(links) and names == ["ends"]
    # a longer list comes to one task as soon as rounds have made it short, and gives the same
    names.clear()
    monkeypatch.setattr(splits, "HOT", 40)
    links = [(i, j) for i in range(10) for j in range(i, 10)]
    got = {r["node"]: r["component"] for r in splits.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == union_find(links) and "small" in names and names.count("small") == 1


def test_no_links(spark):
    assert splits.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_keys(spark):
    names = [("./in/Ruzavi_Northern_Reader.djvu", "ruzavi northern reader"), ("D:\\books\\X_Y.pdf", "x y"), (" A  B ", "a b"), (None, None), ("..pdf", None), ("ÀÉ_Vol. 2", "ae vol 2")]
    df = spark.createDataFrame([(n,) for n, _ in names], "n string")
    assert [r[0] for r in df.select(bookkeys.book_key(df["n"]).alias("k")).collect()] == [None if k is None else k.replace(" ", "") for _, k in names]
    people = [("Sorvová, C. & Z.Grimano", ["grimano", "sorvova"]), ("C.SORVOVA", ["sorvova"]), ("-", []), ("various", []), (None, []), ("Pellöder E; I. Jasková", ["jaskova", "pelloder"]), ("?", []), ("H.Mirvholt and V. Haldik", ["haldik", "mirvholt"])]
    df = spark.createDataFrame([(n,) for n, _ in people], "n string")
    assert [sorted(p["words"][0] for p in r[0]) for r in df.select(bookkeys.persons(df["n"]).alias("p")).collect()] == [p for _, p in people]


def test_surnames(spark):
    """Given names, orders, particles and surnames of two words; two different surnames stay two."""
    people = ["B. Larsen", "Bent Larsen", "Larsen Bent", "LARSEN, Bent", "Garcia Lopez, A.", "A. Garcia Lopez", "Juan Lopez", "van Foreest, J.", "J. van Foreest", "Tal", "Talman", None, "-", "Ånd Ex & Tal"]
    df = spark.createDataFrame([(f"b{i:02d}", a) for i, a in enumerate(people)], "book_id string, author string")
    got = {}
    for r in bookkeys.surnames(df).collect():
        got.setdefault(int(r["book_id"][1:]), set()).add(r["surname"])
    assert {k: got[k] for k in range(4)} == {k: {"larsen"} for k in range(4)}
    assert got[4] == got[5] == {"garcia lopez"} and got[6] == {"lopez"}
    assert got[7] == got[8] == {"foreest van"} and got[9] == {"tal"} and got[10] == {"talman"} and got[13] == {"ex", "tal"}
    assert 11 not in got and 12 not in got


BOOKS = [("b1", "Ruz_Silent_Vol_1.pdf", "s1", "Ruz A"), ("b2", "Ruz_Silent_Vol_2.pdf", "s2", "-"), ("b3", "scan77_x.djvu", "s2", None), ("b4", "Other_Games.djvu", "s4", "B; A. RUZ"), ("b5", "Lone_Book.pdf", "s5", "various"), ("b6", "Lane_Book.pdf", None, "various")]


def books(spark):
    return spark.createDataFrame(BOOKS, "book_id string, path string, sha256 string, author string")


def test_resolve(spark):
    raw = ["RUZ-SILENT-VOL-1.PDF", "Ruz_Silnet_Vol_2", "Ruz_Silent_Vol_3.pdf", "Lone Book", "Line_Book.pdf", None, "Othr_Games.pdf", "completely else"]
    got = {r["book"]: r["book_id"] for r in bookkeys.resolve(spark.createDataFrame([(x,) for x in raw], "book string"), books(spark)).collect()}
    # Line_Book is one slip from two books
    assert got == {"RUZ-SILENT-VOL-1.PDF": "b1", "Ruz_Silnet_Vol_2": "b2", "Lone Book": "b5", "Othr_Games.pdf": "b4"}


def test_groups_and_splits(spark):
    g = {r["book_id"]: r["group_book"] for r in splits.book_groups(books(spark)).collect()}
    assert g == {"b1": "b1", "b2": "b2", "b3": "b2", "b4": "b1", "b5": "b5", "b6": "b6"}
    clip = spark.createDataFrame([(1, "train", "Ruz_Silent_Vol_1.pdf"), (1, "train", "Ruz_Silent_Vol_1.pdf"), (2, "holdout", "Other Games"), (3, None, "Other Games"), (4, "train", None), (5, "train", "Lone_Book.pdf")], "clip_id bigint, split string, book string")
    classic = spark.createDataFrame([(1, "development", ("scan77_x",)), (2, None, None), (5, "train", ("Lone Book",)), (6, "development", ("Ruz_Silent_Vol_2",))], "template_id bigint, split string, source struct<book: string>")
    rec = splits.record_groups(clip, classic, books(spark))
    assert sorted(tuple(r) for r in splits.spread_groups(rec).collect()) == [("clipped_notation", 1, "b1"), ("clipped_notation", 2, "b1"), ("clipped_notation", 3, "b1")]
    plan = spark.createDataFrame([("train", 0.8), ("development", 0.1), ("holdout", 0.1)], "split string, share double")
    out = splits.assign(rec, plan).collect()
    per = {}
    for r in out:
        per.setdefault(r["group_book"], set()).add(r["new_split"])
    assert all(len(v) == 1 for k, v in per.items() if k is not None) and len(out) == 9
    many = spark.range(20_000).selectExpr("cast(id as string) AS k")
    n = {r["s"]: r["count"] for r in many.select(splits.in_proportion(many["k"], [("train", 0.8), ("development", 0.1), ("holdout", 0.1)]).alias("s")).groupBy("s").count().collect()}
    assert abs(n["train"] - 16_000) < 300 and abs(n["holdout"] - 2_000) < 200
