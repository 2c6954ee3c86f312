import pytest

from galley.llm import scannoise as S

BASE = "The players agreed to a draw after many moves although the opening was still doubtful and nobody had expected the combination. "
NAMES = ["opening paths", "jaskürk"]


def corpus():
    rows = [("n", 100 + i, BASE * 3 + f"Pawn-chain number {i} and pawn-chain.", NAMES, 5) for i in range(30)]
    note = "OPENING PATHS\n217\nThe players agreed to a combi-\nnation after the openiug and the pawn-\nchain, and the comb1nation was rnany moves.\nJASKÜRK   218\nNobody had expected 12.Nf3 but 13.£f4 was ex\xad\n— 218 —\npected.\r\n1-0\nGame 12"
    return rows + [("n", 1, note, NAMES, 217), ("n", 2, None, NAMES, 1), ("n", 3, "", [], None), ("n", 4, " \n ", None, None), ("w", 5, "4)h4", [], None), ("w", 6, "♘h4", [], None), ("w", 7, "Combinatioii", [], None), ("n", 8, "word " * 50_000, NAMES, 3), ("n", 1, note, NAMES, 217)]


@pytest.mark.parametrize("small", [200_000, 0])
def test_faults_and_repair(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", small)
    df = spark.createDataFrame(corpus(), S.TEXTS).selectExpr("*", "1 AS line_no", "'clash' AS kind")
    got = {(r["rec_id"], r["line_no"], r["kind"]) for r in S.faults(df).distinct().collect()}
    assert {x for x in got if x[0] == 1} == {(1, 1, "header"), (1, 2, "page_number"), (1, 3, "hyphen"), (1, 4, "char"), (1, 5, "char"), (1, 6, "header"), (1, 7, "char"), (1, 7, "hyphen"), (1, 8, "page_number")}
    assert (5, 1, "char") in got and not any(x[0] in (2, 3, 4, 6, 8) or x[0] >= 100 for x in got)
    text = {r["rec_id"]: r["text"] for r in S.repair(df).distinct().collect()}
    assert text[2] is None and text[3] == ""
    assert "agreed to a combination after the" in text[1] and "the pawn-chain, and the combination was many moves." in text[1] and "was expected." in text[1]
    assert "217" not in text[1] and "PATHS" not in text[1] and "Game 12" in text[1]


def brute(word, words):
    """All words within the bound, by dynamic programming over both words."""
    out = {}
    for w in words:
        best = [[9.0] * (len(w) + 1) for _ in range(len(word) + 1)]
        best[0][0] = 0.0
        for i in range(len(word) + 1):
            for j in range(len(w) + 1):
                c = best[i][j]
                if i < len(word) and j < len(w):
                    d = 0.0 if word[i] == w[j] else S.DEAR
                    best[i + 1][j + 1] = min(best[i + 1][j + 1], c + d)
                if i < len(word):
                    best[i + 1][j] = min(best[i + 1][j], c + S.DEAR)
                if j < len(w):
                    best[i][j + 1] = min(best[i][j + 1], c + S.DEAR)
                for a, b in S.CONFUSIONS:
                    if word.startswith(a, i) and w.startswith(b, j):
                        best[i + len(a)][j + len(b)] = min(best[i + len(a)][j + len(b)], c + S.CHEAP)
        if best[-1][-1] <= S.BOUND + 1e-9:
            out[w] = round(best[-1][-1], 6)
    return out


def test_automaton_is_complete():
    import random

    rnd = random.Random(2)
    words = sorted({"".join(rnd.choices("abcdehilmnorstu", k=rnd.randint(2, 7))) for _ in range(400)} | {"many", "modern", "clear", "world", "defence", "white"})
    trie = S.Trie((w, 10) for w in words)
    for w in ["rnany", "modem", "dear", "vvorld", "clefence", "wliite", *rnd.sample(words, 30), *("".join(rnd.choices("abcdehilmnorstu", k=5)) for _ in range(40))]:
        assert {v: round(c, 6) for v, c, _ in trie.near(w)} == brute(w, words)


@pytest.mark.parametrize(
    "token, wanted",
    [("12.Nf3", "move"), ("0-0-0!", "move"), ("1-0", "move"), ("½-½", "move"), ("1936.", "move"), ("word,", "word"), ("pawn-chain", "word"), ("£f4", "bad"), ("11,Qh5", "bad"), ("bA", "bad"), ("Лc?", "bad"), ("(2", "bad"), ("op€ning", "odd"), ("—", "sign"), ("g:f3+", "move"), ("9xf7", "bad"), ("♔:е5", "bad")],
)
def test_shapes(token, wanted):
    assert S.shape(token) == wanted


def test_heads():
    for line in ["Opening Paths", "OPENlNG PATHS", "12   JASKURK", "Chapter 3. Opening Paths", "J A S K Ü R K     1 2", "Opening Paths | 33"]:
        assert S.is_head(line, NAMES), line
    for line in ["The opening was fine", "Game 33", "1-0", "Jaskürk played well in the opening", ""]:
        assert not S.is_head(line, NAMES), line
    assert S.furniture(["[4]", "p. 304", "- 12 -", "1 2", "l0", "1936"], [], None)[:5] == ["page_number"] * 5
    assert S.furniture(["1936"], [], 12) == ["body"]


def found(spark, *words, firm=100_000):
    df = spark.createDataFrame([*words, ("the", firm)], "word string, n bigint")
    return sorted((r["word"], r["right"]) for r in S.misreadings(df).collect())


def test_unlisted_edits_by_ratio(spark):
    for times in (1, 3, 30):  # a larger corpus of the same kind
        assert found(spark, ("combinatixn", times), ("combination", 130 * times), firm=100_000 * times) == [("combinatixn", "combination")]
    assert found(spark, ("combinatixn", 4), ("combination", 130)) == []


def test_words_of_all_lengths_are_looked_up(spark):
    assert found(spark, ("rnornenturn", 1), ("momentum", 400)) == [("rnornenturn", "momentum")]  # three letters longer
    assert found(spark, ("bumtumed", 1), ("burnturned", 400)) == [("bumtumed", "burnturned")]  # two letters shorter
    assert found(spark, ("0f", 1), ("of", 400)) == [("0f", "of")]
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    assert found(spark, (long.replace("gesell", "gcsell"), 1), (long, 400)) == [(long.replace("gesell", "gcsell"), long)]


def test_routes_miss_nothing(spark):
    """The routed search against the automaton over the whole vocabulary, for every word of a random corpus."""
    import random

    rnd = random.Random(5)
    entries = sorted({"".join(rnd.choices("abcdehilmnrtu", k=rnd.randint(1, 9))) for _ in range(500)} | {"many", "momentum", "burnturned", "clear", "mmm", "uu", "b"})
    asked = [w.replace("m", "rn", 2).replace("u", "ii", 1).replace("d", "cl") for w in entries] + [w[:-1] + "x" for w in entries] + [w[1:] for w in entries if len(w) > 1]
    trie = S.Trie((w, 50) for w in entries)
    for w in asked:
        mine, ways = {v for v, _, _ in trie.near(w)}, set(S.routes(w))
        assert all(ways & set(S.entry_routes(v)) for v in mine), w
    words = {w: 1 for w in asked if w} | {w: 50 for w in entries}
    want = {(w, v) for w, n in words.items() for v, cost, k in trie.near(w, S.bound_of(w)) if len(v) >= 2 and S.explains(w, n, v, cost, k)}
    got = {(r["word"], r["right"]) for r in S.candidates(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    assert got == want and want


def test_corpus_size_does_not_matter(spark, monkeypatch):
    for scale in (1, 1000):
        assert found(spark, ("positiou", scale), ("position", 400 * scale), firm=600 * scale) == [("positiou", "position")]
    monkeypatch.setattr(S, "SHARD_WORDS", 1)  # every asked route is cut into parts
    assert found(spark, ("positiou", 1), ("posilion", 1), ("position", 400)) == [("posilion", "position"), ("positiou", "position")]


def test_context_ranks(spark):
    """rnoon: moon and room print alike; the neighbour decides, and frequency where none is known."""
    rows = [("n", i, "the full moon rose. ", [], None) for i in range(30)] + [("n", 100 + i, "a large noon table. ", [], None) for i in range(40)]
    rows += [("n", 200, "the full uoon rose. ", [], None), ("n", 201, "a large uoon table. ", [], None), ("n", 202, "some uoon somewhere", [], None)]
    assert {v for v, _, _ in S.Trie([("moon", 30), ("noon", 40)]).near("uoon", S.CHEAP)} == {"noon"}
    monkey = [*S.CONFUSIONS]
    text = {r["rec_id"]: r["text"] for r in S.repair(spark.createDataFrame(rows, S.TEXTS)).collect()}
    assert text[201].startswith("a large noon") and S.CONFUSIONS == monkey
    found_ = spark.createDataFrame([("uoon", "noon", 0.3, 40, 3), ("uoon", "moon", 0.3, 30, 3)], "word string, right string, cost double, k bigint, n bigint")
    told = {(r["word"], r["near"]): r["right"] for r in S.in_context(spark.createDataFrame(rows, S.TEXTS), found_).collect()}
    assert told == {("uoon", "full"): "moon", ("uoon", "rose"): "moon", ("uoon", "large"): "noon", ("uoon", "table"): "noon"}
    bad, beside = {"uoon": "noon"}, told
    assert S.repaired("the full uoon rose.", [], None, bad, set(), beside) == "the full moon rose."
    assert S.repaired("some uoon somewhere", [], None, bad, set(), beside) == "some noon somewhere"
