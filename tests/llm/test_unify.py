import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley.llm import unify


@pytest.mark.parametrize(
    "given_, wanted",
    [
        ("♗ɡ4​", "♗g4"), ("ԁеbіlіԁɑԁ", "debilidad"), ("7.с8.", "7.c8."), ("крaсивая", "красивая"), ("２８．♘ｈ５", "28.♘h5"), ("активная\u2007контригра", "активная контригра"), ("Schwächung".replace("ä", "a\u0308"), "Schwächung"),
        ("♕︎d2", "♕d2"), ("𝐊𝐱𝐡𝟐", "Kxh2"), ("Фe4", "Фe4"), ("Лc1:f4", "Лc1:f4"), ("41.'Шa3:a8.", "41.'Шa3:a8."), ("ф;xb6", "ф;xb6"), ("контрнгра", "контрнгра"), ("op€ning", "op€ning"), ("12.Кg2", "12.Kg2"), ("", ""), (None, None), ("Лԁԁ~1", "Лdd~1"),
        ("Ozeán\xadico", "Ozeánico"), ("0‑0", "0-0"), ("два слова", "два слова"), ("Quοrοtt", "Quorott"), ("\u2060", ""),
    ],
)
def test_forms(given_, wanted):
    assert unify.consistent(given_) == wanted


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcxеасоКФЛg4♗.​ａ１\xada\u0308𝐚ԁ ", max_size=12))
def test_idempotent_and_checked(text):
    form = unify.consistent(text)
    assert unify.consistent(form) == form
    assert unicodedata.normalize("NFC", form) == form
    if unify.is_stable(text):
        assert form == text


def every():
    return [chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) not in ("Cn", "Cs", "Co")]


def test_quick_check_over_all_characters():
    """What the quick check passes is in normal form, alone and after any starter; what is normalized is in NFC and keeps
    no character that the form replaces."""
    import random
    import re

    rnd = random.Random(1)
    marks = [c for c in every() if unicodedata.combining(c)]
    for c in every():
        for text in (c, "e" + c, c + rnd.choice(marks), "か" + c, "\u1112" + c) if c in unify.UNSTABLE else (c,):
            if unify.is_stable(text):
                assert unicodedata.is_normalized("NFC", text) and unify.consistent(text) == text, ascii(text)
            form = unify.normalized(text)
            assert unicodedata.is_normalized("NFC", form) and unify.normalized(form) == form, ascii(text)
            assert not set(form) & (unify.INVISIBLE | unify.COMPATIBLE), ascii(text)
    safe = re.compile(f"[{unify.SAFE}]")
    assert not [c for c in every() if safe.match(c) and (c in unify.UNSTABLE or c in unify.NEVER or c in unify.DASHES)]


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=10))
def test_runs_equal_whole_normalization(text):
    """Splicing normalized runs gives what normalizing the whole text gives."""
    whole = "".join(unicodedata.normalize("NFKC", c) if c in unify.COMPATIBLE else c for c in text if c not in unify.INVISIBLE)
    assert unify.normalized(text) == unicodedata.normalize("NFC", whole)


@pytest.mark.parametrize(
    "given_, wanted",
    [("\u212b", "Å"), ("\u2126", "Ω"), ("\u212a", "K"), ("か\u3099", "が"), ("\u1112\u1161\u11ab", "한"), ("\uf900", "豈"), ("ｱ", "ア"), ("\ufefb", "لا"), ("½-½", "½-½"), ("№ 3…", "№ 3…"), ("①²", "①²"), ("ﬁn", "fin"), ("Ⅳ", "IV"), ("ᎪᏴ", "AB"), ("a\u0323\u0302", "ậ")],
)
def test_canonical_and_alike(given_, wanted):
    assert unify.consistent(given_) == wanted


def test_column(spark):
    values = ["♗ɡ4", "plain text", None, "", "крaсивая", "𝐊", "е8", "a" * 100_000 + "​"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string").withColumn("form", F.lit("clash"))
    got = {r["id"]: r["form"] for r in unify.with_form(df, "v").collect()}
    assert [got[i] for i in range(len(values))] == [unify.consistent(v) for v in values]
    # the JVM check passes nothing that needs a form
    assert df.where(~unify.needs_form(F.col("v"))).where(F.col("v").isin(*[v for v in values if v and unify.consistent(v) != v])).count() == 0
    assert unify.with_form(df.limit(0), "v").count() == 0
