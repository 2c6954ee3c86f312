"""Which book of ``books`` a log means, and who wrote it, as column expressions and joins."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Author fields that name no person.
PLACEHOLDERS = ("various", "various authors", "unknown", "author unknown", "anonymous", "anon", "none", "null", "nan", "na", "nn", "no author", "not known", "tba", "tbd", "editor", "editors", "et al", "diverse", "unbekannt", "verschiedene", "anonym", "autor unbekannt", "varios", "varios autores", "desconocido", "anonimo", "неизвестен", "неизвестный", "автор неизвестен", "разные", "разные авторы", "аноним", "коллектив авторов")


def _folding() -> tuple[str, str]:
    """Accented Latin and Cyrillic small letters and their bases."""
    src, dst = [], []
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(i))[0]
        if base != chr(i) and base.isalpha():
            src.append(chr(i))
            dst.append(base)
    return "".join(src), "".join(dst)


_FROM, _TO = _folding()


def folded(c: Column) -> Column:
    """Lower case without accents and combining marks."""
    return F.regexp_replace(F.lower(F.translate(c, _FROM, _TO)), "[\\u0300-\\u036f]", "")


def book_key(c: Column) -> Column:
    """What stays of a book's name in a log: no folder, no extension, letters and digits only; NULL if empty."""
    name = F.regexp_replace(F.trim(c), r"^.*[/\\]", "")
    stem = F.regexp_replace(F.lower(name), r"\.(pdf|djvu|djv|epub|txt)$", "")
    key = F.regexp_replace(folded(stem), "[^a-z0-9а-яё]+", "")
    return F.when(key != "", key)


def persons(author: Column) -> Column:
    """array<struct<words, sure>> of the persons in an author field, folded: the words of the name without initials, sorted,
    and whether they are the surname alone: one word, or what stands before a comma.  NULL and placeholders give none."""
    each = F.split(folded(author), r"\s*(?:[;&/+]|\band\b|\bund\b)\s*")
    letters = lambda p: F.filter(F.split(F.regexp_replace(p, "[^a-zа-яё'-]+", " "), " +"), lambda w: F.length(F.regexp_replace(w, "['-]", "")) > 1)

    def person(p: Column) -> Column:
        head = letters(F.element_at(F.split(p, ","), 1))
        comma = p.contains(",") & (F.size(head) > 0)
        own = F.when(comma, head).otherwise(letters(p))
        return F.struct(own.alias("words"), (comma | (F.size(own) == 1)).alias("sure"))

    named = F.filter(F.transform(each, person), lambda x: (F.size(x["words"]) > 0) & ~F.array_join(F.array_sort(x["words"]), " ").isin(*PLACEHOLDERS) & ~F.array_join(x["words"], " ").isin(*PLACEHOLDERS))
    return F.coalesce(F.array_distinct(named), named, F.array().cast("array<struct<words: array<string>, sure: boolean>>"))


def surnames(books: DataFrame) -> DataFrame:
    """(book_id, surname) of all persons of ``books``; order, case, accents, initials and given names do not matter.  A name
    of several words without a comma is a surname if the whole is known as one elsewhere, else the one word of it that is;
    failing that, the last word."""
    each = books.select("book_id", F.explode(persons(F.col("author"))).alias("p")).select("book_id", "p.words", "p.sure")
    whole = F.array_join(F.array_sort("words"), " ")
    sure = each.where("sure").select("book_id", whole.alias("surname"))
    known = sure.select(F.col("surname").alias("part")).distinct()
    unsure = each.where("not sure").select("words", whole.alias("whole")).distinct()
    parts = F.array_distinct(F.concat(F.array("whole"), "words"))
    told = unsure.select("whole", "words", F.explode(parts).alias("part")).join(known.withColumn("known", F.lit(True)), "part", "left")
    names = told.groupBy("words", "whole").agg(F.bool_or((F.col("part") == F.col("whole")) & F.col("known")).alias("all"), F.collect_set(F.when(F.col("known") & (F.col("part") != F.col("whole")), F.col("part"))).alias("of"))
    pick = F.when(F.coalesce("all", F.lit(False)), F.col("whole")).when(F.size("of") == 1, F.element_at("of", 1)).otherwise(F.element_at("words", -1))
    return sure.unionByName(each.where("not sure").join(names.select("words", pick.alias("surname")), "words").select("book_id", "surname")).distinct()


def _deletions(key: Column) -> Column:
    """The key and all keys with one character left out."""
    return F.array_distinct(F.concat(F.array(key), F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key))))))


def resolve(raw: DataFrame, books: DataFrame, column: str = "book") -> DataFrame:
    """(column, book_id) for each distinct name in ``raw`` that means one book: equal keys first, then keys one slip
    apart (a letter lost, added, changed or two swapped; digits must agree), if only one book is that near.
    NULL names and names near several books or none have no row.  Keys of ``books`` that two books share mean none."""
    names = raw.select(F.col(column).cast("string").alias("name")).where("name is not null").distinct().withColumn("key", book_key(F.col("name"))).where("key is not null")
    known = books.select("book_id", book_key(F.col("path")).alias("key")).where("key is not null").groupBy("key").agg(F.min("book_id").alias("book_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    direct = names.join(known, "key", "left")
    exact = direct.where("book_id is not null").select("name", "book_id")
    off = direct.where("book_id is null").select("key").distinct()
    left = off.select(F.col("key").alias("near"), F.explode(_deletions(F.col("key"))).alias("part"))
    right = known.select("book_id", F.col("key").alias("full"), F.explode(_deletions(F.col("key"))).alias("part"))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    distance = F.levenshtein("near", "full", 2)
    slip = (distance == 1) | (distance == 2) & (F.length("near") == F.length("full")) & (letters(F.col("near")) == letters(F.col("full")))
    close = left.join(right, "part").where(slip & (digits(F.col("near")) == digits(F.col("full")))).select("near", "book_id").distinct()
    one = close.groupBy("near").agg(F.min("book_id").alias("book_id"), F.count("*").alias("n")).where("n = 1").select(F.col("near").alias("key"), "book_id")
    fuzzy = direct.where("book_id is null").select("name", "key").join(one, "key").select("name", "book_id")
    return exact.unionByName(fuzzy).withColumnRenamed("name", column)
