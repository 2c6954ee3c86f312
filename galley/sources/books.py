"""Book folders, page text, template profiles, manifests; the interface for page readers that need outside tools."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, path: str, pattern: str = "*.{pdf,djvu,djv}") -> DataFrame:
    """(path, kind, sha256, size) of all books below a folder, in order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("kind"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")).orderBy("path")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, ...) of the cases of a JSON manifest; ids must be words and unique."""
    cases = spark.read.option("multiLine", "true").json(path).select(F.explode("cases").alias("c")).select("c.*")
    bad = cases.groupBy("id").agg(F.count("*").alias("n")).where(F.col("id").isNull() | ~F.col("id").rlike(r"^[\w.-]+$") | (F.col("n") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"case id {bad[0]['id']!r} is no word or not unique")
    return cases


def profile(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Templates of a JSON profile; another schema version is an error."""
    doc = spark.read.option("multiLine", "true").json(path)
    found = doc.select("schema_version").first()
    if found is None or found[0] != version:
        raise ValueError(f"{path} is of version {found and found[0]}, not {version}")
    return doc.select(F.explode("templates").alias("t")).select("t.*")


def union(base: DataFrame, supplement: DataFrame, name: str) -> DataFrame:
    """A profile with a supplement under a name of its own."""
    return base.withColumn("profile", F.lit(name)).unionByName(supplement.withColumn("profile", F.lit(name)), allowMissingColumns=True)


def tool(name: str) -> str:
    """The path of an outside program; FileNotFoundError tells which is missing."""
    found = shutil.which(name)
    if not found:
        raise FileNotFoundError(f"{name} is not installed")
    return found


def run(name: str, *args: str) -> str:
    """Output of an outside program; its complaint becomes the error's text."""
    done = subprocess.run([tool(name), *args], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"{name}: {done.stderr.strip()[:500]}")
    return done.stdout


def read_pages(books: DataFrame, reader: Callable[[str, int], str | None], dpi: int = 300) -> DataFrame:
    """(book_id, page, text, ocr, error) by any page reader ``reader(path, page)``, one page at a time on the executors;
    a page that fails is a row with its error, not the end of the book.  Rows: (book_id, path, page)."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    rows.append((r.book_id, r.page, reader(r.path, int(r.page)), True, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((r.book_id, r.page, None, True, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["book_id", "page", "text", "ocr", "error"])

    return books.select("book_id", "path", "page").mapInPandas(go, "book_id string, page int, text string, ocr boolean, error string")


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages (book_id, page, fingerprint) that no valid cache row has."""
    return wanted.join(cache.where("text is not null").select("book_id", "page", "fingerprint"), ["book_id", "page", "fingerprint"], "left_anti")


def cache_key(df: DataFrame, parts: list[str]) -> DataFrame:
    """``fingerprint`` of all that a page's reading depends on."""
    return df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*parts)), 256))
