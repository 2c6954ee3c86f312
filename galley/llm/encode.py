"""Token ids and token counts of whole corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import tokens

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters encoded at a time in a Python worker; a batch of long texts is worked off in such parts.
PART_CHARS = 4_000_000
_tables: dict[tuple[str, str], object] = {}


def merges(spark: SparkSession, path: str = TOKENIZER):
    """The vocabulary as a broadcast; its size is that of the vocabulary file (about 50,000 entries)."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _tables:
        with open(path, "rb") as f:
            _tables[key] = spark.sparkContext.broadcast(tokens.load_merges(f.read()))
    return _tables[key]


def parts(texts: list[str | None], most: int = PART_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive runs of texts of at most ``most`` characters (a longer text is a run of its own)."""
    first, chars = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and chars + n > most:
            yield first, i
            first, chars = i, 0
        chars += n
    if first < len(texts):
        yield first, len(texts)


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id, ids): the ids of every text, without special tokens, by greedy proposal, pair test and exact merging
    of the failing words (see ``tokens``).  NULL and empty texts get an empty list; repeated rows stay repeated;
    other columns are not read.  One pass, no shuffle."""
    spark = df.sparkSession
    ship(spark)
    tables = merges(spark, path)
    key = hash(path)
    pairs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        e = tokens.encoder(key, tables)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in parts(texts):
                flat, offsets = e.encode(texts[i:j])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), ids], ["id", "ids"])

    out = pairs.mapInArrow(run, f"id {dict(pairs.dtypes)['id']}, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of every text; 0 for NULL and empty ones.  The ids are not materialised."""
    spark = df.sparkSession
    ship(spark)
    tables = merges(spark, path)
    key = hash(path)
    pairs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        e = tokens.encoder(key, tables)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in parts(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(e.sizes(texts[i:j]), pa.int64())], ["id", "n_tokens"])

    return pairs.mapInArrow(run, f"id {dict(pairs.dtypes)['id']}, n_tokens bigint").select(F.col("id").alias(id_col), "n_tokens")
