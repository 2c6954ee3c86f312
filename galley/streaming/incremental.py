"""Pages and events as streams: every new file is worked on once, late rows within a watermark still count."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir


def pages(spark: SparkSession, folder: str, schema: str = "book_id string, page int, text string, added_at timestamp", files: int = 100) -> DataFrame:
    """New parquet files of pages as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once_per_row(stream: DataFrame, keys: list[str], time: str, late: str = "30 days") -> DataFrame:
    """Rows sent again within ``late`` are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows per window and key; late rows count until the watermark passes."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(stream: DataFrame, time: str, key: str, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, idle).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def gapless(stream: DataFrame, key: str, number: str) -> DataFrame:
    """(key, number, expected): numbers that do not follow the last one of their key; the last number is kept as state."""

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for pdf in rows:
            for n in sorted(pdf[number].dropna().astype(int)):
                if last is not None and n != last + 1:
                    out.append((k[0], n, last + 1))
                last = n
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, number, "expected"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{number}` bigint, expected bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, work: Callable[[DataFrame, int], None], name: str) -> StreamingQuery:
    """Work on everything new and stop; progress is kept in the shared folder, so no file is worked on twice."""
    at = f"{shared_dir(stream.sparkSession)}/galley-streams/{name}"
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", at).trigger(availableNow=True).start()


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Everything an aggregated stream has to say about the files there are: it is worked off and its whole result written
    into the shared folder.  Progress of this call is its own, so it can be called again."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/galley-streams/{name}-{uuid.uuid4().hex}"
    save = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/out")
    stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
