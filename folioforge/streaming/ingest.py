"""Continuous ingestion: files as they arrive are converted, measured and charged to a shared page budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioforge.operators import convert
from folioforge.session import prepare


def read_stream(spark: SparkSession, path: str, pattern: str | None = None, files_a_batch: int = 1000) -> DataFrame:
    """(doc_id, path, modificationTime, length, content) of the files that arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = prepare(spark).readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).withColumn("doc_id", F.col("path"))


def write_converted(stream: DataFrame, out: str, checkpoint: str, opts: convert.Options | None = None, available_now: bool = True) -> StreamingQuery:
    """Converts each micro-batch and appends its rows as Parquet; a batch that runs again overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        convert.convert(batch, opts).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingestion_counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes by window of their modification time; later than `late` is dropped by the watermark."""
    w = stream.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window))
    return w.agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "files", "bytes")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events (user_id, ts): count by session window."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


BILLED = "run_id string, doc_id string, ord long, asked int, billed int, spent long"


def budgeted(requests: DataFrame, per_run: int) -> DataFrame:
    """Rows (run_id, doc_id, ord, asked) with billed: pages within the run's budget, which is kept as state over micro-batches.

    In a micro-batch documents are billed in the order of ord, then doc_id.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ord", "doc_id"], kind="stable")
        billed, sums = [], []
        for asked in rows["asked"]:
            take = int(asked) if per_run <= 0 else max(0, min(int(asked), per_run - spent))
            spent += take
            billed.append(take)
            sums.append(spent)
        state.update((spent,))
        yield rows.assign(run_id=key[0], billed=billed, spent=sums)[["run_id", "doc_id", "ord", "asked", "billed", "spent"]]

    return requests.groupBy("run_id").applyInPandasWithState(run, BILLED, "spent long", "append", GroupStateTimeout.NoTimeout)
