"""The live form of a remote scan and of edits by hand, as Structured Streaming queries. There is no event time and no state to expire."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import messages

#: Fixed value: milliseconds between reports that are shown.
INTERVAL = 80


def message_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Messages of text files as they arrive in a folder."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return messages.messages(reader.text(folder).withColumnRenamed("value", "line"))


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Give micro-batches to a writer, which must be idempotent by batch number: a batch can come again after a failure."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def throttled(reports: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """Of a job's reports (job, no, stage, ms, done, total) those that are shown: the first of a stage, the last of it, and others only
    `interval` milliseconds after the last one that was shown. Each job's reports are read in their order (ms, no), one at a time."""
    names = ["job", "no", "stage", "ms", "done", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, stage, last = None, None, 0
        for batch in batches:
            keep = []
            for j, _, s, ms, done, total in zip(*(c.to_pylist() for c in batch.columns)):
                fresh = j != job or s != stage or done >= total or ms - last >= interval
                if fresh:
                    job, stage, last = j, s, ms
                keep.append(fresh)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = reports.select(*names)
    return rows.repartition("job").sortWithinPartitions("job", "ms", "no").mapInArrow(run, rows.schema)
