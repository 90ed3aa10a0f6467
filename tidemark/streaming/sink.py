"""Appending a stream to a dataset: one snapshot a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.dataset import Dataset


def append_stream(stream: DataFrame, dataset: Dataset, author: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that appends each micro-batch. A batch that was committed
    before a restart is recognised and not appended again: by the mark that the dataset
    keeps of the last batch, and by the messages of the commits after that one."""

    def write(batch: DataFrame, number: int) -> None:
        mark = f"stream {checkpoint} batch {number}"
        marks = dataset.refresh().doc.get("streams", {})
        done, since = marks.get(checkpoint, (-1, 0))
        if number <= done or batch.isEmpty():
            return
        later = range(since + 1, dataset.next_sequence_number())
        at = next((i for i in later if dataset._load(i).commit_message == mark), None)
        if at is None:
            at = dataset.append(batch, author, mark).sequence_number
        dataset.doc = dataset.catalog._patch_dataset(dataset.identifier, {"streams": {**marks, checkpoint: [number, at]}})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
