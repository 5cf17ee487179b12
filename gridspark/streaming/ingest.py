"""Workbooks as a stream of files. A file is decoded whole, so there is no state to keep."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..operators import relations

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def workbook_stream(spark: SparkSession, folder: str, glob: str = "*.[xX][lL][sS][xXmMbB]", most_files: int = 100) -> DataFrame:
    """New workbooks below a folder, at most so many per trigger."""
    return (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", most_files).load(folder)
    )


def stream_relation(stream: DataFrame, relation: str, target: str, checkpoint: str, available_now: bool = True):
    """Append a relation ('cells', 'formulas', ...) of every new workbook to a parquet folder, exactly once.

    A batch writes its own sub-folder, so a batch that runs again replaces what it wrote. Batches are
    numbered by the checkpoint folder, so every checkpoint has a sub-folder of its own: another stream
    on the same target adds to it.
    """
    stream_id = hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    of = getattr(relations, relation)

    def write(batch: DataFrame, number: int) -> None:
        of(batch.select("path", "content")).write.mode("overwrite").parquet(f"{target}/stream={stream_id}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
