"""New photos as a stream: what arrives is read once and appended to the prediction table.

Reading keeps no state between photos, so the file source's own checkpoint is all
there is. A batch that is run again replaces its own run; what it already saved
in a run that broke off later is known and not read twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.sources import results

FILES = "path string, modificationTime timestamp, length long, content binary"


def photo_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """(image, path, content) of photos as they appear in folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(folder)
    named = files.withColumn("image", F.element_at(F.split("path", "/"), -1))
    return named.where(results.is_photo(F.col("image"))).select("image", "path", "content")


def read_stream(photos: DataFrame, reader: Callable[[DataFrame], DataFrame], table: str, backend: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start reading into the prediction table that batch runs use: each batch reads the photos the table lacks and is a run of its own.

    once: what is there now, then stop.
    """
    name = hashlib.blake2b(checkpoint.encode(), digest_size=8).hexdigest()

    def write(batch: DataFrame, number: int) -> None:
        known = results.predictions(batch.sparkSession, table, backend)
        todo = batch if known is None else results.unread(batch, known, backend)
        results.save_run(reader(todo), table, backend, f"stream-{name}-{number}")

    writer = photos.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
