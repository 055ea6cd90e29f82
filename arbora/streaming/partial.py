"""Validation of a folder that predictions still arrive in: a file stream of tiles, each new batch matched against all that is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.workflows import validate
from ..sources import readers


def validate_as_they_come(spark: SparkSession, folder: str, trees: DataFrame, width: int, height: int, checkpoint: str, then: Callable[[DataFrame, DataFrame, int], None]) -> StreamingQuery:
    """Start a query that calls then(table, summary, batch) whenever tile files have come; a batch that is run again gives the same."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "tile_x*_y*.npz").load(folder)

    def batch(new: DataFrame, number: int) -> None:
        if not new.select("path").isEmpty():
            runs, extents = readers.tile_masks(spark, folder, width, height)
            then(*validate(spark, trees, runs, extents, width, height), number)

    return files.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
