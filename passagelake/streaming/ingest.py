"""Documents that keep arriving, added to a passage store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import PassageStore

ARRIVING = "source string, title string, text string"


def arriving(spark: SparkSession, path: str, schema: str = ARRIVING, files_per_batch: int = 1000) -> DataFrame:
    """A stream of documents from Parquet files put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(documents: DataFrame, store: PassageStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Add each batch of a stream to the store, and merge its parts when they have become many.  A batch that is run again adds nothing: ids go by content."""

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.add(batch)
            store.compact()

    writer = documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
