"""Documents that arrive over time: each micro-batch of lines is inventoried as a whole, once.

A document's lines must arrive in one file, as a document is the unit of every operator; a batch's rows are written
under its number by overwriting, so a batch that runs again leaves no double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridquarry.plans.modes import list_mode
from gridquarry.sources import schemas


def inventory_stream(spark: SparkSession, source: str, target: str, checkpoint: str, keywords=(), files_per_batch: int = 1000) -> StreamingQuery:
    """Starts the list mode over Parquet files of lines that arrive in source; ends when all that is there is done."""
    lines = spark.readStream.schema(schemas.LINES).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        list_mode(batch, keywords).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inventory(spark: SparkSession, target: str) -> DataFrame:
    """All rows that the stream has written."""
    return spark.read.parquet(target).drop("batch")
