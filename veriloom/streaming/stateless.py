"""Scoring and cleaning of streaming frames.

Every step here is a row-wise function of the library, so a stream needs no
state, watermark or special operator: the batch functions are applied as is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Step = Callable[[DataFrame], DataFrame]


def read_table_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def apply_steps(stream: DataFrame, steps: list[Step]) -> DataFrame:
    return reduce(lambda df, step: step(df), steps, stream)


def write_available(stream: DataFrame, path: str, checkpoint: str):
    """Process what is there, append it to parquet and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
