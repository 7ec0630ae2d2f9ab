"""The same plan over streams: scoring keeps no state, so it is the batch plan; replays and counts do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prosemill.operators.integrity import input_sha256
from prosemill.plans.pipeline import score_documents
from prosemill.policy import Policy


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, ts timestamp", files_per_trigger: int = 8) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def without_replays(stream: DataFrame, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first of documents with equal text within the delay; the state is bounded by the watermark."""
    keyed = stream.withColumn("input_sha256", input_sha256(F.col("text"))).withWatermark(ts, delay)
    return keyed.dropDuplicatesWithinWatermark(["input_sha256"])


def score_stream(stream: DataFrame, policy: Policy = Policy(), declared: str | None = None) -> DataFrame:
    """Every document scored as it arrives. A lexicon would be a static table joined on words; without it no state is held."""
    return score_documents(stream, policy, declared=declared)


def status_counts(scored: DataFrame, width: str = "10 minutes", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Documents by window of arrival and status; late ones within the delay count."""
    return scored.withWatermark(ts, delay).groupBy(F.window(ts, width), F.col("gate.status").alias("status")).agg(F.count("*").alias("n"))


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """To Parquet, each row once, until all that has arrived is done."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
