"""Scoring documents as they arrive, with weights fitted on a batch: stateless per document, windowed over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.functions.text import tokens


def linear_scores(docs: DataFrame, weights: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and score: the sum of weights(feature, weight) over a document's tokens; 0 without any."""
    rows = docs.select("doc_id", F.explode_outer(tokens(F.col(text))).alias("feature")).join(weights, "feature", "left")
    return rows.groupBy("doc_id").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("score"))


def score_stream(stream: DataFrame, weights: DataFrame, path: str, checkpoint: str, text: str = "text", once: bool = False) -> StreamingQuery:
    """Scores every micro-batch of documents and appends it to path. A document is whole within its batch, so no state is
    kept; a batch that is run again after a failure overwrites its own folder, so each document counts once."""

    def write(batch: DataFrame, number: int) -> None:
        linear_scores(batch, weights, text).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a window and key; windows close `late` after the newest event, later rows are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), key).agg(F.count("*").alias("n"))


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet folder, or the files of a pattern, as a stream."""
    return spark.readStream.schema(schema).parquet(path)
