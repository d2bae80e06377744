"""Keeping index tables in step with a growing mutation log, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import corpus


def postings_delta(batch: DataFrame, memory: str = "memory_id") -> DataFrame:
    """(memory_id, seq, op, term, tf) of a batch of log records; a delete is one row without a term."""
    log = batch.where(F.col(memory).isNotNull()).dropDuplicates(["seq", memory])
    terms = corpus.postings(log.where("op <> 'delete'").withColumn("key", F.struct(memory, "seq")), "key").select(F.col(f"id.{memory}").alias(memory), F.col("id.seq").alias("seq"), "term", "tf")
    marks = log.select(memory, "seq", "op")
    return marks.join(terms, [memory, "seq"], "left")


def follow(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str):
    """Start a query that appends the postings of every new log file under `source` to the table `index`; each batch once."""

    def write(batch: DataFrame, number: int) -> None:
        postings_delta(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(index)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_postings(index: DataFrame, memory: str = "memory_id") -> DataFrame:
    """(memory_id, term, tf) of each memory's last record if the memory is alive, that is, inserted after its last delete.

    Records that came again in a later batch count once. What a memory's records come to is one row, so a memory with
    very many of them is no window.
    """
    at = lambda op: F.max(F.when(F.col("op") == op, F.col("seq")))
    last = index.groupBy(F.col(memory).alias("_m")).agg(F.max("seq").alias("_top"), at("insert").alias("_in"), at("delete").alias("_out"))
    last = last.where(F.col("_in") > F.coalesce("_out", F.lit(-1)))
    rows = index.where("op <> 'delete' and term is not null").join(last, (F.col(memory) == F.col("_m")) & (F.col("seq") == F.col("_top")))
    return rows.select(memory, "seq", "term", "tf").dropDuplicates([memory, "seq", "term"]).drop("seq")


__all__ = ["postings_delta", "follow", "current_postings"]
