"""A stored index of fingerprint bands: a row (id, band, hash) for every band with bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import EngineConfig
from palimpsest.functions.hashing import band_hashes

SCHEMA = "id long, band int, hash long"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def index(prints: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """The index of fingerprints (id, bits). Bands without bits are no rows; null and empty fingerprints have none."""
    bands, rows = F.lit(cfg.lsh_bands), F.lit(cfg.lsh_rows)
    h = prints.where(F.size("bits") > 0).select(F.col("id").cast("long").alias("id"), band_hashes("bits", bands, rows).alias("h"), band_hashes(F.array().cast("array<int>"), bands, rows).alias("void"))
    on = F.filter(F.transform("h", lambda x, i: F.struct(i.alias("band"), x.alias("hash"), (x != F.col("void")[i]).alias("on"))), lambda s: s.on)
    return h.select("id", F.explode(on).alias("b")).select("id", "b.band", "b.hash")


def inserted(stored: DataFrame, prints: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """The index with fingerprints put in; those of the same id give way."""
    return removed(stored, prints.select("id")).unionByName(index(prints, cfg))


def removed(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the rows of `ids`; unknown ones change nothing."""
    return stored.join(ids.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")


def candidates(stored: DataFrame, queries: DataFrame, least: int = 2, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(qid, id, hits) of the ids that agree with a query (qid, bits) in at least `least` bands that have bits."""
    asked = index(queries.withColumnRenamed("qid", "id"), cfg).withColumnRenamed("id", "qid")
    return asked.join(stored, ["band", "hash"]).groupBy("qid", "id").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
