"""Retrieval and classification metrics over ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import stage


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """`results` (qid, id, rank) of queries that have judgments, with `rel` (0/1) and `relevant`, the query's relevant ids."""
    q = qrels.select("qid", "id").distinct()
    n = q.groupBy("qid").agg(F.count("*").alias("relevant"))
    return results.join(n, "qid").join(q.withColumn("rel", F.lit(1)), ["qid", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def metrics(results: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """`metrics_of` the results (qid, id, rank) that have judgments (qid, id)."""
    return metrics_of(judged(results, qrels), k)


def metrics_of(j: DataFrame, k: int = 10) -> DataFrame:
    """One row (queries, recall, precision, mrr, map, ndcg) of (qid, rank, rel, relevant), means over queries with judgments and results.

    Precision divides by the results there are, up to k; reciprocal rank and average precision have no cutoff.
    """
    j = j.withColumn("so_far", F.sum("rel").over(Window.partitionBy("qid").orderBy("rank")))
    hit = F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))
    gain = F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + F.lit(1.0))), F.lit(0.0), lambda s, x: s + x)
    per = j.groupBy("qid", "relevant").agg(
        hit.alias("hit"), F.count("*").alias("n"), F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"), gain.alias("gain"),
    )
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias(name)
    return per.agg(
        F.count("*").alias("queries"), mean(F.col("hit") / F.col("relevant"), "recall"), mean(F.col("hit") / F.least(F.col("n"), F.lit(k)), "precision"),
        mean(F.col("rr"), "mrr"), mean(F.col("ap") / F.col("relevant"), "map"), mean(F.col("gain") / ideal, "ndcg"),
    )


def predictions(best: DataFrame) -> DataFrame:
    """(qid, predicted, best): the class of the highest score, ties to the lowest label."""
    top = best.groupBy("qid").agg(F.max(F.struct(F.round("best", 9).alias("b"), (-F.col("label")).alias("l"))).alias("t"))
    return top.select("qid", (-F.col("t.l")).alias("predicted"), F.col("t.b").alias("best"))


def _below(counts: DataFrame, value: str, n: str) -> DataFrame:
    """`counts` (one row per value) with `below`, the sum of `n` over all smaller values.

    Values are put in ranges, one a partition, summed up in each and shifted by the ranges before, of which there are
    as many as partitions.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(counts.repartitionByRange(parts, value).withColumn("_part", F.spark_partition_id()), "ranged")
    up_to = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_part").agg(F.sum(n).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(up_to(F.lit(0)).orderBy("_part")), F.lit(0))).drop("_n")
    inner = F.coalesce(F.sum(n).over(up_to("_part").orderBy(value)), F.lit(0))
    return ranged.withColumn("_in", inner).join(F.broadcast(before), "_part").withColumn("below", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def auroc_of_counts(counts: DataFrame) -> DataFrame:
    """One row (auroc) of (score, same, other), a row per score: the rank-sum statistic, ties half, 0.5 if a side is empty."""
    won = _below(counts, "score", "other").withColumn("w", F.col("same") * (F.col("below") + F.col("other") / 2))
    won = won.agg(F.sum("w").alias("w"), F.coalesce(F.sum("same"), F.lit(0)).alias("p"), F.coalesce(F.sum("other"), F.lit(0)).alias("n"))
    return won.select(F.round(F.when((F.col("p") == 0) | (F.col("n") == 0), 0.5).otherwise(F.col("w") / (F.col("p") * F.col("n"))), 9).alias("auroc"))


def auroc(scores: DataFrame) -> DataFrame:
    """One row (auroc) of (score, positive 0/1). Works on counts per score."""
    return auroc_of_counts(scores.groupBy("score").agg(F.sum("positive").alias("same"), F.sum(1 - F.col("positive")).alias("other")))


def low_percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    """One row (value): the sorted value at index int((n-1)p), found by counts per value instead of a collected list; null of no values."""
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    upto = _below(c, value, "n")
    total = c.agg(F.floor((F.sum("n") - 1) * F.lit(p)).alias("at"))
    return upto.join(F.broadcast(total)).where(F.col("below") + F.col("n") > F.col("at")).agg(F.min(value).alias("value"))


def stratified(df: DataFrame, label: str, ident: str, n: int) -> DataFrame:
    """The `n` rows of each label that come first by a hash of the id."""
    return df.withColumn("pick", F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.col(ident).cast("string"))))).where(F.col("pick") <= n)


def code_bytes(segments: Column) -> Column:
    """Stored bytes of a fingerprint by its non-empty 64-bit segments: listed, masked, or whole."""
    return F.when(segments <= 20, 1 + 9 * segments).when(segments <= 157, 21 + 8 * segments).otherwise(1280)


MASKED = -1e9  # fixed value: score of a class that is not active


def masked(scores: DataFrame, active: list[int]) -> DataFrame:
    """(qid, label, score) of (qid, label, best) with the classes that are not `active` masked."""
    return scores.select("qid", "label", F.when(F.col("label").isin(active), F.col("best")).otherwise(F.lit(MASKED)).alias("score"))


def dense_scores(scores: DataFrame, most: DataFrame) -> DataFrame:
    """(qid, scores): an array with a place for every class from 0 to `most` (one row), -1 where (qid, label, best) has none."""
    m = scores.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("int"), "best"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.col("most").cast("int")), lambda i: F.coalesce(F.col("m")[i], F.lit(-1.0)))
    return m.join(F.broadcast(most)).select("qid", at.alias("scores"))


def with_keys(results: DataFrame, keys: DataFrame) -> DataFrame:
    """`results` with the documents' external keys (id, doc_key), empty where there is none."""
    return results.join(keys.select("id", "doc_key"), "id", "left").withColumn("doc_key", F.coalesce("doc_key", F.lit("")))
