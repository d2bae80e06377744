"""Corpus statistics: postings, term and collection counts, inverse document frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens


_BLOCK = 100_000  # documents numbered or counted by one task


def postings(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, term, tf)."""
    t = docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col("text"))).alias("term"))
    return t.groupBy("id", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.size(tokens(F.col("text"))).alias("len"))


def term_stats(post: DataFrame) -> DataFrame:
    """(term, cf, df)."""
    return post.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def ordinals(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents with their 1-based place in insertion order, summed up over blocks of ids."""
    d = docs.withColumn("_block", F.floor(F.col(id_col) / _BLOCK))
    base = d.groupBy("_block").agg(F.count("*").alias("_n"))
    base = base.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(id_col))
    return d.withColumn("_in", place).join(base, "_block").withColumn("ordinal", F.col("_in") + F.col("_base")).drop("_block", "_in", "_base")


def _running_counts(docs: DataFrame, id_col: str) -> DataFrame:
    """Of documents by `text`, or by their distinct `terms`: (term, at, base), lists of the ordinals of the documents with the term, of one block of documents each, and the term's count before it."""
    terms = docs if "terms" in docs.columns else docs.select(id_col, F.array_distinct(tokens(F.col("text"))).alias("terms"))
    each = terms.select(id_col, "terms").join(ordinals(docs.select(id_col), id_col), id_col).select("ordinal", F.explode("terms").alias("term"))
    lists = each.groupBy("term", F.floor(F.col("ordinal") / _BLOCK).alias("block")).agg(F.sort_array(F.collect_list("ordinal")).alias("at"))
    before = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return lists.withColumn("base", F.coalesce(F.sum(F.size("at").cast("long")).over(before), F.lit(0)))


def sequential_idf(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, df, last_ordinal, idf, top_idf) as insertion one by one leaves them: idf = ln(ordinal of the last insert with the term / df).

    `top_idf` is the highest value the term's idf ever had, so its maximum is the corpus's running maximum. Ids are unique. `docs` has
    a `text`, or in its place the distinct `terms`.
    """
    top = F.array_max(F.transform("at", lambda x, i: F.log(x / (F.col("base") + i + 1))))
    lists = _running_counts(docs, id_col).select("term", F.size("at").cast("long").alias("n"), F.element_at("at", -1).alias("last"), top.alias("top"))
    return lists.groupBy("term").agg(F.sum("n").alias("df"), F.max("last").alias("last_ordinal"), F.log(F.max("last") / F.sum("n")).alias("idf"), F.max("top").alias("top_idf"))


def running_idf(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(id, term, idf) and (id, top): a document's terms' idf, and the corpus's running maximum, as they are just after its insertion."""
    each = _running_counts(docs, id_col).select("term", "base", F.posexplode("at").alias("i", "ordinal"))
    each = each.select("term", "ordinal", F.log(F.col("ordinal") / (F.col("base") + F.col("i") + 1)).alias("idf"))
    ids = ordinals(docs.select(id_col), id_col).withColumnRenamed(id_col, "id")
    own = each.groupBy("ordinal").agg(F.max("idf").alias("own")).withColumn("block", F.floor(F.col("ordinal") / _BLOCK))
    up_to = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    blocks = own.groupBy("block").agg(F.max("own").alias("most"))
    blocks = blocks.select((F.col("block") + 1).alias("block"), F.max("most").over(up_to(F.lit(0)).orderBy("block")).alias("before"))  # one row per block
    tops = own.join(blocks, "block", "left").select("ordinal", F.greatest(F.max("own").over(up_to("block").orderBy("ordinal")), "before").alias("top"))
    return each.join(ids, "ordinal").select("id", "term", "idf"), tops.join(ids, "ordinal").select("id", "top")


def batch_idf(stats: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) with idf = ln(documents / df), as a reloaded index has it."""
    return stats.select("term", "df", F.log(F.lit(float(n_docs)) / F.col("df")).alias("idf"))


def scaled_probes(idf: Column, max_idf: Column, base: int) -> Column:
    """Probes of a feature: base while nothing is known, else in proportion to the square of its relative idf, at least 1."""
    r = F.coalesce(idf, F.lit(0.0)) / max_idf
    return F.when(max_idf <= 0, F.lit(base)).otherwise(F.greatest(F.lit(1.0), base * (r * r)).cast("int"))
