"""Joins, ranks and positions that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import stage

#: A key is hot with more than one row in HOT_SHARE; so there are fewer than HOT_SHARE hot keys, at any size of the input.
HOT_SHARE = 1000
#: Below so many rows a key is never worth special treatment.
HOT_ROWS = 200_000
#: A group up to this many rows is sorted by one task.
SORT_ROWS = 2_000_000


def hot_of(counts: DataFrame, n: str) -> tuple[DataFrame, int]:
    """Rows of `counts` (one per key) whose `n` makes them hot, and how many: fewer than HOT_SHARE by construction."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = counts.where(F.col(n) > max(total / HOT_SHARE, HOT_ROWS))
    return hot, hot.count() if total > HOT_ROWS else 0


def join_per_key(df: DataFrame, per_key: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of `df` with `per_key` (one row per key, `n` = the key's rows in `df`).

    Hot keys, of which there are fewer than HOT_SHARE, are broadcast; all others are joined by a shuffle.
    """
    hot, many = hot_of(per_key, n)
    if not many:
        return df.join(per_key.drop(n), key)
    hot_keys = F.broadcast(hot.select(key))
    cold = df.join(hot_keys, key, "left_anti").join(per_key.join(hot_keys, key, "left_anti").drop(n), key)
    return cold.unionByName(df.join(F.broadcast(hot.drop(n)), key))


def keep_highest(df: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows of `df` whose `order` is the highest of their key, and the staged table (key, best, rows) of keys.

    Null keys are kept apart as one key of their own only if `df` has them; a key whose `order` is null throughout keeps its rows.
    """
    best = stage(df.groupBy(key).agg(F.max(order).alias("best"), F.count("*").alias("rows")), "best")
    kept = join_per_key(df, best, key, "rows").where(F.col(order).eqNullSafe(F.col("best"))).drop("best")
    return kept, best


def positions(df: DataFrame, group: list[str], order: list[Column], name: str = "position", sort_rows: int = SORT_ROWS) -> DataFrame:
    """`df` with the row's 1-based place within its group by `order`, which must be total within a group.

    Groups above `sort_rows` are range-partitioned by the order, numbered per partition and shifted
    by the partitions before.
    """
    plain = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    sizes = df.groupBy(*group).count().where(F.col("count") > sort_rows)
    if not sizes.take(1):
        return df.withColumn(name, plain)
    sizes = stage(sizes.select(*group), "large-groups")
    same = [df[g].eqNullSafe(sizes[g]) for g in group]
    cold = df.join(sizes, same, "left_anti").withColumn(name, plain)
    hot = df.join(sizes, same, "left_semi").repartitionByRange(*[F.col(g) for g in group], *order)
    hot = stage(hot.withColumn("_part", F.spark_partition_id()), "ranged")
    hot = hot.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)))
    before = hot.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = before.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_before")
    on = (hot["_part"] == b["_p"])
    for i, g in enumerate(group):
        on = on & hot[g].eqNullSafe(b[f"_g{i}"])
    hot = hot.join(b, on)
    return cold.unionByName(hot.withColumn(name, (F.col("_at") + F.col("_before")).cast("int")).select(*cold.columns))


def mean_ranks(df: DataFrame, group: list[str], value: str, name: str = "rank_share", sort_rows: int = SORT_ROWS) -> DataFrame:
    """`df` with the value's rank from below within its group, ties sharing their mean rank, divided by the group's rows."""
    if not df.groupBy(*group).count().where(F.col("count") > sort_rows).take(1):
        whole, tied = Window.partitionBy(*group), Window.partitionBy(*group, value)
        rank = F.rank().over(whole.orderBy(value)) + (F.count("*").over(tied) - 1) / 2
        return df.withColumn(name, rank / F.count("*").over(whole))
    # ties collapse first; the distinct values are placed by ranges
    values = positions(df.groupBy(*group, value).agg(F.count("*").alias("_c")), group, [F.col(value)], "_pos", sort_rows)
    values = stage(values, "values")
    blocks = values.withColumn("_block", F.floor(F.col("_pos") / 100_000))
    upto = Window.partitionBy(*group, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(*group, "_block").agg(F.sum("_c").alias("_s"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("_all", F.sum("_s").over(Window.partitionBy(*group)))
    ranked = blocks.withColumn("_in", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    keys = [*group, "_block"]
    s = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_base", "_all")
    on = ranked[keys[0]].eqNullSafe(s["_k0"])
    for i, k in enumerate(keys[1:], 1):
        on = on & ranked[k].eqNullSafe(s[f"_k{i}"])
    ranked = ranked.join(s, on).withColumn(name, (F.col("_base") + F.col("_in") + (F.col("_c") + 1) / 2) / F.col("_all"))
    back = [*group, value]
    r = ranked.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(back)], name)
    on = df[back[0]].eqNullSafe(r["_k0"])
    for i, k in enumerate(back[1:], 1):
        on = on & df[k].eqNullSafe(r[f"_k{i}"])
    return df.join(r, on).drop(*[f"_k{i}" for i in range(len(back))])
