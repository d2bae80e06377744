"""References to records that do not exist.

Keys become integers (dense whole numbers stand for themselves, all others go through a
dictionary), and per key range of 32,768 and per period one bitmap holds the referring keys
and others hold what happened to the parents. References AND NOT live parents leaves the
bits that are decoded; only those rows meet the parents' history again for the exact verdict.
Bitmaps are built in the map tasks, so a hot key is one bit before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import stage

RANGE = 32768  # keys per bitmap of Spark's bitmap functions
NO_PERIOD = -1
#: Whole-number keys stand for themselves while at least one value in so many is in use.
SPARSE = 64
#: So many rows of keys are broadcast at most. Tables of keys compress so well that their bytes on disk tell nothing.
BROADCAST_ROWS = 20_000
_FOLD = "rel string, code long, period int"


def by_rows(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of `rows` rows, as a side of a join: broadcast only if they are few, else the driver holds none of it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def month_index(ts: Column) -> Column:
    """Months since year 0; rows without a time go to a period of their own before all others."""
    return F.coalesce((F.year(ts) * 12 + F.month(ts) - 1).cast("int"), F.lit(NO_PERIOD))


def month_name(period: Column) -> Column:
    return F.when(period >= 0, F.format_string("%04d-%02d", F.floor(period / 12), period % 12 + 1))


@dataclass
class Dictionary:
    """Keys to integer codes. `table`, of `rows` rows, is null where whole numbers stand for themselves."""

    table: DataFrame | None
    rows: int = 0

    def encode(self, df: DataFrame, key: str) -> DataFrame:
        """`df` with `code`; rows with a null key are dropped."""
        df = df.where(F.col(key).isNotNull())
        if self.table is None:
            return df.withColumn("code", F.col(key).cast("long"))
        return df.join(by_rows(self.table.withColumnRenamed("dict_key", key), self.rows), key)

    def decode(self, df: DataFrame, key: str, rows: int = BROADCAST_ROWS + 1) -> DataFrame:
        """`df`, of `rows` rows, with `key`."""
        if self.table is None:
            return df.withColumn(key, F.col("code"))
        return by_rows(df, rows).join(self.table.withColumnRenamed("dict_key", key), "code")


def dictionary(columns: list[tuple[DataFrame, str]]) -> Dictionary:
    """A dictionary over the keys in all `columns`.

    The code of a dictionary key is its place within its range partition plus the partition's
    number times 2^33: dense inside a partition, so bitmaps of neighbouring codes are full.
    """
    kinds = {dict(df.dtypes)[c] for df, c in columns}
    if kinds <= {"bigint", "int", "smallint", "tinyint"}:
        seen = None
        for df, c in columns:
            d = df.select(F.col(c).cast("long").alias("k"))
            seen = d if seen is None else seen.unionByName(d)
        lo, hi, n = seen.agg(F.min("k"), F.max("k"), F.approx_count_distinct("k")).first()
        if lo is None or hi - lo < SPARSE * max(n, RANGE):
            return Dictionary(None)
    keys = None
    for df, c in columns:
        d = df.select(F.col(c).cast("string" if "string" in kinds else "long").alias("dict_key")).where("dict_key is not null").distinct()
        keys = d if keys is None else keys.unionByName(d)
    keys = keys.distinct().repartitionByRange("dict_key").sortWithinPartitions("dict_key")
    table = stage(keys.withColumn("code", F.monotonically_increasing_id() + 1), "dictionary")
    return Dictionary(table, table.count())


def bitmaps(df: DataFrame, rel: str, role: str, period: Column) -> DataFrame:
    """One bitmap of `code` per key range and period."""
    return (
        df.groupBy(F.lit(rel).alias("rel"), F.bitmap_bucket_number("code").alias("range"), period.alias("period"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
        .withColumn("role", F.lit(role))
    )


def _decode(bucket: int, bits: np.ndarray) -> np.ndarray:
    place = np.nonzero(np.unpackbits(bits, bitorder="little"))[0].astype(np.int64)
    return (bucket - 1) * RANGE + place + 1 if bucket > 0 else bucket * RANGE - place


def _fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Walk one key range through its periods: suspects are references whose parent was not alive all period long."""
    rel, bucket = key
    size = RANGE // 8
    live, seen = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    codes, periods = [], []
    for period, rows in pdf.groupby("period", sort=True):
        at = {}
        for role, raw in zip(rows["role"], rows["bits"]):
            b = np.frombuffer(raw, np.uint8)
            at[role] = at[role] | b if role in at else b
        if (ref := at.get("first")) is not None:  # only a key's first reference counts
            ref, seen = ref & ~seen, seen | ref
        else:
            ref = at.get("ref")
        if ref is not None:
            safe = live & ~at["broken"] if "broken" in at else live
            left = _decode(int(bucket), ref & ~safe)
            codes.append(left)
            periods.append(np.full(len(left), period, np.int32))
        if "up" in at:
            live = live | at["up"]
        if "down" in at:
            live = live & ~at["down"]
    if not codes:
        return pd.DataFrame({"rel": pd.Series([], dtype=object), "code": np.empty(0, np.int64), "period": np.empty(0, np.int32)})
    return pd.DataFrame({"rel": rel, "code": np.concatenate(codes), "period": np.concatenate(periods)})


def suspects(maps: list[DataFrame]) -> DataFrame:
    """(rel, code, period) of the references that survive AND NOT. Roles of the bitmaps:

    `ref` references of a period; `first` the same, of which only a key's first counts; `up` and
    `down` parents that exist, or don't, at the period's end; `broken` parents that were deleted
    at some time in it. A group is one range's bitmaps: at most five of 4 KB a period.
    """
    every = maps[0]
    for m in maps[1:]:
        every = every.unionByName(m)
    return every.groupBy("rel", "range").applyInPandas(_fold, _FOLD)


def as_of_verdicts(refs: DataFrame, events: DataFrame) -> DataFrame:
    """Verdict of each of `refs` (parent, ref_key, at) by `events` (parent, ts, seq, op): missing, late, deleted or null.

    The last event at or before `at` decides (ties in ts: the higher seq). It is looked up within
    the parent's day; what a day begins with is carried over from the parent's earlier days, of
    which there is one row each. A hot parent is thus spread over its days.
    """
    both = events.select("parent", "ts", "seq", "op", F.lit(None).cast("long").alias("ref_key")).unionByName(
        refs.select("parent", F.col("at").alias("ts"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("op"), F.col("ref_key").cast("long").alias("ref_key"))
    ).withColumn("day", F.to_date("ts"))
    is_event = F.col("ref_key").isNull()
    days = both.groupBy("parent", "day").agg(
        F.max(F.when(is_event & F.col("ts").isNotNull(), F.struct("ts", "seq", "op"))).alias("last"), F.min(F.when(is_event, F.col("ts"))).alias("first_ts"), F.max(is_event).alias("any_event")
    )
    per_parent = Window.partitionBy("parent")
    days = days.select(
        F.col("parent").alias("d_parent"), F.col("day").alias("d_day"),
        F.last("last.op", ignorenulls=True).over(per_parent.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.min("first_ts").over(per_parent).alias("first_ts"), F.max("any_event").over(per_parent).alias("known"),
    )
    in_day = Window.partitionBy("parent", "day").orderBy("ts", F.col("ref_key").isNotNull(), "seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("state", F.last("op", ignorenulls=True).over(in_day)).where(~is_event)
    joined = seen.join(days.hint("merge"), seen.parent.eqNullSafe(days.d_parent) & seen.day.eqNullSafe(days.d_day))
    kind = (
        F.when(~F.col("known"), "missing")
        .when(F.col("first_ts") > F.col("ts"), "late")
        .when(F.coalesce("state", "carried") == "delete", "deleted")
    )
    return joined.select("parent", "ref_key", F.col("ts").alias("at"), kind.alias("kind"))


def orphans(wal: DataFrame, chunks: DataFrame, postings: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Orphan references: (src_table, src_key, kind, period), one row per key, `period` a month index.

    `chunks` entries whose parent is missing, late or deleted at `written_at`; chunk ids of
    `postings` and of text `fingerprints` that `chunks` lacks, or has only later (fingerprints).
    Postings take the month of their record's `ts`, the earliest where there are several.

    Null keys refer to nothing and are no case. A reference without a time can only be missing. Repeated
    rows count once, empty tables give no rows (an empty `chunks` makes every chunk id missing),
    extra columns are ignored.
    """
    wal = wal.select("seq", "op", "memory_id", "ts")
    chunks = chunks.select("entry_id", "parent_memory_id", "chunk_id", "written_at")
    prints = fingerprints.where(F.col("kind") == "text").select("chunk_id", "written_at")
    memories = dictionary([(wal, "memory_id"), (chunks, "parent_memory_id")])
    ids = dictionary([(chunks, "chunk_id"), (postings.select("chunk_id"), "chunk_id"), (prints, "chunk_id")])

    # what each month did to a memory: how it ended, and whether it was ever deleted in between
    last = (
        memories.encode(wal, "memory_id").groupBy("code", month_index(F.col("ts")).alias("period"))
        .agg(F.max(F.struct("ts", "seq", "op")).op.alias("op"), F.max((F.col("op") == "delete").cast("int")).alias("deleted"))
    )
    entries = memories.encode(chunks, "parent_memory_id")
    owned = ids.encode(chunks, "chunk_id")
    found = stage(
        suspects([
            bitmaps(entries, "chunks", "ref", month_index(F.col("written_at"))),
            bitmaps(last.where("op <> 'delete'"), "chunks", "up", F.col("period")),
            bitmaps(last.where("op = 'delete'"), "chunks", "down", F.col("period")),
            bitmaps(last.where("deleted = 1"), "chunks", "broken", F.col("period")),
            bitmaps(ids.encode(postings.select("chunk_id"), "chunk_id"), "postings", "ref", F.lit(1)),
            bitmaps(owned, "postings", "up", F.lit(0)),
            bitmaps(ids.encode(prints, "chunk_id"), "fingerprints", "first", month_index(F.col("written_at"))),
            bitmaps(owned, "fingerprints", "up", month_index(F.col("written_at"))),
        ]),
        "suspects",
    )

    many = {r["rel"]: r["count"] for r in found.groupBy("rel").count().collect()}  # three rows
    keys = lambda rel: many.get(rel, 0)

    # chunks: the suspects' own history decides
    parents = memories.decode(found.where("rel = 'chunks'"), "parent_memory_id", keys("chunks")).select("parent_memory_id", "period")
    refs = (
        chunks.withColumn("period", month_index(F.col("written_at")))
        .join(by_rows(parents, keys("chunks")), ["parent_memory_id", "period"], "left_semi")
        .groupBy("entry_id").agg(F.min(F.struct("written_at", "parent_memory_id")).alias("e"))
        .select(F.col("e.parent_memory_id").alias("parent"), F.col("entry_id").alias("ref_key"), F.col("e.written_at").alias("at"))
    )
    events = wal.join(by_rows(parents.select(F.col("parent_memory_id").alias("memory_id")), keys("chunks")), "memory_id", "left_semi").select(F.col("memory_id").alias("parent"), "ts", "seq", "op")
    of_chunks = as_of_verdicts(refs, events).where("kind is not null").select(F.lit("chunks").alias("src_table"), F.col("ref_key").alias("src_key"), "kind", month_index(F.col("at")).alias("period"))

    # postings: the bits are the verdict, the record's time only dates it
    lost = ids.decode(found.where("rel = 'postings'"), "chunk_id", keys("postings")).select("chunk_id")
    dated = (
        postings.select("chunk_id", "seq").join(by_rows(lost, keys("postings")), "chunk_id", "left_semi").distinct()
        .join(wal.groupBy("seq").agg(F.min("ts").alias("ts")).hint("merge"), "seq", "left")
        .groupBy("chunk_id").agg(F.min("ts").alias("ts"))
    )
    of_postings = dated.select(F.lit("postings").alias("src_table"), F.col("chunk_id").cast("long").alias("src_key"), F.lit("missing").alias("kind"), month_index(F.col("ts")).alias("period"))

    # fingerprints: first print against first entry
    maybe = by_rows(ids.decode(found.where("rel = 'fingerprints'"), "chunk_id", keys("fingerprints")).select("chunk_id").distinct(), keys("fingerprints"))
    first = prints.join(maybe, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("written_at").alias("printed"))
    entry = chunks.join(maybe, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("written_at").alias("entered"), F.lit(True).alias("held"))
    verdict = F.when(F.col("held").isNull(), "missing").when(F.col("entered") > F.col("printed"), "late")
    of_prints = (
        first.join(by_rows(entry, keys("fingerprints")), "chunk_id", "left").withColumn("kind", verdict).where("kind is not null")
        .select(F.lit("fingerprints").alias("src_table"), F.col("chunk_id").cast("long").alias("src_key"), "kind", month_index(F.col("printed")).alias("period"))
    )
    return of_chunks.unionByName(of_postings).unionByName(of_prints)


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, month (`yyyy-MM`, null where undated) and kind."""
    return found.groupBy("src_table", month_name(F.col("period")).alias("month"), "kind").agg(F.count("*").alias("orphans"))
