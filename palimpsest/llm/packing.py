"""Filling containers of fixed capacity with whole documents: conflict-constrained best fit.

Documents are hashed to shards of bounded size, which are packed on their own, longest first.
A shard's open containers are kept in the order of the room they have left; the search starts
at the tightest that could take the document and goes on to the next until it finds one without
a conflict. A container carries bitmaps of the sources and of the duplicate clusters in it:
no two documents of one duplicate cluster, and no two sources declared apart, share one.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import nearcopies
from palimpsest.llm.tokens import plain_source, token_sizes
from palimpsest.session import stage

SHARD_ITEMS = 20_000
_MOST_KINDS = 1_000
_PLACES = "container string, capacity long, shard int, bin int, place int, doc_id long, piece int, begins long, tokens long"


def best_fit(sizes: list[int], capacity: int, sources: list[int], clusters: list[int], conflicts: dict[int, int]) -> list[int]:
    """The bin of each item, items in order. `clusters` has -1 where an item has no duplicate in the shard.

    `conflicts` maps a source to the bitmap of sources that it must not be with.
    """
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    of_bin_sources: list[int] = []
    of_bin_clusters: list[int] = []
    least = min(sizes, default=0)
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        apart, twin = conflicts.get(source, 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect.bisect_left(room, (size, -1))
        while at < len(room) and (of_bin_clusters[room[at][1]] & twin or of_bin_sources[room[at][1]] & apart):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(of_bin_sources)
            of_bin_sources.append(0)
            of_bin_clusters.append(0)
        of_bin_sources[b] |= 1 << source
        of_bin_clusters[b] |= twin
        if left - size >= least:
            bisect.insort(room, (left - size, b))
        out.append(b)
    return out


def _packer(apart: tuple[tuple[str, str], ...]):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        container, capacity, shard = key
        capacity = int(capacity)
        rows, bins = [], 0
        rest = []
        for doc, source, tokens, cluster in zip(pdf["doc_id"], pdf["source"], pdf["tokens"], pdf["cluster"]):
            whole = int(tokens) // capacity if tokens > capacity else 0
            for i in range(whole):  # pieces of a divided document that fill a container each
                rows.append((bins, doc, i, i * capacity, capacity))
                bins += 1
            if left := int(tokens) - whole * capacity:
                rest.append((left, int(doc), whole, source or "", cluster))
        rest.sort(key=lambda r: (-r[0], r[1]))
        names = {s: i for i, s in enumerate(sorted({r[3] for r in rest}))}
        conflicts: dict[int, int] = {}
        for a, b in apart:
            if a in names and b in names:
                conflicts[names[a]] = conflicts.get(names[a], 0) | 1 << names[b]
                conflicts[names[b]] = conflicts.get(names[b], 0) | 1 << names[a]
        often = pd.Series([r[4] for r in rest]).value_counts()
        numbers = {c: i for i, c in enumerate(often[often > 1].index)}
        placed = best_fit([r[0] for r in rest], capacity, [names[r[3]] for r in rest], [numbers.get(r[4], -1) for r in rest], conflicts)
        rows += [(bins + b, doc, piece, piece * capacity, left) for b, (left, doc, piece, _, _) in zip(placed, rest)]
        out = pd.DataFrame(rows, columns=["bin", "doc_id", "piece", "begins", "tokens"])
        out["place"] = out.groupby("bin").cumcount()
        return out.assign(container=container, capacity=capacity, shard=shard)[[c.split()[0] for c in _PLACES.split(", ")]]

    return pack


def duplicate_clusters(documents: DataFrame) -> DataFrame:
    """(doc_id, cluster): near duplicates by runs of five words and a similarity of 0.8, and equal texts below five words."""
    near = nearcopies.near_duplicate_groups(documents, "doc_id", "doc_id", words=5, min_size=1, threshold=0.8)
    same = documents.where("doc_id is not null and text <> ''").groupBy("doc_id").agg(F.max(F.xxhash64("text")).alias("own"))
    return same.join(near.groupBy(F.col("id").alias("doc_id")).agg(F.min("group_id").alias("group_id")), "doc_id", "left").select("doc_id", F.coalesce("group_id", "own").alias("cluster"))


def places(documents: DataFrame, containers: DataFrame, apart: Sequence[tuple[str, str]] = (), tokenizer: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Where every document goes in each kind of container: (container, capacity, bin_id, place, doc_id, piece, begins, tokens).

    Only documents longer than a capacity are divided, into full pieces and a rest; `begins` is the
    piece's first token. Null and empty texts take no space and have no place; repeated rows count once; null
    sources are one source; containers without a positive capacity are left out; extra columns are ignored.
    """
    sized = token_sizes(documents, tokenizer)
    items = stage(sized.where("tokens > 0").join(duplicate_clusters(documents), "doc_id"), "items")
    shards = max(1, -(-items.count() // shard_items))
    kinds = containers.select("container", F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0").distinct()
    kinds = [tuple(r) for r in kinds.take(_MOST_KINDS + 1)]
    if len(kinds) > _MOST_KINDS:
        raise ValueError(f"more than {_MOST_KINDS} kinds of container: every document gets a place in each")
    each = items.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).cast("long").alias("capacity")) for c, n in kinds])).alias("k")) if kinds else None
    if each is None:
        return documents.sparkSession.createDataFrame([], "container string, capacity long, bin_id long, place int, doc_id long, piece int, begins long, tokens long")
    names = tuple((a.lower().replace(" ", ""), b.lower().replace(" ", "")) for a, b in apart)
    packed = each.select("k.container", "k.capacity", "shard", "doc_id", "source", "tokens", "cluster").groupBy("container", "capacity", "shard").applyInPandas(_packer(names), _PLACES)
    return packed.select("container", "capacity", (F.col("shard") * F.lit(1 << 32) + F.col("bin")).alias("bin_id"), "place", "doc_id", "piece", "begins", "tokens")


def fill(placed: DataFrame) -> DataFrame:
    """Per kind of container: how many are used, the tokens in them, and the space left unused."""
    bins = placed.groupBy("container", "capacity", "bin_id").agg(F.sum("tokens").alias("tokens"))
    return bins.groupBy("container", "capacity").agg(
        F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), (F.count("*") * F.col("capacity") - F.sum("tokens")).alias("unused"),
        F.round(1 - F.sum("tokens") / (F.count("*") * F.col("capacity")), 6).alias("unused_share"),
    )


__all__ = ["best_fit", "places", "fill", "plain_source", "duplicate_clusters"]
