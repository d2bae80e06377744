"""One ranking from several differently-scaled scores, by a principal component of ranks.

Scores become rank shares within their list, which removes the lists' scales. A correlation
matrix between kinds of list is summed up over all queries; its first principal component
weighs the standardised ranks. Ranks count in each list's declared direction, and the component
is oriented to it. Every kind has a loading of its own: the matrix of a few kinds is decomposed
on the driver, that of many is only multiplied with vectors, where its pairs are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.skew import mean_ranks, positions
from palimpsest.session import stage

MASKED = -1e9
DENSE_KINDS = 64  # kinds of list whose matrix is decomposed on the driver
_BASIS, _ROOM = 40, 4_000_000  # vectors over more kinds that the driver holds at least, and numbers it has room for
_CLOSE = 1e-13  # what is left of a product beside the component, as a share of it
_ROUNDS = 50


def best_scores(hits: DataFrame, down: list[str] = []) -> DataFrame:  # noqa: B006
    """(qid, list, memory_id, score): a memory's best score in each list, of lanes `down` the lowest; null, NaN and masked scores are none."""
    scored = hits.select("qid", F.struct(F.col("lane"), F.col("mu")).alias("list"), "memory_id", "score").where(
        F.col("qid").isNotNull() & F.col("memory_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") != MASKED)
    )
    best = F.when(F.col("list.lane").isin(down), F.min("score")).otherwise(F.max("score")) if down else F.max("score")
    return scored.groupBy("qid", "list", "memory_id").agg(best.alias("score"))


def with_kinds(ranked: DataFrame, most: int | None = None) -> DataFrame:
    """`ranked` with `kind` (lane, mu): each list's own, unless a caller asks for `most` at most.

    With `most`, a kind is a lane with its `mu` if there are few such, else a lane, with `mu` as a parameter of it; beyond
    the `most` - 1 lanes with most rows, all lanes are one kind, `*`.
    """
    if most is None:
        return ranked.withColumn("kind", F.col("list"))
    if ranked.select("list").distinct().limit(most + 1).count() <= most:
        return ranked.withColumn("kind", F.col("list"))
    lanes = ranked.groupBy("list.lane").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lane").limit(most).collect()
    named = [r["lane"] for r in lanes[: most if len(lanes) < most else most - 1]]
    lane = F.col("list.lane")
    own = lane.isin([x for x in named if x is not None]) | (lane.isNull() if None in named else F.lit(False))
    return ranked.withColumn("kind", F.struct(F.when(own, lane).otherwise("*").alias("lane"), F.lit(None).cast("double").alias("mu")))


def correlations(ranked: DataFrame) -> DataFrame:
    """Per pair of kinds of list: rows, sums, squares and products over all memories of the queries that have both.

    A memory that a list lacks counts as rank share 0. A memory's lists are as few as its query's. Different lists of
    one kind are no pair.
    """
    of_memory = ranked.groupBy("qid", "memory_id").agg(F.collect_list(F.struct("list", "kind", "share")).alias("v"))
    members = of_memory.groupBy("qid").agg(F.count("*").alias("n"))
    lists = ranked.groupBy("qid", "list", "kind").agg(F.sum("share").alias("s"), F.sum(F.col("share") * F.col("share")).alias("ss"))
    lists = lists.groupBy("qid").agg(F.collect_list(F.struct("list", "kind", "s", "ss")).alias("v")).join(members, "qid")
    alike = F.col("a.kind").eqNullSafe(F.col("b.kind")) & ~F.col("a.list").eqNullSafe(F.col("b.list"))
    a = lists.select("n", F.explode("v").alias("a"), "v").select("n", "a", F.explode("v").alias("b")).where(~alike)
    sums = a.groupBy(F.col("a.kind").alias("a"), F.col("b.kind").alias("b")).agg(
        F.sum("n").cast("double").alias("n"), F.sum("a.s").alias("sa"), F.sum("b.s").alias("sb"), F.sum("a.ss").alias("saa"), F.sum("b.ss").alias("sbb")
    )
    m = of_memory.select(F.explode("v").alias("a"), "v").select("a", F.explode("v").alias("b")).where(~alike)
    products = m.groupBy(F.col("a.kind").alias("pa"), F.col("b.kind").alias("pb")).agg(F.sum(F.col("a.share") * F.col("b.share")).alias("sab"))
    return sums.join(products, F.col("a").eqNullSafe(F.col("pa")) & F.col("b").eqNullSafe(F.col("pb")), "left").select("a", "b", "n", "sa", "sb", "saa", "sbb", F.coalesce("sab", F.lit(0.0)).alias("sab"))


def loadings(moments: list) -> list[tuple]:
    """(kind, weight, mean): the first principal component's loadings over the standard deviations.

    `moments` has a row per pair of kinds, DENSE_KINDS squared at most. Pairs of kinds that no query has both of
    take the mean of the known correlations. The shares already follow the declared directions, so the component
    is turned to where the loadings' sum is positive; a list that runs against the others keeps its negative loading.
    """
    kinds = sorted({tuple(r["a"]) for r in moments}, key=lambda t: (t[0] or "", t[1] is not None, t[1] or 0.0))
    at, d = {k: i for i, k in enumerate(kinds)}, len(kinds)
    if not d:
        return []
    corr, sd, mean = np.full((d, d), np.nan), np.zeros(d), np.zeros(d)
    for r in moments:
        i, j, n = at[tuple(r["a"])], at[tuple(r["b"])], r["n"]
        va, vb = r["saa"] / n - (r["sa"] / n) ** 2, r["sbb"] / n - (r["sb"] / n) ** 2
        if i == j:
            sd[i], mean[i] = np.sqrt(max(va, 0)), r["sa"] / n
        if va > 1e-12 and vb > 1e-12:
            corr[i, j] = (r["sab"] / n - r["sa"] * r["sb"] / n**2) / np.sqrt(va * vb)
    known = ~np.isnan(corr) & ~np.eye(d, dtype=bool)
    corr[np.isnan(corr)] = corr[known].mean() if known.any() else 0.0
    np.fill_diagonal(corr, 1.0)
    _, vectors = np.linalg.eigh((corr + corr.T) / 2)
    weight = vectors[:, -1] * (-1 if vectors[:, -1].sum() < 0 else 1)
    return [(k, float(w / s) if s > 1e-6 else float(w), float(m)) for k, w, s, m in zip(kinds, weight, sd, mean)]


def first_component(times: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The unit eigenvector of the largest eigenvalue of a symmetric matrix known by its products with vectors (Lanczos, restarted)."""
    v = np.ones(d) / np.sqrt(d) + np.random.default_rng(0).standard_normal(d) * 0.1 / np.sqrt(d)
    v /= np.linalg.norm(v)
    most = min(d, max(_BASIS, _ROOM // d))
    for _ in range(_ROUNDS):
        basis, along, beside = [v], [], []
        while True:
            w = times(basis[-1])
            along.append(w @ basis[-1])
            for _ in range(2):  # once leaves what rounding leaves
                for b in basis:
                    w = w - (w @ b) * b
            left = np.linalg.norm(w)
            values, vectors = np.linalg.eigh(np.diag(along) + np.diag(beside, 1) + np.diag(beside, -1))
            done = left * abs(vectors[-1, -1]) <= _CLOSE * max(abs(values[-1]), 1.0)
            if done or len(basis) == most:
                break
            basis.append(w / left)
            beside.append(left)
        v = sum(x * b for x, b in zip(vectors[:, -1], basis))
        v /= np.linalg.norm(v)
        if done or len(basis) == d:
            return v
    raise ArithmeticError(f"no first component of {d} kinds of list after {_ROUNDS * most} products: its two largest eigenvalues are all but equal")


def many_loadings(moments: DataFrame) -> DataFrame:
    """(k, weight) as `loadings` has them, for any number of kinds: the driver holds some vectors over the kinds, never their pairs.

    The matrix is the mean of the known correlations everywhere, 1 in the diagonal, and at the known pairs what they have besides.
    """
    spark = moments.sparkSession
    var = lambda s, ss: F.col(ss) / F.col("n") - (F.col(s) / F.col("n")) * (F.col(s) / F.col("n"))
    m = stage(moments.withColumns({"va": var("sa", "saa"), "vb": var("sb", "sbb")}), "moments")
    own = F.col("a").eqNullSafe(F.col("b"))
    kinds = m.where(own).select(F.col("a.lane").alias("lane"), F.col("a.mu").alias("mu"), "va").toArrow().sort_by([("lane", "ascending"), ("mu", "ascending")])
    d = kinds.num_rows
    sd = np.sqrt(np.maximum(kinds["va"].to_numpy(), 0))
    at = stage(spark.createDataFrame(kinds.append_column("i", pa.array(np.arange(d, dtype=np.int32))), "lane string, mu double, va double, i int").select(F.struct("lane", "mu").alias("k"), "i"), "kinds")
    known = m.where(~own & (F.col("va") > 1e-12) & (F.col("vb") > 1e-12))
    known = known.withColumn("c", (F.col("sab") / F.col("n") - F.col("sa") * F.col("sb") / (F.col("n") * F.col("n"))) / F.sqrt(F.col("va") * F.col("vb")))
    row, col = at.select(F.col("k").alias("ka"), F.col("i").alias("a_at")), at.select(F.col("k").alias("kb"), F.col("i").alias("b_at"))
    cells = stage(known.join(row, F.col("a").eqNullSafe(F.col("ka"))).join(col, F.col("b").eqNullSafe(F.col("kb"))).select(F.col("a_at").alias("i"), F.col("b_at").alias("j"), "c"), "cells")
    mean = cells.agg(F.avg("c")).first()[0] or 0.0

    def times(v: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(v)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = np.zeros(len(sent.value))
            for batch in batches:
                x += np.bincount(batch["i"].to_numpy(), (batch["c"].to_numpy() - mean) * sent.value[batch["j"].to_numpy()], len(x))
            some = np.nonzero(x)[0]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(x[some])], names=["i", "x"])

        got = cells.mapInArrow(partial, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        sent.destroy()
        out = mean * v.sum() + (1 - mean) * v
        out[got["i"].to_numpy()] += got["x"].to_numpy()
        return out

    vector = first_component(times, d)
    vector = vector * (-1 if vector.sum() < 0 else 1)
    weight = pa.array(np.where(sd > 1e-6, vector / np.where(sd > 1e-6, sd, 1), vector))
    w = spark.createDataFrame(kinds.append_column("weight", weight), "lane string, mu double, va double, weight double")
    return w.select(F.struct("lane", "mu").alias("k"), "weight")


def rank_shares(hits: DataFrame, directions: dict[str, int] | None = None) -> DataFrame:
    """(qid, list, memory_id, share): the rank share in each list, 1 for its best; where the lane's direction is -1, lower scores are better."""
    down = [lane for lane, d in (directions or {}).items() if d < 0]
    best = best_scores(hits, down)
    if down:
        best = best.withColumn("score", F.when(F.col("list.lane").isin(down), -F.col("score")).otherwise(F.col("score")))
    return mean_ranks(best, ["qid", "list"], "score", "share").select("qid", "list", "memory_id", "share")


def fused(hits: DataFrame, directions: dict[str, int] | None = None) -> DataFrame:
    """(qid, memory_id, fused): the projection of each memory's standardised ranks, up to a constant per query.

    Each list has the same say but for its loading; a memory absent from a list takes that list's lowest
    place and gains nothing. `directions` gives -1 for lanes where lower is better (default 1). Repeated and late rows
    change nothing; null, NaN and masked scores are no scores, and a memory without any is left out. Empty input gives
    no rows; extra columns are ignored.
    """
    ranked = stage(rank_shares(hits, directions), "ranked")
    ranked = with_kinds(ranked)
    moments = correlations(ranked)  # one row per pair of kinds of list
    if ranked.select("kind").distinct().limit(DENSE_KINDS + 1).count() > DENSE_KINDS:
        w = many_loadings(moments)
    else:
        weights = [((k[0], k[1]), x) for k, x, _ in loadings(moments.collect())]
        w = F.broadcast(hits.sparkSession.createDataFrame(weights, "k struct<lane: string, mu: double>, weight double"))
    joined = ranked.join(w, F.col("kind").eqNullSafe(F.col("k")))
    return joined.groupBy("qid", "memory_id").agg(F.sum(F.col("share") * F.col("weight")).alias("fused"))


def ranking(hits: DataFrame, directions: dict[str, int] | None = None) -> DataFrame:
    """`fused` with the memory's place in its query's ranking (ties: smaller memory_id)."""
    scores = fused(hits, directions).withColumn("fused", F.round("fused", 9))
    return positions(scores, ["qid"], [F.col("fused").desc(), F.col("memory_id")], "place")


def firsts(hits: DataFrame) -> DataFrame:
    """(qid, memory_id) of the first place of every query."""
    best = fused(hits).groupBy("qid").agg(F.max(F.struct(F.round("fused", 9).alias("f"), (-F.col("memory_id")).alias("m"))).alias("top"))
    return best.select("qid", (-F.col("top.m")).alias("memory_id"))
