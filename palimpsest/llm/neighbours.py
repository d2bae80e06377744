"""The k most similar fingerprints of every fingerprint, by multiprobe p-stable hashing.

A fingerprint is a 0/1 vector. Each hash function projects it on a random vector drawn from a
p-stable law and cuts the projection into buckets at a random offset. With a small p the law's
tails are so heavy that the projection follows its largest terms, which is what tells sets
apart that share half of their bits from sets that share few; the buckets are cut on the
projection's logarithm and sign, since its size spans many orders of magnitude. M functions
make a bucket key, L tables have functions of their own. A query looks into its own bucket
and into T perturbed ones per table, in the order of the estimated chance that a neighbour
crossed just those bucket walls. Candidates of all tables are merged and reranked by exact
similarity. What is lost is measured against brute force in the tests.

Fingerprints with the same bits are hashed once, as one class.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import discard, stage

BITS = 10240
_PER_BUCKET = 200  # vectors a bucket's rows are joined for; those of a larger one are compared in blocks
_BLOCK = 20_000
_TILE = 4_000_000  # pairs of a block compared at once
_PART_ROWS = 1_500_000  # rows of keys that one task groups
_ROUNDS = 4  # in which the tables, and then the candidates, are gone through if there are many: what a round shuffles is gone in the next
_KEYS = "key long, id long, own boolean"


@dataclass(frozen=True)
class Hashing:
    """p of the stable law, functions per key, bucket width on the natural logarithm, tables, perturbed probes per table."""

    p: float = 0.05
    functions: int = 4
    width: float = 2.0
    tables: int = 24
    probes: int = 1
    seed: int = 20240101


def probe_order(m: int, probes: int) -> list[tuple[int, ...]]:
    """The first perturbation sets by expected score, as ranks among the 2m distances to bucket walls (0 = nearest wall)."""
    j = np.arange(1, 2 * m + 1)
    low, high = j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
    score = np.where(j <= m, low, high)
    heap, out = [(score[0], (0,))], []
    while heap and len(out) < probes:
        s, ranks = heapq.heappop(heap)
        if all(2 * m - 1 - r not in ranks for r in ranks):  # not both walls of one function
            out.append(ranks)
        if (last := ranks[-1]) + 1 < 2 * m:
            heapq.heappush(heap, (s - score[last] + score[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (s + score[last + 1], (*ranks, last + 1)))
    return out


def projections(h: Hashing) -> tuple[np.ndarray, np.ndarray]:
    """The stable random vectors (bits x tables x functions) and the offsets."""
    rng = np.random.default_rng((h.seed, 0))
    shape = (BITS, h.tables * h.functions)
    angle, wait = rng.uniform(-np.pi / 2, np.pi / 2, shape), rng.exponential(size=shape)
    # by logarithms, since terms reach beyond a double's range; what is too large for one is cut there
    size = np.log(np.abs(np.sin(h.p * angle))) - np.log(np.cos(angle)) / h.p + (np.log(np.cos((1 - h.p) * angle)) - np.log(wait)) * ((1 - h.p) / h.p)
    draw = np.sign(angle) * np.exp(np.clip(size, -690, 690))
    return draw, rng.uniform(size=shape[1])


def _hasher(h: Hashing, some: slice):
    """Keys of a batch of vectors: their own bucket of each of `some` of the tables and the perturbed ones."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = h.functions
        draw, offset = projections(h)
        draw, offset = np.ascontiguousarray(draw[:, some.start * m : some.stop * m]), offset[some.start * m : some.stop * m]
        rng = np.random.default_rng(h.seed + 1)
        table_salt = rng.integers(1, 2**62, h.tables).astype(np.int64)[some]
        salt = (rng.integers(1, 2**62, (m, h.tables)).astype(np.int64).T | 1)[some]
        tables = len(table_salt)
        order_sets = probe_order(m, h.probes)
        for batch in batches:
            all_ids, lists = batch.column("id").to_numpy(), batch.column("bits")
            base, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for lo in range(0, len(all_ids), 1000):
                hi = min(lo + 1000, len(all_ids))
                ids = all_ids[lo:hi]
                n = hi - lo
                start = base[lo:hi] - base[lo]
                y = np.empty((n, draw.shape[1]))
                for c in range(0, draw.shape[1], 64):
                    y[:, c : c + 64] = np.add.reduceat(draw[values[base[lo] : base[hi]], c : c + 64], start, axis=0)
                f = np.log(np.maximum(np.abs(y), 1e-300)) / h.width + offset
                cell = np.floor(f)
                inside = (f - cell).reshape(n, tables, m)
                code = (cell.astype(np.int64) * 2 + (y > 0)).reshape(n, tables, m)
                with np.errstate(over="ignore"):
                    key = (code * salt).sum(2) + table_salt
                    near = np.argsort(np.concatenate([inside, 1 - inside], 2), axis=2)
                    found = [key]
                    for ranks in order_sets:
                        moved = key.copy()
                        for r in ranks:
                            w = near[:, :, r]
                            function, up = w % m, np.where(w < m, -1, 1)
                            moved += up * 2 * np.take_along_axis(np.broadcast_to(salt, (n, tables, m)), function[:, :, None], 2)[:, :, 0]
                        found.append(moved)
                for i, k in enumerate(found):
                    yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), pa.array(np.repeat(ids, tables)), pa.array(np.full(k.size, i == 0))], names=["key", "id", "own"])

    return keys


@dataclass
class _Vectors:
    """Ids in order, numbers of bits, and each bit with the place of its vector."""

    ids: np.ndarray
    sizes: np.ndarray
    bits: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> _Vectors:
        t = t.sort_by("id").combine_chunks()
        lists = t.column("bits").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        return cls(t.column("id").to_numpy(), sizes, lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes))


def _best(asked: _Vectors, stored: _Vectors, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids: each of `asked` with its k most similar of `stored`, ties by smaller id, or with all.

    Bits that many vectors of both sides have are counted by a product of matrices, the others along their lists.
    """
    n, out = len(stored.ids), []
    by_bit = np.argsort(stored.bits, kind="stable")
    holders, held = stored.at[by_bit], np.bincount(stored.bits, minlength=BITS)
    begin = np.cumsum(held) - held
    step = max(1, _TILE // max(n, 1))
    for lo in range(0, len(asked.ids) if n else 0, step):
        ids, sizes = asked.ids[lo : lo + step], asked.sizes[lo : lo + step]
        i, j = np.searchsorted(asked.at, [lo, lo + len(ids)])
        bits, row = asked.bits[i:j], asked.at[i:j] - lo
        common = np.bincount(bits, minlength=BITS) * held > len(ids) * n / 200
        shared = np.zeros((len(ids), n), np.float32)
        dense = np.nonzero(common)[0]
        for c in range(0, len(dense), 512):
            column = np.full(BITS, -1)
            column[dense[c : c + 512]] = np.arange(len(dense[c : c + 512]))
            left, right = np.zeros((len(ids), 512), np.float32), np.zeros((n, 512), np.float32)
            x, y = column[bits], column[stored.bits]
            left[row[x >= 0], x[x >= 0]] = 1
            right[stored.at[y >= 0], y[y >= 0]] = 1
            shared += left @ right.T
        bits, row = bits[~common[bits]], row[~common[bits]]
        total = np.cumsum(held[bits])
        done = 0
        while done < len(bits):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _TILE, "right")))
            count = held[bits[done:upto]]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            np.add.at(shared.reshape(-1), np.repeat(row[done:upto] * n, count) + holders[np.repeat(begin[bits[done:upto]], count) + within], 1)
            done = upto
        # similarities differ by 1 / BITS^2 at least, so the place, which is the order of ids, only parts ties
        far = np.arange(n) * 1e-13 - shared / (sizes[:, None] + stored.sizes[None, :] - shared.astype(float))
        own = np.minimum(np.searchsorted(stored.ids, ids), n - 1)
        same = np.nonzero(stored.ids[own] == ids)[0]
        far[same, own[same]] = 2
        if k is None or k >= n:
            r, c = np.nonzero(far < 2)
        else:
            c = np.argpartition(far, k - 1, axis=1)[:, :k]
            r, keep = np.repeat(np.arange(len(ids)), k), np.take_along_axis(far, c, 1).reshape(-1) < 2
            r, c = r[keep], c.reshape(-1)[keep]
        out.append((ids[r], stored.ids[c]))
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


STORED, OWN, PROBING = 0, 1, 2


def _comparer(k: int | None):
    def compare(t: pa.Table) -> pa.Table:
        stored, own, probing = (_Vectors.of(t.filter(pc.equal(t.column("role"), role))) for role in (STORED, OWN, PROBING))
        found = [_best(own, stored, k), _best(probing, stored, k)]
        if k is not None:
            found.append(_best(stored, probing, k))  # a vector's neighbour may be one that only looked in
        x, y = (np.concatenate([f[side] for f in found]) for side in (0, 1))
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return compare


def clean_bits(bits: Column) -> Column:
    """Sorted distinct positions within the fingerprint; null has none."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(bits, F.array().cast("array<int>")), lambda b: (b >= 0) & (b < BITS))))


def newest_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(chunk_id, bits) of the row with the latest `written_at` of each chunk, of either kind; ties take the larger bits."""
    rows = fingerprints.where("chunk_id is not null").select("chunk_id", "written_at", "bits")
    newest = rows.groupBy("chunk_id").agg(F.max(F.struct("written_at", "bits")).alias("r"))
    return newest.select("chunk_id", clean_bits(F.col("r.bits")).alias("bits"))


def rounds_for(sets: DataFrame, h: Hashing) -> int:
    return _ROUNDS if sets.count() * h.tables * (1 + h.probes) > _PART_ROWS else 1


def candidate_pairs(sets: DataFrame, h: Hashing, k: int | None = None) -> DataFrame:
    """(a, b) with a < b of `sets` (id, bits) that some table brings together.

    A bucket belongs to one table, so the tables are gone through in rounds. The rows of a bucket of more than a few hundred
    vectors are not joined: all that are stored in it or look into it
    are compared there, exactly, in blocks of vectors, and with a `k` only each one's k most similar are given.
    """
    rounds = min(rounds_for(sets, h), h.tables)
    ends = [h.tables * i // rounds for i in range(rounds + 1)]
    return reduce(DataFrame.unionByName, [_met(sets, h, slice(lo, hi), k) for lo, hi in zip(ends, ends[1:])]).distinct()


def _met(sets: DataFrame, h: Hashing, some: slice, k: int | None) -> DataFrame:
    """The candidates of `some` of the tables, as a table."""
    spark = sets.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sets.count() * (some.stop - some.start) * (1 + h.probes) // _PART_ROWS)
    # one exchange, which is used again: for the sizes of buckets, and for the rows of those where vectors meet
    keys = sets.mapInArrow(_hasher(h, some), _KEYS).where("key is not null").repartition(parts, "key")
    sizes = keys.groupBy("key").agg(F.count_if("own").alias("n"), F.count("*").alias("m"), F.min("id").alias("i0"), F.max("id").alias("i1"))
    sizes = sizes.where("n > 0 and i0 <> i1").select("key", "n", "m")
    rows = stage(keys.join(sizes.hint("shuffle_hash"), "key"), "buckets")
    few = rows.where(F.col("n") <= _PER_BUCKET)
    met = few.join(few.where("own").select("key", F.col("id").alias("x")), "key")
    met = met.where((~F.col("own") & (F.col("id") != F.col("x"))) | (F.col("id") < F.col("x")))
    pairs = met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))
    crowded = rows.where(F.col("n") > _PER_BUCKET)
    if crowded.take(1):
        pairs = pairs.unionByName(_compared(crowded, sets, k))
    pairs = stage(pairs.distinct(), "met")
    discard(rows)
    return pairs


def _compared(keys: DataFrame, sets: DataFrame, k: int | None) -> DataFrame:
    """(a, b) of the buckets' vectors. Every block of stored vectors meets every block of those that look in."""
    blocks = lambda n: F.ceil(F.col(n) / _BLOCK).cast("int")
    rows = keys.select("key", "id", "own", blocks("n").alias("n"), blocks("m").alias("m")).join(sets.select("id", F.col("bits").cast("array<short>").alias("bits")), "id")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = rows.where("own").select("key", block("n").alias("of"), each("m").alias("to"), "id", "bits", F.lit(STORED).alias("role"))
    asked = rows.select("key", each("n").alias("of"), block("m").alias("to"), "id", "bits", F.when(F.col("own"), OWN).otherwise(PROBING).alias("role"))
    return stored.unionByName(asked).groupBy("key", "of", "to").applyInArrow(_comparer(k), "a long, b long")


def similar_pairs(sets: DataFrame, h: Hashing, k: int | None = None) -> DataFrame:
    """(a, b, sim) of the candidates, with their exact Jaccard similarity."""
    pairs, rounds = stage(candidate_pairs(sets, h, k), "candidates"), rounds_for(sets, h)
    part = lambda x: F.pmod(F.xxhash64(x), F.lit(rounds))
    shared = F.size(F.array_intersect("ba", "bb"))
    similar = []
    for i in range(rounds):  # by the one side, whose bits go with the pair to the other
        a, b = sets.where(part("id") == i).select(F.col("id").alias("a"), F.col("bits").alias("ba")), sets.select(F.col("id").alias("b"), F.col("bits").alias("bb"))
        both = pairs.where(part("a") == i).join(a, "a").join(b, "b")
        similar.append(stage(both.select("a", "b", (shared / (F.size("ba") + F.size("bb") - shared)).alias("sim")), "compared"))
    return reduce(DataFrame.unionByName, similar)


def nearest(fingerprints: DataFrame, k: int = 5, h: Hashing = Hashing(), least: float = 0.0) -> DataFrame:
    """(chunk_id, neighbour, sim, place): up to k most similar chunks of every chunk's newest fingerprint, ties by smaller id.

    Fingerprints without bits are similar to nothing. Of a class of equal fingerprints each member gets the
    class's smallest ids first; no more than k+1 members of a class are ever looked at, so copies cost a row each.
    """
    newest = newest_fingerprints(fingerprints).withColumn("bits", F.col("bits").cast("array<short>")).where(F.size("bits") > 0)
    newest = stage(newest.withColumns({"h1": F.xxhash64("bits"), "h2": F.xxhash64(F.lit(1), "bits")}), "newest")
    of_class = Window.partitionBy("h1", "h2").orderBy("chunk_id")
    first = newest.select("h1", "h2", "chunk_id").withColumn("at", F.row_number().over(of_class)).where(F.col("at") <= k + 1)
    heads = stage(first.groupBy("h1", "h2").agg(F.min("chunk_id").alias("rep"), F.sort_array(F.collect_list("chunk_id")).alias("some")), "classes")
    sets = stage(newest.join(heads.select(F.col("rep").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("id"), "bits"), "sets")
    classed = stage(newest.select("chunk_id", "h1", "h2"), "classed")
    discard(newest)
    near = stage(similar_pairs(sets, h, k).where(F.col("sim") >= least), "similar")
    discard(sets)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    # the k best other classes hold the k best other members, since a class ranks by its smallest id
    best = both.withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "b"))).where(F.col("at") <= k)
    others = best.join(heads.select(F.col("rep").alias("b"), "some"), "b").select(F.col("a").alias("rep"), "sim", F.explode(F.slice("some", 1, k)).alias("neighbour"))
    others = others.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy(F.col("sim").desc(), "neighbour"))).where(F.col("at") <= k)
    others = others.groupBy("rep").agg(F.collect_list(F.struct((-F.col("sim")).alias("d"), F.col("neighbour").alias("n"))).alias("others"))
    members = classed.join(heads, ["h1", "h2"]).join(others, "rep", "left")
    own = F.transform("some", lambda m: F.struct(F.lit(-1.0).alias("d"), m.alias("n")))
    every = F.filter(F.concat(own, F.coalesce("others", F.array().cast("array<struct<d:double,n:bigint>>"))), lambda e: e.n != F.col("chunk_id"))
    listed = members.select("chunk_id", F.posexplode(F.slice(F.array_sort(every), 1, k)).alias("at", "e"))
    return listed.select("chunk_id", F.col("e.n").alias("neighbour"), (-F.col("e.d")).alias("sim"), (F.col("at") + 1).alias("place"))


def mutual_or_single_pairs(fingerprints: DataFrame, k: int = 5, least: float = 0.5, h: Hashing = Hashing()) -> DataFrame:
    """(a, b) with a < b, similarity of at least `least`, at least one among the other's k most similar."""
    near = nearest(fingerprints, k, h, least).where(F.col("sim") >= least)
    return near.select(F.least("chunk_id", "neighbour").alias("a"), F.greatest("chunk_id", "neighbour").alias("b")).distinct()
