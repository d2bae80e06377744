"""A stated set of queries against all rows, in blocks, with the best k of every query.

Both sides are written as blocks, some hundred rows as one value. Every block of queries meets
every block of rows in one of the tasks of a product of the two tables, which scores all its
pairs by array operations and keeps each query's k best over the blocks that it goes through.
So no pair is ever a row of a shuffle and no block is written more often than once: on disk are
the two sides and each task's k rows per query, however many blocks there are. Rows are sparse
vectors (lists of feature numbers and weights); features that many rows of both sides have are
summed by a product of matrices, the others along their lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import discard, stage, together

STORED, ASKED, LEAST = 4096, 1024, 256  # rows and queries of a block; no block of rows is made smaller than LEAST to keep cores busy
_SPARE = 16  # rows per query and block beyond k, since ranks go by scores rounded elsewhere
_TILE = 4_000_000
_SLICE = 200_000  # rows that are handed on at once
_PARTS = 20_000
_BYTES = 3_000_000  # of a block
_RUN = 32  # blocks of rows that one task goes through
_DENSE = 0.01  # share of a block's pairs that have a feature on both sides, from which matrices are cheaper


class Sparse:
    """Rows of lists, as arrays: the row and the feature of every entry."""

    def __init__(self, table: pa.Table, features: str) -> None:
        lists = table.column(features).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.n, self.sizes = len(sizes), sizes
        self.row = np.repeat(np.arange(self.n), sizes)
        self.feature = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def column(table: pa.Table, name: str) -> np.ndarray:
    """A column as numbers, or the flattened entries of a column of lists."""
    c = table.column(name).combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return (c.flatten() if pa.types.is_list(c.type) else c).to_numpy(zero_copy_only=False)


def product(n: int, m: int, row: np.ndarray, feature: np.ndarray, weight: np.ndarray, other_row: np.ndarray, other_feature: np.ndarray, other_weight: np.ndarray) -> np.ndarray:
    """(n, m) sums over features of the products of weights, in the weights' type. No row has a feature twice."""
    names = np.unique(feature)
    out = np.zeros((n, m), np.result_type(weight, other_weight, np.float32))
    if not len(names) or not m:
        return out
    x = np.searchsorted(names, feature)
    y = np.minimum(np.searchsorted(names, other_feature), len(names) - 1)
    met = names[y] == other_feature
    y, col, wy = y[met], other_row[met], other_weight[met]
    order = np.argsort(y, kind="stable")
    y, col, wy = y[order], col[order], wy[order]
    held = np.bincount(y, minlength=len(names))
    begin = np.cumsum(held) - held
    dense = np.bincount(x, minlength=len(names)) * held > max(_DENSE * n * m, 64)
    hot = np.nonzero(dense)[0]
    place = np.full(len(names), -1)
    for lo in range(0, len(hot), 512):
        some = hot[lo : lo + 512]
        place[:] = -1
        place[some] = np.arange(len(some))
        left, right = np.zeros((n, len(some)), out.dtype), np.zeros((len(some), m), out.dtype)
        on = place[x] >= 0
        left[row[on], place[x[on]]] = weight[on]
        on = place[y] >= 0
        right[place[y[on]], col[on]] = wy[on]
        out += left @ right
    rare = ~dense[x] & (held[x] > 0)
    x, r, w = x[rare], row[rare], weight[rare]
    total, flat, done = np.cumsum(held[x]), out.reshape(-1), 0
    while done < len(x):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _TILE, "right")))
        count = held[x[done:upto]]
        at = np.repeat(begin[x[done:upto]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        np.add.at(flat, np.repeat(r[done:upto] * m, count) + col[at], np.repeat(w[done:upto], count) * wy[at])
        done = upto
    return out


def common(q: Sparse, d: Sparse, lo: int = 0, hi: int = 1 << 62) -> np.ndarray:
    """(n, m) numbers of features in [lo, hi) that both rows have."""
    x, y = (q.feature >= lo) & (q.feature < hi), (d.feature >= lo) & (d.feature < hi)
    return product(q.n, d.n, q.row[x], q.feature[x], np.ones(x.sum(), np.float32), d.row[y], d.feature[y], np.ones(y.sum(), np.float32))


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores, ties by column; -inf is no score."""
    n, m = scores.shape
    if k >= m:
        return np.nonzero(scores > -np.inf)
    last = float((1 << 61) // m)  # times m, still a 64-bit number
    key = np.where(scores > -np.inf, np.minimum(np.rint(np.nan_to_num(scores, neginf=0.0) * -1e9), last - 1), last)
    key = key.astype(np.int64) * m + np.arange(m)
    c = np.argpartition(key, k - 1, axis=1)[:, :k]
    r, c = np.repeat(np.arange(n), k), c.reshape(-1)
    good = scores[r, c] > -np.inf
    return r[good], c[good]


def _packer(rows: int):
    """Blocks of up to `rows` rows in order of `key`, and of no more than about `_BYTES`, as Arrow streams."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t, sink = pa.Table.from_batches(held).sort_by("key").combine_chunks(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(t)
        return pa.record_batch({"block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full = [], 0.0
        for b in batches:
            most, at = max(1, min(rows, int(b.num_rows * _BYTES / max(b.nbytes, 1)))), 0  # such rows to a block
            while at < b.num_rows:
                n = max(1, min(b.num_rows - at, int((1 - full) * most)))
                held.append(b.slice(at, n))
                at, full = at + n, full + n / most
                if full + 1 / most > 1:
                    yield packed(held)
                    held, full = [], 0.0
        if held:
            yield packed(held)

    return pack


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    for b in batches:
        for asked, stored in zip(b.column("asked"), b.column("stored")):
            yield tuple(pa.ipc.open_stream(x.as_buffer()).read_all() for x in (asked, stored))


def over_blocks(queries: DataFrame, stored: DataFrame, meet: Callable[[Iterator[tuple[pa.Table, pa.Table]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `meet` makes of the blocks of `queries` (qid, ...), each with blocks of `stored` (id, ...) one after another.

    It gets pairs of a table of queries and one of rows in order of ids, each with `key`. Rows without an id are left
    out. Nothing is made of an empty side.
    """
    spark = queries.sparkSession
    sides = together(lambda: stage(queries.where("qid is not null"), "asked"), lambda: stage(stored.where("id is not null"), "stored"))
    cores = spark.sparkContext.defaultParallelism
    rows = min(STORED, max(LEAST, -(-sides[1].count() // cores)))

    def packed(df: DataFrame, ident: str, most: int, name: str) -> DataFrame:
        keyed = df.select(F.col(ident).cast("long").alias("key"), *[c for c in df.columns if c != ident])
        out = stage(keyed.mapInArrow(_packer(most), "block binary"), name)
        discard(df)
        return out.withColumnRenamed("block", name)

    a, s = together(lambda: packed(sides[0], "qid", ASKED, "asked"), lambda: packed(sides[1], "id", rows, "stored"))
    to, of = a.count(), s.count()
    parts = max(1, min(of, max(-(-4 * cores // max(to, 1)), -(-of // _RUN))))
    both = a.repartition(max(1, min(to, _PARTS // parts))).hint("shuffle_replicate_nl").crossJoin(s.repartition(parts))
    return both.mapInArrow(lambda batches: meet(_cells(batches)), schema)


def in_blocks(queries: DataFrame, stored: DataFrame, reduce: Callable[[pa.Table, pa.Table], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `reduce` makes of every block of `queries` with every block of `stored`; see `over_blocks`."""

    def meet(cells: Iterator[tuple[pa.Table, pa.Table]]) -> Iterator[pa.RecordBatch]:
        for asked, rows in cells:
            out = reduce(asked, rows)
            for part in [out] if isinstance(out, pa.RecordBatch) else out:
                for lo in range(0, part.num_rows, _SLICE):
                    yield part.slice(lo, _SLICE)

    return over_blocks(queries, stored, meet, schema)


class _Best:
    """Each query's best rows so far, `k` and those that ranks by scores rounded elsewhere might prefer."""

    def __init__(self, asked: pa.Table, k: int) -> None:
        self.keys, self.k = column(asked, "key"), k
        self.row, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(len(self.keys), -np.inf)  # what the k-th best has

    def add(self, asked: pa.Table, rows: pa.Table, score: Callable, above: Callable | None) -> None:
        most, ids = self.k + _SPARE, column(rows, "key")
        if above and np.isfinite(self.least).all():
            r, c, s = above(asked, rows, self.least - 2e-9)
        else:
            every = score(asked, rows)
            if every.max(initial=-np.inf) == -np.inf:
                return
            r, c = np.divmod(np.flatnonzero(every >= (self.least - 2e-9)[:, None]), every.shape[1]) if np.isfinite(self.least).all() else _best(every, most)
            s = every[r, c]
        if not len(r):
            return
        row, ident, score = np.concatenate([self.row, r]), np.concatenate([self.id, ids[c]]), np.concatenate([self.score, s])
        order = np.lexsort((ident, np.rint(score * -1e9), row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.row, self.id, self.score = row[place < most], ident[order][place < most], score[order][place < most]
        last = place == self.k - 1
        self.least[row[last]] = score[order][last]

    def batch(self) -> pa.RecordBatch:
        on = self.score >= self.least[self.row] - 2e-9
        return pa.record_batch({"qid": pa.array(self.keys[self.row[on]]), "id": pa.array(self.id[on]), "score": pa.array(self.score[on])})


def top_scores(queries: DataFrame, stored: DataFrame, score: Callable[[pa.Table, pa.Table], np.ndarray], k: int, above: Callable | None = None) -> DataFrame:
    """(qid, id, score) of candidates, which hold each query's k best; `score` gives a matrix, -inf where a pair is none.

    `above` gives the rows, columns and scores of all pairs with no less than a number per query, where that is cheaper.
    """

    def meet(cells: Iterator[tuple[pa.Table, pa.Table]]) -> Iterator[pa.RecordBatch]:
        best = None
        for asked, rows in cells:
            if best is None or not np.array_equal(best.keys, column(asked, "key")):
                if best:
                    yield best.batch()
                best = _Best(asked, k)
            best.add(asked, rows, score, above)
        if best:
            yield best.batch()

    return over_blocks(queries, stored, meet, "qid long, id long, score double")


def top_k(scored: DataFrame, k: int, ident: str = "id", name: str = "rank") -> DataFrame:
    """The `k` best of each `qid` by `score`, ties by id, numbered from 1."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), ident))
    return scored.withColumn(name, place).where(F.col(name) <= k)
