"""Batch retrieval: lexical and semantic lanes, fusion, parents, reranking.

Every step takes all queries at once. Ranks go by `round(score, 9) desc, id`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import EngineConfig
from palimpsest.functions.hashing import band_hashes, band_values, mixed
from palimpsest.functions.text import ascii_lower, tokens
from palimpsest.operators import blocks
from palimpsest.operators.blocks import top_k
from palimpsest.session import stage


def _likelihood(mu: float):
    def score(asked: pa.Table, stored: pa.Table) -> np.ndarray:
        q, d = blocks.Sparse(asked, "f"), blocks.Sparse(stored, "f")
        names, first = np.unique(q.feature, return_index=True)
        rarity = blocks.column(asked, "c")[first]
        at = np.minimum(np.searchsorted(names, d.feature), max(len(names) - 1, 0))
        met = names[at] == d.feature if len(names) else np.zeros(len(at), bool)
        if not met.any():
            return np.full((q.n, d.n), -np.inf)
        gain = np.log1p(blocks.column(stored, "w")[met] * rarity[at[met]])
        s = blocks.product(q.n, d.n, q.row, q.feature, blocks.column(asked, "w"), d.row[met], d.feature[met], gain)
        shift = blocks.column(asked, "len").astype(float)[:, None] * np.log(mu / (np.nan_to_num(blocks.column(stored, "len").astype(float)) + mu))[None, :]
        return np.where(s > 0, s + shift, -np.inf)

    return score


def lexical(queries: DataFrame, post: DataFrame, stats: DataFrame, lens: DataFrame, k: int, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(qid, id, score, rank) by query likelihood with Dirichlet smoothing; unknown query terms count in the length only.

    Queries and rows meet in blocks, where a term that is in every row is a row of a matrix and no hot key. Terms
    go by 64-bit hashes there.
    """
    total = stats.agg(F.sum("cf").cast("double").alias("total"))
    q = queries.select("qid", tokens(F.col("text")).alias("t"))
    terms = q.select("qid", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("w"), F.first("len").alias("len"))
    known = terms.join(stats.select("term", "cf"), "term").join(F.broadcast(total))  # one row
    entry = F.struct(F.xxhash64("term").alias("f"), "w", (F.col("total") / (F.lit(cfg.dirichlet_mu) * F.col("cf"))).alias("c"))
    asked = known.groupBy("qid").agg(F.collect_list(entry).alias("e"), F.first("len").cast("long").alias("len")).select("qid", "e.f", "e.w", "e.c", "len")
    rows = post.groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("f"), F.col("tf").cast("double").alias("w"))).alias("e")).select("id", "e.f", "e.w")
    rows = rows.join(lens.select("id", F.col("len").cast("long").alias("len")), "id", "left")
    return top_k(blocks.top_scores(asked, rows, _likelihood(cfg.dirichlet_mu), k), k)


def lexical_within(queries: DataFrame, docs: DataFrame, k: int, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(qid, id, score, rank): `lexical` with an index of its own for every namespace; `queries` (ns, qid, text), `docs` (ns, id, text).

    Features stand for a term of a namespace, so rows of others have none in common. Blocks are of one namespace or few.
    """
    t, mu = tokens(F.col("text")), F.lit(cfg.dirichlet_mu)
    stats = docs.select("ns", F.explode(t).alias("term")).groupBy("ns", "term").agg(F.count("*").alias("cf"))
    total = stats.groupBy("ns").agg(F.sum("cf").cast("double").alias("total"))
    terms = queries.select("ns", "qid", F.size(t).alias("len"), F.explode(t).alias("term")).groupBy("ns", "qid", "term").agg(F.count("*").cast("double").alias("w"), F.first("len").alias("len"))
    known = terms.join(stats, ["ns", "term"]).join(total, "ns")
    entry = F.struct(F.xxhash64("ns", "term").alias("f"), "w", (F.col("total") / (mu * F.col("cf"))).alias("c"))
    asked = known.groupBy("ns", "qid").agg(F.collect_list(entry).alias("e"), F.first("len").cast("long").alias("len"))
    asked = asked.repartitionByRange("ns", "qid").sortWithinPartitions("ns", "qid").select("qid", "e.f", "e.w", "e.c", "len")
    cores = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = docs.where("id is not null").repartitionByRange(cores, "ns", "id").sortWithinPartitions("ns", "id")
    rows = near.select("id", F.transform(t, lambda x: F.xxhash64("ns", x)).alias("f")).mapInArrow(_counted, "id long, f array<long>, w array<int>, len long")
    return top_k(blocks.top_scores(asked, rows, _likelihood(cfg.dirichlet_mu), k), k)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of features as distinct ones, how often each occurs, and how many there were."""
    for b in batches:
        x = blocks.Sparse(pa.Table.from_batches([b]), "f")
        f = x.feature[np.lexsort((x.feature, x.row))]
        first = np.nonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (x.row[1:] != x.row[:-1])]))[0] if len(f) else np.empty(0, np.int64)
        at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(x.row[first], minlength=x.n))]).astype(np.int32))
        times = np.diff(np.append(first, len(f))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.ListArray.from_arrays(at, pa.array(f[first])), pa.ListArray.from_arrays(at, pa.array(times)), pa.array(x.sizes)], names=["id", "f", "w", "len"])


def bands(prints: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(id, hashes): a hash per band of the fingerprint."""
    return prints.select("id", band_hashes("bits", F.lit(cfg.lsh_bands), F.lit(cfg.lsh_rows)).alias("hashes"))


def _filled(df: DataFrame, cfg: EngineConfig, name: str) -> DataFrame:
    """`df` with the bands that have bits, (band, hash), as `name`."""
    hashes, empty = f"{name}_h", f"{name}_e"
    h = df.withColumns({hashes: band_hashes("bits", F.lit(cfg.lsh_bands), F.lit(cfg.lsh_rows)), empty: band_hashes(F.array().cast("array<int>"), F.lit(cfg.lsh_bands), F.lit(cfg.lsh_rows))})
    on = F.filter(F.transform(hashes, lambda x, i: F.struct(i.alias("band"), x.alias("hash"), (x != F.col(empty)[i]).alias("on"))), lambda s: s.on)
    return h.withColumn(name, on).drop(hashes, empty)


def band_candidates(queries: DataFrame, prints: DataFrame, least: int = 2, empty_bands: bool = True, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(qid, id, hits) of pairs that agree in at least `least` bands; `queries` (qid, bits), `prints` (id, bits).

    Bands with bits meet on (band, hash). Bands empty in both are counted, not joined: their number follows from
    the non-empty bands of either side and those both have. `empty_bands=False` leaves them out, which is
    selective where the faithful rule lets nearly every pair through; its pairs are found where blocks meet.
    """
    if not empty_bands:
        return blocks.in_blocks(_short(queries.select("qid", "bits")), _short(prints.select("id", "bits")), _meeting_bands(least, cfg), "qid long, id long, hits long")
    q, d = _filled(queries, cfg, "b").select("qid", "b"), _filled(prints, cfg, "b").select("id", "b")
    rows = lambda df, ident: df.select(ident, F.explode("b").alias("x")).select(ident, "x.band", "x.hash")
    met = rows(q, "qid").join(rows(d, "id"), ["band", "hash"]).groupBy("qid", "id").agg(F.count("*").alias("same"))
    qs, ds = q.select("qid", F.transform("b", lambda s: s.band).alias("qb")), d.select("id", F.transform("b", lambda s: s.band).alias("db"))
    pairs = ds.join(qs).withColumn("void", cfg.lsh_bands - F.size(F.array_union("qb", "db")))  # a stated query set against all rows
    return pairs.join(met, ["qid", "id"], "left").select("qid", "id", (F.coalesce("same", F.lit(0)) + F.col("void")).alias("hits")).where(F.col("hits") >= least)


def _meeting_bands(least: int, cfg: EngineConfig):
    """Pairs of a block that agree in at least `least` bands with bits."""

    def filled(x: blocks.Sparse) -> tuple[np.ndarray, np.ndarray]:
        void, h = band_values(1, *(np.empty(0, np.int64),) * 2, cfg.lsh_bands, cfg.lsh_rows), band_values(x.n, x.row, x.feature, cfg.lsh_bands, cfg.lsh_rows)
        row, band = np.nonzero(h != void)
        # one number for the band and its content
        return row, mixed(h[row, band] ^ mixed(band.astype(np.uint64) + np.uint64(1)))

    def reduce(asked: pa.Table, stored: pa.Table) -> pa.RecordBatch:
        q, d = blocks.Sparse(asked, "bits"), blocks.Sparse(stored, "bits")
        (qr, qh), (dr, dh) = filled(q), filled(d)
        order = np.argsort(dh)
        dr, dh = dr[order], dh[order]
        begin = np.searchsorted(dh, qh, "left")
        n = np.searchsorted(dh, qh, "right") - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell, hits = np.unique(np.repeat(qr, n) * d.n + dr[at], return_counts=True)
        cell, hits = cell[hits >= least], hits[hits >= least]
        r, c = np.divmod(cell, d.n)
        return pa.record_batch({"qid": pa.array(blocks.column(asked, "key")[r]), "id": pa.array(blocks.column(stored, "key")[c]), "hits": pa.array(hits.astype(np.int64))})

    return reduce


def region_counts(queries: DataFrame, prints: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(qid, id, i_token, i_bigram, i_context): common bits per region of pairs that have any, counted where blocks meet."""
    names = [f"i_{n}" for n, *_ in cfg.regions]

    def reduce(asked: pa.Table, stored: pa.Table) -> Iterator[pa.RecordBatch]:
        q, d = blocks.Sparse(asked, "bits"), blocks.Sparse(stored, "bits")
        qid, ident = blocks.column(asked, "key"), blocks.column(stored, "key")
        both = [blocks.common(q, d, lo, hi) for _, lo, hi, _ in cfg.regions]
        for at in range(0, q.n, 64):  # nearly every pair is a row, so some queries at once
            r, c = np.nonzero(sum(x[at : at + 64] for x in both))
            yield pa.record_batch({"qid": pa.array(qid[r + at]), "id": pa.array(ident[c])} | {n: pa.array(x[r + at, c].astype(np.int64)) for n, x in zip(names, both)})

    return blocks.in_blocks(_short(queries.select("qid", "bits")), _short(prints.select("id", "bits")), reduce, "qid long, id long, " + ", ".join(f"{n} long" for n in names))


def _within(lo: int, hi: int):
    return lambda b: (b >= lo) & (b < hi)


def region_sizes(df: DataFrame, prefix: str, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    return df.withColumns({f"{prefix}_{n}": F.size(F.filter("bits", _within(lo, hi))) for n, lo, hi, _ in cfg.regions})


def jaccard(inter: Column, a: Column, b: Column) -> Column:
    """Jaccard of two sets by their sizes; two empty ones are equal."""
    union = a + b - inter
    return F.when(union == 0, 1.0).otherwise(inter / union)


def _agreeing_bands(q: blocks.Sparse, d: blocks.Sparse, cfg: EngineConfig) -> np.ndarray:
    """Bands of equal content, those empty in both included, of every pair of a block."""
    segments = cfg.bits // 64
    held = [[] for _ in range(segments)]  # the bands that each segment is in
    for band in range(cfg.lsh_bands):
        for i in range(cfg.lsh_rows):
            held[(band * cfg.lsh_rows + i) % segments].append(band)
    most = max(map(len, held))
    of = np.array([h + [-1] * (most - len(h)) for h in held])

    def contents(x: blocks.Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bands = of[x.feature // 64]
        row, bit = np.repeat(x.row, most)[bands.reshape(-1) >= 0], np.repeat(x.feature, most)[bands.reshape(-1) >= 0]
        key = row * cfg.lsh_bands + bands.reshape(-1)[bands.reshape(-1) >= 0]
        with np.errstate(over="ignore"):
            sums = np.zeros(x.n * cfg.lsh_bands, np.uint64)
            np.add.at(sums, key, mixed(bit.astype(np.uint64)))
            used = np.unique(key)
            return used // cfg.lsh_bands, used % cfg.lsh_bands, mixed(sums[used] ^ mixed((used % cfg.lsh_bands + 1).astype(np.uint64) << np.uint64(32))).view(np.int64)

    (qr, qb, qc), (dr, db, dc) = contents(q), contents(d)
    left, right = np.ones((q.n, cfg.lsh_bands), np.float32), np.ones((d.n, cfg.lsh_bands), np.float32)
    left[qr, qb] = right[dr, db] = 0
    void = left @ right.T
    if void.min(initial=2) >= 2:  # all pass
        return void
    return void + blocks.product(q.n, d.n, qr, qc, np.ones(len(qr)), dr, dc, np.ones(len(dr)))


def _short(df: DataFrame) -> DataFrame:
    """Positions in two bytes: a fingerprint has fewer than 2^15."""
    return df.withColumn("bits", F.col("bits").cast("array<short>"))


def _weighted_jaccard(cfg: EngineConfig, lsh: str):
    def score(asked: pa.Table, stored: pa.Table) -> np.ndarray:
        q, d = blocks.Sparse(asked, "bits"), blocks.Sparse(stored, "bits")
        out = np.zeros((q.n, d.n))
        for _, lo, hi, weight in cfg.regions:
            x, y = (q.feature >= lo) & (q.feature < hi), (d.feature >= lo) & (d.feature < hi)
            both = blocks.product(q.n, d.n, q.row[x], q.feature[x], np.ones(x.sum()), d.row[y], d.feature[y], np.ones(y.sum()))
            union = np.bincount(q.row[x], minlength=q.n)[:, None] + np.bincount(d.row[y], minlength=d.n)[None, :] - both
            out += weight * np.where(union == 0, 1.0, both / np.maximum(union, 1))
        return np.where(_agreeing_bands(q, d, cfg) >= 2, out, -np.inf) if lsh == "faithful" else out

    return score


def _weighted_jaccard_above(cfg: EngineConfig):
    """All pairs that reach a score per query; single precision tells which to count exactly."""

    def above(asked: pa.Table, stored: pa.Table, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, d = blocks.Sparse(asked, "bits"), blocks.Sparse(stored, "bits")
        sizes = lambda x, lo, hi: np.bincount(x.row[(x.feature >= lo) & (x.feature < hi)], minlength=x.n)
        held, rough, part = [], np.zeros((q.n, d.n), np.float32), np.empty((q.n, d.n), np.float32)
        for _, lo, hi, weight in cfg.regions:
            both, a, b = blocks.common(q, d, lo, hi), sizes(q, lo, hi), sizes(d, lo, hi)
            np.add(a.astype(np.float32)[:, None], b.astype(np.float32)[None, :], out=part)
            part -= both
            void = np.ix_(a == 0, b == 0)
            part[void] = 1
            np.divide(both, part, out=part)
            part[void] = 1
            part *= np.float32(weight)
            rough += part
            held.append((weight, both, a, b))
        r, c = np.divmod(np.flatnonzero(rough >= (least - 1e-5).astype(np.float32)[:, None]), d.n)
        s = np.zeros(len(r))
        for weight, both, a, b in held:
            n = both[r, c].astype(float)
            union = a[r] + b[c] - n
            s += weight * np.where(union == 0, 1.0, n / np.maximum(union, 1))
        on = s >= least[r]
        return r[on], c[on], s[on]

    return above


def semantic(queries: DataFrame, prints: DataFrame, k: int, cfg: EngineConfig = EngineConfig(), lsh: str = "faithful") -> DataFrame:
    """(qid, id, score, rank) by region-weighted Jaccard of candidates. `lsh`: `faithful`, `nonzero` or `off`.

    Nearly every pair passes the faithful rule, so queries and rows meet in blocks; `nonzero` joins on the bands.
    """
    queries, prints = queries.select("qid", "bits"), prints.select("id", "bits")
    if lsh != "nonzero":
        queries, prints = _short(queries), _short(prints)
        return top_k(blocks.top_scores(queries, prints, _weighted_jaccard(cfg, lsh), k, _weighted_jaccard_above(cfg) if lsh == "off" else None), k)
    q = region_sizes(queries, "q", cfg).withColumnRenamed("bits", "qb")
    d = region_sizes(prints, "d", cfg).withColumnRenamed("bits", "db")
    pairs = band_candidates(queries, prints, 2, False, cfg).select("qid", "id").join(q, "qid").join(d, "id").withColumn("both", F.array_intersect("qb", "db"))
    score = F.lit(0.0)
    for n, lo, hi, w in cfg.regions:
        score = score + w * jaccard(F.size(F.filter("both", _within(lo, hi))), F.col(f"q_{n}"), F.col(f"d_{n}"))
    return top_k(pairs.select("qid", "id", score.alias("score")), k)


def _jaccards(asked: pa.Table, stored: pa.Table) -> np.ndarray:
    q, d = blocks.Sparse(asked, "bits"), blocks.Sparse(stored, "bits")
    both = blocks.product(q.n, d.n, q.row, q.feature, np.ones(len(q.row)), d.row, d.feature, np.ones(len(d.row)))
    out = both / np.maximum(q.sizes[:, None] + d.sizes[None, :] - both, 1)
    return np.where(blocks.column(asked, "key")[:, None] == blocks.column(stored, "key")[None, :], -np.inf, out)


def _jaccards_above(asked: pa.Table, stored: pa.Table, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs that reach a similarity per query: they have so many bits in common, with the smallest row even."""
    q, d = blocks.Sparse(asked, "bits"), blocks.Sparse(stored, "bits")
    both = blocks.common(q, d)
    enough = least / (1 + least) * (q.sizes + d.sizes.min()) - 1e-3
    r, c = np.divmod(np.flatnonzero(both >= enough.astype(np.float32)[:, None]), d.n)
    n = both[r, c].astype(float)
    s = n / np.maximum(q.sizes[r] + d.sizes[c] - n, 1)
    on = (s >= least[r]) & (blocks.column(asked, "key")[r] != blocks.column(stored, "key")[c])
    return r[on], c[on], s[on]


def plain_jaccard(queries: DataFrame, prints: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) by Jaccard similarity over all bits, itself left out; two rows without bits have 0."""
    return top_k(blocks.top_scores(_short(queries.select("qid", "bits")), _short(prints.select("id", "bits")), _jaccards, k, _jaccards_above), k)


def fused_scores(lanes: list[DataFrame], cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(qid, id, score): the sums of the lanes' reciprocal ranks, each raised by how its score lies within its lane's."""
    every = None
    for lane in lanes:
        w = Window.partitionBy("qid")
        spread = F.max("score").over(w) - F.min("score").over(w)
        share = F.when(spread <= 1e-9, 1.0).otherwise((F.col("score") - F.min("score").over(w)) / spread)
        part = lane.select("qid", "id", ((1.0 / (cfg.rrf_k + F.col("rank"))) * (1 + share)).alias("c"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("qid", "id").agg(F.sum("c").alias("score"))


def fuse(lanes: list[DataFrame], k: int, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(qid, id, score, rank) by score-aware reciprocal ranks of the lanes' (qid, id, score, rank) rows."""
    return top_k(fused_scores(lanes, cfg), k)


def to_parents(fused: DataFrame, chunk_parents: DataFrame) -> DataFrame:
    """(qid, id, score): the best score over a parent's chunks; a chunk without a parent is its own."""
    own = fused.join(chunk_parents.select(F.col("chunk_id").alias("id"), "parent_id"), "id", "left")
    return own.groupBy("qid", F.coalesce("parent_id", "id").alias("id")).agg(F.max("score").alias("score"))


def rerank(queries: DataFrame, candidates: DataFrame, docs: DataFrame, idf: DataFrame, lens: DataFrame, avg_len: float, k: int, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(qid, id, score, rank): the first `rerank_depth` candidates get boosts for coverage, phrases and length and stay ahead of the rest."""
    ranked = stage(top_k(candidates, k, name="before"), "ranked")  # k rows a query, read as head and as tail
    q = queries.select("qid", tokens(F.col("text")).alias("qt"))
    weights = q.select("qid", F.posexplode("qt").alias("pos", "term")).join(idf.select("term", "idf"), "term", "left")
    weights = weights.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "term", F.coalesce("idf", F.lit(0.0)).alias("w")))).alias("qw"))
    q = q.join(weights, "qid", "left")
    d = docs.select("id", ascii_lower(F.coalesce("text", F.lit(""))).alias("low"), F.array_distinct(tokens(F.col("text"))).alias("dt"))
    head = ranked.where(F.col("before") <= cfg.rerank_depth).join(q, "qid").join(d, "id", "left").join(lens, "id", "left")
    # few rows, of which each takes long: they are spread over all cores, however few bytes they have
    cores = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head = head.repartition(max(cores, queries.sparkSession.sparkContext.defaultParallelism), "qid", "id")
    hit = F.filter("qw", lambda x: F.array_contains("dt", x.term))
    add = lambda a: F.aggregate(F.transform(a, lambda x: x.w), F.lit(0.0), lambda s, x: s + x)
    n = F.size("qt")
    plain = F.when(n == 0, 0.0).otherwise(F.size(F.filter("qt", lambda t: F.array_contains("dt", t))) / n)
    cover = F.when(add("qw") > 0, add(hit) / add("qw")).otherwise(plain)
    grams = F.when(n > 1, F.zip_with(F.slice("qt", 1, n - 1), F.slice("qt", 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    phrase = F.when(n > 1, F.size(F.filter(grams, lambda g: F.contains(F.col("low"), g))) / (n - 1)).otherwise(0.0)
    size = 1.0 / (1.0 + F.log(1.0 + F.coalesce("len", F.lit(0)) / F.lit(max(1.0, avg_len)))) if avg_len > 0 else F.lit(1.0)
    boosted = head.select("qid", "id", (F.col("score") + cfg.rerank_idf_weight * cover + cfg.rerank_phrase_weight * phrase + cfg.rerank_len_weight * size).alias("score"), F.lit(1).alias("head"))
    tail = ranked.where(F.col("before") > cfg.rerank_depth).select("qid", "id", "score", F.lit(0).alias("head"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("head").desc(), F.round("score", 9).desc(), "id"))
    return boosted.unionByName(tail).withColumn("rank", place).drop("head")


def _dots(asked: pa.Table, stored: pa.Table) -> np.ndarray:
    """Dot products; -inf for a row with itself and where the lengths differ."""
    q, d = (pc.fill_null(pc.list_value_length(t.column("v")), 0).to_numpy() for t in (asked, stored))
    out = np.full((len(q), len(d)), -np.inf)
    qv, dv = (blocks.column(t, "v").astype(float) for t in (asked, stored))
    for n in np.intersect1d(q, d):
        i, j = np.nonzero(q == n)[0], np.nonzero(d == n)[0]
        if n:
            pick = lambda v, sizes, at: v[(np.cumsum(sizes) - sizes)[at][:, None] + np.arange(n)]
            out[np.ix_(i, j)] = pick(qv, q, i) @ pick(dv, d, j).T
    out[blocks.column(asked, "key")[:, None] == blocks.column(stored, "key")[None, :]] = -np.inf
    return out


def cosine(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k rows of `vectors` (id, v) with the largest dot products with each of `queries` (qid, v), itself left out."""
    return top_k(blocks.top_scores(queries.select("qid", "v"), vectors.select("id", "v"), _dots, k), k)


def class_cosines(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, label, best): each query's largest dot product with the vectors (id, v, label) of a class, itself left out."""

    def reduce(asked: pa.Table, stored: pa.Table) -> pa.RecordBatch:
        s, label = _dots(asked, stored), blocks.column(stored, "label").astype(np.int64)
        names = np.unique(label)
        best = np.stack([s[:, label == c].max(1) for c in names], 1)
        r, c = np.nonzero(best > -np.inf)
        return pa.record_batch({"qid": pa.array(blocks.column(asked, "key")[r]), "label": pa.array(names[c]), "best": pa.array(best[r, c])})

    found = blocks.in_blocks(queries.select("qid", "v"), vectors.select("id", "v", F.col("label").cast("long").alias("label")).where("label is not null"), reduce, "qid long, label long, best double")
    return found.groupBy("qid", "label").agg(F.max("best").alias("best"))


def cosine_histogram(queries: DataFrame, vectors: DataFrame, digits: int = 6) -> DataFrame:
    """(score, same, other): of all pairs of `queries` and `vectors` (both with a label), how many of one and of different classes have a dot product."""

    def reduce(asked: pa.Table, stored: pa.Table) -> pa.RecordBatch:
        s = _dots(asked, stored)
        same = blocks.column(asked, "label")[:, None] == blocks.column(stored, "label")[None, :]
        on = s > -np.inf
        value, at = np.unique(np.round(s[on], digits), return_inverse=True)
        n = np.bincount(at, same[on], len(value)).astype(np.int64)
        return pa.record_batch({"score": pa.array(value), "same": pa.array(n), "other": pa.array(np.bincount(at, minlength=len(value)) - n)})

    pick = lambda df, ident: df.select(ident, "v", F.col("label").cast("long").alias("label")).where("label is not null")
    found = blocks.in_blocks(pick(queries, "qid"), pick(vectors, "id"), reduce, "score double, same long, other long")
    return found.groupBy(F.round("score", digits).alias("score")).agg(F.sum("same").alias("same"), F.sum("other").alias("other"))
