"""Near-duplicate records: an exact set-similarity join on rare shingles, or by partitioning the universe.

A record is the set of its distinct word runs (shingles), hashed to 64 bits. Two sets with
Jaccard similarity t or more share one of their rarest shingles, so sets meet on those
(prefixes), and only where the shared one leaves room for enough others behind it. Lists of
these shingles grow with the collection; where they are too long, sets meet otherwise: they
differ in at most H = (1-t)/(1+t) * (|x|+|y|) elements. The universe of shingles is hashed into m segments, m fixed per band of sizes; whatever budget
v_i of differences is allowed to segment i, if the sum of (v_i + 1) exceeds H, then some
segment differs by no more than its budget (pigeonhole). Budgets used are none, 0 (equal
segments) and 1 (one element more or less, found through one-deletion neighbourhoods), and
they are allotted per record where the expected lists are shortest. Candidates are verified
exactly. Nothing is missed; a set whose segments can't hold the budget falls back to a join
on single shingles.

Records with the same set form a class first, so copies meet once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import discard, stage

_SKETCH_BITS = (16, 21)  # counters of shingle frequencies that guide the costs: one per eight shingles, 2^16 at least, 2^21 (8 MB) at most
_SLICE = 400_000  # shingles worked on at once
_TEXT_BYTES = 1_000_000  # of text hashed at once
_PART_ROWS = 1_500_000
_MEETINGS = 10_000  # per set, on rare shingles; where there are more, the universe is partitioned, with about 300 keys a set
_COSTED = 20_000  # sets by which the meetings are estimated
_HOT_KEY = 4_000  # index rows of one key that one task joins; more are salted
_ROUNDS = 6  # in which the bands, and so the keys and their pairs, are gone through: what a round shuffles is gone in the next
PAIRS_SHOWN = 1_000_000  # pairs of copies of two classes that are all shown
_KEYS = "key long, id long, grp long, size int, role byte, pos int"
INDEX, PROBE, LEFTOVER = 1, 2, 4  # a key may be in the index and ask it, too


@dataclass(frozen=True)
class Join:
    """Threshold and least size of a join, and what follows from them."""

    threshold: float = 0.6
    min_size: int = 15

    @property
    def per_element(self) -> float:
        return (1 - self.threshold) / (1 + self.threshold)

    def band(self, size: np.ndarray) -> np.ndarray:
        """Bands grow by 1/threshold, so a set meets its own band and the one below."""
        return np.floor(np.log(np.maximum(size, 1) / self.min_size) / -np.log(self.threshold) + 1e-9).astype(np.int64)

    def low(self, band: np.ndarray) -> np.ndarray:
        return self.min_size * self.threshold ** -band.astype(float)

    def segments(self, band: np.ndarray) -> np.ndarray:
        """So many that the non-empty ones, about m(1-e^-load), exceed H by a sixth."""
        need, load = min(0.95, 1.16 * 2 * self.per_element), 1e-3
        while load < 40 and (1 - np.exp(-load * 1.01)) / (load * 1.01) >= need:
            load *= 1.01
        return np.maximum(2, np.round(self.low(band) / np.sqrt(self.threshold) / load)).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _segmented(rec: np.ndarray, tok: np.ndarray, freq: np.ndarray, band: np.ndarray, m: np.ndarray) -> dict:
    """Tokens in order of record, segment and frequency, and their groups. `band` and `m` are per token."""
    with np.errstate(over="ignore"):
        seg = _mix(tok + band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % m
    order = np.lexsort((freq, seg, rec))
    rec, seg, tok, freq, band = rec[order], seg[order], tok[order], freq[order], band[order]
    first = np.concatenate([[True], (rec[1:] != rec[:-1]) | (seg[1:] != seg[:-1])])
    start = np.nonzero(first)[0]
    count = np.diff(np.append(start, len(rec)))
    value = _mix(tok ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    total = np.add.reduceat(value, start)
    place = _mix(seg[start] * np.uint64(1 << 20) + band[start].astype(np.uint64) + np.uint64(1))
    second = np.where(count > 1, freq[np.minimum(start + 1, len(rec) - 1)], 0)
    return {"rec": rec[start], "start": start, "count": count, "total": total, "place": place, "value": value, "rarest": freq[start], "second": second, "group": np.cumsum(first) - 1}


def _full(g: dict, at: np.ndarray, kind: int) -> np.ndarray:
    return _mix(_mix(g["total"][at] ^ g["place"][at]) + np.uint64(kind))


def _deleted(g: dict, at: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the groups `at` with each one element left out, and their records."""
    chosen = np.zeros(len(g["rec"]), bool)
    chosen[at] = True
    t = np.nonzero(chosen[g["group"]])[0]
    owner = g["group"][t]
    return _mix(_mix((g["total"][owner] - g["value"][t]) ^ g["place"][owner]) + np.uint64(kind)), g["rec"][owner]


def signatures(rec_sizes: np.ndarray, flat: np.ndarray, freq: np.ndarray, join: Join, bands: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(keys, record numbers, role) of a block of sets given as one flat array, those of some bands. Keys of different bands never meet."""
    n, out = len(rec_sizes), []
    rec = np.repeat(np.arange(n), rec_sizes)
    own = join.band(rec_sizes)
    for below in (0, 1):
        band = own - below
        reach = np.isin(band, bands)
        if below:
            reach &= (band >= 0) & (join.band(np.ceil(rec_sizes * join.threshold - 1e-9)) <= band)
        if not reach.any():
            continue
        keep = reach[rec]
        m = join.segments(band)
        g = _segmented(rec[keep], flat[keep], freq[keep], band[rec[keep]], m[rec[keep]])
        if not below:
            k, r = _deleted(g, np.nonzero(g["count"] > 1)[0], 1)
            out.append((k, r, INDEX))
        # H + 1 units are needed; each segment offers one for equality and one more for a neighbourhood
        top = np.minimum(rec_sizes, np.ceil(join.low(band + 1)) if below else rec_sizes)
        need = np.floor(join.per_element * (rec_sizes + top) + 1e-9).astype(np.int64) + 1
        two = np.nonzero(g["count"] > 1)[0]
        unit_group = np.concatenate([np.arange(len(g["rec"])), two])
        more = np.concatenate([np.zeros(len(g["rec"]), np.int8), np.ones(len(two), np.int8)])
        equal_cost = 1.0 + g["rarest"]
        cost = np.concatenate([equal_cost, np.maximum(equal_cost[two], g["count"][two] + 1.0 + g["rarest"][two] + g["second"][two])])
        order = np.lexsort((more, cost, g["rec"][unit_group]))
        owner = g["rec"][unit_group[order]]
        begin = np.searchsorted(owner, np.arange(n))
        taken = order[(np.arange(len(order)) - begin[owner]) < need[owner]]
        have = np.bincount(owner, minlength=n)
        short = reach & (have < need)
        equal, near = unit_group[taken[more[taken] == 0]], unit_group[taken[more[taken] == 1]]
        if below:
            out.append((_full(g, equal, 0), g["rec"][equal], PROBE))
        else:  # all are in the index, and some ask it
            asks = np.zeros(len(g["rec"]), bool)
            asks[equal] = True
            other = np.nonzero(~asks)[0]
            out.append((_full(g, equal, 0), g["rec"][equal], INDEX | PROBE))
            out.append((_full(g, other, 0), g["rec"][other], INDEX))
        out.append((_full(g, near, 1), g["rec"][near], PROBE))
        k, r = _deleted(g, near, 0)
        out.append((k, r, PROBE))
        left = np.nonzero(short)[0]
        out.append((_mix(left.astype(np.uint64)), left, LEFTOVER))  # under any key, spread
    return out


_SETS = "id long, grp long, toks array<long>, occ array<long>, h1 long, h2 long"
_ODD = 0x9E3779B97F4A7C15  # a word's hash is the sum of its letters' numbers times powers of this
_LETTERS = np.zeros(256, np.uint64)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _LETTERS[_c] = _LETTERS[_c - 32 if _c > 96 else _c] = int.from_bytes(xxhash.xxh64_digest(bytes([_c])), "big") | 1


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit hashes of the runs of `words` words of every text, sorted within each, as one array; and how many each has."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    out, sizes = [], np.zeros(len(texts), np.int64)
    every, lo = np.frombuffer(texts.buffers()[2] or b"", np.uint8), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _TEXT_BYTES, "right")) - 1)
        value = _LETTERS[every[ends[lo] : ends[hi]]]
        begins = ends[lo : hi + 1] - ends[lo]
        on = np.concatenate([[False], value > 0, [False]])
        first, last = on[1:-1] & ~on[:-2], on[1:-1] & ~on[2:]
        edges = begins[(begins > 0) & (begins < len(value))]  # a text's first byte begins a word, and the one before ends one
        first[edges] |= on[1:-1][edges]
        last[edges - 1] |= on[1:-1][edges - 1]
        start, stop = np.nonzero(first)[0], np.nonzero(last)[0] + 1
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(value * _powers(_ODD, len(value))[:-1], dtype=np.uint64)])
            h = _mix((sums[stop] - sums[start]) * _powers(pow(_ODD, -1, 1 << 64), len(value))[start])
            rec = np.searchsorted(begins, start, "right") - 1
            n = max(len(h) - words + 1, 0)
            run = h[words - 1 :]
            for i in range(words - 2, -1, -1):
                run = _mix(h[i : n + i] + _mix(run))
        whole = rec[:n] == rec[words - 1 :]
        run, rec = run[whole], rec[:n][whole]
        at = np.concatenate([[0], np.cumsum(np.bincount(rec, minlength=hi - lo))])
        for i in range(hi - lo):
            run[at[i] : at[i + 1]].sort()
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (rec[1:] != rec[:-1])
        out.append(run[new])
        sizes[lo:hi] = np.bincount(rec[new], minlength=hi - lo)
        lo = hi
    return np.concatenate(out) if out else np.empty(0, np.uint64), sizes


def occupied(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of 1,024 places, by the highest ten bits, the hashes of each set fall in, as sixteen 64-bit words a set."""
    at = (hashes >> np.uint64(54)).astype(np.int64)
    words = np.zeros(16 * len(sizes), np.uint64)
    np.bitwise_or.at(words, np.repeat(np.arange(len(sizes)) * 16, sizes) + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return words.view(np.int64)


def _shingler(words: int, min_size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = shingle_hashes(batch.column("text"), words)
            keep = sizes >= min_size
            flat, sizes, batch = flat[np.repeat(keep, sizes)], sizes[keep], batch.select(["id", "grp"]).filter(pa.array(keep))
            if not len(sizes):
                continue
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            raw = memoryview(flat.tobytes())
            digest = lambda f: pa.array(np.array([f(raw[8 * a : 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64).view(np.int64))
            toks = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))
            occ = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(sizes) + 1, 16, dtype=np.int32)), pa.array(occupied(flat, sizes)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grp"), toks, occ, digest(xxhash.xxh64_intdigest), digest(xxhash.xxh3_64_intdigest)], names=["id", "grp", "toks", "occ", "h1", "h2"])

    return sets


def _frequency(sketch, values: np.ndarray) -> np.ndarray:
    counts = np.frombuffer(sketch.value, np.int32)
    return counts[(values % np.uint64(len(counts))).astype(np.int64)]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, their shingles as one array, their sizes) of so many rows at once."""
    lists = batch.column("toks")
    base, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    lo, n = 0, len(base) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(base, base[lo] + _SLICE, "right")) - 1)
        yield slice(lo, hi), values[base[lo] : base[hi]], np.diff(base[lo : hi + 1]).astype(np.int64)
        lo = hi


def _rows(key: np.ndarray, at: np.ndarray, ids: np.ndarray, grp: np.ndarray, sizes: np.ndarray, role: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[at]), pa.array(grp[at]), pa.array(sizes[at].astype(np.int32)), pa.array(role.astype(np.int8)), pa.array(pos.astype(np.int32))], names=["key", "id", "grp", "size", "role", "pos"])


def _keyer(join: Join, sketch, bands: tuple[int, ...]):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grp = batch.column("id").to_numpy(), batch.column("grp").to_numpy()
            for rows, flat, sizes in _blocks(batch):
                for key, r, role in signatures(sizes, flat, _frequency(sketch, flat), join, bands):
                    if len(key):
                        yield _rows(key, r, ids[rows], grp[rows], sizes, np.full(len(key), role), np.zeros(len(key)))

    return keys


def _prefixer(join: Join, sketch):
    """Each set's rarest shingles, so many that two similar sets share one of them; `asks` tells which sets ask the index.

    The smaller set of a pair is found in the index, where fewer shingles do: it shares 2t/(1+t) of its own at least.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grp, asks = batch.column("id").to_numpy(), batch.column("grp").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            for rows, flat, sizes in _blocks(batch):
                rec = np.repeat(np.arange(len(sizes)), sizes)
                freq = _frequency(sketch, flat).astype(np.int64)
                order = np.lexsort((flat, freq, rec))
                place = np.arange(len(rec)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                upto = lambda share: sizes - np.ceil(share * sizes - 1e-9).astype(np.int64) + 1
                role = np.where(place < upto(2 * join.threshold / (1 + join.threshold))[rec], INDEX, 0) | np.where(asks[rows][rec] & (place < upto(join.threshold)[rec]), PROBE, 0)
                flat, freq = flat[order], freq[order]
                on = (role > 0) & (freq > 1)  # one that no other set has meets none
                salts = -(-freq // _HOT_KEY)
                cold, hot = on & (salts == 1), np.nonzero(on & (salts > 1))[0]
                yield _rows(flat[cold], rec[cold], ids[rows], grp[rows], sizes, role[cold], place[cold])
                if len(hot):
                    its, own = hot[role[hot] & INDEX > 0], hot[role[hot] & PROBE > 0]
                    every = np.repeat(own, salts[own])
                    salt = np.arange(len(every)) - np.repeat(np.cumsum(salts[own]) - salts[own], salts[own])
                    at = np.concatenate([its, every])
                    salt = np.concatenate([(_mix(ids[rows].view(np.uint64))[rec[its]] % salts[its].astype(np.uint64)).astype(np.int64), salt])
                    kind = np.repeat([INDEX, PROBE], [len(its), len(every)])
                    yield _rows(_mix(flat[at] + _mix(salt.astype(np.uint64) + np.uint64(1))), rec[at], ids[rows], grp[rows], sizes, kind, place[at])

    return keys


def _pairer(join: Join):
    """(a, b) of different groups and fitting sizes that meet on a key, of rows of keys in order of the key."""
    t, names = join.threshold, ("key", "id", "grp", "size", "role", "pos")

    def meet(key: np.ndarray, ident: np.ndarray, grp: np.ndarray, size: np.ndarray, role: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        its, asks = (np.nonzero(role & kind)[0] for kind in (INDEX, PROBE))
        begin = np.searchsorted(key[its], key[asks], "left")
        many = np.searchsorted(key[its], key[asks], "right") - begin
        upto, done = np.cumsum(many), 0
        while done < len(asks):
            end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + _SLICE, "right")))
            n = many[done:end]
            x = its[np.repeat(begin[done:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            y = np.repeat(asks[done:end], n)
            sx, sy = size[x], size[y]
            # what comes before the first shared shingle is not shared
            fits = (grp[x] != grp[y]) & (sx <= sy) & (sx >= sy * t - 1e-9) & (np.minimum(sx - pos[x], sy - pos[y]) * (1 + t) >= (sx + sy) * t - 1e-9)
            x, y, done = ident[x[fits]], ident[y[fits]], end
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [batch.column(n).to_numpy() for n in names]
            if not len(rows[0]):
                continue
            rows = [np.concatenate(x) for x in zip(held, rows)] if held else rows
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on
            yield from meet(*(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
        if held:
            yield from meet(*held)

    return pairs


def _meetings(join: Join, sketch):
    """About how often each set meets others on rare shingles: as many as have the shingle anywhere, at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, flat, sizes in _blocks(batch):
                rec = np.repeat(np.arange(len(sizes)), sizes)
                freq = _frequency(sketch, flat)
                freq = freq[np.lexsort((freq, rec))]
                place = np.arange(len(rec)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = place < (sizes - np.ceil(join.threshold * sizes - 1e-9).astype(np.int64) + 1)[rec]
                yield pa.RecordBatch.from_arrays([pa.array([float(freq[first].sum())]), pa.array([len(sizes)])], names=["met", "sets"])

    return count


@dataclass
class Classes:
    """`members` (id, grp, rep, copies: rows, repeated ones too) of all records in scope; `sets` (id, grp, size, toks) of one per class."""

    members: DataFrame
    sets: DataFrame


def classes(records: DataFrame, id_col: str, grp_col: str, text: Column, words: int, min_size: int) -> Classes:
    """Records with at least `min_size` distinct runs of `words` words, those with equal sets as one class."""
    df = records.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(F.lit("g"), F.col(grp_col)), F.lit(0)).alias("grp"), text.alias("text"))
    df = df.where(F.col("id").isNotNull() & (F.octet_length("text") >= 2 * (min_size + words) - 3)).mapInArrow(_shingler(words, min_size), _SETS)
    # the sets are by far the most of all this, so they go to their classes part by part
    df = stage(df.withColumn("part", F.pmod(F.xxhash64("h1"), F.lit(_ROUNDS)).cast("int")), "sets", by=["part"])
    heads = df.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.count("*").alias("copies"))
    # a class over several groups belongs to none of them
    heads = stage(heads.withColumn("cgrp", F.when(F.col("g0") == F.col("g1"), F.col("g0")).otherwise(F.xxhash64(F.lit("m"), "rep"))), "heads")
    members = df.select("id", "grp", "h1", "h2").distinct().join(heads.select("h1", "h2", "rep", "copies"), ["h1", "h2"]).select("id", "grp", "rep", "copies")
    members = stage(members, "members")
    reps = heads.select(F.col("rep").alias("id"), "h1", "h2", F.col("cgrp"))
    many, parts = df.count() > _PART_ROWS // 100, []
    for i in range(_ROUNDS if many else 1):
        sets = (df.where(F.col("part") == i) if many else df).drop("grp", "part").join(reps, ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"])
        # an id logged with two different texts keeps both, under the classes' own ids
        parts.append(stage(sets.select("id", F.col("cgrp").alias("grp"), F.size("toks").alias("size"), "occ", "toks"), "classes"))
        discard(df, f"/part={i}" if many else "")
    return Classes(members, reduce(DataFrame.unionByName, parts))


def rounds(sizes: list[tuple[int, int]], join: Join) -> list[tuple[tuple[int, ...], str, int]]:
    """The rounds over the bands of sets with `sizes` (size, sets): each one's bands, the condition on the sizes that take part, and their shingles.

    A set has keys in its own band and in the one below. Bands are put together so that rounds have about as much to do.
    """
    size, n = (np.array([r[i] for r in sizes], np.int64) for i in (0, 1))
    own = join.band(size)
    by_band = {b: int((size * n)[own == b].sum()) for b in range(max(int(own.min()) - 1, 0), int(own.max()) + 1)} if len(own) else {}
    work = {b: w + by_band.get(b + 1, 0) for b, w in by_band.items()}
    groups: list[list[int]] = [[] for _ in range(_ROUNDS if sum(work.values()) > _PART_ROWS else 1)]
    for b in sorted(work, key=work.get, reverse=True):
        min(groups, key=lambda g: sum(work[x] for x in g)).append(b)
    out = []
    for g in filter(None, groups):
        its = [(int(size[own == b].min()), int(size[own == b].max())) for b in sorted({*g, *(x + 1 for x in g)}) if (own == b).any()]
        where = " or ".join(f"size between {lo} and {hi}" for lo, hi in its)
        out.append((tuple(g), where, sum(work[b] for b in g)))
    return out


def similar_sets(sets: DataFrame, join: Join) -> DataFrame:
    """(a, b) with a < b: ids of different sets of different groups with Jaccard similarity of at least the threshold."""
    spark = sets.sparkSession
    sizes = [(r["size"], r["count"]) for r in sets.groupBy("size").count().collect()]
    total = sum(size * n for size, n in sizes)
    width = 1 << min(max(int(total // 8).bit_length(), _SKETCH_BITS[0]), _SKETCH_BITS[1])
    counted = sets.select(F.explode("toks").alias("t")).groupBy(F.expr(f"t & {width - 1}").cast("int").alias("at")).agg(F.count("*").alias("n"))
    counts = stage(counted, "counters")
    counted = counts.toArrow()  # at most `width` rows, as Arrow batches
    freq = np.zeros(width, np.int32)
    freq[counted["at"].to_numpy()] = np.minimum(counted["n"].to_numpy(), 2**31 - 1)
    sketch = spark.sparkContext.broadcast(freq.tobytes())
    del counted, freq  # the driver has little room
    discard(counts)

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = sum(n for _, n in sizes)
    some = sets.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // _COSTED))) == 0)  # for the choice of the way only
    met, of = some.select("toks").mapInArrow(_meetings(join, sketch), "met double, sets long").agg(F.sum("met"), F.sum("sets")).first()
    if (met or 0) <= _MEETINGS * (of or 0):
        every = sets.select("id", "grp", "toks", F.lit(True).alias("asks")).mapInArrow(_prefixer(join, sketch), _KEYS)
        keys = every.repartition(max(least, int(total / _PART_ROWS)), "key").sortWithinPartitions("key")
        pairs = stage(keys.mapInArrow(_pairer(join), "a long, b long").distinct(), "met")
        return verified(pairs, sets, join)

    found, left = [], []
    for bands, where, work in rounds(sizes, join):
        some = sets.where(where)
        rows, pairs = _meeting(some.select("id", "grp", "toks").mapInArrow(_keyer(join, sketch, bands), _KEYS), max(least, int(work / _PART_ROWS)), join)
        pairs = stage(pairs, "met")
        short = stage(rows.where(f"role = {LEFTOVER}").select("id").distinct(), "left")
        discard(rows)
        left += [short] if short.take(1) else []
        found.append(stage(verified(pairs, some, join), "near"))
        discard(pairs)
    if left:  # sets whose segments can't hold the budget meet all others on their rarest shingles
        asks = reduce(DataFrame.unionByName, left).distinct().withColumn("asks", F.lit(True))
        asking = sets.select("id", "grp", "toks").join(asks, "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        found.append(verified(_meeting(asking.mapInArrow(_prefixer(join, sketch), _KEYS), max(least, int(2 * total / _PART_ROWS)), join)[1], sets, join))
        return reduce(DataFrame.unionByName, found).distinct()
    return reduce(DataFrame.unionByName, found) if found else sets.select(F.col("id").alias("a"), F.col("id").alias("b"))


def _meeting(keys: DataFrame, parts: int, join: Join) -> tuple[DataFrame, DataFrame]:
    """The staged rows of keys where sets meet, and the LEFTOVER ones; and (a, b) of different groups whose sets meet on a key and are of fitting sizes. Hot keys are salted."""
    # one exchange, which is used again: for the sides that a key has, and for its rows. The condition is on both uses alike
    keys = keys.where("key is not null").repartition(parts, "key")
    side = lambda role: F.sum(F.col("role").bitwiseAND(role).cast("boolean").cast("long"))
    live = keys.groupBy("key").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"), side(INDEX).alias("n_index"), side(PROBE).alias("n_probe"), F.min("id").alias("i0"), F.max("id").alias("i1"), F.min("size").alias("s0"), F.min("pos").alias("p0"))
    live = live.where("g0 <> g1 and i0 <> i1 and s0 > 0 and p0 >= 0 and n_index > 0 and n_probe > 0").select("key", "n_index")
    held = rows = stage(keys.join(live.hint("shuffle_hash"), "key", "left").where(f"n_index is not null or role = {LEFTOVER}"), "keys")

    # of a hot key, the group with most rows need not meet itself
    hot = rows.where(F.col("n_index") > _HOT_KEY)
    main = hot.groupBy("key", "grp").count().groupBy("key").agg(F.max_by("grp", "count").alias("main"))
    rows = rows.where(f"role <> {LEFTOVER}").join(main, "key", "left")
    salts = F.ceil(F.col("n_index") / _HOT_KEY).cast("int")
    is_main = F.coalesce(F.col("grp") == F.col("main"), F.lit(False))
    x = rows.where(f"role & {INDEX} <> 0").select("key", F.col("id").alias("x"), F.col("grp").alias("xg"), F.col("size").alias("xs"), F.col("pos").alias("xp"), is_main.alias("xm"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    y = rows.where(f"role & {PROBE} <> 0").select("key", F.col("id").alias("y"), F.col("grp").alias("yg"), F.col("size").alias("ys"), F.col("pos").alias("yp"), is_main.alias("ym"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    fits = (F.col("xs") <= F.col("ys")) & (F.col("xs") >= F.col("ys") * join.threshold - 1e-9) & (F.col("xg") != F.col("yg"))
    # what comes before the first shared shingle is not shared
    fits &= F.least(F.col("xs") - F.col("xp"), F.col("ys") - F.col("yp")) * (1 + join.threshold) >= (F.col("xs") + F.col("ys")) * join.threshold - 1e-9
    met = y.where("not ym").join(x, ["key", "salt"]).where(fits).unionByName(y.where("ym").join(x.where("not xm"), ["key", "salt"]).where(fits))
    return held, met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The candidates whose similarity, counted on the whole sets, reaches the threshold."""
    t = join.threshold

    def enough(shared: Column) -> Column:
        return shared * (1 + t) >= (F.col("sa") + F.col("sb")) * t - 1e-9

    # a place that one set occupies and the other doesn't holds at least one element that is not shared: a short
    # upper bound of what is shared spares most candidates the whole sets
    few = pairs.join(sets.select(F.col("id").alias("a"), F.col("size").alias("sa"), F.col("occ").alias("oa")), "a").join(sets.select(F.col("id").alias("b"), F.col("size").alias("sb"), F.col("occ").alias("ob")), "b")
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, c: n + c)
    few = few.where(enough(F.least(F.col("sa") - alone("oa", "ob"), F.col("sb") - alone("ob", "oa")))).select("a", "b", "sa", "sb")
    both = few.join(sets.select(F.col("id").alias("a"), F.col("toks").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("toks").alias("tb")), "b")
    return both.where(enough(F.size(F.array_intersect("ta", "tb")))).select("a", "b")


def similar_records(c: Classes, join: Join, most: int = PAIRS_SHOWN) -> DataFrame:
    """(a, b) with a < b: records of different groups whose sets are similar.

    Of two classes with no more than `most` pairs of copies (of one class, with itself) all pairs are shown. Of larger
    ones, every copy is shown with the other class's first record and with its first of another group, so the rows
    grow with the copies, not with their square; `near_duplicate_groups` has every record's class.
    """
    links = stage(similar_sets(c.sets, join), "links")
    members = c.members
    first = members.groupBy("rep").agg(F.min(F.struct("id", "grp")).alias("f"), F.countDistinct("id").alias("n"))
    other = members.join(first.select("rep", "f"), "rep").where("grp <> f.grp").groupBy("rep").agg(F.min(F.struct("id", "grp")).alias("o"))
    heads = stage(first.join(other, "rep", "left").select("rep", "n", F.filter(F.array("f", "o"), lambda h: h.isNotNull()).alias("heads")), "first-members")
    side = lambda x: heads.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("heads").alias(f"h{x}"))
    copies = lambda x: members.select(F.col("rep").alias(x), F.struct("id", "grp").alias(f"m{x}"))

    meet = links.unionByName(heads.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    meet = stage(meet.join(side("a"), "a").join(side("b"), "b").withColumn("few", F.col("na") * F.col("nb") <= most), "meeting")
    every = meet.where("few").select("a", "b").join(copies("a"), "a").join(copies("b"), "b").select("ma", "mb")
    many = meet.where("not few")
    one = many.select("a", F.explode("hb").alias("mb")).join(copies("a"), "a").select("ma", "mb")
    two = many.where("a <> b").select("b", F.explode("ha").alias("ma")).join(copies("b"), "b").select("ma", "mb")
    pairs = every.unionByName(one).unionByName(two).where("ma.grp <> mb.grp and ma.id <> mb.id")
    return pairs.select(F.least("ma.id", "mb.id").alias("a"), F.greatest("ma.id", "mb.id").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, group_id) of every id in `links` (a, b): connected components by their least id.

    Large-star and small-star rounds, each written to the shared folder; about log(n) rounds.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        edges = stage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges"
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group_id"))).distinct()


def near_duplicate_pairs(records: DataFrame, id_col: str = "seq", grp_col: str = "memory_id", words: int = 3, min_size: int = 15, threshold: float = 0.6) -> DataFrame:
    """(a, b) of records of different `grp_col` whose sets of word runs have at least the threshold in common.

    Null and empty texts and those with fewer than `min_size` runs are no records; repeated rows count once; null
    groups are one group; rows with a null id are ignored, as are extra columns. Of classes with very many copies,
    see `similar_records`, each copy is paired with representatives only.
    """
    c = classes(records, id_col, grp_col, F.col("text"), words, min_size)
    return similar_records(c, Join(threshold, min_size))


def near_duplicate_groups(records: DataFrame, id_col: str = "seq", grp_col: str = "memory_id", words: int = 3, min_size: int = 15, threshold: float = 0.6) -> DataFrame:
    """(id, class_id, group_id, links), one row per record in scope: its class of equal sets, its group of near
    duplicates (transitively; its own class where it has none), and to how many other classes its class is linked."""
    c = classes(records, id_col, grp_col, F.col("text"), words, min_size)
    links = stage(similar_sets(c.sets, Join(threshold, min_size)), "links")
    groups = components(links)
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    out = c.members.join(groups.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.select("id", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
