"""Mixing sources to target weights, in blocks of tokens drawn by index.

The documents of a source, in a pseudorandom order, are one stream of tokens cut into blocks
of fixed length. Each output shard has so many slots; how many go to each source is a multinomial
draw, conditioned on the sources' totals so that targets are met and no cap is passed: the
totals are split down a binary tree of shards by hypergeometric draws whose seed is the node,
so each shard finds its counts by itself. The slots of a source are numbered through all
shards; slot j takes the block that a keyed permutation of the source's block numbers gives for
j modulo their count, with a key per pass. Blocks are then joined by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.tokens import plain_source, token_sizes
from palimpsest.session import stage

BLOCK, SHARD_SLOTS, BUCKET_DOCS, SEED = 128, 1024, 50_000, 11
_EXACT = 10**9  # slots from which numpy draws no hypergeometric numbers
_SLOTS = "out_shard long, slot int, source_no int, pass_no int, block long"


@dataclass(frozen=True)
class Share:
    """One wanted source: its target, cap, tokens at hand, blocks, and the slots it gets."""

    source: str
    target: float
    max_repeats: int
    tokens: int
    blocks: int
    slots: int = 0


def plan(shares: list[Share], block: int, total_tokens: int | None = None) -> list[Share]:
    """Slots per source. Without `total_tokens`, the largest mixture in which every source that has text meets its target.

    With it, sources that reach their cap give up what is missing to the others in proportion to their targets.
    """
    have = [i for i, s in enumerate(shares) if s.blocks and s.target > 0 and s.max_repeats > 0]
    if not have:
        return shares
    target = np.array([shares[i].target for i in have])
    target = target / target.sum()
    most = np.array([shares[i].max_repeats * shares[i].blocks for i in have])
    length = np.array([shares[i].tokens / shares[i].blocks for i in have])  # a source's last block may be short
    cap = most * length
    want = np.min(cap / target) if total_tokens is None else float(total_tokens)
    want = min(want, cap.sum())
    size, open_ = np.zeros(len(have)), np.ones(len(have), bool)
    left = want
    while open_.any():
        size[open_] = left * target[open_] / target[open_].sum()
        over = open_ & (size > cap)
        if not over.any():
            break
        size[over] = cap[over]
        open_ &= ~over
        left = want - size[~open_].sum()
    whole = np.minimum(np.round(size / length), most).astype(np.int64)
    out = list(shares)
    for i, n in zip(have, whole):
        s = out[i]
        out[i] = Share(s.source, s.target, s.max_repeats, s.tokens, s.blocks, int(n))
    return out


def _drawn(here: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `size` slots, taken at random from `here` slots per source, are each source's.

    Hypergeometric, exactly, below _EXACT slots. Above, source by source given those before: rare sources by their
    binomial limit, others by the normal one, whose errors are far below one standard deviation at such counts;
    either way the sum is `size` and no source gives more than it has.
    """
    if here.sum() < _EXACT:
        return rng.multivariate_hypergeometric(here, size, method="marginals")
    out, rest = np.zeros_like(here), int(here.sum())
    for i, k in enumerate(map(int, here)):
        others, p = rest - k, size / max(rest, 1)
        low, high = max(0, size - others), min(k, size)
        if rest < _EXACT:
            n = int(rng.hypergeometric(k, others, size)) if rest else 0
        elif k < rest / 100:
            n = int(rng.binomial(k, p))
        else:
            n = round(k * p + rng.standard_normal() * np.sqrt(k * p * (1 - p) * others / rest))
        out[i] = n = min(max(n, low), high)
        size, rest = size - n, others
    return out


def shard_counts(totals: np.ndarray, shards: int, slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots in it): a multinomial draw per shard given the totals."""
    lo, hi, before, here = 0, shards, np.zeros_like(totals), totals.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        size = min(slots * (mid - lo), int(here.sum()))
        left = _drawn(here, size, np.random.default_rng((seed, lo, hi)))
        if shard < mid:
            hi, here = mid, left
        else:
            lo, before, here = mid, before + left, here - left
    return before, here


def permuted(index: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """A keyed permutation of 0..n-1 at `index`: a four-round Feistel network, walked until it falls below n."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 2**63, 4).astype(np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            with np.errstate(over="ignore"):
                f = (right + k) * np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(32)
            left, right = right, (left ^ f) & mask
        return (left << np.uint64(half)) | right

    x = once(index.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def _drawer(totals: list[int], blocks: list[int], shards: int, slots: int, seed: int):
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                before, here = shard_counts(np.array(totals, np.int64), shards, slots, int(shard), seed)
                parts = []
                for s, (b, n) in enumerate(zip(before, here)):
                    if n:
                        j = np.arange(b, b + n)
                        for p in np.unique(j // blocks[s]):
                            at = j[j // blocks[s] == p] % blocks[s]
                            parts.append(pd.DataFrame({"source_no": s, "pass_no": p, "block": permuted(at, blocks[s], (seed, s, int(p)))}))
                if parts:
                    out = pd.concat(parts, ignore_index=True)
                    out["slot"] = np.random.default_rng((seed, 7, int(shard))).permutation(len(out))
                    yield out.assign(out_shard=int(shard))[["out_shard", "slot", "source_no", "pass_no", "block"]]

    return draw


@dataclass
class Mixture:
    """`shares` per wanted source; `slots` (out_shard, slot, source, pass_no, block); `parts` (source, block, doc_id, begins, tokens)."""

    shares: list[Share]
    slots: DataFrame
    parts: DataFrame
    sized: DataFrame


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, tokenizer: str | None = None) -> Mixture:
    """Draw the mixture. `targets` (source, target_share, max_repeats) is a short list and is read by the driver.

    Sources are compared without letter case and blanks; documents of unwanted or null sources, and without
    text, are not used; a wanted source without text gets nothing and its share goes to the others in
    proportion. Null shares or repeats count as 0; a source listed twice counts with its larger share. The last block of a source may be short.
    """
    spark = documents.sparkSession
    wanted = targets.select(plain_source(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("t"), F.coalesce("max_repeats", F.lit(0)).alias("r")).where("source is not null")
    wanted = wanted.groupBy("source").agg(F.max(F.struct("t", "r")).alias("x")).select("source", "x.t", "x.r")
    sized = stage(token_sizes(documents, tokenizer).join(F.broadcast(wanted.select("source")), "source").where("tokens > 0"), "sized")
    sums = {r["source"]: (r["n"], r["d"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("d")).collect()}
    shares = [Share(r["source"], float(r["t"]), int(r["r"]), *(lambda n: (n, -(-n // block)))(sums.get(r["source"], (0, 0))[0])) for r in wanted.orderBy("source").collect()]
    shares = plan(shares, block, total_tokens)
    number = F.create_map(*[x for i, s in enumerate(shares) for x in (F.lit(s.source), F.lit(i))]) if shares else None

    # a document's place in its source's stream: sums over buckets of its random order, then within the bucket
    buckets = max(16, -(-max([d for _, d in sums.values()], default=0) // BUCKET_DOCS))
    order = sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.floor((F.col("h") / 2.0**64 + 0.5) * buckets).cast("int"))
    base = order.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    base = base.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "bucket", "base")
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = order.withColumn("inner", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(base, ["source", "bucket"]).withColumn("at", F.col("base") + F.col("inner"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("tokens") - 1) / block)
    parts = placed.select("source", "doc_id", "at", F.col("tokens").alias("n"), F.explode(F.sequence(first, last)).alias("block"))
    begins = F.greatest(F.col("block") * block, F.col("at"))
    parts = parts.select("source", "block", "doc_id", (begins - F.col("at")).alias("begins"), (F.least((F.col("block") + 1) * block, F.col("at") + F.col("n")) - begins).alias("tokens"))

    totals = [s.slots for s in shares]
    shards = -(-sum(totals) // shard_slots)
    schema = "out_shard long, slot int, source string, pass_no int, block long"
    if not shards:
        return Mixture(shares, spark.createDataFrame([], schema), parts, sized)
    slots = spark.range(0, shards, 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(_drawer(totals, [s.blocks for s in shares], shards, shard_slots, seed), _SLOTS)
    names = F.array(*[F.lit(s.source) for s in shares])
    return Mixture(shares, slots.select("out_shard", "slot", names[F.col("source_no")].alias("source"), "pass_no", "block"), parts, sized)


def copies(m: Mixture) -> DataFrame:
    """(doc_id, source, tokens, used_tokens, least_copies, most_copies) of every document of a wanted source.

    A document lies in one or more blocks, whose numbers of uses differ by one at most within a pass.
    """
    uses = m.slots.groupBy("source", "block").agg(F.count("*").alias("uses"))
    each = m.parts.join(uses, ["source", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return each.groupBy("doc_id", "source").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.min("uses").alias("least_copies"), F.max("uses").alias("most_copies"))


def report(m: Mixture) -> DataFrame:
    """(source, target_share, max_repeats, tokens, used_tokens, reached_share) of every wanted source."""
    spark = m.sized.sparkSession
    rows = [(s.source, s.target, s.max_repeats, s.tokens) for s in m.shares]
    wanted = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens long")
    used = copies(m).groupBy("source").agg(F.sum("used_tokens").alias("used_tokens"))
    out = wanted.join(F.broadcast(used), "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    return out.withColumn("reached_share", F.round(F.col("used_tokens") / F.sum("used_tokens").over(Window.partitionBy()), 6))
