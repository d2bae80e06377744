"""How distinctive a term is for a record: a two-Poisson mixture per term.

Over the whole collection a term's occurrence counts are modelled as a mixture of two Poisson
laws, one for the records it merely appears in and one for the "elite" that are about it. The
mixture is fitted by expectation-maximisation on the term's frequency histogram (how many
records hold it how often, those without it included), so the fit costs one row per term
whatever the number of records. The posterior probability of the elite component scores each
occurrence count; its log-odds order terms whose posterior is near one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import ascii_lower
from palimpsest.operators.skew import join_per_key, keep_highest
from palimpsest.session import stage

ROUNDS, TOLERANCE = 400, 1e-8  # a term's fit ends when its log rates and share move by less, or after so many rounds
_LEAST = 1e-9
_PARAMS = "term string, df long, corpus_freq long, elite_share double, elite_rate double, other_rate double"


def newest_frequencies(postings: DataFrame) -> tuple[DataFrame, int]:
    """Staged (chunk_id, term, tf) of the newest record of each chunk, and the number of chunks.

    Repeated rows count once; terms are lowered (A-Z) and trimmed, rows with a null or empty
    term, a null chunk, or a null or non-positive freq are dropped first; of a chunk, the rows with
    its highest `seq` remain, and `freq` is added up per term.
    """
    p = postings.select("segment", F.trim(ascii_lower(F.col("term"))).alias("norm"), "term", "chunk_id", "freq", "seq")
    p = p.where("chunk_id is not null and norm <> '' and freq > 0")
    newest, best = keep_highest(p, "chunk_id", "seq")
    tf = (
        newest.repartition("chunk_id", "norm")  # serves both the distinct and the sum
        .dropDuplicates(["chunk_id", "norm", "segment", "term", "freq", "seq"])
        .groupBy("chunk_id", F.col("norm").alias("term")).agg(F.sum("freq").alias("tf"))
    )
    return stage(tf, "tf"), best.count()


def fit_two_poisson(start: np.ndarray, tf: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elite share and both rates of many histograms at once, each iterated until it has converged.

    `start` holds where each histogram begins in `tf` (counts, zero included) and `weight` (records).
    A histogram with a single count, zero apart, is elite wherever it occurs.
    """
    lens = np.diff(np.append(start, len(tf)))
    total, mass = np.add.reduceat(weight, start), np.add.reduceat(weight * tf, start)
    held = np.add.reduceat(np.where(tf > 0, weight, 0.0), start)
    share = np.clip(held / total * 0.5, _LEAST, 0.5)
    high = np.maximum(mass / np.maximum(held, _LEAST), 1.0) * 1.25
    low = np.maximum(mass / total * 0.5, _LEAST)
    left = np.arange(len(start))  # histograms that still move
    x, w, n = tf, weight, lens
    for _ in range(rounds):
        if not len(left):
            break
        owner, begin = np.repeat(np.arange(len(left)), n), np.cumsum(n) - n
        s, h, lo, t, m = share[left], high[left], low[left], total[left], mass[left]
        odds = np.log(s / (1 - s))[owner] + x * np.log(h / lo)[owner] - (h - lo)[owner]
        elite = w / (1 + np.exp(-np.clip(odds, -700, 700)))
        e, ex = np.add.reduceat(elite, begin), np.add.reduceat(elite * x, begin)
        s1 = np.clip(e / t, _LEAST, 1 - _LEAST)
        h1, lo1 = np.maximum(ex / np.maximum(e, _LEAST), _LEAST), np.maximum((m - ex) / np.maximum(t - e, _LEAST), _LEAST)
        swap = lo1 > h1
        h1, lo1, s1 = np.where(swap, lo1, h1), np.where(swap, h1, lo1), np.where(swap, np.clip(1 - s1, _LEAST, 1 - _LEAST), s1)
        share[left], high[left], low[left] = s1, h1, lo1
        move = np.abs(np.log(h1 / h)) + np.abs(np.log(lo1 / lo)) + np.abs(np.log(s1 / s))
        on = move >= tolerance
        x, w, left, n = x[np.repeat(on, n)], w[np.repeat(on, n)], left[on], n[on]
    return share, high, low


def _fitter(n: int):
    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            lens = pdf["tfs"].map(len).to_numpy()
            held = np.concatenate(pdf["ns"].to_numpy()).astype(float)
            tf = np.concatenate(pdf["tfs"].to_numpy()).astype(float)
            ends = np.cumsum(lens)
            df = np.add.reduceat(held, ends - lens)
            # a zero entry in front of each histogram
            at = ends - lens
            tf_all, w_all = np.insert(tf, at, 0.0), np.insert(held, at, np.maximum(n - df, 0))
            start = at + np.arange(len(at))
            share, high, low = fit_two_poisson(start, tf_all, w_all)
            yield pd.DataFrame({
                "term": pdf["term"], "df": df.astype(np.int64), "corpus_freq": np.add.reduceat(held * tf, ends - lens).astype(np.int64),
                "elite_share": share, "elite_rate": high, "other_rate": low,
            })

    return fit


def term_models(tf: DataFrame, n_chunks: int) -> DataFrame:
    """The mixture of every term. A term's histogram has one entry per distinct count, so its array is short."""
    hist = tf.groupBy("term", "tf").agg(F.count("*").alias("n")).groupBy("term").agg(F.sort_array(F.collect_list(F.struct("tf", "n"))).alias("h"))
    hist = hist.select("term", F.col("h.tf").alias("tfs"), F.col("h.n").alias("ns"))
    return hist.mapInPandas(_fitter(n_chunks), _PARAMS)


def distinctive_terms(postings: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, df, corpus_freq, elite, log_odds) of every term of every chunk.

    `elite` is the posterior probability that the chunk is one the term is about. Empty input, or
    input of junk alone, gives no rows; extra columns are ignored.
    """
    tf, n = newest_frequencies(postings)
    return _scored(tf, n)


def _scored(tf: DataFrame, n: int) -> DataFrame:
    models = stage(term_models(tf, n).withColumn("rows", F.col("df")), "models")
    odds = (
        F.log(F.col("elite_share") / (1 - F.col("elite_share"))) + F.col("tf") * F.log(F.col("elite_rate") / F.col("other_rate")) - (F.col("elite_rate") - F.col("other_rate"))
    )
    joined = join_per_key(tf, models, "term", "rows").withColumn("log_odds", odds)
    return joined.select("chunk_id", "term", "tf", "df", "corpus_freq", (1 / (1 + F.exp(-F.col("log_odds")))).alias("elite"), "log_odds")


def top_terms(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k most telling terms of each chunk, ranked by elite log-odds (ties: term). Cut per map task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.round("log_odds", 9).desc(), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def rare_shared_terms(postings: DataFrame, least_tf: int = 3, one_in: int = 40, least_df: int = 2, most_df: int = 8) -> DataFrame:
    """(chunk_id, term) of the scored occurrences that are also frequent in the chunk and shared by few chunks.

    The counts define a case and no least posterior is asked for: a chunk with a term three times must not lose it because
    another chunk has it a hundred times, so that the mixture takes three for the other component.
    """
    tf, n = newest_frequencies(postings)
    telling = _scored(tf, n).where((F.col("tf") >= least_tf) & F.col("df").between(least_df, most_df))
    totals = tf.groupBy("chunk_id").agg(F.sum("tf").alias("chunk_tf"))
    return telling.join(totals, "chunk_id").where(F.col("tf") * one_in >= F.col("chunk_tf")).select("chunk_id", "term")


def mixtures(postings: DataFrame) -> DataFrame:
    """(term, df, corpus_freq, elite_share, elite_rate, other_rate) of every term."""
    return term_models(*newest_frequencies(postings))
