"""Whole runs over an engine: retrieval quality of a judged corpus, and rates of insertion, deletion, update and search."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import evaluate
from palimpsest.session import stage
from palimpsest.store import Engine


def judged_run(engine: Engine, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """Insert a corpus (doc_key, text), search for all queries (query_key, text), and judge by (query_key, doc_key).

    Gives the results (query_key, doc_key, score, rank), the key empty where a document has none, and one row of metrics.
    Documents are inserted in order of their keys.
    """
    keys = engine.insert(corpus.select("doc_key", "text"), order="doc_key").select("id", "doc_key")
    asked = stage(queries.where("text is not null").select(F.xxhash64("query_key").alias("qid"), "query_key", "text"), "asked")
    found = stage(engine.search(asked.select("qid", "text"), k).select("qid", "id", "score", "rank"), "found")
    rel = qrels.select(F.xxhash64("query_key").alias("qid"), "doc_key").join(keys, "doc_key").select("qid", "id")
    named = evaluate.with_keys(found, keys).join(asked.select("qid", "query_key"), "qid").select("query_key", "doc_key", "score", "rank")
    return named, evaluate.metrics(found, rel)


def rates(engine: Engine, texts: DataFrame, deletes: int, updates: int, queries: DataFrame, k: int = 10) -> dict[str, float]:
    """Rows a second of inserting `texts` (text), deleting the first so many, updating the next so many, and searching for `queries` (qid, text)."""
    out = {}

    def timed(name: str, rows: int, call) -> DataFrame | None:
        began = time.monotonic()
        done = call()
        out[name] = rows / max(time.monotonic() - began, 1e-9)
        return done

    texts = stage(texts.select("text"), "texts")
    ids = timed("insert", texts.count(), lambda: engine.insert(texts))
    timed("delete", deletes, lambda: engine.delete(ids.where(F.col("id") < deletes).select("id")))
    some = ids.where((F.col("id") >= deletes) & (F.col("id") < deletes + updates))
    timed("update", updates, lambda: engine.update(some.select("id", F.concat("text", F.lit(" updated")).alias("text"))))
    timed("search", queries.count(), lambda: engine.search(queries, k).count())
    return out


__all__ = ["judged_run", "rates"]
