"""Sizes of texts in tokens of a public tokenizer. Tokenizer files are read where they are installed."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SETTING = "spark.palimpsest.tokenizer"  # the session's setting that names the vocabulary file on every machine
INSTALLED = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # where it is without the setting
_PIECE = 100_000


def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(enc, text: str) -> int:
    """Tokens of a whole text. Very long texts are counted in parts that end at blanks, so that no part takes quadratic time."""
    if len(text) <= _PIECE:
        return len(enc.encode_ordinary(text))
    n, at = 0, 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        if end < len(text):
            cut = text.rfind(" ", at + 1, end)
            end = cut if cut > at else end
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            sizes = np.array([count_tokens(enc, t.as_py()) for t in batch.column("text")], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes)], names=["doc_id", "source", "tokens"])

    return count


def plain_source(c: Column) -> Column:
    """A source's name without differences of letter case and blanks."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def token_sizes(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, tokens), one row per doc_id with text; `source` plain, possibly null. Null and empty texts have no row."""
    tokenizer = tokenizer or documents.sparkSession.conf.get(SETTING, INSTALLED)
    d = documents.select("doc_id", plain_source(F.col("source")).alias("source"), "text").where("doc_id is not null and text <> ''")
    sized = d.mapInArrow(_counter(tokenizer), "doc_id long, source string, tokens long")
    return sized.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))
