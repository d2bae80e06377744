"""Readers of benchmark files: JSON lines, tab-separated judgments, conversations, binary features."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, text): title and text of each line, the title in front where there is one."""
    d = spark.read.schema("_id string, title string, text string").json(path)
    text = F.coalesce("text", F.lit(""))
    return d.select(F.col("_id").alias("doc_key"), F.when(F.length("title") > 0, F.concat_ws(" ", "title", text)).otherwise(text).alias("text"))


def queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("query_key"), "text")


def qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(query_key, doc_key), each once, of a file with a header; rows of fewer than three fields are skipped, scores ignored."""
    d = spark.read.csv(path, sep="\t", header=True, schema="q string, d string, s string", mode="PERMISSIVE")
    return d.where("s is not null").select(F.trim("q").alias("query_key"), F.trim("d").alias("doc_key")).distinct()


def sessions(turns: DataFrame) -> DataFrame:
    """(session, text) of (session, turn, role, text): `role: text` lines in order of the turn."""
    t = turns.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return t.select("session", F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit(": "), F.coalesce(x.text, F.lit("")))), "\n").alias("text"))


def question_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question_type, question, session, answers, text), one row per haystack session of a long-conversation file."""
    schema = (
        "question_id string, question_type string, question string, answer string, answer_session_ids array<string>, "
        "haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"
    )
    d = spark.read.schema(schema).json(path, multiLine=True)
    d = d.select("question_id", "question_type", "question", F.col("answer_session_ids").alias("answers"), F.explode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("h"))
    line = F.transform("h.haystack_sessions", lambda x: F.concat(x.role, F.lit(": "), x.content))
    return d.select("question_id", "question_type", "question", F.col("h.haystack_session_ids").alias("session"), "answers", F.array_join(line, "\n").alias("text"))


# fixed values: layout, first number and version of feature files
FEATURE_HEADER, FEATURE_MAGIC, FEATURE_VERSION = "<4s7I", b"ADLV", 1


def features_binary(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, split, embedding, label) of feature files: four bytes and seven 32-bit numbers (magic, version, train rows, test rows,
    dimensions, classes, two spare), then both float32 matrices, then both label lists. Files of another magic, version or size give an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                b = raw.as_py()
                head = struct.calcsize(FEATURE_HEADER)
                if len(b) < head:
                    raise ValueError("feature file without a header")
                magic, version, train, test, dim, *_ = struct.unpack_from(FEATURE_HEADER, b)
                n = train + test
                if (magic, version) != (FEATURE_MAGIC, FEATURE_VERSION) or len(b) != head + n * dim * 4 + n * 4:
                    raise ValueError("feature file of another kind or size")
                x = np.frombuffer(b, "<f4", n * dim, head)
                y = np.frombuffer(b, "<u4", n, head + n * dim * 4).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(["train"] * train + ["test"] * test), lists, pa.array(y)], names=["vec_id", "split", "embedding", "label"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "vec_id long, split string, embedding array<float>, label int")
