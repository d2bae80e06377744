"""Queries of problem 4, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators import orphans as op
from palimpsest.sources.tables import table


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.orphans(*[table(spark, sf_dir, t) for t in ("wal", "chunks", "postings", "fingerprints")])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("src_table", "src_key", "kind")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.orphan_counts(_found(spark, sf_dir))


_CASES = """
with w as (select distinct seq, op, memory_id, ts from wal where memory_id is not null),
born as (select memory_id, min(ts) as first_ts from w group by 1),
entry as (select distinct entry_id, parent_memory_id, written_at from chunks where parent_memory_id is not null),
state as (
  select e.entry_id, e.written_at, b.memory_id, b.first_ts,
         (select w.op from w where w.memory_id = e.parent_memory_id and w.ts <= e.written_at order by w.ts desc, w.seq desc limit 1) as last_op
  from entry e left join born b on b.memory_id = e.parent_memory_id),
of_chunks as (
  select 'chunks' as src_table, entry_id as src_key, written_at as at_ts,
         case when memory_id is null then 'missing' when first_ts > written_at then 'late' when last_op = 'delete' then 'deleted' end as kind
  from state),
of_postings as (
  select 'postings' as src_table, p.chunk_id as src_key, min(w.ts) as at_ts, 'missing' as kind
  from (select distinct chunk_id, seq from postings where chunk_id is not null) p left join (select seq, min(ts) as ts from wal group by 1) w on w.seq = p.seq
  where p.chunk_id not in (select chunk_id from chunks where chunk_id is not null) group by p.chunk_id),
prints as (select chunk_id, min(written_at) as at_ts from fingerprints where kind = 'text' and chunk_id is not null group by 1),
entered as (select chunk_id, min(written_at) as first_entry from chunks where chunk_id is not null group by 1),
of_prints as (
  select 'fingerprints' as src_table, p.chunk_id as src_key, p.at_ts,
         case when e.chunk_id is null then 'missing' when e.first_entry > p.at_ts then 'late' end as kind
  from prints p left join entered e on e.chunk_id = p.chunk_id),
cases as (
  select src_table, src_key, at_ts, kind from of_chunks where kind is not null union all
  select src_table, src_key, at_ts, kind from of_postings union all
  select src_table, src_key, at_ts, kind from of_prints where kind is not null)
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
ORACLE = {
    "p4_found": _CASES + "select src_table, src_key, kind from cases",
    "p4_report": _CASES + "select src_table, strftime(at_ts, '%Y-%m') as month, kind, count(*) as orphans from cases group by 1, 2, 3",
}
