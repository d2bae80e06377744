"""Queries of the operators in this folder, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import distinctive, mixing, nearcopies, neighbours, packing, rankfuse, residue, split
from palimpsest.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.rare_shared_terms(table(spark, sf_dir, "postings"))


def p1_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = distinctive.top_terms(distinctive.distinctive_terms(table(spark, sf_dir, "postings")), 10)
    return top.withColumns({"elite": F.round("elite", 5), "log_odds": F.round("log_odds", 4)})


def p1_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = distinctive.mixtures(table(spark, sf_dir, "postings"))
    return m.withColumns({"elite_share": F.round("elite_share", 6), "elite_rate": F.round("elite_rate", 4), "other_rate": F.round("other_rate", 6)})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.mutual_or_single_pairs(table(spark, sf_dir, "fingerprints"))
    return found.withColumnsRenamed({"a": "chunk_id_a", "b": "chunk_id_b"})


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "fingerprints"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearcopies.near_duplicate_pairs(table(spark, sf_dir, "wal"))
    return found.withColumnsRenamed({"a": "seq_a", "b": "seq_b"})


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_duplicate_groups(table(spark, sf_dir, "wal")).withColumnRenamed("id", "seq")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.over_limit_records(table(spark, sf_dir, "wal"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.pieces(table(spark, sf_dir, "wal"))


def p5_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.covers(table(spark, sf_dir, "wal"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankfuse.firsts(table(spark, sf_dir, "lane_hits"))


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankfuse.ranking(table(spark, sf_dir, "lane_hits")).withColumn("fused", F.round("fused", 6))


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.places(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p7_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`p7_places` with sources that must not share a container: the ranker's issues with any chat, drafts with papers."""
    apart = [("issues/ranker", "chat/lsh"), ("issues/ranker", "chat/store"), ("howto/drafts", "notes/papers"), ("issues/drafts", "notes/papers")]
    return packing.places(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"), apart)


def p7_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p7_places(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(_mixture(spark, sf_dir))


def p8_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).slots


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_mixture(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_top_terms": p1_top_terms, "p1_mixtures": p1_mixtures,
    "p2_found": p2_found, "p2_neighbours": p2_neighbours,
    "p3_found": p3_found, "p3_groups": p3_groups,
    "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_covers": p5_covers,
    "p6_found": p6_found, "p6_ranking": p6_ranking,
    "p7_places": p7_places, "p7_apart": p7_apart, "p7_unused": p7_unused,
    "p8_copies": p8_copies, "p8_slots": p8_slots, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_clean": p9_clean,
}

_TF = r"""
with recursive p as (select distinct segment, term, chunk_id, freq, seq from postings),
n as (select trim(translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as term, chunk_id, freq, seq from p where term is not null and trim(term) <> '' and chunk_id is not null and freq > 0),
newest as (select chunk_id, max(seq) as seq from n group by 1),
tf as (select n.chunk_id, n.term, sum(n.freq) as tf from n join newest using (chunk_id, seq) group by 1, 2)"""

# the expectation-maximisation, a round a step, on each term's histogram with the zero counts in front
_EM = _TF + r""",
hist as (select term, tf, count(*) as n from tf group by 1, 2),
lists as (select term, sum(n)::bigint as df, sum(n * tf)::bigint as mass, list_prepend(0.0::double, list(tf::double order by tf)) as x, list(n::double order by tf) as held, (select count(distinct chunk_id) from newest) as chunks from hist group by 1),
begun as (select term, df, mass, x, list_prepend(greatest(chunks - df, 0)::double, held) as w, greatest(chunks, df)::double as total from lists),
em as (
 select term, x, w, total, mass::double as mass, least(0.5, greatest(1e-9, df / total * 0.5))::double as s, (greatest(mass / df, 1.0) * 1.25)::double as h, greatest(mass / total * 0.5, 1e-9)::double as lo, 0 as round, 1.0::double as move from begun
 union all
 select term, x, w, total, mass, s1, h1, lo1, round + 1, abs(ln(h1 / h)) + abs(ln(lo1 / lo)) + abs(ln(s1 / s))
 from (select *, case when b > a then greatest(1e-9, least(1 - 1e-9, 1 - sh)) else sh end as s1, greatest(a, b) as h1, least(a, b) as lo1
  from (select *, greatest(1e-9, least(1 - 1e-9, e / total)) as sh, greatest(ex / greatest(e, 1e-9), 1e-9) as a, greatest((mass - ex) / greatest(total - e, 1e-9), 1e-9) as b
   from (select *, list_sum(z) as e, list_sum(list_transform(range(1, len(x) + 1), lambda i: z[i] * x[i])) as ex
    from (select *, list_transform(range(1, len(x) + 1), lambda i: w[i] / (1 + exp(-greatest(-700.0, least(700.0, ln(s / (1 - s)) + x[i] * ln(h / lo) - (h - lo)))))) as z from em where move >= 1e-8 and round < 400))))),
fit as (select term, arg_max(s, round) as s, arg_max(h, round) as h, arg_max(lo, round) as lo from em group by 1),
model as (select term, df, mass as corpus_freq, s, h, lo from begun join fit using (term))"""

# every pair of records that share a run of three words; classes of equal sets, and their links
_RUNS = r"""
with recursive t as (select distinct seq, memory_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') as w from wal where seq is not null and text is not null),
sets as (select seq, memory_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as s from t where len(w) >= 3),
big as (select seq, memory_id, s, len(s) as n, md5(array_to_string(s, '|')) as h from sets where len(s) >= 15),
cls as (select h, min(seq) as rep, any_value(s) as s, any_value(n) as n, count(*) as copies, count(distinct memory_id) + max((memory_id is null)::int) as owners, min(memory_id) as owner from big group by 1),
run as (select h, n, owners, owner, unnest(s) as r from cls),
met as (select a.h as ha, b.h as hb, any_value(a.n) as na, any_value(b.n) as nb, count(*) as shared from run a join run b on a.r = b.r and a.h < b.h group by 1, 2),
near as (select ha, hb from met where shared * 5 >= 3 * (na + nb - shared)),
same as (select h as ha, h as hb from cls where copies > 1 union all select ha, hb from near)"""

# ranks in shares, correlations over the queries that have both lists, and the first component by powers of the matrix
_COMPONENT = r"""
with recursive best as (select qid, lane, mu, memory_id, max(score) as s from lane_hits where qid is not null and memory_id is not null and score is not null and not isnan(score) and score <> -1e9 group by all),
kinds as (select lane, mu, row_number() over (order by lane, mu nulls first) as k from (select distinct lane, mu from best)),
ranked as (select qid, k, memory_id, (rank() over (partition by qid, k order by s) + (count(*) over (partition by qid, k, s) - 1) / 2.0) / count(*) over (partition by qid, k) as share from best join kinds on kinds.lane is not distinct from best.lane and kinds.mu is not distinct from best.mu),
members as (select qid, count(distinct memory_id)::double as n from ranked group by 1),
lists as (select qid, k, sum(share) as s, sum(share * share) as ss from ranked group by 1, 2),
sums as (select a.k as a, b.k as b, sum(n) as n, sum(a.s) as sa, sum(b.s) as sb, sum(a.ss) as saa, sum(b.ss) as sbb from lists a join lists b using (qid) join members using (qid) group by 1, 2),
products as (select a.k as a, b.k as b, sum(a.share * b.share) as sab from ranked a join ranked b using (qid, memory_id) group by 1, 2),
moments as (select a, b, saa / n - (sa / n) ** 2 as va, sbb / n - (sb / n) ** 2 as vb, coalesce(sab, 0) / n - sa * sb / n ** 2 as cab from sums left join products using (a, b)),
known as (select a, b, cab / sqrt(va * vb) as c from moments where va > 1e-12 and vb > 1e-12),
cells as (select x.k as a, y.k as b, case when x.k = y.k then 1.0 else coalesce(c, (select avg(c) from known where a <> b), 0) end::double as c from kinds x cross join kinds y left join known on known.a = x.k and known.b = y.k),
matrix as (select list(row order by a) as m from (select a, list(c order by b) as row from cells group by 1)),
power as (
 select m, list_transform(m, lambda r: 1.0::double + list_sum(r) / 1e3) as v, 0 as i from matrix
 union all
 select m, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y)))) as v, i + 1 from (select m, i, list_transform(m, lambda r: list_sum(list_transform(range(1, len(v) + 1), lambda j: r[j] * v[j]))) as u from power where i < 600)),
vec as (select case when list_sum(v) < 0 then list_transform(v, lambda x: -x) else v end as v from power where i = 600),
weights as (select k, v[k] / case when va > 1e-12 then sqrt(va) else 1 end as w from kinds, vec, moments where a = k and b = k),
fused as (select qid, memory_id, round(sum(share * w), 9) as f from ranked join weights using (k) group by 1, 2)"""

ORACLE = {
    "p3_found": _RUNS + " select distinct least(a.seq, b.seq) as seq_a, greatest(a.seq, b.seq) as seq_b from same join big a on a.h = ha join big b on b.h = hb where a.seq <> b.seq and a.memory_id is distinct from b.memory_id",
    "p3_groups": _RUNS + """, apart as (select a.rep as a, b.rep as b from near join cls a on a.h = ha join cls b on b.h = hb where not (a.owners = 1 and b.owners = 1 and a.owner is not distinct from b.owner)),
 ways as (select a, b from apart union all select b, a from apart),
 reach as (select rep as a, rep as b from cls union select reach.a, ways.b from reach join ways on ways.a = reach.b),
 grp as (select a as rep, min(b) as group_id from reach group by 1), deg as (select a as rep, count(*) as links from ways group by 1)
 select distinct seq, rep as class_id, group_id, coalesce(links, 0) as links from big join cls using (h) join grp using (rep) left join deg using (rep)""",
    "p6_ranking": _COMPONENT + " select qid, memory_id, round(f, 6) as fused, row_number() over (partition by qid order by f desc, memory_id)::int as place from fused",
    "p1_mixtures": _EM + " select term, df, corpus_freq, round(s, 6) as elite_share, round(h, 4) as elite_rate, round(lo, 6) as other_rate from model",
    "p1_top_terms": _EM + """, scored as (select chunk_id, term, tf::bigint as tf, df, corpus_freq, ln(s / (1 - s)) + tf * ln(h / lo) - (h - lo) as log_odds from tf join model using (term)),
 placed as (select *, row_number() over (partition by chunk_id order by round(log_odds, 9) desc, term)::int as place from scored)
 select chunk_id, term, tf, df, corpus_freq, round(1 / (1 + exp(-log_odds)), 5) as elite, round(log_odds, 4) as log_odds, place from placed where place <= 10""",
    "p1_found": _TF + r""",
df as (select term, count(*) as df from tf group by 1),
total as (select chunk_id, sum(tf) as chunk_tf from tf group by 1)
select chunk_id, term from tf join df using (term) join total using (chunk_id) where tf >= 3 and df between 2 and 8 and tf * 40 >= chunk_tf""",
    "p5_found": r"""
with t as (select distinct seq, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from wal where length(text) > 500),
big as (select * from t where len(regexp_extract_all(low, '[a-z0-9]+')) >= 492 or length(regexp_replace(low, '[^a-z0-9]+', '', 'g')) - len(regexp_extract_all(low, '[a-z0-9]+')) >= 1844),
unit as (select seq, unnest(string_split_regex(regexp_replace(low, '([.!?])([ \t\n\r])', '\1' || chr(1) || '\2', 'g'), chr(1) || '|\n|\r')) as u from big),
sized as (select seq, len(regexp_extract_all(u, '[a-z0-9]+')) as w, length(regexp_replace(u, '[^a-z0-9]+', '', 'g')) as c from unit)
select seq, case when max(case when w >= 492 or c - w >= 1844 then 1 else 0 end) = 1 then 'forced' else 'boundary' end as kind from sized group by seq""",
    "p5_covers": r"""
with t as (select distinct seq, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from wal where length(text) > 500),
n as (select seq, text, len(regexp_extract_all(low, '[a-z0-9]+')) as w, length(regexp_replace(low, '[^a-z0-9]+', '', 'g')) as c from t)
select seq, length(text)::bigint as fresh_chars, length(text)::bigint as last_end, 0::bigint as over, 0::bigint as unfounded, 0::bigint as gaps from n where w >= 492 or c - w >= 1844""",
    "p6_found": r"""
with best as (select qid, lane, mu, memory_id, max(score) as s from lane_hits where score is not null and not isnan(score) and score <> -1e9 group by all),
ranked as (select qid, memory_id, rank() over (partition by qid, lane, mu order by s) + (count(*) over (partition by qid, lane, mu, s) - 1) / 2.0 as r, count(*) over (partition by qid, lane, mu) as n from best),
fused as (select qid, memory_id, sum(r / n) as f from ranked group by 1, 2)
select qid, arg_max(memory_id, (f, -memory_id)) as memory_id from fused group by 1""",
}
