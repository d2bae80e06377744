import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from palimpsest import cli
from palimpsest.config import EngineConfig
from palimpsest.functions.hashing import hash_features
from palimpsest.functions.text import tokens
from palimpsest.operators import blocks, chunker, corpus, encode, evaluate, retrieval
from palimpsest.operators import lsh as band_index
from palimpsest.plans import harness
from palimpsest.sources import readers
from palimpsest.store import Engine
from palimpsest.streaming import ingest
from pyspark.sql import functions as F


def test_settings():
    c = EngineConfig()
    assert c.bits == 10240 and c.token_weight + c.bigram_weight + c.context_weight == 1 and c.lsh_bands * c.lsh_rows == 160
    assert (c.max_tokens(), c.max_pairs()) == (491, 1843)


@pytest.mark.parametrize("word, value", [("a", 29161854018), ("quick", 17093897742474994334), ("0p", 14904192145392), ("machinelearning2020", 2858906395887035173)])
def test_hash(word, value):
    assert int(hash_features([word.encode()])[0]) == value


def test_tokens(spark):
    df = spark.createDataFrame([("Two RED-foxes, 3x!",), ("Kelvin İstanbul",), ("?;",), ("",), (None,)], "text string")
    assert [r.t for r in df.select(tokens(F.col("text")).alias("t")).collect()] == [["two", "red", "foxes", "3x"], ["elvin", "stanbul"], [], [], []]


def test_chunks(spark):
    long = " ".join(f"Sentence number {i} is here to fill the text." for i in range(120))
    df = spark.createDataFrame([(1, "short text"), (2, long), (3, ""), (4, None)], "doc_id long, text string")
    got = {}
    for r in chunker.with_ids(chunker.chunks_of(df)).collect():
        got.setdefault(r.parent_id, []).append(r)
    assert [r.text for r in got[1]] == ["short text"] and got[3][0].text == "" and len(got[2]) > 1
    two = sorted(got[2], key=lambda r: r.pos)
    assert all(r.words <= 491 and r.pairs <= 1843 for r in two)
    last = two[0].text.rsplit(". ", 1)[1]
    assert two[1].text.startswith(last)
    assert got[1][0].chunk_id == 0 and two[0].memory_id == 1 and two[0].chunk_id == 2


def test_idf(spark):
    df = spark.createDataFrame([(0, "the quick brown fox"), (1, "the lazy dog")], "doc_id long, text string")
    idf = {r.term: r.idf for r in corpus.sequential_idf(df).collect()}
    assert idf["the"] == 0 and idf["quick"] == 0 and idf["lazy"] == pytest.approx(math.log(2))


def test_jaccard_and_bands(spark):
    a = spark.createDataFrame([(0, [10, 20, 30])], "qid long, bits array<int>")
    b = spark.createDataFrame([(1, [10, 25]), (2, [10, 20, 30]), (3, [])], "id long, bits array<int>")
    got = {r.id: r.score for r in retrieval.semantic(a, b, 5, lsh="off").collect()}
    assert got[1] == pytest.approx(0.625) and got[2] == 1.0
    hits = {r.id: r.hits for r in retrieval.band_candidates(a, b).collect()}
    assert hits == {1: 79, 2: 80, 3: 79}  # one filled band differs, all others are empty in both


@pytest.mark.parametrize("k", [3, 500])
def test_blocks_find_the_best(spark, monkeypatch, k):
    for name, size in (("STORED", 40), ("ASKED", 17), ("LEAST", 10), ("_PARTS", 5), ("_TILE", 50)):
        monkeypatch.setattr(blocks, name, size)
    rnd = random.Random(k)
    rows = {i: {f: 1.0 + rnd.randrange(3) for f in {rnd.randrange(30) ** 2 // 30 for _ in range(rnd.randrange(9))}} for i in rnd.sample(range(10**6), 130)}
    df = spark.createDataFrame([(i, sorted(r), [r[f] for f in sorted(r)]) for i, r in rows.items()], "id long, f array<long>, w array<double>")

    def score(a, b):
        q, d = blocks.Sparse(a, "f"), blocks.Sparse(b, "f")
        s = blocks.product(q.n, d.n, q.row, q.feature, blocks.column(a, "w"), d.row, d.feature, blocks.column(b, "w"))
        return np.where(s > 0, s, -np.inf)

    asked = df.where("id % 2 = 0").withColumnRenamed("id", "qid").unionByName(spark.createDataFrame([(None, [1], [1.0])], "qid long, f array<long>, w array<double>"))
    got = {(r.qid, r.id): (r.score, r.rank) for r in retrieval.top_k(blocks.top_scores(asked, df, score, k), k).collect()}
    want = {}
    for q in (i for i in rows if i % 2 == 0):
        s = sorted((-sum(w * rows[i].get(f, 0) for f, w in rows[q].items()), i) for i in rows)
        want |= {(q, i): (-v, n + 1) for n, (v, i) in enumerate(s[:k]) if v < 0}
    assert got == want
    assert blocks.top_scores(asked, df.where("false"), score, k).count() == 0 and blocks.top_scores(asked.where("false"), df, score, k).count() == 0


def test_short_texts_are_candidates(spark):
    rows = [(i, [100 * i, 100 * i + 7, 5000 + 40 * i, 9000 + i]) for i in range(1, 30)] + [(30, [101, 109, 5041, 9002]), (31, [])] + [(32 + i, list(range(128 * i, 10240, 200 - i))) for i in range(3)]
    prints = spark.createDataFrame(rows, "id long, bits array<int>")
    q = prints.where("id = 1 or id >= 31").withColumnRenamed("id", "qid")
    passed = {(r.qid, r.id) for r in retrieval.band_candidates(q, prints).collect()}
    assert {(r.qid, r.id) for r in retrieval.semantic(q, prints, 100).collect()} == passed
    assert (1, 30) in passed and len(passed) > 100
    assert (1, 30) not in {(r.qid, r.id) for r in retrieval.semantic(q, prints, 100, lsh="nonzero").collect()}


def test_flagship_takes_the_reference_rule(spark, monkeypatch):
    from palimpsest.plans import core_queries

    assert "lsh_candidates_faithful" in core_queries.QUERIES
    rules, semantic = [], retrieval.semantic
    monkeypatch.setattr(retrieval, "semantic", lambda q, p, k, cfg, lsh="faithful": rules.append(lsh) or semantic(q, p, k, cfg, lsh))
    core_queries.hybrid_search(spark, "/root/testdata/sf0.001")
    assert rules == ["faithful"]


def test_fusion(spark):
    lane = "qid long, id long, score double, rank int"
    one = spark.createDataFrame([(7, 31, 5.0, 1), (7, 12, 4.0, 2), (7, 55, 1.0, 3)], lane)
    two = spark.createDataFrame([(7, 12, -3.0, 1), (7, 90, -3.0, 2)], lane)
    got = {r.id: r.score for r in retrieval.fuse([one, two], 10, EngineConfig(rrf_k=4)).collect()}
    want = {31: 2 / 5, 12: 1.75 / 6 + 2 / 5, 55: 1 / 7, 90: 2 / 6}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("name", ["rrf_fusion_lexical", "lane_origins_lexical", "parent_scores_lexical"])
def test_lexical_lists_are_fused(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from palimpsest.plans import core_queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lane_hits", "chunks"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    assert sorted(tuple(r) for r in core_queries.QUERIES[name](spark, d).collect()) == sorted(con.sql(core_queries.ORACLE[name]).fetchall())


def test_dense(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.id: r.bits for r in encode.encode_vectors(df).collect()}
    assert got[0] == got[3] != [] and got[1] == [] and got[2] == []


def test_metrics(spark):
    res = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "qid long, id long, rank int")
    rel = spark.createDataFrame([(1, 6), (1, 6), (1, 9), (2, 1)], "qid long, id long")
    m = evaluate.metrics(res, rel).first()
    assert (m.queries, m.recall, m.precision, m.mrr, m.map) == (1, 0.5, round(1 / 3, 9), 0.5, 0.25)
    s = spark.createDataFrame([(1.0, 1), (2.0, 1), (1.0, 0), (0.0, 0)], "score double, positive int")
    assert evaluate.auroc(s).first().auroc == 0.875
    assert evaluate.auroc(s.where("positive = 1")).first().auroc == 0.5
    v = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")
    assert evaluate.low_percentile(v, "x", 0.5).first()["value"] == 2
    sizes = spark.createDataFrame([(0,), (20,), (21,), (157,), (158,)], "s int").select(evaluate.code_bytes(F.col("s")).alias("b"))
    assert [r.b for r in sizes.collect()] == [1, 181, 189, 1277, 1280]


def test_store(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    text = "text string"
    ids = {r.text: r.id for r in e.insert(spark.createDataFrame([("alpha beta gamma delta",), ("the red fox jumps",), ("-",), (None,)], text)).collect()}
    assert sorted(ids.values()) == [0, 1]
    q = spark.createDataFrame([(1, "red fox")], "qid long, text string")
    best = e.search(q, 1).first()
    assert best.id == ids["the red fox jumps"] and best.text == "the red fox jumps" and best.created > 0
    e.update(spark.createDataFrame([(0, "a red fox and a red fox"), (55, "nobody")], "id long, text string"))
    e.delete(spark.createDataFrame([(1,), (77,)], "id long"))
    assert [(r.id, r.text) for r in e.search(q, 5).collect()] == [(0, "a red fox and a red fox")]
    folder = e.checkpoint()
    dense = {r.key: r.id for r in e.insert_dense(spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0])], "key long, vector array<float>")).collect()}
    vector = spark.createDataFrame([(9, [1.0, 0.0, 0.0, 0.0])], "qid long, vector array<float>")
    assert e.search_dense(vector, 2, kind="dense").orderBy("rank").first().id == dense[1]
    assert {r.id for r in e.search_dense(vector, 9).collect()} == {0, *dense.values()}  # texts' fingerprints are searched, too
    e.delete_dense(spark.createDataFrame([(dense[1],), (0,)], "id long"))
    assert e.vectors().count() == 1 and e.documents().count() == 1 and e.stats().first().documents == 1
    # what the log changed since the snapshot is made anew, the rest is the snapshot's
    e.insert(spark.createDataFrame([(2, "one more fox"), (1, "another text")], "n int, text string"), order="n")
    assert {r.text: r.id for r in e.documents().collect()}["another text"] == 4
    rows = lambda t, name: sorted(map(str, t[name].select(*sorted(t[name].columns)).collect()))
    whole, grown, opened = e.tables(), e.index(), e.open(folder)
    for name in ("docs", "chunks", "postings", "lengths", "stats", "idf"):
        assert rows(whole, name) == rows(grown, name) == rows(opened, name)
    assert {r.id for r in grown["prints"].collect()} == {r.id for r in whole["prints"].collect()} and rows(whole, "postings")
    assert e.checkpoint() != folder and e._snapshots()[0] == e._next()[0] - 1
    assert rows(Engine(spark, e.path).index(), "bands") == rows(grown, "bands")


def test_store_errors_and_two_writers(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "log").write_text("no parquet")
    with pytest.raises(Exception):  # and not ids from 0 again
        e.insert(spark.createDataFrame([("x y",)], "text string"))
    assert not e._exists("writer.lock")
    e = Engine(spark, str(tmp_path / "t"), lock_seconds=30)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: Engine(spark, e.path, lock_seconds=60).insert(spark.createDataFrame([(f"text {i} {j}",) for j in range(3)], "text string")), range(3)))
    log = e._log().collect()
    assert sorted(r.id for r in log) == list(range(9)) == sorted(r.seq - 1 for r in log)
    with e._writing(), pytest.raises(TimeoutError):
        Engine(spark, e.path, lock_seconds=0.2).delete(spark.createDataFrame([(1,)], "id long"))


def test_whole_runs(spark, tmp_path):
    corpus = spark.createDataFrame([("d1", "cold shards are merged at night"), ("d2", "warm lanes are read twice"), ("d3", "the night lane merges shards")], "doc_key string, text string")
    asked = spark.createDataFrame([("q1", "night shards"), ("q2", "lanes read"), ("q3", None)], "query_key string, text string")
    rel = spark.createDataFrame([("q1", "d1"), ("q1", "d3"), ("q2", "d2"), ("q2", "gone")], "query_key string, doc_key string")
    found, m = harness.judged_run(Engine(spark, str(tmp_path / "a")), corpus, asked, rel, 3)
    assert found.where("rank = 1 and query_key = 'q2'").first().doc_key == "d2"
    m = m.first()
    assert m.queries == 2 and m.recall == 1.0 and m.mrr == 1.0
    r = harness.rates(Engine(spark, str(tmp_path / "b")), corpus, 1, 1, spark.createDataFrame([(1, "night")], "qid long, text string"))
    assert r.keys() == {"insert", "delete", "update", "search"} and min(r.values()) > 0


def test_band_index(spark):
    prints = spark.createDataFrame([(1, [5, 700, 9000]), (2, [5, 700, 44]), (3, []), (4, None), (5, [5, 9000])], "id long, bits array<int>")
    stored = band_index.inserted(band_index.empty(spark), prints)
    assert stored.count() == 3 + 2 + 2 and {r.id for r in stored.collect()} == {1, 2, 5}
    q = prints.where("id = 1").withColumnRenamed("id", "qid")
    assert {(r.id, r.hits) for r in band_index.candidates(stored, q).collect()} == {(1, 3), (5, 2)}
    less = band_index.removed(stored, spark.createDataFrame([(5,), (88,)], "id long"))
    assert {r.id for r in band_index.candidates(less, q, 1).collect()} == {1, 2}
    again = band_index.inserted(stored, spark.createDataFrame([(2, [5, 700, 9000])], "id long, bits array<int>"))
    assert {r.id for r in band_index.candidates(again, q, 3).collect()} == {1, 2}


def test_stream(spark, tmp_path):
    schema = "seq long, op string, memory_id long, text string"
    rows = [(1, "insert", 1, "one two two"), (2, "insert", 2, "three"), (3, "delete", 2, None), (4, "update", 1, "four")]
    spark.createDataFrame(rows[:2], schema).write.parquet(str(tmp_path / "log" / "a"))
    for part in ("a", "b"):
        if part == "b":
            spark.createDataFrame(rows[2:], schema).write.parquet(str(tmp_path / "log" / "b"))
        q = ingest.follow(spark, str(tmp_path / "log" / "*"), schema, str(tmp_path / "index"), str(tmp_path / "ck"))
        q.awaitTermination()
    got = {tuple(r) for r in ingest.current_postings(spark.read.parquet(str(tmp_path / "index"))).collect()}
    assert got == {(1, "four", 1)}
    # a record that comes again, and an update of a deleted memory
    spark.createDataFrame([rows[3], (5, "update", 2, "late")], schema).write.parquet(str(tmp_path / "log" / "c"))
    ingest.follow(spark, str(tmp_path / "log" / "*"), schema, str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in ingest.current_postings(spark.read.parquet(str(tmp_path / "index"))).collect()] == [(1, "four", 1)]


def test_command_line(spark, tmp_path, capsys):
    def run(*args):
        assert cli.main(["--store", str(tmp_path / "cli"), *args]) == 0
        return capsys.readouterr().out

    assert [run("insert", t).strip() for t in ("a red fox", "a blue whale")] == ["0", "1"]
    assert "red fox" in run("search", "fox", "1")
    run("update", "0", "a green frog")
    run("delete", "1")
    assert "frog" in run("search", "frog") and "|1        |" in run("stats")
    for bad in (["insert", ""], ["update", "0", "-"]):
        with pytest.raises(SystemExit):
            run(*bad)


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id":"1","title":"T","text":"x"}\n{"_id":"2","title":"","text":"y"}\n')
    assert {r.text for r in readers.corpus_jsonl(spark, str(tmp_path / "c.jsonl")).collect()} == {"T x", "y"}
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\t2\t1\n1\t2\t1\n3\t4\n")
    assert [tuple(r) for r in readers.qrels_tsv(spark, str(tmp_path / "q.tsv")).collect()] == [("1", "2")]
    t = spark.createDataFrame([(1, 2, "b", "you"), (1, 1, "a", "hi")], "session long, turn long, role string, text string")
    assert readers.sessions(t).first().text == "a: hi\nb: you"
    import struct

    raw = struct.pack("<4s7I", b"ADLV", 1, 1, 1, 2, 2, 0, 0) + np.array([1, 2, 3, 4], "<f4").tobytes() + np.array([0, 1], "<u4").tobytes()
    (tmp_path / "f.bin").write_bytes(raw)
    assert [(r.split, r.embedding, r.label) for r in readers.features_binary(spark, str(tmp_path / "f.bin")).collect()] == [("train", [1.0, 2.0], 0), ("test", [3.0, 4.0], 1)]
    for bad in (raw[:20], b"NONE" + raw[4:], raw[:4] + struct.pack("<I", 2) + raw[8:], raw + b"x"):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(Exception, match="feature file"):
            readers.features_binary(spark, str(tmp_path / "bad.bin")).collect()


def test_best_leaves_out_what_has_no_score():
    s = np.full((3, 4096), -np.inf)
    s[:, 4000:4020] = -np.arange(60.0).reshape(3, 20)
    r, c = blocks._best(s, 5)
    assert sorted(zip(r.tolist(), c.tolist())) == [(i, 4000 + j) for i in range(3) for j in range(5)]


def _some_prints(spark, n=300):
    rnd = random.Random(4)
    rows = [(i, sorted({300 * rnd.randrange(34) + rnd.randrange(2) for _ in range(rnd.randrange(12))})) for i in range(n)]
    return dict(rows), spark.createDataFrame(rows, "id long, bits array<int>")


def _small_blocks(monkeypatch):
    """No pair of a block is a row of a shuffle, and no side is written once per block of the other."""
    for name, size in (("STORED", 40), ("ASKED", 8), ("LEAST", 10), ("_RUN", 3)):
        monkeypatch.setattr(blocks, name, size)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weighted_jaccard_over_many_blocks(spark, monkeypatch):
    _small_blocks(monkeypatch)
    rows, prints = _some_prints(spark)
    cfg = EngineConfig()
    got = retrieval.semantic(prints.where("id % 20 = 0").withColumnRenamed("id", "qid"), prints, 7, cfg, "off")
    assert "CartesianProduct" in _plan(got)
    part = lambda b, lo, hi: {x for x in b if lo <= x < hi}
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    score = lambda q, d: sum(w * share(part(rows[q], lo, hi), part(rows[d], lo, hi)) for _, lo, hi, w in cfg.regions)
    want = {(q, d, i + 1) for q in rows if q % 20 == 0 for i, d in enumerate(sorted(rows, key=lambda d: (-round(score(q, d), 9), d))[:7])}
    assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == want


def test_plain_jaccard_over_many_blocks(spark, monkeypatch):
    _small_blocks(monkeypatch)
    rows, prints = _some_prints(spark)
    got = retrieval.plain_jaccard(prints.where("id % 20 = 0").withColumnRenamed("id", "qid"), prints, 3)
    assert "CartesianProduct" in _plan(got)
    sets = {i: set(b) for i, b in rows.items()}
    score = lambda q, d: len(sets[q] & sets[d]) / max(1, len(sets[q] | sets[d]))
    want = {(q, d, i + 1) for q in rows if q % 20 == 0 for i, d in enumerate(sorted((d for d in rows if d != q), key=lambda d: (-round(score(q, d), 9), d))[:3])}
    assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == want


def test_bands_meet_in_blocks(spark, monkeypatch):
    _small_blocks(monkeypatch)
    rows, prints = _some_prints(spark)
    got = retrieval.band_candidates(prints.where("id % 20 = 0").withColumnRenamed("id", "qid"), prints, 2, False)
    assert "CartesianProduct" in _plan(got) and "SortMergeJoin" not in _plan(got)
    held = {i: {(x >> 7, tuple(y for y in b if y >> 7 == x >> 7)) for x in b} for i, b in rows.items()}
    want = {(q, d, len(held[q] & held[d])) for q in rows if q % 20 == 0 for d in rows if len(held[q] & held[d]) >= 2}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_candidates_after_a_removal_meet_in_blocks(spark, monkeypatch):
    from palimpsest.plans import core_queries

    _small_blocks(monkeypatch)
    rows, prints = _some_prints(spark)
    monkeypatch.setattr(core_queries, "_prints", lambda spark, d: prints)
    got = core_queries.lsh_after_removal(spark, "")
    assert "CartesianProduct" in _plan(got)
    held = {i: {(x >> 7, tuple(y for y in b if y >> 7 == x >> 7)) for x in b} for i, b in rows.items()}
    want = {(q, d, len(held[q] & held[d])) for q in rows if q % 20 == 0 for d in rows if d % 3 and len(held[q] & held[d]) >= 2}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_namespaces_meet_in_blocks(spark, monkeypatch):
    _small_blocks(monkeypatch)
    rnd = random.Random(8)
    rows = [(f"n{i % 3}", i, " ".join(rnd.choice("abcdefghij") * rnd.randrange(1, 4) for _ in range(rnd.randrange(12)))) for i in range(240)]
    docs = spark.createDataFrame(rows, "ns string, id long, text string")
    q = docs.where("id % 20 = 0").withColumnRenamed("id", "qid")
    got = retrieval.lexical_within(q, docs, 4)
    assert "CartesianProduct" in _plan(got)
    want = set()
    for ns in ("n0", "n1", "n2"):
        own = docs.where(f"ns = '{ns}'").select(F.col("id").alias("doc_id"), "text")
        post = corpus.postings(own)
        want |= {(r.qid, r.id, r["rank"]) for r in retrieval.lexical(q.where(f"ns = '{ns}'"), post, corpus.term_stats(post), corpus.lengths(own), 4).collect()}
    assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == want and want


def test_common_bits_are_counted_in_blocks(spark, monkeypatch):
    _small_blocks(monkeypatch)
    rows, prints = _some_prints(spark)
    got = retrieval.region_counts(prints.where("id % 20 = 0").withColumnRenamed("id", "qid"), prints)
    assert "CartesianProduct" in _plan(got) and "SortMergeJoin" not in _plan(got)
    sets = {i: set(b) for i, b in rows.items()}
    both = {(q, d): sets[q] & sets[d] for q in rows if q % 20 == 0 for d in rows}
    assert {tuple(r) for r in got.collect()} == {(*p, sum(x < 4096 for x in b), sum(4096 <= x < 7168 for x in b), sum(x >= 7168 for x in b)) for p, b in both.items() if b}
