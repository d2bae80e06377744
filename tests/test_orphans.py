from datetime import datetime

from palimpsest.operators.orphans import dictionary, orphan_counts, orphans

WAL = "seq long, op string, memory_id long, ts timestamp_ntz"
CHUNKS = "entry_id long, parent_memory_id long, chunk_id long, written_at timestamp_ntz, code string"
POST = "chunk_id long, seq long"
PRINTS = "chunk_id long, kind string, written_at timestamp_ntz"


def t(day, hour=0):
    return datetime(2024, 1 + day // 31, 1 + day % 31, hour)


def test_verdicts(spark):
    wal = spark.createDataFrame([(1, "insert", 1, t(0)), (2, "delete", 1, t(40)), (2, "delete", 1, t(40)), (3, "insert", 1, t(45)), (4, "insert", 2, t(50)), (5, "insert", None, t(1))], WAL)
    chunks = spark.createDataFrame(
        [(1, 1, 1, t(5), "x"), (2, 1, 1, t(42), "x"), (2, 1, 1, t(42), "x"), (3, 1, 1, t(46), "x"), (4, 2, 2, t(10), "x"), (5, 3, 3, t(10), "x"), (6, None, 4, t(10), "x"), (7, 9, 5, None, "x"), (8, 1, 1, t(40), "x")], CHUNKS
    )
    post = spark.createDataFrame([(1, 1), (77, 4), (77, 1), (None, 1), (-5, 99)], POST)
    prints = spark.createDataFrame([(3, "text", t(1)), (3, "text", t(20)), (88, "text", t(3)), (99, "dense", t(3)), (1, "text", t(6)), (None, "text", t(1)), (2, "text", None)], PRINTS)
    found = orphans(wal, chunks, post, prints)
    got = {(r.src_table, r.src_key, r.kind) for r in found.collect()}
    assert got == {
        ("chunks", 2, "deleted"), ("chunks", 8, "deleted"), ("chunks", 4, "late"), ("chunks", 5, "missing"), ("chunks", 7, "missing"),
        ("postings", 77, "missing"), ("postings", -5, "missing"), ("fingerprints", 3, "late"), ("fingerprints", 88, "missing"),
    }
    months = {(r.src_table, r.month, r.kind, r.orphans) for r in orphan_counts(found).collect()}
    assert ("postings", "2024-01", "missing", 1) in months and ("postings", None, "missing", 1) in months and ("chunks", "2024-02", "deleted", 2) in months


def test_empty(spark):
    e = spark.createDataFrame
    assert orphans(e([], WAL), e([], CHUNKS), e([], POST), e([], PRINTS)).count() == 0
    assert [r.kind for r in orphans(e([], WAL), e([(1, 1, 1, t(1), "")], CHUNKS), e([], POST), e([], PRINTS)).collect()] == ["missing"]


def test_ranges_with_parents_alone(spark):
    far = 90001
    wal = spark.createDataFrame([(i, "insert", i, t(0)) for i in range(1, 5)] + [(9, "insert", far, t(0))], WAL)
    chunks = spark.createDataFrame([(i, i, i, t(1), "x") for i in range(1, 5)] + [(50 + i, 1, far + i, t(1), "x") for i in range(40)], CHUNKS)
    post = spark.createDataFrame([(1, 1), (6, 1)], POST)
    prints = spark.createDataFrame([(2, "text", t(2)), (7, "text", t(2))], PRINTS)
    got = {(r.src_table, r.src_key, r.kind) for r in orphans(wal, chunks, post, prints).collect()}
    assert got == {("postings", 6, "missing"), ("fingerprints", 7, "missing")}


def test_dictionary_of_sparse_and_text_keys(spark):
    for rows, kind in (([(10**15 * i,) for i in range(50)], "k long"), ([(f"key {i}",) for i in range(50)], "k string")):
        df = spark.createDataFrame(rows, kind)
        d = dictionary([(df, "k")])
        assert d.table is not None
        back = d.decode(d.encode(df, "k").select("code"), "k")
        assert {r.k for r in back.collect()} == {r[0] for r in rows}


def test_many_keys_are_never_broadcast(spark, monkeypatch):
    far = 10**12  # so that keys go through a dictionary
    n = 3000
    wal = spark.createDataFrame([(i, "insert", far * (i % 7) + i, t(0)) for i in range(n)], WAL)
    chunks = spark.createDataFrame([(i, far * (i % 7) + i + n * (i % 2), i, t(1), "x") for i in range(n)], CHUNKS)
    post = spark.createDataFrame([(i + n // 2, i) for i in range(n)], POST)
    prints = spark.createDataFrame([(2 * i, "text", t(2)) for i in range(n)], PRINTS)
    broadcast = lambda df: "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    few = orphans(wal, chunks, post, prints)
    want = {tuple(r) for r in few.collect()}
    monkeypatch.setattr("palimpsest.operators.orphans.BROADCAST_ROWS", 1000)
    many = orphans(wal, chunks, post, prints)
    assert {tuple(r) for r in many.collect()} == want and len(want) == 1500 + 1500 + 1500
    assert broadcast(few) and not broadcast(many)
