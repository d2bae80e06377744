import random
import time
from datetime import datetime

import numpy as np
import pytest

pytest.importorskip("palimpsest.llm")
from pyspark.sql import functions as F  # noqa: E402

from palimpsest.llm import distinctive, mixing, nearcopies, neighbours, packing, rankfuse, residue, split, tokens  # noqa: E402


def test_distinctive(spark):
    schema = "segment int, term string, chunk_id long, freq int, seq long, df string"
    rows = [(0, " Zebra ", c, 4, 10, "x") for c in (1, 2)] + [(0, "zebra", 1, 2, 10, "x")] * 2 + [(0, "the", c, 1 + c % 3, 10, "x") for c in range(60)]
    rows += [(0, "old", 1, 9, 3, "x"), (0, None, 1, 1, 10, "x"), (0, " ", 1, 1, 10, "x"), (0, "the", None, 1, 1, "x"), (0, "the", 2, None, 10, "x")]
    df = spark.createDataFrame(rows, schema)
    got = {(r.chunk_id, r.term): r for r in distinctive.distinctive_terms(df).collect()}
    assert got[1, "zebra"].tf == 6 and (1, "old") not in got and got[1, "zebra"].elite > 0.99 and got[1, "zebra"].log_odds > got[1, "the"].log_odds
    assert {tuple(r) for r in distinctive.rare_shared_terms(df).collect()} == {(1, "zebra"), (2, "zebra")}
    assert distinctive.top_terms(distinctive.distinctive_terms(df), 1).where("chunk_id = 1").first().term == "zebra"
    assert distinctive.distinctive_terms(spark.createDataFrame([], schema)).count() == 0


def test_counts_make_a_case_where_the_posterior_is_low(spark):
    rows = [(0, "rare", 1, 3, 1), (0, "rare", 2, 100, 1)] + [(0, "the", c, 1 + c % 2, 1) for c in range(3000)]
    df = spark.createDataFrame(rows, "segment int, term string, chunk_id long, freq int, seq long")
    elite = {(r.chunk_id, r.term): r.elite for r in distinctive.distinctive_terms(df).where("term = 'rare'").collect()}
    assert elite[1, "rare"] < 0.01 < 0.99 < elite[2, "rare"]
    assert {tuple(r) for r in distinctive.rare_shared_terms(df).collect()} == {(1, "rare"), (2, "rare")}


def test_two_poisson_recovers_rates():
    rng = np.random.default_rng(0)
    x = np.where(rng.random(20000) < 0.2, rng.poisson(9, 20000), rng.poisson(1, 20000))
    tf, n = np.unique(x, return_counts=True)
    share, high, low = distinctive.fit_two_poisson(np.array([0]), tf.astype(float), n.astype(float), 400)
    assert abs(share[0] - 0.2) < 0.03 and abs(high[0] - 9) < 0.5 and abs(low[0] - 1) < 0.1


def test_neighbours_against_brute_force(spark):
    rnd, rows, now = random.Random(2), [], datetime(2024, 1, 1)
    for c in range(300):
        base = rnd.sample(range(10240), 60)
        rows.append((2 * c, "text", base, now, "x"))
        keep = base[: rnd.randrange(40, 60)]
        rows.append((2 * c + 1, "dense", keep + rnd.sample(range(10240), 60 - len(keep)), now, "x"))
    same = rows[0][2]
    rows += [(1000 + i, "text", same, now, "x") for i in range(9)] + [(2000, "text", None, now, "x"), (2001, "text", [], now, "x"), (2002, "text", [-1, 99999], now, "x"), (3, "dense", [5], datetime(2023, 1, 1), "x"), (None, "text", [1], now, "x")]
    df = spark.createDataFrame(rows + rows[:5], "chunk_id long, kind string, bits array<int>, written_at timestamp_ntz, id string")
    sets = {r[0]: set(r[2]) for r in rows if r[0] is not None and r[2] and r[0] not in (2002,) and r[3] == now}
    want = set()
    for a, x in sets.items():
        sims = sorted(((-len(x & y) / len(x | y), b) for b, y in sets.items() if b != a))[:5]
        want |= {(min(a, b), max(a, b)) for s, b in sims if s <= -0.5}
    got = {tuple(r) for r in neighbours.mutual_or_single_pairs(df).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(want)
    assert neighbours.nearest(df.where("false")).count() == 0
    assert neighbours.nearest(df).groupBy("chunk_id").count().where("count > 5").count() == 0


def test_crowded_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_PER_BUCKET", 3)
    rnd = random.Random(4)
    base = rnd.sample(range(10240), 60)
    sets = spark.createDataFrame([(i, sorted(set(base[:57] + rnd.sample(range(10240), 3)))) for i in range(40)], "id long, bits array<int>")
    pairs = neighbours.candidate_pairs(sets, neighbours.Hashing(tables=6))
    assert pairs.count() > 300


def test_crowded_buckets_lose_nothing(spark, monkeypatch):
    rnd = random.Random(6)
    base, now = rnd.sample(range(10240), 56), datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        out = rnd.randrange(4, 20)
        rows.append((i, "text", sorted(set(rnd.sample(base, 56 - out) + rnd.sample(range(10240), out))), now))
    df = spark.createDataFrame(rows, "chunk_id long, kind string, bits array<int>, written_at timestamp_ntz")
    found = []
    for most, block in ((10**9, 10**9), (5, 100)):
        monkeypatch.setattr(neighbours, "_PER_BUCKET", most)
        monkeypatch.setattr(neighbours, "_BLOCK", block)
        found.append({tuple(r) for r in neighbours.nearest(df).collect()})
    assert found[0] == found[1] and len(found[0]) > 1000


@pytest.mark.parametrize("tile", [900, 10**6])
def test_best_of_a_crowded_bucket(monkeypatch, tile):
    monkeypatch.setattr(neighbours, "_TILE", tile)
    rnd = random.Random(8)
    sets = {i: set(rnd.sample(range(30), rnd.randrange(1, 9))) | set(rnd.sample(range(10240), 5)) for i in rnd.sample(range(1000), 120)}
    table = lambda ids: neighbours.pa.table({"id": ids, "bits": neighbours.pa.array([sorted(sets[i]) for i in ids], neighbours.pa.list_(neighbours.pa.int16()))})
    asked, stored = list(sets)[:70], list(sets)[40:]
    a, b = neighbours._best(neighbours._Vectors.of(table(asked)), neighbours._Vectors.of(table(stored)), 4)
    want = {(i, j) for i in asked for j in sorted((j for j in stored if j != i), key=lambda j: (-len(sets[i] & sets[j]) / len(sets[i] | sets[j]), j))[:4]}
    assert set(zip(a.tolist(), b.tolist())) == want


def _sets(text, n):
    w = residue.re.findall(r"[a-z0-9]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("threshold, words, least", [(0.6, 3, 5), (0.8, 5, 1)])
def test_near_duplicates_are_exact(spark, threshold, words, least, monkeypatch):
    monkeypatch.setattr(nearcopies, "_HOT_KEY", 5)
    rnd, rows = random.Random(3), []
    for i in range(150):
        t = [f"w{rnd.randrange(900)}" for _ in range(rnd.choice([4, 7, 12, 30, 90]))]
        rows.append((len(rows), i % 40, " ".join(t)))
        for _ in range(rnd.randrange(3)):
            u = list(t)
            for _ in range(rnd.randrange(1 + len(u) // 12)):
                u[rnd.randrange(len(u))] = f"w{rnd.randrange(900)}"
            rows.append((len(rows), rnd.randrange(40), " ".join(u)))
    rows += [(5000, 1, None), (5001, 2, ""), (None, 3, rows[0][2]), (5002, None, rows[0][2]), (5003, 77, rows[0][2].upper())]
    df = spark.createDataFrame(rows + rows[:9], "seq long, memory_id long, text string")
    sets = {r[0]: (r[1], _sets(r[2] or "", words)) for r in rows if r[0] is not None}
    ids = [i for i, (_, s) in sets.items() if len(s) >= least]
    want = {(a, b) for a in ids for b in ids if a < b and sets[a][0] != sets[b][0] and len(sets[a][1] & sets[b][1]) >= threshold * len(sets[a][1] | sets[b][1]) - 1e-9}
    got = {tuple(r) for r in nearcopies.near_duplicate_pairs(df, words=words, min_size=least, threshold=threshold).collect()}
    assert got == want and want
    groups = nearcopies.near_duplicate_groups(df, words=words, min_size=least, threshold=threshold).collect()
    assert {r.id for r in groups} == set(ids)
    assert nearcopies.near_duplicate_pairs(df.where("seq >= 5000 and seq < 5002")).count() == 0


def test_every_copy_of_a_large_class_is_paired(spark):
    text = [f"v{j}" for j in range(60)]
    rows = [(i, 1, " ".join(text)) for i in range(70)] + [(100, 2, " ".join(text[:58]))]
    rows += [(200 + i, 200 + i // 2, " ".join(f"u{j}" for j in range(40))) for i in range(70)]
    df = spark.createDataFrame(rows + rows[:9], "seq long, memory_id long, text string")
    want = {(i, 100) for i in range(70)} | {(200 + i, 200 + j) for i in range(70) for j in range(i + 1, 70) if i // 2 != j // 2}
    got = [tuple(r) for r in nearcopies.near_duplicate_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)


def test_copies_beyond_the_pairs_shown_meet_representatives(spark):
    text, near, alone = ([f"{w}{j}" for j in range(60)] for w in "vzu")
    near = text[:58]
    rows = [(i, 1, " ".join(text)) for i in range(70)] + [(100 + i, 2 + i % 2, " ".join(near)) for i in range(30)]
    rows += [(200 + i, 200 + i // 2, " ".join(alone)) for i in range(70)]
    df = spark.createDataFrame(rows + rows[:9], "seq long, memory_id long, text string")
    c = nearcopies.classes(df, "seq", "memory_id", F.col("text"), 3, 15)
    got = {tuple(r) for r in nearcopies.similar_records(c, nearcopies.Join(0.6, 15), most=500).collect()}
    grp = {r[0]: r[1] for r in rows}
    assert all(grp[a] != grp[b] for a, b in got) and {x for p in got for x in p} == set(grp)
    assert {p for p in got if p[0] < 100} == {(i, b) for i in range(70) for b in (100, 101)} | {(0, b) for b in range(100, 130)}
    assert {p for p in got if p[0] >= 200} == {(200, b) for b in range(202, 270)} | {(202, b) for b in range(203, 270) if b > 203} | {(201, 202)}
    within = {p for p in got if 100 <= p[0] < 200}  # 900 pairs at most, above 500, too
    assert within == {(min(x, h), max(x, h)) for h in (100, 101) for x in range(100, 130) if grp[x] != grp[h]}


def test_rare_shingles_do_where_their_lists_are_short(spark, monkeypatch):
    rnd = random.Random(9)
    base = [[f"w{rnd.randrange(400)}" for _ in range(40)] for _ in range(40)]
    rows = [(i, i, " ".join(t)) for i, t in enumerate(base)] + [(100 + i, 100 + i, " ".join([*t[: 40 - i // 4], f"é x{i}"])) for i, t in enumerate(base)]
    df = spark.createDataFrame(rows, "seq long, memory_id long, text string")
    sets = {r[0]: _sets(r[2], 3) for r in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    asked = []
    monkeypatch.setattr(nearcopies, "_keyer", lambda *a, f=nearcopies._keyer: asked.append(1) or f(*a))
    assert {tuple(r) for r in nearcopies.near_duplicate_pairs(df).collect()} == want and want and not asked
    monkeypatch.setattr(nearcopies, "_HOT_KEY", 2)
    assert {tuple(r) for r in nearcopies.near_duplicate_pairs(df).collect()} == want and not asked
    monkeypatch.setattr(nearcopies, "_MEETINGS", 0)
    monkeypatch.setattr(nearcopies, "_PART_ROWS", 100)
    assert {tuple(r) for r in nearcopies.near_duplicate_pairs(df).collect()} == want and len(asked) > 1


def test_sets_that_cannot_hold_the_budget(spark, monkeypatch):
    monkeypatch.setattr(nearcopies.Join, "segments", lambda self, band: np.full(len(band), 2, np.uint64))
    texts = [" ".join(f"v{j}" for j in range(30)), " ".join(f"v{j}" for j in range(2, 32))]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "seq long, memory_id long, text string")
    assert [tuple(r) for r in nearcopies.near_duplicate_pairs(df).collect()] == [(0, 1)]


@pytest.mark.parametrize("text", ["word " * 2000, "a" * 9000, "One two three. " * 400, "x" * 1900 + " y. " + "z " * 600, ("Ab cd! " * 90 + "\n\n") * 8, "é. " * 3 + "ab " * 700])
def test_pieces(text):
    lay, pieces, unit_over = split.lay_out(text)
    assert "".join(text[(0 if not f else lay.cut_at[f]) : lay.cut_at[b]] for _, f, b in pieces) == text
    for a, f, b in pieces:
        assert b - a <= 491 and lay.pairs[b] - lay.pairs[a] <= 1843
        if b < lay.n and lay.strength[b] == split.FORCED:
            assert unit_over


def _fewest(lay, cuts_at):
    """Least number of pieces with an overlap of 40 words, cut at `cuts_at` only: as far as a piece reaches is never wrong."""
    at, n = 0, 0
    while at < lay.n:
        begin = max(0, at - split.OVERLAP)
        at = max(c for c in cuts_at if c > at and (c == min(x for x in cuts_at if x > at) or c - begin <= 491 and lay.pairs[c] - lay.pairs[begin] <= 1843))
        n += 1
    return n


def test_few_pieces_more_than_needed():
    rnd, more = random.Random(7), []
    for _ in range(60):
        text = " ".join(" ".join("w" * rnd.choice([1, 3, 5, 9, 14]) for _ in range(rnd.randrange(1, 60))) + rnd.choice([". ", "! ", "\n", "\n\n"]) for _ in range(rnd.randrange(30, 200)))
        lay, pieces, over = split.lay_out(text)
        least = _fewest(lay, sorted((np.nonzero(lay.strength[1:] >= split.FORCED)[0] + 1).tolist()))
        assert not over and all(b - a <= 491 and lay.pairs[b] - lay.pairs[a] <= 1843 for a, _, b in pieces)
        more.append((len(pieces), least))
    # strong boundaries are preferred to full pieces
    assert all(n <= 1.5 * least + 1 for n, least in more) and sum(n for n, _ in more) <= 1.3 * sum(m for _, m in more)
    for sentences in (110, 200, 999):
        lay, pieces, _ = split.lay_out("One two three four five. " * sentences)
        assert len(pieces) == _fewest(lay, list(range(5, 5 * sentences + 1, 5)))


def test_very_long_text_in_pieces():
    rnd = random.Random(1)
    text = " ".join(f"{rnd.choice(['One', 'Another one'])} {'x' * rnd.randrange(1, 20)} {'word ' * rnd.randrange(1, 30)}ends." for _ in range(60_000))
    lay, pieces, _ = split.lay_out(text)
    assert pieces[-1][2] == lay.n and all(a <= f < b and b - a <= 491 for a, f, b in pieces) and len(pieces) > 1500


def test_pieces_of_records(spark):
    long = "One two three. " * 400
    df = spark.createDataFrame([(1, 1, long, 0), (1, 1, long, 0), (2, None, "word " * 600, 0), (3, 1, "short", 0), (4, 1, None, 0), (5, 1, "", 0)], "seq long, memory_id long, text string, words int")
    assert {tuple(r) for r in split.over_limit_records(df).collect()} == {(1, "boundary"), (2, "forced")}
    p = split.pieces(df).where("seq = 1").orderBy("piece").collect()
    assert all(p[i].begins < p[i - 1].ends for i in range(1, len(p))) and split.pieces(df.where("false")).count() == 0


def test_rankfuse(spark):
    schema = "qid long, lane string, mu double, memory_id long, score double, fused int"
    rows = [(q, lane, mu, m, scale * (10 - m) + q, 0) for q in range(6) for lane, mu, scale in (("a", None, 1.0), ("b", 5.0, 1000.0), ("c", None, 1e-6)) for m in range(8)]
    rows += [(0, "b", 5.0, 7, 1e12, 0), (0, "a", None, 3, float("nan"), 0), (0, "a", None, 4, None, 0), (0, "a", None, 5, -1e9, 0), (None, "a", None, 5, 1.0, 0), (9, "a", None, 5, None, 0)]
    df = spark.createDataFrame(rows + rows[:7], schema)
    assert {tuple(r) for r in rankfuse.firsts(df).collect()} == {(q, 0) for q in range(6)}
    r = rankfuse.ranking(df).where("qid = 1").orderBy("place").collect()
    assert [x.memory_id for x in r] == list(range(8))
    assert rankfuse.ranking(df.where("false")).count() == 0
    flipped = rankfuse.fused(df.where("lane = 'a'"), {"a": -1}).where("qid = 1").orderBy("fused").collect()
    assert flipped[0].memory_id == 0


def _reference_fusion(rows):
    """(qid, memory_id) to score, in NumPy: ranks, correlations over the queries that have both lists, first component."""
    share = {}
    for key in {(q, lane) for q, lane, _, _, _ in rows}:
        s = {m: v for q, lane, _, m, v in rows if (q, lane) == key}
        x = np.array(sorted(s.values()))
        share[key] = {m: ((x < v).sum() + ((x == v).sum() + 1) / 2) / len(x) for m, v in s.items()}
    lanes = sorted({k[1] for k in share})
    of = {q: sorted({m for k, s in share.items() if k[0] == q for m in s}) for q in {k[0] for k in share}}

    def column(lane, with_):
        return np.array([share[q, lane].get(m, 0) for q in sorted(of) if (q, lane) in share and (q, with_) in share for m in of[q]])

    corr = np.array([[np.corrcoef(column(a, b), column(b, a))[0, 1] for b in lanes] for a in lanes])
    vec = np.linalg.eigh(corr)[1][:, -1]
    w = {lane: v / column(lane, lane).std() for lane, v in zip(lanes, vec * np.sign(vec.sum()))}
    return w, {(q, m): sum(w[k[1]] * s.get(m, 0) for k, s in share.items() if k[0] == q) for q in of for m in of[q]}


def test_rankfuse_follows_the_component(spark):
    rnd = random.Random(9)
    rows = []
    for q in range(60):
        for m in range(12):
            x = rnd.gauss(0, 1)
            rows += [(q, "good", None, m, x + rnd.gauss(0, 0.2)), (q, "fair", None, m, 1e6 * (x + rnd.gauss(0, 0.6)))]
            rows += [(q, "noise", None, m, rnd.gauss(0, 1e-9))] if q % 3 else []
            rows += [(q, "against", None, m, -x + rnd.gauss(0, 0.5))] if m % 4 else []
    w, want = _reference_fusion(rows)
    assert w["against"] < -0.5 < 0.5 < w["good"] and abs(w["noise"]) < 0.5  # the lists have not the same say
    df = spark.createDataFrame(rows, "qid long, lane string, mu double, memory_id long, score double")
    got = {(r.qid, r.memory_id): r.fused for r in rankfuse.fused(df).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    first = {q: max((v, -m) for (p, m), v in want.items() if p == q) for q in range(60)}
    assert {tuple(r) for r in rankfuse.firsts(df).collect()} == {(q, -m) for q, (_, m) in first.items()}
    turned = rankfuse.fused(df.where("lane <> 'against'").unionByName(df.where("lane = 'against'")), {"against": -1})
    got = {(r.qid, r.memory_id): r.fused for r in turned.collect()}
    _, want = _reference_fusion([(q, lane, mu, m, -v if lane == "against" else v) for q, lane, mu, m, v in rows])
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_rankfuse_with_continuous_mu_and_many_lanes(spark):
    rows = [(q, "lex", 1000 + 0.5 * q, m, float(m)) for q in range(90) for m in range(3)] + [(q, f"l{q}", None, m, float(m)) for q in range(90) for m in range(3)]
    df = spark.createDataFrame(rows, "qid long, lane string, mu double, memory_id long, score double")
    ranked = rankfuse.with_kinds(rankfuse.rank_shares(df), 4)
    assert {r.kind.lane for r in ranked.select("kind").distinct().collect()} == {"lex", "l0", "l1", "*"}
    assert {tuple(r) for r in rankfuse.firsts(df).collect()} == {(q, 2) for q in range(90)}


def test_rankfuse_of_more_kinds_than_a_driver_decomposes(spark):
    rnd = random.Random(3)
    rows = []
    for q in range(8):
        for m in range(10):
            x = rnd.gauss(0, 1)
            rows += [(q, f"l{i:02}", None, m, x + rnd.gauss(0, 0.2 + i / 40)) for i in range(rankfuse.DENSE_KINDS + 5)]
            rows += [(q, "z", None, m, -x + rnd.gauss(0, 0.2))] if m < 9 else []  # the fewest rows
    w, want = _reference_fusion(rows)
    assert w["z"] < 0 < w["l00"]
    df = spark.createDataFrame(rows, "qid long, lane string, mu double, memory_id long, score double")
    got = {(r.qid, r.memory_id): r.fused for r in rankfuse.fused(df).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert {r.kind.lane for r in rankfuse.with_kinds(rankfuse.rank_shares(df)).select("kind").distinct().collect()} == set(w)


def test_first_component():
    x = np.random.default_rng(1).standard_normal((150, 150))
    want = np.linalg.eigh(x + x.T)[1][:, -1]
    got = rankfuse.first_component(lambda v: (x + x.T) @ v, 150)
    assert 1 - abs(got @ want) < 1e-12


def test_neighbours_in_rounds_keep_all_and_leave_nothing_shuffled(spark, monkeypatch):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for i in range(files.size()) if (f := files.apply(i)).getName().startswith("shuffle")}

    rnd = random.Random(11)
    base = [sorted(rnd.sample(range(10240), 60)) for _ in range(40)]
    rows = [(4 * i + c, [x if rnd.random() > 0.1 * c else rnd.randrange(10240) for x in b]) for i, b in enumerate(base) for c in range(3)]
    sets = spark.createDataFrame(rows, "id long, bits array<int>").withColumn("bits", neighbours.clean_bits(F.col("bits")))
    h = neighbours.Hashing(tables=10)
    once = {tuple(r) for r in neighbours.candidate_pairs(sets, h).collect()}
    prints = sets.select(F.col("id").alias("chunk_id"), "bits", F.current_timestamp().alias("written_at"))
    near = {tuple(r) for r in neighbours.nearest(prints, 5, h).collect()}
    monkeypatch.setattr(neighbours, "_PART_ROWS", 100)
    spark.sparkContext._jvm.System.gc()
    before = shuffled()
    again = neighbours.candidate_pairs(sets, h)  # every round is written by now
    for _ in range(50):  # files are removed a little later; those of a count have some bytes and stay
        new = sum(n for name, n in shuffled().items() if name not in before)
        if new < 10_000:
            break
        time.sleep(0.1)
    assert len(once) > 60 and {tuple(r) for r in again.collect()} == once
    assert {tuple(r) for r in neighbours.nearest(prints, 5, h).collect()} == near
    assert new < 10_000


def test_near_duplicates_in_rounds_of_bands(spark, monkeypatch):
    rnd = random.Random(12)
    texts = []
    for n in (18, 30, 50, 80, 140):
        for _ in range(6):
            base = [f"w{rnd.randrange(4000)}" for _ in range(n)]
            texts += [" ".join(w if rnd.random() > 0.03 * c else f"v{rnd.randrange(4000)}" for w in base) for c in range(3)]
            texts.append(" ".join(base[: int(0.8 * n)]))
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts + texts[:5])], "seq long, memory_id long, text string")
    once = {tuple(r) for r in nearcopies.near_duplicate_pairs(df).collect()}
    monkeypatch.setattr(nearcopies, "_PART_ROWS", 100)
    join = nearcopies.Join()
    sizes = [(n, 1) for n in range(15, 200)]
    bands = [b for its, _, _ in nearcopies.rounds(sizes, join) for b in its]
    assert sorted(bands) == sorted(set(bands)) == sorted(set(join.band(np.arange(15, 200)))) and len(nearcopies.rounds(sizes, join)) > 3
    assert len(once) > 60 and {tuple(r) for r in nearcopies.near_duplicate_pairs(df).collect()} == once


def test_best_fit_conflicts():
    bins = packing.best_fit([6, 5, 4, 3], 10, [0, 1, 0, 0], [0, -1, 0, -1], {})
    assert bins == [0, 1, 1, 0]  # 4 fits 6's bin exactly but is its duplicate
    assert packing.best_fit([6, 4], 10, [0, 1], [-1, -1], {0: 2, 1: 1}) == [0, 1]


def test_places(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(1, 80))), None if i % 7 == 0 else "A / b", i) for i in range(60)] + [(100, "long " * 700, "c", 0), (101, None, "c", 0), (102, "", "c", 0)]
    docs.append((103, docs[5][1], "a/B", 0))
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string, source string, capacity int")
    kinds = spark.createDataFrame([("s", 256), ("l", 1024), ("none", None)], "container string, capacity_tokens int")
    got = packing.places(df, kinds, shard_items=25).collect()
    size = {r.doc_id: r.tokens for r in tokens.token_sizes(df).collect()}
    for name, cap in (("s", 256), ("l", 1024)):
        mine = [r for r in got if r.container == name]
        room, docs_in = {}, {}
        for r in mine:
            room[r.bin_id] = room.get(r.bin_id, 0) + r.tokens
            docs_in.setdefault(r.bin_id, []).append(r.doc_id)
        assert max(room.values()) <= cap and not any({5, 103} <= set(d) for d in docs_in.values())
        for d, n in size.items():
            parts = [r for r in mine if r.doc_id == d]
            assert sum(r.tokens for r in parts) == n and len(parts) == -(-n // cap)
    assert packing.places(df, kinds.where("false")).count() == 0 and packing.places(df.where("false"), kinds).count() == 0


def test_sources_apart(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(1, 40))), ("A / b", "c", "d", None)[i % 4]) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kinds = spark.createDataFrame([("s", 256)], "container string, capacity_tokens int")
    source = {i: s for i, _, s in docs}
    for apart, free in (((), True), ((("a/b", "C"), ("d", "unknown")), False)):
        bins = {}
        for r in packing.places(df, kinds, apart).collect():
            bins.setdefault(r.bin_id, set()).add(source[r.doc_id])
        assert any({"A / b", "c"} <= s for s in bins.values()) == free and any({"A / b", "d"} <= s for s in bins.values())
    with pytest.raises(ValueError):
        packing.places(df, spark.createDataFrame([(f"k{i}", 9) for i in range(1001)], "container string, capacity_tokens int"))


def test_large_cluster_is_placed_in_time():
    n = 7000
    bins = packing.best_fit([9] * n + [3] * 200, 4096, [0] * (n + 200), [0] * n + [-1] * 200, {})
    assert len(set(bins[:n])) == n


def test_permutation_and_counts():
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, (1, 2))) == list(range(n))
    totals = np.array([500, 37, 1200])
    at = np.zeros(3, int)
    for s in range(17):
        before, here = mixing.shard_counts(totals, 17, 103, s, 5)
        assert (before == at).all() and (s == 16 or here.sum() == 103)
        at += here
    assert (at == totals).all()


@pytest.mark.parametrize("slots", [1.5e9, 1e11, 3e13])
def test_counts_of_very_many_slots(slots):
    totals = (np.array([0.55, 0.3, 0.1499999, 0, 1e-7]) * slots).astype(np.int64)
    shards = -(-int(totals.sum()) // 1024)
    for s in (0, 1, shards // 3, shards - 2):
        before, here = mixing.shard_counts(totals, shards, 1024, s, 5)
        after, _ = mixing.shard_counts(totals, shards, 1024, s + 1, 5)
        assert here.sum() == 1024 and before.sum() == 1024 * s and (before + here == after).all() and (before <= totals).all()
        assert abs(here[0] - 563) < 90 and here[3] == 0
    left = mixing._drawn(totals, int(totals.sum() // 2), np.random.default_rng(1))
    spread = np.sqrt(totals / 4.0 * (1 - totals / totals.sum()))
    assert left.sum() == totals.sum() // 2 and (np.abs(left - totals / 2) <= 6 * spread + 1).all()
    last = mixing.shard_counts(totals, shards, 1024, shards - 1, 5)
    assert (last[0] + last[1] == totals).all()


def test_mixture(spark):
    rnd = random.Random(6)
    docs = [(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(60)), ("Big", "b i g", "small", "other", None)[i % 5], 0) for i in range(200)] + [(900, None, "big", 0), (901, "", "big", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n int")
    wanted = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("gone", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mixture(df, wanted, block=64, shard_slots=50)
    rows = {r.source: r for r in mixing.report(m).collect()}
    assert set(rows) == {"big", "small", "gone"} and rows["gone"].used_tokens == 0
    assert abs(rows["big"].reached_share - 0.625) < 0.01
    c = mixing.copies(m).collect()
    assert max(r.most_copies for r in c if r.source == "small") <= 3 and max(r.most_copies for r in c if r.source == "big") <= 1
    big = mixing.report(mixing.mixture(df, wanted, total_tokens=10**9, block=64)).collect()
    assert {r.source: round(r.used_tokens / max(1, r.tokens)) for r in big} == {"big": 1, "small": 3, "gone": 0}
    assert mixing.mixture(df.where("false"), wanted).slots.count() == 0 and mixing.report(mixing.mixture(df, wanted.where("false"))).count() == 0


@pytest.fixture(scope="module")
def residue_model(spark):
    return residue.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_residue(spark, residue_model):
    h = residue_model.held_out
    assert h["documents"] > 0 and h["both"] >= 0.8 * (h["both"] + h["labels_only"])
    mine = spark.createDataFrame(
        [(1, "Dear {{first_name}},\nyour export of {{title}} is ready.", None), (2, "404 Not Found", "x"), (3, "In the guide, put `{{ user }}` where the value belongs; the engine fills it in.", "x"), (4, None, None), (5, "", "x"), (6, "```\nHello {{x}}\n```", "x"), (7, "Please enable JavaScript to view this page.", "x"), (8, "a" * 60_000, "x"), (9, " \n ", "x")],
        "doc_id long, text string, kind string",
    )
    assert {r.doc_id for r in residue.residue(mine.unionByName(mine.where("doc_id < 3")), residue_model).collect()} == {1, 2, 7}
    assert residue.residue(mine.withColumn("source", mine.kind).where("doc_id in (4, 5)")).count() == 0
    assert {r.doc_id for r in residue.without_residue(mine.withColumn("source", mine.kind)).collect()} >= {4, 5}


def _planted(rnd, known):
    """Error pages of an invented house style; only with `known` one of the label phrases is on them."""
    own = [f"Your {rnd.choice(['badge', 'key', 'pass'])} opens no {rnd.choice(['vault', 'drawer', 'shelf'])} today.", f"Ask the {rnd.choice(['warden', 'porter', 'keeper'])} to let you in.", "Ring the bell twice."]
    rnd.shuffle(own)
    return "\n".join([*(["Access denied"] if known else []), *own[: 2 if known else 3]])


def test_classifier_finds_what_the_labels_miss():
    rnd = random.Random(12)
    word = lambda: rnd.choice(["cache", "index", "lane", "shard", "chunk", "query", "merger", "token"])
    plain = lambda: f"The {rnd.choice(['cold', 'warm', 'small'])} {word()} near the {word()} rebuilds the {word()} on day {rnd.randrange(90)}."
    texts, truth = [], []
    for i in range(900):
        kind = i % 15
        known = kind == 0 or kind == 1
        page = known or kind == 2
        texts.append(_planted(rnd, known) if page else "\n".join(plain() for _ in range(rnd.randrange(1, 9))))
        if kind == 3:  # the phrase talked about beside content
            texts[-1] += f"\nThe {word()} counts how often access denied was shown."
        truth.append(page)
    hosts = [f"h{rnd.randrange(20)}" for _ in texts]
    s = residue.sampled(texts, hosts, frozenset(["the", "near", "rebuilds", "on", "day"]))
    assert 0 < s.held.sum() < len(texts)
    model = residue.learn(s, frozenset(["the", "near", "rebuilds", "on", "day"]))
    said = np.array([k != "" for k in model.judge(s.docs, residue.Reader(model.common))])
    truth = np.array(truth)
    labelled = np.array([(residue.weak_labels(u)[0] == residue.ERROR).any() for u in s.docs])
    missed = truth & ~labelled & s.held
    assert missed.sum() >= 3 and said[missed].all()  # on unseen hosts, without any phrase
    assert (said & truth & s.held).sum() >= 0.95 * (truth & s.held).sum() and not (said & ~truth).any()
    assert residue.validate(s, model)["model_only"] >= 3


def test_residue_of_one_host_and_of_texts_without_units():
    s = residue.sampled(["One line.", "Forbidden"], ["a", "a"], frozenset())
    assert not s.held.any() and residue.validate(s, residue.learn(s, frozenset()))["documents"] == 0
    s = residue.sampled(["\u200b", "."], ["a", "b"], frozenset())
    model = residue.learn(s, frozenset())
    assert model.judge(s.docs, residue.Reader(frozenset())) == ["", ""] and residue.Reader(frozenset()).read([]).norm.size == 0
