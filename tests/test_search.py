import gzip
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecscore.operators import index as ix
from vecscore.operators import kernel, kmeans, knn, search, tuning
from vecscore.params import NEVER, SearchParams
from vecscore.plans import fixtures, queries
from vecscore.sources import tables

P = SearchParams(fast=2, fast_t=(NEVER, 110_000_000, 115_000_000, 120_000_000, 125_000_000, 130_000_000))


@pytest.fixture(scope="module")
def refs(spark, sf):
    return fixtures.embeddings(spark, sf).drop("e").cache()


@pytest.fixture(scope="module")
def arrays(refs):
    rows = sorted(refs.collect())
    return np.array([r.v for r in rows], np.int64), np.array([r.fraud for r in rows])


@pytest.fixture(scope="module")
def built(refs):
    return ix.build(refs, 64, 16, 3)


def brute(v, q, k=5, drop=None):
    d = ((v - v[q]) ** 2).sum(axis=1)
    if drop is not None:
        d = np.where(np.arange(len(v)) == drop, np.iinfo(np.int64).max, d)
    o = np.lexsort((np.arange(len(v)), d))[:k]
    return list(zip(d[o].tolist(), o.tolist(), strict=True))


@pytest.mark.parametrize("block", [3, 1000])
def test_exact_knn(refs, arrays, block):
    v, _ = arrays
    got: dict = {}
    for r in knn.exact_knn(fixtures.asked(refs), refs, not_self=True, block_rows=block).orderBy("qid", "rk").collect():
        got.setdefault(r.qid, []).append((r.dist, r.ref_id))
    assert got == {q: brute(v, q, drop=q) for q in range(0, len(v), 50)}


@pytest.mark.parametrize("kind", ["near", "copies", "same", "far apart"])
def test_boxes_leave_out_only_what_is_too_far(kind, monkeypatch):
    """The same neighbours as by brute force, ties and repeated ids included, from a part of all distances."""
    r = np.random.default_rng(4)
    n, dims = 20_000, 6
    v = {"near": r.integers(-9000, 9000, (60, dims))[r.integers(0, 60, n)] + r.integers(-300, 300, (n, dims)), "copies": r.integers(0, 3, (n, dims)) * 5000, "same": np.ones((n, dims), int), "far apart": r.integers(-10000, 10001, (n, dims))}[kind]
    ids, fraud = r.permutation(n), r.integers(0, 2, n)
    ids[:50] = ids[50]
    cells = []
    real = kernel.distances
    monkeypatch.setattr(kernel, "distances", lambda a, b: cells.append(len(a) * len(b)) or real(a, b))
    monkeypatch.setattr(knn, "PART_BYTES", 300_000, raising=False)
    asked = r.choice(np.arange(51, n), 400, replace=False)
    asked[0] = 50
    rows = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 3000]), pa.array(v[i : i + 3000].tolist(), pa.list_(pa.int32())), pa.array(fraud[i : i + 3000].astype(np.int32))], ["ref_id", "v", "fraud"]) for i in range(0, n, 3000)]
    bc = type("Sent", (), {"value": (ids[asked], v[asked].astype(np.float64))})
    (out,) = knn._nearest(bc, 5, True, False)(iter(rows))
    got: dict = {}
    for q, d, i, f in sorted(zip(*(c.to_pylist() for c in out.columns), strict=True)):
        got.setdefault(q, []).append((d, i, f))
    for q in asked:
        d = ((v - v[q]) ** 2).sum(axis=1)
        other = np.flatnonzero(ids != ids[q])
        o = other[np.lexsort((ids[other], d[other]))[:5]]
        assert [x[:2] for x in got[ids[q]]] == list(zip(d[o].tolist(), ids[o].tolist(), strict=True))
    assert kind == "far apart" or sum(cells) < n * len(asked) / 4


def test_exact_score_searches_all_others(spark, sf):
    rows = fixtures.transactions(spark, sf).orderBy("ref_id").collect()
    ids, v, fraud = np.array([r.ref_id for r in rows]), np.array([r.v for r in rows], np.int64), np.array([r.fraud for r in rows])
    got = {r.qid: r for r in queries.q_exact_score(spark, sf).collect()}
    asked = np.flatnonzero(ids % 50 == 0)
    assert sorted(got) == ids[asked].tolist()
    for q in asked.tolist():
        near = brute(v, q, drop=q)
        cnt = int(sum(fraud[o] for _, o in near))
        x = got[int(ids[q])]
        assert (x.cnt, x.worst, x.approved, x.fraud_score) == (cnt, near[-1][0], cnt < 3, cnt / 5)


def test_ties_and_few_rows(spark):
    refs = spark.createDataFrame([(i, [1, 1], 1) for i in (5, 3, 9, 1)], "ref_id long, v array<int>, fraud int")
    q = spark.createDataFrame([(100, [1, 1]), (101, [0, 0])], "qid long, v array<int>")
    got = knn.exact_knn(q, refs, 3)
    assert [r.ref_id for r in got.where("qid = 100").orderBy("rk").collect()] == [1, 3, 5]
    v = {r.qid: r for r in knn.votes(q, knn.exact_knn(q, refs.limit(3), 5)).collect()}
    assert (v[100].found, v[100].cnt, v[100].worst) == (3, 3, NEVER)
    assert v[100].cnt * 5 >= 15  # three frauds of three: not approved
    none = knn.votes(q, knn.exact_knn(q, refs.limit(0), 5)).select("qid", "cnt", *knn.verdict(F.col("cnt"))).collect()
    assert all((r.cnt, r.approved, r.fraud_score) == (0, True, 0.0) for r in none)


def test_kmeans_matches_numpy(refs, arrays):
    v, _ = arrays
    n = len(v) // 16
    c = v[np.arange(16) * n].astype(np.float64)
    cf = c.astype(np.float32) / np.float32(10000)
    for _ in range(3):
        a = ((v[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(16):
            if (a == k).any():
                s = v[a == k].sum(axis=0).astype(np.float32)
                cf[k] = s / (np.float32((a == k).sum()) * np.float32(10000))
        x = (cf * np.float32(10000)).astype(np.float64)
        c = np.trunc(x + np.copysign(0.5, x))
    got = sorted(kmeans.fit(refs, 16, 64, 3)[0].select("cid", "cq").collect())
    assert np.array_equal(np.array([r.cq for r in got]), c)


def test_two_blobs(spark):
    rows = [(i, [500, 500] if i < 20 else [9500, 9500], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "ref_id long, v array<int>, fraud int")
    centroids, rounds = kmeans.fit(df, 2, 2)
    assert sorted(tuple(r.cq) for r in centroids.collect()) == [(500, 500), (9500, 9500)] and rounds < 30
    with pytest.raises(ValueError):
        kmeans.stride_init(df, 41)
    assert kmeans.seed_plus_plus(df, 2).select("cq").distinct().count() == 2


def test_index_invariants(built, refs):
    c = built.clusters
    assert c.agg(F.sum("n")).first()[0] == refs.count()
    starts = [(r.start, r.n) for r in c.orderBy("cid").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    blocks = ix.pack_blocks(built.vectors)
    assert blocks.agg(F.sum("n")).first()[0] == refs.count() and blocks.agg(F.max("n")).first()[0] <= 8
    # every cluster is in the cell of each of its members
    a, b = built.disc
    q = built.vectors.select(F.col("ref_id").alias("qid"), "v", F.col("cid").alias("own"))
    seen = search.candidates(q.select("qid", "v"), built)
    assert q.join(seen.withColumnRenamed("cid", "own"), ["qid", "own"], "left_anti").count() == 0


def test_search_invariants(built, refs, arrays):
    v, fraud = arrays
    q = fixtures.asked(refs)
    probed = search.probes(search.candidates(q, built), 16).cache()
    near = search.neighbours(q, probed, built, P).cache()
    lb = {(r.qid, r.probe_rk): r.lb for r in probed.collect()}
    assert all(r.dist >= lb[r.qid, r.probe_rk] for r in near.collect())
    five = {r.qid: r for r in search.probe_votes(q, near, 2, P).collect()}
    full = {r.qid: r for r in search.probe_votes(q, near, 24, P).collect()}
    assert all(full[k].worst <= five[k].worst for k in five)
    got = {r.qid: r for r in search.adaptive(q, near, P).collect()}
    for k, r in got.items():
        up = five[k].found < 5 or (five[k].cnt > 0 and five[k].worst >= P.fast_t[five[k].cnt])
        assert r.escalated == up and r.cnt == (full if up else five)[k].cnt
    # all clusters, no grid: exact
    every = search.centroid_probes(q, built, 16)
    wide = search.neighbours(q, every, built, P)
    exact = {k: (sum(fraud[i] for _, i in brute(v, k)), brute(v, k)[-1][0]) for k in five}
    assert {r.qid: (r.cnt, r.worst) for r in search.probe_votes(q, wide, 16, P).collect()} == exact


def test_large_clusters_are_split(built, refs, monkeypatch):
    q = fixtures.asked(refs)
    probed = search.centroid_probes(q, built, 16)
    whole = sorted(search.probe_votes(q, search.neighbours(q, probed, built, P), 16, P).collect())
    monkeypatch.setattr(search, "MEMBERS", 7)
    monkeypatch.setattr(search, "QUERIES", 3)
    assert sorted(search.probe_votes(q, search.neighbours(q, probed, built, P), 16, P).collect()) == whole


def test_bounds_prune_without_loss(built, refs):
    """Clusters whose bound is beyond the k-th neighbour are left out, and no vote changes."""
    q = fixtures.asked(refs)
    probed = search.probes(search.candidates(q, built), 16)
    every, some = (search.neighbours(q, probed, built, P, bounded=b).cache() for b in (False, True))
    assert some.count() <= every.count()
    for n in (2, 5, 16):
        assert sorted(search.probe_votes(q, some, n, P).collect()) == sorted(search.probe_votes(q, every, n, P).collect())


def test_references_to_index_to_verdict(spark, tmp_path):
    r = np.random.default_rng(4)
    v = r.random((60, 14)).round(4)
    for part, rows in enumerate((range(25), range(25, 60))):
        with gzip.open(f"{tmp_path}/{part}.json.gz", "wt") as f:
            json.dump([{"vector": v[i].tolist(), "label": "fraud" if i % 3 == 0 else "legit"} for i in rows], f)
    index = ix.build_index(spark, f"{tmp_path}/*.json.gz", f"{tmp_path}/index", n_clusters=4, rounds=3, seed=7)
    rows = index.vectors.orderBy("ref_id").collect()
    assert [x.ref_id for x in rows] == list(range(60)) and sum(x.fraud for x in rows) == 20
    q = index.vectors.where("ref_id < 5").select(F.col("ref_id").alias("qid"), "v")
    near = search.neighbours(q, search.centroid_probes(q, index, 4), index)
    w = np.array([x.v for x in rows], np.int64)
    for x in search.probe_votes(q, near, 16).collect():
        assert (x.cnt, x.worst) == (sum(rows[i].fraud for _, i in brute(w, x.qid)), brute(w, x.qid)[-1][0])
    with pytest.raises(ValueError):
        ix.build(index.vectors.where("ref_id <> 3"), 14, 4)
    spark.createDataFrame([(1, 15, [0, 1])], "version int, dims int, disc array<int>").write.mode("overwrite").parquet(f"{tmp_path}/index/meta")
    with pytest.raises(ValueError):
        ix.load(spark, f"{tmp_path}/index")


def test_seeding_covers_all_ids(spark):
    """The bounded sample isn't a prefix."""
    df = spark.range(0, 199).selectExpr("id as ref_id", "array(cast(if(id < 100, 0, 9000) as int), 0) as v", "0 as fraud")
    assert {tuple(r.cq) for r in kmeans.seed_plus_plus(df, 2, most=100).collect()} == {(0, 0), (9000, 0)}


def test_csv_rates(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(4, 1 / 3)], "nprobe int, fn_rate double"), f"{tmp_path}/c")
    assert [x.value for x in spark.read.text(f"{tmp_path}/c").collect()] == ["nprobe,fn_rate", "4,0.33333333"]


def test_save_and_load(spark, built, tmp_path):
    ix.save(built, f"{tmp_path}/i")
    again = ix.load(spark, f"{tmp_path}/i")
    assert again.disc == built.disc and sorted(again.grid.collect()) == sorted(built.grid.collect())
    spark.createDataFrame([(99, 64, [0, 1])], "version int, dims int, disc array<int>").write.mode("overwrite").parquet(f"{tmp_path}/i/meta")
    with pytest.raises(ValueError):
        ix.load(spark, f"{tmp_path}/i")


def test_thresholds(spark):
    rows = [(i, 2, 100 + i, 3) for i in range(10)] + [(20, 1, 7, 1)]
    got = {r.fast: r for r in tuning.thresholds(spark.createDataFrame(rows, "qid long, fast int, worst long, full int")).collect()}
    assert (got[2].n, got[2].p10, got[2].p50, got[2].p90) == (10, 101, 105, 109)
    assert got[1].fast_t == NEVER and got[1].n == 0 and len(got) == 6


def test_sources(spark, tmp_path):
    with gzip.open(f"{tmp_path}/r.json.gz", "wt") as f:
        json.dump([{"vector": [i / 10] * 14, "label": "fraud" if i % 2 else "legit"} for i in range(9)], f)
    rows = tables.read_references(spark, f"{tmp_path}/r.json.gz").orderBy("ref_id").collect()
    assert [r.ref_id for r in rows] == list(range(9)) and rows[3].label == "fraud"
    (tmp_path / "m.json").write_text(json.dumps({"5411": 0.15, "x": 1, "70000": 0.2}))
    assert [(r.mcc, round(r.risk, 2)) for r in tables.read_risks(spark, f"{tmp_path}/m.json").collect()] == [(5411, 0.15)]
    (tmp_path / "n.json").write_text(json.dumps({k: i + 1 for i, k in enumerate(tables.Norm.__dataclass_fields__)}))
    assert tables.read_norm(spark, f"{tmp_path}/n.json").max_minutes == 4
    from vecscore.functions.payload import DDL

    (tmp_path / "e.json").write_text(json.dumps({"entries": [{"request": {"id": "a", "merchant": {"id": "M"}}, "expected_approved": True}]}))
    e = tables.read_eval(spark, f"{tmp_path}/e.json", DDL).collect()
    assert (e[0].id, e[0].merchant.id, e[0].expected_approved) == ("a", "M", True)
