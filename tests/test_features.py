import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecscore.functions import payload
from vecscore.functions.vector import axis, box_bound, float_box_bound, guarded_ratio, l2sq, quantize
from vecscore.params import NEVER, SearchParams
from vecscore.plans import queries
from vecscore.sources.tables import default_risks


def body(amount, inst, at, avg, tx, known, mid, mcc, mavg, online, card, km, last=None):
    return json.dumps({
        "id": "t", "transaction": {"amount": amount, "installments": inst, "requested_at": at}, "customer": {"avg_amount": avg, "tx_count_24h": tx, "known_merchants": known},
        "merchant": {"id": mid, "mcc": mcc, "avg_amount": mavg}, "terminal": {"is_online": online, "card_present": card, "km_from_home": km}, "last_transaction": last,
    })


# fixed values: golden payloads with their quantized features
GOLDEN = [
    (body(41.12, 2, "2026-03-11T18:45:53Z", 82.24, 3, ["MERC-003", "MERC-016"], "MERC-016", "5411", 60.25, False, True, 29.23), [41, 1667, 500, 7826, 3333, -10000, -10000, 292, 1500, 0, 10000, 0, 1500, 60]),
    (body(9505.97, 10, "2026-03-14T05:15:12Z", 81.28, 20, ["MERC-008", "MERC-007", "MERC-005"], "MERC-068", "7802", 54.86, False, True, 952.27), [9506, 8333, 10000, 2174, 8333, -10000, -10000, 9523, 10000, 0, 10000, 10000, 7500, 55]),
    (body(100, 1, "2026-03-11T12:00:00Z", 100, 2, ["M1"], "M1", "5411", 90, False, True, 5), [100, 833, 1000, 5217, 3333, -10000, -10000, 50, 1000, 0, 10000, 0, 1500, 90]),
    (body(99999, 0, "2026-01-01T00:00:00Z", 100, 0, [], "X", "0000", 0, False, False, 0), [10000, 0, 10000, 0, 5000, -10000, -10000, 0, 0, 0, 0, 10000, 5000, 0]),
]


def vectors(spark, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "qid long, body string")
    parsed = payload.with_risk(payload.parse(rows), default_risks(spark))
    return {r.qid: r for r in payload.features(parsed, keep=["qid", "_corrupt"]).collect()}


def test_golden(spark):
    got = vectors(spark, [b for b, _ in GOLDEN])
    assert [got[i].v for i in range(len(GOLDEN))] == [v for _, v in GOLDEN]


def test_odd_bodies(spark):
    got = vectors(spark, ["", "not json", "{}", None, '{"transaction": {"installments": 2.5, "requested_at": null}, "merchant": {"mcc": 5411}, "last_transaction": {}}'])
    default = [0, 0, 0, 0, 0, -10000, -10000, 0, 0, 0, 0, 10000, 5000, 0]
    assert [got[i].v for i in range(4)] == [default] * 4
    assert [got[i]._corrupt for i in range(5)] == [True, True, False, True, False]
    assert got[4].v == [0, 1667, 0, 0, 0, 0, 0, 0, 0, 0, 0, 10000, 1500, 0]


def test_last_transaction_and_known_cap(spark):
    known = [f"M{i}" for i in range(20)]
    last = {"timestamp": "2026-03-10T12:00:00Z", "km_from_current": 500}
    got = vectors(spark, [body(1, 1, "2026-03-11T00:00:00Z", 1, 1, known, m, "5411", 1, True, True, 1, last) for m in ("M15", "M16")])
    assert (got[0].v[11], got[1].v[11]) == (0, 10000)
    assert got[0].v[5:7] == [5000, 5000]


def test_expressions(spark):
    xs = [0.5, 0.00005, -0.00005, 1.5, -2.0, float("nan"), 0.33335]
    rows = spark.createDataFrame([(x,) for x in xs], "x float").select("x", quantize(F.col("x")).alias("q")).collect()
    half = lambda x: int(np.trunc(np.float64(np.float32(x) * np.float32(10000)) + np.copysign(0.5, x)))
    assert [r.q for r in rows] == [max(-10000, min(10000, half(x))) if x == x else 0 for x in xs]
    cells = spark.createDataFrame([(v,) for v in (-10000, -1, 0, 9999, 10000)], "v int").select(axis(F.col("v")).alias("c")).collect()
    assert [r.c for r in cells] == [0, 15, 16, 31, 31]
    row = spark.createDataFrame([([0, 20000], [3, 20004], [1, 0], [2, 10000])], "a array<int>, b array<int>, mn array<int>, mx array<int>")
    r = row.select(l2sq(F.col("a"), F.col("b")).alias("d"), box_bound(F.col("a"), F.col("mn"), F.col("mx")).alias("lb")).first()
    assert (r.d, r.lb) == (25, 1 + 10000**2)


def test_risk_default_and_digits(spark):
    rows = spark.createDataFrame([("5411",), ("54-11",), ("9999",), (None,), ("",)], "mcc string").select(F.struct("mcc").alias("merchant"))
    got = [r.risk for r in payload.with_risk(rows, default_risks(spark)).collect()]
    assert got == pytest.approx([0.15, 0.15, 0.5, 0.5, 0.5])


def test_ratios_and_float_boxes(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (3.0, 2.0), (-1.0, 2.0)], "x float, m float")
    assert [r.g for r in rows.select(guarded_ratio(F.col("x"), F.col("m")).alias("g")).collect()] == [0.0, 0.5, 1.0, 0.0]
    rows = spark.createDataFrame([([0.5, 2.0], [0.0, 0.0], [1.0, 1.0]), ([0.5, 0.5], [0.0, 0.0], [1.0, 1.0])], "q array<double>, a array<double>, b array<double>")
    assert [r.d for r in rows.select(float_box_bound(F.col("q"), F.col("a"), F.col("b")).alias("d")).collect()] == [1.0, 0.0]


def test_settings():
    p = SearchParams.from_env({"FAST_NPROBE": "5", "FAST_T1": "4431050", "FAST_T3": "x"})
    assert (p.fast, p.fast_t[:4]) == (5, (NEVER, 4431050, NEVER, NEVER)) and SearchParams.from_env({}).fast == 16
    assert p.probes(24) == 16


def test_float_features_honour_the_offset(spark):
    last = {"timestamp": "2026-03-11T18:00:00Z", "km_from_current": 500}
    rows = [body(50, 6, "2026-03-12T01:30:00+02:00", 100, 2, ["M"] * 20 + ["X"], "X", "5411", 100, True, False, 10, last), body(0, 1, "x", 0, 1, [], "X", "5411", 1, True, True, 1, last)]
    parsed = payload.with_risk(payload.parse(spark.createDataFrame(list(enumerate(rows)), "qid long, body string")), default_risks(spark))
    got = {r.qid: r.v for r in payload.float_features(parsed, keep=["qid"]).collect()}
    want = [0.005, 0.5, 0.05, 23 / 23, 2 / 6, 330 / 1440, 0.5, 0.01, 0.1, 1.0, 0.0, 0.0, 0.15, 0.01]
    assert got[0] == pytest.approx(want, abs=1e-6)
    assert np.isnan(got[1][2]) and got[1][3:6] == [0.0, 0.0, 0.0]


def test_float_features_of_a_first_amount_of_zero(spark, tmp_path):
    """0 over an average of 0 is NaN, which no integer holds: the query writes it as such, and all other places as ever."""
    rows = [(0, "2024-01-01 00:00:00", 1, "click", 0.0), (1, "2024-01-01 01:00:00", 1, "view", 0.0), (2, "2024-01-01 02:00:00", 1, "view", 5.0), (3, "2024-01-01 03:00:00", 1, "view", 5.0), (4, "2024-01-01 00:00:00", 2, "error", 7.0)]
    events = spark.createDataFrame([(*r, '{"k": 3}') for r in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.ref_id: r.v.split(",") for r in queries.q_features_float(spark, str(tmp_path)).collect()}
    assert [got[i][2] for i in range(5)] == ["NaN", "NaN", "100000", "30000", "100000"]
    assert all(len(v) == 14 and "NaN" not in v[:2] + v[3:] for v in got.values())
