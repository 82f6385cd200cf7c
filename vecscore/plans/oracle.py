"""The same results as plain SQL over the test tables (for DuckDB)."""

from __future__ import annotations

QZ = "cast(least(10000::FLOAT, greatest(-10000::FLOAT, round(({}) * 10000::FLOAT))) as INTEGER)"
CLAMP = "least(1::FLOAT, greatest(0::FLOAT, ({})))"
NEVER = "9223372036854775807"
TXT = "array_to_string({}, ',')"
CLUSTERS, ROUNDS = 16, 3
FAST_T = (NEVER, 110_000_000, 115_000_000, 120_000_000, 125_000_000, 130_000_000)

EMB = f"""emb AS MATERIALIZED (SELECT vec_id AS ref_id, list_transform(embedding, lambda x: {QZ.format("x")}) AS v,
 CAST(label < 3 AS INTEGER) AS fraud, embedding AS e FROM embeddings)"""

_DIMS = [
    CLAMP.format("amount / 10000::FLOAT"),
    CLAMP.format("CAST(k % 14 AS FLOAT) / 12::FLOAT"),
    CLAMP.format("(amount / avg) / 10::FLOAT"),
    "CAST(hour(ts) AS FLOAT) / 23::FLOAT",
    "CAST(isodow(ts) - 1 AS FLOAT) / 6::FLOAT",
    f"CASE WHEN lts IS NULL THEN -1::FLOAT ELSE {CLAMP.format('(CAST(greatest(CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lts)) AS BIGINT), 0) AS FLOAT) / 60::FLOAT) / 1440::FLOAT')} END",
    f"CASE WHEN lts IS NULL THEN -1::FLOAT ELSE {CLAMP.format('CAST(abs(k - lk) * 13 AS FLOAT) / 1000::FLOAT')} END",
    CLAMP.format("CAST((k * 37) % 1200 AS FLOAT) / 1000::FLOAT"),
    CLAMP.format("CAST(c24 AS FLOAT) / 20::FLOAT"),
    "CAST(event_type IN ('click', 'view', 'signup') AS FLOAT)",
    "CAST(event_type = 'purchase' AS FLOAT)",
    "CASE WHEN coalesce(list_contains(list_sort(list_distinct(prev))[1:16], mid), false) THEN 0::FLOAT ELSE 1::FLOAT END",
    "CASE event_type WHEN 'click' THEN 0.15::FLOAT WHEN 'view' THEN 0.30::FLOAT WHEN 'purchase' THEN 0.50::FLOAT WHEN 'signup' THEN 0.85::FLOAT ELSE 0.5::FLOAT END",
    CLAMP.format("CAST(CAST(msum AS DOUBLE) / mn / 100 AS FLOAT) / 10000::FLOAT"),
]
TXN = f"""ev AS (SELECT event_id, user_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) * 20 AS cents FROM events),
ev2 AS (SELECT *, 'MERC-' || lpad(CAST(k % 40 AS VARCHAR), 3, '0') AS mid FROM ev),
ev3 AS (SELECT *, sum(cents) OVER b AS s, count(*) OVER b AS n, lag(ts) OVER w AS lts, lag(k) OVER w AS lk,
 count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) - 1 AS c24,
 list(mid) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prev,
 sum(cents) OVER (PARTITION BY mid) AS msum, count(*) OVER (PARTITION BY mid) AS mn FROM ev2
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ev4 AS (SELECT *, CAST(CAST(cents AS DOUBLE) / 100 AS FLOAT) AS amount, CASE WHEN n > 0 AND s > 0 THEN CAST(CAST(s AS DOUBLE) / n / 100 AS FLOAT) ELSE 1::FLOAT END AS avg FROM ev3),
txn AS MATERIALIZED (SELECT event_id AS ref_id, CAST((event_type IN ('signup', 'error') AND k >= 50) OR k >= 90 AS INTEGER) AS fraud, [{", ".join(QZ.format(d) for d in _DIMS)}] AS v FROM ev4)"""


TXN_EMB = f"""{TXN}, emb AS MATERIALIZED (SELECT * FROM txn)"""
_HOLD = "CASE WHEN isnan({0}) THEN {0} ELSE least(1::DOUBLE, greatest(0::DOUBLE, {0})) END"
_AMOUNT = "CAST(amount AS DOUBLE)"
_AVG = "CAST(CASE WHEN n > 0 THEN CAST(CAST(s AS DOUBLE) / n / 100 AS FLOAT) ELSE 0 END AS DOUBLE)"
_FLOAT_DIMS = [
    _HOLD.format(f"({_AMOUNT} / 10000)"),
    "least(1::DOUBLE, CAST(k % 14 AS DOUBLE) / 12)",
    f"CASE WHEN {_AVG} = 0 THEN CASE WHEN {_AMOUNT} > 0 THEN 1::DOUBLE WHEN {_AMOUNT} < 0 THEN 0::DOUBLE ELSE 'NaN'::DOUBLE END ELSE least(1::DOUBLE, greatest(0::DOUBLE, {_AMOUNT} / {_AVG} / 10)) END",
    "CAST(hour(ts) AS DOUBLE) / 23",
    "CAST(isodow(ts) - 1 AS DOUBLE) / 6",
    "CASE WHEN lts IS NULL THEN -1::DOUBLE ELSE least(1::DOUBLE, greatest(0::DOUBLE, CAST(floor(epoch(ts)) - floor(epoch(lts)) AS DOUBLE) / 60 / 1440)) END",
    "CASE WHEN lts IS NULL THEN -1::DOUBLE ELSE least(1::DOUBLE, CAST(abs(k - lk) * 13 AS DOUBLE) / 1000) END",
    "least(1::DOUBLE, CAST((k * 37) % 1200 AS DOUBLE) / 1000)",
    "least(1::DOUBLE, CAST(c24 AS DOUBLE) / 20)",
    "CAST(event_type IN ('click', 'view', 'signup') AS DOUBLE)",
    "CAST(event_type = 'purchase' AS DOUBLE)",
    "CASE WHEN coalesce(list_contains(prev, mid), false) THEN 0::DOUBLE ELSE 1::DOUBLE END",
    "CAST(CASE event_type WHEN 'click' THEN 0.15::FLOAT WHEN 'view' THEN 0.30::FLOAT WHEN 'purchase' THEN 0.50::FLOAT WHEN 'signup' THEN 0.85::FLOAT ELSE 0.5::FLOAT END AS DOUBLE)",
    "least(1::DOUBLE, CAST(CAST(CAST(msum AS DOUBLE) / mn / 100 AS FLOAT) AS DOUBLE) / 10000)",
]


def dist(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] - {b}[i] AS BIGINT) * CAST({a}[i] - {b}[i] AS BIGINT))) AS BIGINT)"


def near(table: str, queries: str, refs: str, not_self: bool) -> str:
    """nn: the five nearest by (distance, id)."""
    on = "q.ref_id <> r.ref_id" if not_self else "true"
    return f"""nn AS MATERIALIZED (SELECT q.ref_id AS qid, r.ref_id, r.fraud, {dist("q.v", "r.v")} AS dist, row_number() OVER (PARTITION BY q.ref_id ORDER BY {dist("q.v", "r.v")}, r.ref_id) AS rk
 FROM {table} q JOIN {table} r ON {on} WHERE {queries} AND {refs} QUALIFY rk <= 5)"""


def voted(source: str, queries: str, name: str = "vt") -> str:
    """vt: votes of source (qid, dist, fraud) for the queries (ref_id)."""
    return f"""{name} AS MATERIALIZED (SELECT q.ref_id AS qid, count(n.qid) AS found, CAST(coalesce(sum(n.fraud), 0) AS INTEGER) AS cnt,
 CASE WHEN count(n.qid) = 5 THEN max(n.dist) ELSE {NEVER} END AS worst FROM ({queries}) q LEFT JOIN {source} n ON n.qid = q.ref_id GROUP BY q.ref_id)"""


def step(i: int, dims: int = 64) -> str:
    """a{i}: assignment with c{i}; c{i + 1}: the update."""
    return f"""a{i} AS MATERIALIZED (SELECT e.ref_id, any_value(e.v) AS v, any_value(e.fraud) AS fraud, arg_min(c.cid, struct_pack(d := {dist("e.v", "c.cq")}, c := c.cid)) AS cid FROM emb e, c{i} c GROUP BY e.ref_id),
u{i} AS (SELECT cid, d, count(*) AS n, sum(v[d]) AS s FROM a{i}, (SELECT unnest(range(1, {dims + 1})) AS d) GROUP BY cid, d),
m{i} AS (SELECT cid, any_value(n) AS n, list(CAST(CAST(s AS FLOAT) / (CAST(n AS FLOAT) * 10000::FLOAT) AS FLOAT) ORDER BY d) AS c FROM u{i} GROUP BY cid),
c{i + 1} AS MATERIALIZED (SELECT cid, n, c, list_transform(c, lambda x: CAST(round(x * 10000::FLOAT) AS INTEGER)) AS cq FROM (SELECT o.cid, coalesce(m.n, 0) AS n, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cid)))"""


def init(source: str = EMB, clusters: int = CLUSTERS) -> str:
    return f"""{source},
st AS (SELECT count(*) // {clusters} AS s FROM emb),
c0 AS MATERIALIZED (SELECT CAST(ref_id // s AS INTEGER) AS cid, list_transform(v, lambda x: CAST(x AS FLOAT) / 10000::FLOAT) AS c, v AS cq FROM emb, st WHERE ref_id % s = 0 AND ref_id // s < {clusters})"""


def fitted(source: str = EMB, dims: int = 64, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    return ",\n".join([init(source, clusters), *(step(i, dims) for i in range(rounds))])


INIT, FIT = init(), fitted()


def axis(v: str) -> str:
    return f"least(31, greatest(0, (({v}) + 10000) // 625))"


def indexed(source: str = EMB, dims: int = 64, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    return f"""{fitted(source, dims, clusters, rounds)},
asg AS MATERIALIZED (SELECT e.ref_id, any_value(e.v) AS v, any_value(e.fraud) AS fraud, arg_min(c.cid, struct_pack(d := {dist("e.v", "c.cq")}, c := c.cid)) AS cid FROM emb e, c{rounds} c GROUP BY e.ref_id),
bd AS (SELECT cid, d, count(*) AS n, min(v[d]) AS lo, max(v[d]) AS hi FROM asg, (SELECT unnest(range(1, {dims + 1})) AS d) GROUP BY cid, d),
box AS MATERIALIZED (SELECT cid, any_value(n) AS n, list(lo ORDER BY d) AS mn, list(hi ORDER BY d) AS mx FROM bd GROUP BY cid),
en AS MATERIALIZED (SELECT CAST(d - 1 AS INTEGER) AS dim, CAST(sum(CAST(v[d] AS BIGINT) * v[d]) AS BIGINT) AS sumsq FROM emb, (SELECT unnest(range(1, {dims + 1})) AS d) GROUP BY d),
dd AS (SELECT list(dim + 1 ORDER BY sumsq DESC, dim)[1:2] AS x FROM en),
grid AS MATERIALIZED (SELECT CAST(a * 32 + b AS INTEGER) AS bucket, cid FROM (SELECT cid, unnest(range(greatest(0, {axis("mn[x[1]]")} - 2), least(31, {axis("mx[x[1]]")} + 2) + 1)) AS a,
  {axis("mn[x[2]]")} AS b0, {axis("mx[x[2]]")} AS b1 FROM box, dd) t, (SELECT unnest(range(0, 32)) AS b) u WHERE b BETWEEN b0 - 2 AND b1 + 2)"""


INDEX = indexed()


def cand(queries: str, dims: int = 64) -> str:
    """cd: (qid, cid, lb) of the queries; pr: ranked, 16 at most."""
    gap = "greatest(b.mn[i] - q.v[i], q.v[i] - b.mx[i], 0)"
    return f"""qs AS MATERIALIZED (SELECT * FROM emb WHERE {queries}),
cd AS MATERIALIZED (SELECT q.ref_id AS qid, b.cid, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: CAST({gap} AS BIGINT) * CAST({gap} AS BIGINT))) AS BIGINT) AS lb
 FROM qs q, dd JOIN grid g ON g.bucket = {axis("q.v[x[1]]")} * 32 + {axis("q.v[x[2]]")} JOIN box b ON b.cid = g.cid),
pr AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY lb, cid) AS INTEGER) AS probe_rk FROM cd QUALIFY probe_rk <= 16)"""


def members(not_self: bool) -> str:
    """nb: distances to all members of the probed clusters."""
    return f"""nb AS MATERIALIZED (SELECT p.qid, p.probe_rk, r.ref_id, r.fraud, {dist("q.v", "r.v")} AS dist FROM pr p JOIN qs q ON q.ref_id = p.qid JOIN asg r ON r.cid = p.cid {"WHERE p.qid <> r.ref_id" if not_self else ""})"""


def passed(n: int, name: str) -> str:
    return f"""{name}n AS (SELECT * FROM nb WHERE probe_rk <= {n} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) <= 5), {voted(name + "n", "SELECT ref_id FROM qs", name)}"""


def search(queries: str = "ref_id % 50 = 0", not_self: bool = True) -> str:
    return f"WITH {INDEX}, {cand(queries)}, {members(not_self)}"


def oracle_sql() -> dict[str, str]:
    mcc = "CASE event_type WHEN 'click' THEN 5411 WHEN 'view' THEN 5812 WHEN 'purchase' THEN 5999 WHEN 'signup' THEN 7995 ELSE 0 END"
    risk = "CASE event_type WHEN 'click' THEN 1500 WHEN 'view' THEN 3000 WHEN 'purchase' THEN 5000 WHEN 'signup' THEN 8500 ELSE 5000 END"
    features = f"WITH {TXN} SELECT ref_id, fraud, {TXT.format('v')} AS v FROM txn"
    body = "'{\"approved\":' || CASE WHEN cnt < 3 THEN 'true' ELSE 'false' END || ',\"fraud_score\":' || CAST(cnt / 5.0::DOUBLE AS VARCHAR) || '}'"
    exact = near("emb", "q.ref_id % 50 = 0", "true", True)
    floats = lambda b: f"""SELECT qid, rk, ref_id, round(dist, 6) AS dist FROM (SELECT q.vec_id AS qid, r.ref_id, list_sum(list_transform(range(1, 65), lambda i: (CAST(q.embedding[i] AS DOUBLE) - {b}) * (CAST(q.embedding[i] AS DOUBLE) - {b}))) AS dist,
 CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY dist, r.ref_id) AS INTEGER) AS rk FROM embeddings q JOIN emb r ON q.vec_id <> r.ref_id WHERE q.vec_id % 50 = 0 QUALIFY rk <= 5)"""  # noqa: E731
    limit = f"[{', '.join(f'{t}::BIGINT' for t in FAST_T)}]"
    probe = lambda n: f"{search()}, {passed(n, 'vt')} SELECT qid, cnt, worst FROM vt"
    pairs = f"{search('ref_id % 10 = 0', False)}, {passed(1, 'fa')}, {passed(16, 'fu')}, pa AS MATERIALIZED (SELECT fa.qid, fa.cnt AS fast, fa.worst, fu.cnt AS full_cnt FROM fa JOIN fu USING (qid))"
    ranks = f"""l AS (SELECT fast, count(*) AS n, list(worst ORDER BY worst) AS w FROM pa WHERE fast <> full_cnt GROUP BY fast)
SELECT k.fast, coalesce(n, 0) AS n, w[n // 10 + 1] AS p10, w[n // 2 + 1] AS p50, w[n * 9 // 10 + 1] AS p90, coalesce(w[n // 10 + 1], {NEVER}) AS fast_t FROM (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS fast) k LEFT JOIN l USING (fast)"""
    return {
        "q_quantize": f"WITH {EMB} SELECT ref_id, fraud, {TXT.format('v')} AS v FROM emb",
        "q_features": features,
        "q_payload_parse": features,
        "q_strict": "SELECT event_id AS ref_id, event_id % 10 = 0 OR event_id % 11 = 0 AS _reject FROM events",
        "q_mcc_lookup": f"SELECT event_id AS ref_id, {mcc} AS mcc, {risk} AS risk_bp FROM events",
        "q_known_merchant": f"WITH {TXN} SELECT ref_id, CAST(v[12] = 10000 AS INTEGER) AS unknown FROM txn",
        "q_exact_knn": f"WITH {EMB}, {exact} SELECT qid, CAST(rk AS INTEGER) AS rk, ref_id, dist, fraud FROM nn",
        "q_exact_score": f"WITH {TXN}, {near('txn', 'q.ref_id % 50 = 0', 'true', True)}, {voted('nn', 'SELECT ref_id FROM txn WHERE ref_id % 50 = 0')} SELECT qid, cnt, worst, cnt < 3 AS approved, cnt / 5.0::DOUBLE AS fraud_score FROM vt",
        "q_knn_float": f"WITH {EMB} {floats('CAST(r.e[i] AS DOUBLE)')}",
        "q_knn_asym": f"WITH {EMB} {floats('(r.v[i] / 10000.0::DOUBLE)')}",
        "q_dim_energy": f"WITH {EMB} SELECT CAST(d - 1 AS INTEGER) AS dim, CAST(sum(CAST(v[d] AS BIGINT) * v[d]) AS BIGINT) AS sumsq FROM emb, (SELECT unnest(range(1, 65)) AS d) GROUP BY d",
        "q_kmeans_init": f"WITH {INIT} SELECT cid, {TXT.format('cq')} AS v FROM c0",
        "q_kmeans_assign": f"WITH {INIT}, {step(0)} SELECT ref_id, cid FROM a0",
        "q_kmeans_step": f"WITH {INIT}, {step(0)} SELECT cid, n, {TXT.format('cq')} AS v FROM c1",
        "q_kmeans_fit3": f"WITH {FIT} SELECT cid, {TXT.format('cq')} AS v FROM c{ROUNDS}",
        "q_cluster_offsets": f"WITH {INDEX}, z AS (SELECT c.cid, coalesce(b.n, 0) AS n FROM c{ROUNDS} c LEFT JOIN box b USING (cid)) SELECT cid, n, CAST(coalesce(sum(n) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, (n + 7) // 8 AS blocks FROM z",
        "q_cluster_aabb": f"WITH {INDEX} SELECT cid, {TXT.format('mn')} AS mn, {TXT.format('mx')} AS mx FROM box",
        "q_block_pack": f"WITH {INDEX}, p AS (SELECT cid, fraud, row_number() OVER (PARTITION BY cid ORDER BY ref_id) - 1 AS pos FROM asg) SELECT cid, pos // 8 AS block, count(*) AS n, CAST(sum(fraud * (1 << CAST(pos % 8 AS INTEGER))) AS BIGINT) AS labels FROM p GROUP BY cid, pos // 8",
        "q_grid": f"WITH {INDEX} SELECT bucket, array_to_string(list(cid ORDER BY cid), ',') AS cids FROM grid GROUP BY bucket",
        "q_grid_stats": f"WITH {INDEX}, b AS (SELECT count(*) AS n FROM grid GROUP BY bucket) SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) // 1024 AS average, max(n) AS most FROM b",
        "q_aabb_lb": f"WITH {INDEX}, {cand('ref_id % 50 = 0')} SELECT qid, cid, lb FROM cd",
        "q_probe_rank": f"WITH {INDEX}, {cand('ref_id % 50 = 0')} SELECT qid, cid, lb, probe_rk FROM pr",
        "q_ivf_probe5": probe(5),
        "q_ivf_probe16": probe(16),
        "q_ivf_adaptive": f"{search()}, {passed(5, 'fa')}, {passed(16, 'fu')} SELECT fa.qid, CASE WHEN x THEN fu.cnt ELSE fa.cnt END AS cnt, CASE WHEN x THEN fu.worst ELSE fa.worst END AS worst, x AS escalated FROM (SELECT *, found < 5 OR (cnt > 0 AND worst >= {limit}[cnt + 1]) AS x FROM fa) fa JOIN fu USING (qid)",
        "q_ivf_centroid_probe": f"""WITH {INDEX}, qs AS MATERIALIZED (SELECT * FROM emb WHERE ref_id % 50 = 0),
pr AS MATERIALIZED (SELECT q.ref_id AS qid, c.cid, row_number() OVER (PARTITION BY q.ref_id ORDER BY {dist("q.v", "c.cq")}, c.cid) AS probe_rk FROM qs q, c{ROUNDS} c QUALIFY probe_rk <= 4),
{members(True)}, {passed(4, "vt")} SELECT qid, cnt, worst FROM vt""",
        "q_recall": f"{search()}, {exact}, got AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) <= 5) SELECT nn.qid, count(got.ref_id) AS hits FROM nn LEFT JOIN got ON got.qid = nn.qid AND got.ref_id = nn.ref_id GROUP BY nn.qid",
        "q_tune_disagree": f"{pairs} SELECT count(*) AS total, count(*) FILTER (WHERE fast <> full_cnt) AS disagree FROM pa",
        "q_tune_thresholds": f"""{pairs}, {ranks}""",
        "q_tune_transactions": f"""WITH {indexed(TXN_EMB, 14, 256, 2)}, {cand("ref_id % 50 = 0", 14)}, {members(False)}, {passed(5, "fa")}, {passed(16, "fu")}, pa AS MATERIALIZED (SELECT fa.qid, fa.cnt AS fast, fa.worst, fu.cnt AS full_cnt FROM fa JOIN fu USING (qid)), {ranks}""",
        "q_index_roundtrip": f"WITH {INDEX} SELECT cid, count(*) AS n, CAST(sum(ref_id) AS BIGINT) AS ids, CAST(sum(fraud) AS BIGINT) AS frauds FROM asg GROUP BY cid",
        "q_stream_score": f"""WITH {indexed(TXN_EMB, 14)}, {cand("ref_id % 50 = 0", 14)}, {members(False)}, {passed(5, "fa")}, {passed(16, "fu")}, vt AS (SELECT fa.qid, CASE WHEN fa.found < 5 OR (fa.cnt > 0 AND fa.worst >= {limit}[fa.cnt + 1]) THEN fu.cnt ELSE fa.cnt END AS cnt FROM fa JOIN fu USING (qid))
SELECT qid, cnt < 3 AS approved, cnt / 5.0::DOUBLE AS fraud_score, {body} AS body FROM vt""",
        "q_features_float": f"WITH {TXN} SELECT event_id AS ref_id, array_to_string(list_transform([{', '.join(_FLOAT_DIMS)}], lambda x: CAST(round(CAST(CAST(x AS FLOAT) AS DOUBLE) * 100000) AS BIGINT)), ',') AS v FROM ev4",
        "q_eval_confusion": f"""{search()}, np AS (SELECT unnest([4, 6, 8, 10, 12, 16, 24]) AS nprobe),
t AS (SELECT np.nprobe, nb.* FROM nb, np WHERE probe_rk <= least(nprobe, 16) QUALIFY row_number() OVER (PARTITION BY np.nprobe, qid ORDER BY dist, ref_id) <= 5),
r AS (SELECT np.nprobe, q.ref_id, q.fraud = 0 AS approved, coalesce(sum(t.fraud), 0) < 3 AS ok FROM qs q CROSS JOIN np LEFT JOIN t ON t.nprobe = np.nprobe AND t.qid = q.ref_id GROUP BY ALL),
g AS (SELECT nprobe, count(*) AS total, count(*) FILTER (WHERE NOT approved) AS frauds, count(*) FILTER (WHERE ok AND NOT approved) AS fn, count(*) FILTER (WHERE NOT ok AND approved) AS fp FROM r GROUP BY nprobe)
SELECT *, fn + fp AS wrong, CASE WHEN frauds > 0 THEN round(fn / frauds, 8) END AS fn_rate, CASE WHEN total > frauds THEN round(fp / (total - frauds), 8) END AS fp_rate FROM g""",
        "q_stride_sample": f"{search('ref_id % 5 = 0', False)}, {passed(16, 'vt')} SELECT count(*) AS n, CAST(sum(cnt) * 4 AS BIGINT) AS checksum FROM vt",
        "q_response_json": f"WITH {EMB}, {exact}, {voted('nn', 'SELECT ref_id FROM emb WHERE ref_id % 50 = 0')} SELECT qid, {body} AS body FROM vt",
        "q_round_robin": "SELECT CAST(event_id % 2 AS INTEGER) AS backend, count(*) AS n FROM events GROUP BY 1",
        "q_route": "SELECT CASE event_type WHEN 'purchase' THEN 'score' WHEN 'view' THEN 'ready' ELSE 'none' END AS target, CASE WHEN event_type IN ('purchase', 'view') THEN 200 ELSE 404 END AS status, count(*) AS n FROM events GROUP BY 1, 2",
        "q_sql_functions": f"SELECT vec_id, {QZ.format('embedding[1]')} AS q, CAST({axis(QZ.format('embedding[1]'))} AS INTEGER) AS cell, {QZ.format(CLAMP.format('embedding[1]'))} AS held FROM embeddings",
    }
