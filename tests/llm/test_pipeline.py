import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import ALNUM, LOW, crc, documents
from tests.llm.test_operators import brute_classes, brute_lines, naive_maxima, texts
from vecscore.llm import common, pieces, queries, toxicity


def test_stages(spark, sf):
    docs = corpus_pipeline.table(spark, sf, "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        assert 0 < out.count() <= docs.count(), name
        if name != "sentencepiece":
            assert out.columns == docs.columns
            assert out.where(F.col("n_chars") != F.length("text")).count() == docs.where(F.col("n_chars") != F.length("text")).count() == 0 or name != "line_dedup"
            docs = out
    assert docs.count() < n and "piece_ids" in out.columns
    assert corpus_pipeline.run(spark, sf).count() == out.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    assert sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall()))) == sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect())))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_rows(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    assert got.count() == corpus_pipeline.table(spark, sf, "documents").count() and "doc_id" in got.columns


ITEMS = [(1, "ß 漢字"), (2, None), (None, "erer anan"), (3, ""), (3, "one two three four five six seven eight nine ten eleven")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of small tables: odd texts, copies, shared passages, toxic texts, repeated and null ids, columns with names of results."""
    r = random.Random(7)
    rows = list(enumerate(texts(20, 11)))
    for i in range(200, 320):
        words = ["".join(r.choice(["th", "er", "an"]) for _ in range(3)) for _ in range(r.randint(10, 40))]
        rows.append((i, " ".join([*words, "idiot scum"] if i % 2 else words)))
    rows += [(4, "word"), (4, "word"), (5, "another text"), (5, ""), (None, "own words of a row that has no id"), (None, "own words of a row that has no id"), (None, None), (None, "idiot scum")]
    at = str(tmp_path_factory.mktemp("odd"))
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    more = documents(spark, ["x"], more=True).columns
    df = df.withColumns({c: F.lit(c) for c in [*more, "__row", "__key"] if c not in df.columns})
    df.coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2 if i >= 200 else 0) for i, _ in rows if i is not None], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def brute_toxic(spark, at, rows):
    """The model is fitted by the operator; its verdicts are made by plain loops."""
    learn = toxicity.sample(common.table(spark, at, "documents"), common.table(spark, at, "labels"), corpus_pipeline.crc_part(F.col("doc_id"), 5) != 0)
    assert all(crc(i, 5) for i, t in rows if any(t == x for x, _, _ in learn) and [y for _, y in rows].count(t) == 1)
    m = toxicity.Model(*([x[k] for x in learn] for k in range(3)))
    out = []
    for i, t in rows:
        logit = np.maximum(np.array(naive_maxima(m, t or "")) + m.bias, 0) @ m.top + m.free
        word, first = toxicity.buckets(*common.utf8(pa.array([t or ""], pa.large_string())))
        if logit < m.cut[m.logits(m.row[word], first)[1][0]]:
            out.append((i, t))
    return out


def brute_dedup(rows):
    by = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    got = [x for k, x in sorted(zip(by, brute_lines([rows[k] for k in by]), strict=True))]
    return [(i, x[2]) for (i, _), x in zip(rows, got, strict=True) if not x[1] or x[2].translate(str.maketrans("\n\t\r", "   ")).strip(" ")]


def brute_near(rows):
    by = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    _, comp = brute_classes([rows[k][1] for k in by])
    return [rows[k] for n, k in enumerate(by) if comp[n] == n]


def brute_clean(rows):
    win = set()
    for _, t in ITEMS:
        w = ALNUM.findall((t or "").translate(LOW))
        win |= {tuple(w[p : p + 10]) for p in range(max(1, len(w) - 9) if w else 0)}
    words = lambda t: ALNUM.findall((t or "").translate(LOW))
    return [(i, t) for i, t in rows if not any(tuple(words(t)[p : p + len(x)]) == x for x in win for p in range(len(words(t)) - len(x) + 1))]


def brute_pieces(rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(pieces.MODEL))
    return [(i, tuple(sp.encode(t or ""))) for i, t in rows]


def told(rows):
    return sorted(map(repr, rows))


def test_stages_match_brute_force(spark, odd):
    """Every stage by itself on all odd rows, then all in a row."""
    docs = common.table(spark, odd, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    brute = [lambda x: brute_toxic(spark, odd, x), brute_dedup, brute_near, brute_clean, brute_pieces]
    want, fewer = rows, []
    for (name, stage), plain in zip(corpus_pipeline.STAGES, brute, strict=True):
        got = stage(spark, docs, odd)
        if name == "sentencepiece":
            assert told((r.doc_id, tuple(r.piece_ids)) for r in got.collect()) == told(plain(rows)), name
        else:
            assert got.columns == docs.columns
            kept = got.collect()
            assert told((r.doc_id, r.text) for r in kept) == told(plain(rows)), name
            assert all(r.n_chars == len(r.text or "") and r["__row"] == "__row" and r["kept"] == "kept" for r in kept), name
            fewer.append(len(plain(want)) < len(want) or name)
        want = plain(want)
    assert fewer[0] is True and fewer[2] is True and fewer[3] is True
    assert told((r.doc_id, tuple(r.piece_ids)) for r in corpus_pipeline.run(spark, odd).collect()) == told(want)


def test_stages_of_an_empty_table(spark, odd):
    docs = common.table(spark, odd, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd)
        assert out.count() == 0 and (name == "sentencepiece" or out.columns == docs.columns), name
