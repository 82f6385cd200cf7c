"""Operators against brute force on small texts, odd cases included."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ALNUM, LOW, ODD, PLAIN, crc, documents
from vecscore.llm import common, language, lines, minhash, pieces, pii, quality, queries, repeats, sharding, toxicity
from vecscore.llm.decontaminate import decontaminate
from vecscore.llm.suffix_array import adjacent_common, big_endian_words, two_stage


def texts(n=60, seed=1):
    """Random texts, copies, near copies and shared passages, with the odd ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "an", "ón", "ß", "ing"]) for _ in range(r.randint(1, 4)))
    text = lambda k: "".join(word() + r.choice([" ", " ", " ", "\n"]) for _ in range(k))
    passage = text(70)
    out = list(ODD) + [text(r.randint(5, 150)) for _ in range(n)]
    for t in list(out[len(ODD) : len(ODD) + 12]):
        out.append(t)
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
        out.append(text(20) + passage + text(20))
    return out


@pytest.fixture(scope="module")
def corpus():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return documents(spark, corpus, more=True).repartition(3).cache()


@pytest.mark.parametrize(("step", "span"), [(37, 5), (64, 64), (1000, 10)])
def test_hashes_in_pieces(monkeypatch, step, span):
    """Spans have the hash of their bytes wherever a piece ends."""
    rng = np.random.default_rng(step)
    d = rng.integers(0, 3, 500).astype(np.uint8)
    s = np.sort(rng.integers(0, 501, 400))
    e = np.minimum(s + rng.integers(0, 40, 400), 500)
    monkeypatch.setattr(common, "HASH_STEP", step)
    monkeypatch.setattr(common, "HASH_SPAN", span)
    monkeypatch.setattr(common, "_POW", {})
    h = common.span_hash(d, s, e)
    of = collections.defaultdict(set)
    for a, b, x in zip(s.tolist(), e.tolist(), h.tolist(), strict=True):
        of[d[a:b].tobytes()].add(x)
    assert all(len(v) == 1 for v in of.values()) and len({x for v in of.values() for x in v}) == len(of)


# --- decontamination


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_decontaminate(spark, corpus, docs, block):
    r = random.Random(3)
    items = [" ".join(ALNUM.findall((corpus[k] or "").translate(LOW))[5:40]) for k in range(20, 40, 3)] + ["Word", None, "", "one two THREE four five six seven eight nine ten", "an"] + [corpus[30][:60]]
    bench = spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id long, text string")
    win = collections.defaultdict(set)
    for i, t in enumerate(items):
        w = ALNUM.findall((t or "").translate(LOW))
        for p in range(max(1, len(w) - 9) if w else 0):
            win[tuple(w[p : p + 10])].add(str(i))
    got = {x.doc_id: x for x in decontaminate(docs, bench, keep=docs.columns, block_bytes=block).collect()}
    for k, t in enumerate(corpus):
        w = ALNUM.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in win}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in win:
                    hit |= set(range(p, p + n))
                    found |= win[tuple(w[p : p + n])]
        x = got[k]
        assert (x.n_words, x.n_hit, x.n_items, x["items"], x.contaminated) == (len(w), len(hit), len(found), sorted(found), bool(hit)), k
    assert any(x.contaminated for x in got.values()) and r


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_decontaminate_repeated_ids(spark, block):
    """Every row is in the result, whatever its id and however many blocks the benchmark has."""
    rows = [(1, "alpha beta"), (1, "gamma delta"), (1, "alpha beta"), (None, "clean"), (None, "gamma"), (2, None)]
    bench = spark.createDataFrame([(7, "alpha"), (8, "gamma delta"), (None, "clean"), (9, "beta"), (9, "omega")], "item_id long, text string")
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_bytes=block).collect()
    want = [(1, 2, 2, ["7", "9"]), (1, 2, 2, ["8"]), (1, 2, 2, ["7", "9"]), (None, 1, 1, []), (None, 1, 0, []), (2, 0, 0, [])]
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got))) == sorted(map(repr, want))


@pytest.mark.parametrize(("most", "overlap"), [(10, 0), (10, 3), (40, 9)])
def test_word_pieces(most, overlap):
    r = random.Random(most)
    text = "".join(r.choice(["ab ", "c", " ", "long" * 9, "\n"]) for _ in range(200))
    d = np.frombuffer(text.encode(), np.uint8)
    words, last = text.split(), 0
    for number, part, s, e in common.word_pieces(d, common.NONSPACE, overlap, most):
        raw = part.tobytes()
        got = [raw[a:b].decode() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        assert got == words[number : number + len(got)] and number in (0, last - overlap)
        last = number + len(got)
    assert last == len(words)


def test_decontaminate_long_text(monkeypatch):
    """Parts of a long text give the hits and counts of the whole."""
    from vecscore.llm import decontaminate as dc

    r = random.Random(8)
    text = " ".join(r.choice("abcdef") for _ in range(600))
    batch = pa.RecordBatch.from_pylist([{"text": "x"}, {"text": text}, {"text": None}])
    bench = [(i, text[k : k + 2 * (4 if i % 2 else 12)].strip()) for i, k in enumerate(range(0, 800, 90))]
    win = dc.Windows(bench, 10)
    keys = np.unique(np.concatenate(win.grams))

    class Box:
        def __init__(self, value):
            self.value = value

        def broadcast(self, value):
            return Box(value)

    class Narrow:
        sparkSession = property(lambda self: self)
        sparkContext = Box(None)

        def mapInArrow(self, f, ddl):  # noqa: N802
            out = [b for b in f([batch])]
            self.total = {k: n for b in out for k, n in zip(*(c.to_pylist() for c in b.columns), strict=True)}
            return self

        groupBy = agg = lambda self, *a: self  # noqa: E731, N815

        def collect(self):
            return list(self.total.items())

    def run():
        n = Narrow()
        bc = dc._prepare(n, "text", bench, 10)
        return n.total, [b.to_pylist() for b in dc._join("text", [], bc)([batch])]

    from unittest import mock

    with mock.patch.object(dc.F, "sum", lambda c: c):
        whole = run()
        monkeypatch.setattr(dc, "CHUNK_BYTES", 50)
        monkeypatch.setattr(dc, "chunks", lambda o: common.chunks(o, 50))
        monkeypatch.setattr(dc, "word_pieces", lambda d, w, k: common.word_pieces(d, w, k, 50))
        assert run() == whole and len(keys) > 3 and whole[1][0][1]["hits"]


def test_decontaminate_empty(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, bench).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate(docs.limit(0), bench.unionAll(spark.createDataFrame([(1, "a b")], bench.schema))).count() == 0


# --- repeats


@pytest.mark.parametrize("alphabet", [1, 2, 4, 250])
def test_two_stage(alphabet):
    rng = np.random.default_rng(alphabet)
    for trial in range(25):
        t = rng.integers(0, alphabet, int(rng.integers(1, 260))).astype(np.uint8)
        wanted = np.ones(len(t), bool) if trial % 2 else rng.random(len(t)) < 0.5
        order = two_stage(t, wanted, 264)
        raw = t.tobytes()
        assert order.tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: raw[i:])
        lcp = adjacent_common(order, big_endian_words(t), 64)
        for k in range(1, len(order)):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[k] >= min(64, same) // 8 * 8


def test_crowded_bucket_of_segments_seen_twice(spark):
    """Many distinct segments of one bucket, each in two texts, are split into windows too."""
    r = random.Random(9)
    core = "".join(r.choice("abcdefgh") for _ in range(200))
    side = lambda: "".join(r.choice("abcdefgh") for _ in range(40))
    whole = [x for _ in range(12) for x in [side() + core + side()] for x in (x, x + "tail")]
    count = collections.Counter(t[i : i + 200] for t in whole for i in range(len(t) - 199))
    for hot in (2, 4096):
        got = {x.doc_id: x for x in repeats.repeated_spans(documents(spark, whole), hot=hot).collect()}
        for k, t in enumerate(whole):
            gone = {j for i in range(len(t) - 199) if count[t[i : i + 200]] > 1 for j in range(i, i + 200)}
            assert {j for x in got[k].spans for j in range(x.s, x.e)} == gone, (hot, k)


@pytest.mark.parametrize("hot", [1, 3, 4096])
def test_repeated_spans(corpus, docs, hot):
    got = {r.doc_id: r for r in repeats.repeated_spans(docs, hot=hot).collect()}
    raw = [(t or "").encode() for t in corpus]
    count = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    for k, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = j + 1
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert got[k].n_bytes == len(b) and [tuple(x) for x in got[k].spans] == spans and got[k].kept_sha256 == hashlib.sha256(kept).hexdigest(), k


def test_repeats_copies_and_empty(spark):
    rows = [(1, "ab" * 150), (1, "ab" * 150), (2, "c" * 199), (None, "d" * 250), (3, "e" * 120)]
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.spans]) for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, [(0, 250)]), (1, [(0, 300)]), (1, [(0, 300)]), (2, []), (3, [])]
    assert repeats.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh ") for _ in range(9000))
    monkeypatch.setattr(repeats, "PIECE", 700)
    d, o = np.frombuffer(long.encode(), np.uint8), np.array([0, 9000])
    _, p, q, m, h = repeats.runs(d, o, 200)
    assert p[0] == 0 and q[-1] == 8800 and (p[1:] == q[:-1] + 1).all() and ((m >= q) & (m <= p + 200 - repeats.GRAM)).all()


# --- personal data


def strict_spans(t):
    import re

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = [int(c) for c in m if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d[::-1])) % 10 == 0
        return 8 <= len(d) <= 15 if kind == "phone" else True

    return [(k, m.start(), m.end()) for k, x in kinds.items() for m in re.finditer(x, t) if ok(k, m.group())]


def test_personal_data(spark):
    cases = [t for t in ODD if t is None or len(t) < 4500 or t[1] != "@"] + [
        "mail é jo@x.example.com, ip 10.0.0.1.2.3.4.5 and 300.1.1.1 0001.2.3.0255", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 7536784127813050 4845168114407329", "+1 (204) 555-7209 ) +12 +1234567",
        "x@y.z@w.v..u@t.s a%b+c@d-e.f-g", "token = \"9b0b3c6a43eb78aa99cbd7049c5720aa\"", "call (204) 555-7209 or jo (at) x (dot) com, mail: jo [at] y.org",
    ]
    for size in (pii.PART, 16):
        got = {r.doc_id: r for r in pii.personal_data(documents(spark, cases, more=True), part=size).collect()}
        for k, t in enumerate(cases):
            assert [tuple(x) for x in got[k].base] == strict_spans(t or ""), (size, k)
            assert all(a.e <= b.s or b.e <= a.s for a in got[k].base for b in got[k].added)
            assert all(x.kind in pii.LOOSE and x.s < x.e <= len(t) for x in got[k].added)
        added = [(x.kind, cases[k][x.s : x.e]) for k, r in got.items() for x in r.added]
        assert ("key", "9b0b3c6a43eb78aa99cbd7049c5720aa") in added
    assert pii.personal_data(documents(spark, [])).count() == 0
    twice = pii.personal_data(spark.createDataFrame([(None, cases[-1]), (None, cases[-1]), (1, cases[-1])], "doc_id long, text string")).collect()
    assert len(twice) == 3 and twice[0].base == twice[1].base == twice[2].base


def test_personal_data_grows_in_proportion(spark):
    """Log lines, with and without line ends: four times the text takes nowhere near sixteen times the time."""
    import time

    line = "10.1.2.3 - jo.smith@example.com [12:00:01] GET /a?b=4111111111111111 +1 (204) 555-7209 "
    for end, n in (("\n", 3000), ("", 700)):
        took = []
        for k in (1, 4):
            t = (line + end) * (n * k)
            start = time.perf_counter()
            got = pii.personal_data(documents(spark, [t])).selectExpr("size(base) as n").first()
            took.append(time.perf_counter() - start)
            assert got.n >= 3 * n * k
        assert took[1] < 10 * took[0] + 2, took


def test_personal_data_quality(spark):
    """Planted spans that no strict pattern has, among look-alikes: precision and recall of what the method adds."""
    r = random.Random(11)
    rows, truth = [], []
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    for i in range(400):
        pick = r.randrange(6)
        digits = "".join(r.choice("0123456789") for _ in range(9))
        yes, no = [
            (f"jo{i} (at) mail{i} (dot) com", f"a{i} (at) b{i} (dot) zzq"), (f"({r.randint(2, 9)}{r.randint(0, 8)}{r.randint(2, 9)}) 555-{digits[:4]}", f"1{digits[:2]} {digits[2:5]}.{digits[5:9]}x"),
            (hexa(40), "0" * 40), (f"10[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}[.]7", f"{r.randint(300, 999)}[.]{r.randint(300, 999)}[.]1[.]9"),
            (hexa(32), "a" * 33), (f"mary.{i} [at] web [dot] org", f"x{i}@y .q{i}q"),
        ][pick]
        word = ["mail: ", "call ", "token = ", "host ", "key: ", "contact "][pick]
        good = r.random() < 0.5
        text = f"some words {word if good else 'no. '}{yes if good else no} and more"
        rows.append(text)
        if good:
            at = text.index(yes)
            truth.append((i, at, at + len(yes)))
    got = [(x.doc_id, s.s, s.e) for x in pii.personal_data(documents(spark, rows)).collect() for s in x.added]
    hit = len(set(got) & set(truth))
    assert hit >= 0.9 * len(truth) and hit >= 0.9 * len(got), (hit, len(truth), len(got))


def test_estimate_finds_reliable_labelers():
    r = random.Random(1)
    counts = collections.Counter()
    for _ in range(3000):
        truth = r.random() < 0.4
        vote = lambda right: (1 if truth else -1) if r.random() < right else (-1 if truth else 1)  # noqa: B023, E731
        counts["phone", vote(0.95), vote(0.9), vote(0.55), vote(0.9), 0] += 1
    p = pii.estimate(counts)
    assert p["phone", 1, 1, -1, 1, 0] > 0.9 > 0.1 > p["phone", -1, -1, 1, -1, 0]
    w = pii.train(counts)
    assert sum(w["phone"][j] for j in pii._active(("phone", 1, 1, -1, 1, 0))) > 0


# --- language


def test_language(spark):
    r = random.Random(2)
    syllables = {"en": ["the", "and", "ing", "er"], "de": ["sch", "ung", "ein", "ä"], "fr": ["eau", "é", "oux", "le"]}
    rows = []
    for i in range(300):
        lang = list(syllables)[i % 3]
        rows.append((i, " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(r.randint(3, 60))), lang if i % 7 else None))
    rows += [(1000 + i, t, "en") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.identify(df, per_lang=60).collect()}
    truth = {i: list(syllables)[i % 3] for i in range(300)}
    held = [k for k in truth if got[k].held_out]
    assert held and all(got[k].held_out == (crc(k, 4) == 2) for k in got)
    assert sum(got[k].lang_pred == truth[k] for k in held) >= 0.95 * len(held)
    for i, t in enumerate(ODD):
        x = got[1000 + i]
        assert 0 <= x.score <= 1 and (x.lang_pred == "und") == (not any(c.isalpha() for c in t or "")), i
    assert language.identify(df.limit(0)).count() == 0
    assert {x.lang_pred for x in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def grams(t):
    b = t.translate(LOW).encode()
    return {b[i : i + n] for n in language.SIZES for i in range(len(b) - n + 1)}


@pytest.mark.parametrize("part", [9, 64, 1 << 21])
def test_language_kernel(monkeypatch, part):
    """Kernel values against intersections of n-gram sets, and decisions from them, for texts by themselves and together."""
    monkeypatch.setattr(language, "PART", part)
    some = [t for t in texts(30, 5) if t]
    langs = [["a", "b", "c"][i % 3] for i in range(len(some))]
    m = language.Model(some, langs, vocab=500, landmarks=20)
    sets = [grams(t) for t in some]
    slot = {g: int(language._slots(np.frombuffer(g, np.uint8), len(g))[0]) for g in set().union(*sets)}
    own = [{m.table[slot[g]] for g in s} - {-1} for s in sets]
    count = sorted(((-sum(s in {slot[g] for g in x} for x in sets), s) for s in set(slot.values())))[:500]
    assert {s for _, s in count} == set(np.flatnonzero(m.table >= 0).tolist())
    data, offs = common.utf8(pa.array(some, pa.large_string()))
    x = np.concatenate([language.traits(d, o, m.table, m.width) for _, _, d, o in language._pieces(data, offs)])
    assert [set(np.flatnonzero(r).tolist()) for r in x] == own
    marks = [set(np.flatnonzero(c).tolist()) for c in m.z.T]
    want = [[len(s & z) / max(1, len(s)) ** 0.5 / max(1, len(z)) ** 0.5 for z in marks] for s in own]
    assert np.allclose(m.kernel(x), want, atol=1e-5) and all(z in own for z in marks)
    assert np.array_equal(language.has_letter(data, offs), [any(c.isalpha() for c in t) for t in some])


def test_language_ties_repeats_and_other_columns(spark):
    same = [(i % 40, "tie text", ["b", "a"][i % 2]) for i in range(400)]  # each id has both languages' share of one text
    df = spark.createDataFrame([*same, (None, "tie text", "a"), (7, "other words", "b"), (7, "other words", "a")], "doc_id long, text string, lang string")
    for c in ("score", "held_out", "lang_pred", "__n", "__k", "n", "x"):
        df = df.withColumn(c, F.lit(c))
    one, two = (sorted(map(repr, language.identify(d).collect())) for d in (df, df.repartition(7, "text", "lang").orderBy(F.rand(3))))
    assert one == two and len(one) == 403 and language.identify(df).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert len({x.split("lang_pred=")[1] for x in one if "lang_pred" in x}) <= 2
    ids = language.least(df.select("doc_id", "lang"), "lang", 5, 1).collect()
    assert len(ids) == len(set(ids)) == 10


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGS", 5)
    monkeypatch.setattr(language, "SAMPLE", 20)
    df = spark.createDataFrame([(i, f"text {i} of", f"l{i % 30 if i < 900 else 3}") for i in range(1200)], "doc_id long, text string, lang string")
    got, langs = language.sample(df, F.lit(True))
    assert len(got) == 20 and len(set(langs)) == 5 and "l3" in langs
    assert len(language.Model([f"t {i}" for i in range(200)], [f"l{i}" for i in range(200)]).z_norm) == 200  # a landmark for each


# --- lines


def brute_lines(rows, run=3, limit=40):
    """(lines, removed, text) of rows (id, text) in the order they are judged."""
    seen, out = set(), []
    for _, t in rows:
        part, gone = t.split("\n") if t is not None else [], set()
        count = [len(ALNUM.findall(x.translate(LOW))) for x in part]
        for n in range(1, run + 1):
            for p in range(len(part) - n + 1):
                w = tuple(part[p : p + n])
                if not any(w) if n == run else not count[p] or not count[p + n - 1] or sum(count[p : p + n]) < limit:
                    continue
                if (n, w) in seen:
                    gone |= set(range(p, p + n))
                seen.add((n, w))
        out.append((len(part), len(gone), "\n".join(x for i, x in enumerate(part) if i not in gone) if gone else t))
    return out


def test_dedup_lines(spark, docs, corpus):
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    want = brute_lines(list(enumerate(corpus)))
    for k in range(len(corpus)):
        assert (got[k].n_lines, got[k].n_removed, got[k].text) == want[k], k
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def test_dedup_repeated_ids_and_nulls(spark):
    """Rows are told apart by themselves, not by their ids."""
    para = "one\ntwo\nthree\nfour"
    rows = [(5, "a\nb\nc\nd"), (5, para + "\nown"), (7, para), (7, para), (None, para), (None, "x\ny\nz"), (8, "x\ny\nz"), (9, None), (9, ""), (9, "\n\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).withColumn("__row", F.lit(1)).repartition(3)
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "__row", "n_lines", "n_removed"]
    want = [(5, "a\nb\nc\nd", 0), (5, "own", 4), (7, "", 4), (7, "", 4), (None, para, 0), (None, "x\ny\nz", 0), (8, "", 3), (9, None, 0), (9, "", 0), (9, "\n\n\n", 0)]
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_removed) for r in got.collect()))) == sorted(map(repr, want))


def test_dedup_compares_bytes(spark, monkeypatch):
    """Lines whose hashes are all equal are still told apart, and fingerprints decide what is compared."""
    monkeypatch.setattr(lines, "span_hash", lambda d, s, e: np.zeros(len(s), np.uint64))
    whole = ["a\nb\nc", "d\ne\nf", "d\ne\nf\ng"]
    batch = [pa.RecordBatch.from_pylist([{"row": i, "text": t} for i, t in enumerate(whole)])]
    prints = [b for b in lines._winnow(3, 40)(batch)]
    assert sum(b.num_rows for b in prints) == 4 < sum(t.count("\n") + 1 for t in whole)
    near = pa.RecordBatch.from_pylist([{"row": i, "id": i, "tie": 0, "at": [0, 1] if i == 2 else [0], "text": t} for i, t in enumerate(whole)])
    wins = [r for b in lines._extend(3, 40)([near]) for r in b.to_pylist()]
    assert len({r["win"] for r in wins}) == 3 and len(wins) == 4
    near = near.set_column(3, "at", pa.array([[], [], []], pa.list_(pa.int32())))
    assert sum(b.num_rows for b in lines._extend(3, 40)([near])) == 0  # without joined fingerprints nothing is compared


def test_dedup_beside_another_first_place(spark):
    """The first place of each line of the run is among other lines than the run's earlier like."""
    whole = ["x1\nb\ny1", "a\nx2\ny2", "x3\ny3\nc", "a\nb\nc", "own\na\nb\nc"]
    got = {x.doc_id: (x.n_removed, x.text) for x in lines.dedup_lines(documents(spark, whole).repartition(3)).collect()}
    assert got == {**{k: (0, t) for k, t in enumerate(whole[:4])}, 4: (3, "own")}


def test_dedup_short_runs(spark):
    """Passages of two lines, each under the limit of one line."""
    r = random.Random(5)
    line = lambda k: " ".join(r.choice("abcdefgh") + str(r.randrange(10**6)) for _ in range(k))
    a, b, c, d, e, f, g = (line(k) for k in (27, 35, 19, 20, 45, 8, 39))
    own = lambda: line(6)
    whole = [
        f"{a}\n{b}", f"{own()}\n{a}\n{b}\n{own()}", f"{a}\n{b}", f"{b}\n{a}", f"{c}\n{d}", f"{own()}\n{c}\n{d}", f"{e}\n{f}", f"{f}\n{own()}\n{e}\n{f}", f"{e}\n\n{own()}\n{e}\n\n{own()}",
        f"{g}\n{own()}", f"{g}\n\n{own()}\n{g}\n\n{own()}", f"{a}\n{b}\n{own()}\n{a}\n{b}",
    ]
    got = {x.doc_id: x for x in lines.dedup_lines(documents(spark, whole).repartition(3)).collect()}
    gone = {1: {1, 2}, 2: {0, 1}, 7: {2, 3}, 8: {0, 3}, 11: {0, 1, 3, 4}}
    for k, t in enumerate(whole):
        part = t.split("\n")
        want = "\n".join(x for i, x in enumerate(part) if i not in gone.get(k, ()))
        assert (got[k].n_lines, got[k].n_removed, got[k].text) == (len(part), len(gone.get(k, ())), want), k


# --- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def test_pieces_are_sentencepieces(spark, corpus, docs, vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(pieces.MODEL))
    got = {r.doc_id: r for r in pieces.encode(docs, keep=["doc_id", "n_words"]).collect()}
    back = {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(docs, keep=["doc_id"]), keep=["doc_id"]).collect()}
    for k, t in enumerate(corpus):
        assert list(got[k].piece_ids) == sp.encode(t or ""), k
        assert back[k] == (t or "").replace("▁", " ") and got[k].n_words == "n_words"
    assert all(r.round_trip for r in pieces.encode(docs, digest=True).collect())


def test_pieces_of_slices_and_small_cache(vocabulary, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(pieces.MODEL))
    monkeypatch.setattr(pieces, "SLICE", 50)
    monkeypatch.setattr(pieces, "KEEP", 30)
    monkeypatch.setattr(pieces, "BLOCK", 7)
    enc = pieces.Encoder(vocabulary)
    r = random.Random(4)
    joined = ["".join(r.choice(["the", "ing", "漢", "字", "é", "\x00", "🙂", "0", "ab", "straße", "="]) for _ in range(200)) for _ in range(20)]
    for long in (1, 3, 64, 1 << 14):  # words walked in parts of every size
        monkeypatch.setattr(pieces, "LONG", long)
        for t in [*texts(20, 9)[len(ODD) :], *joined, "  two  spaces   three ", "x" * 300, "   ", " " * 200 + "end"]:
            ids = enc.encode([t])[0]
            assert ids.tolist() == sp.encode(t) and vocabulary.decode(ids) == t


def test_pieces_repeated_and_empty(spark, vocabulary):
    rows = [(1, "same words"), (1, "same words"), (None, "same words"), (1, "other"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("piece_ids", F.lit("x")).withColumn("decoded", F.lit("y"))
    out = pieces.encode(df, keep=["doc_id", "decoded", "piece_ids"])
    assert out.columns == ["doc_id", "decoded", "piece_ids", "n_pieces"]
    got = pieces.decode(out).collect()
    want = {t: vocabulary.encode_words([" " + t])[" " + t] for _, t in rows if t}
    assert sorted((r.doc_id or 0, r.decoded, tuple(r.piece_ids)) for r in got) == sorted((i or 0, t or "", want.get(t, ())) for i, t in rows)
    assert pieces.decode(pieces.encode(df.limit(0))).count() == 0 and pieces.encode(df.limit(0), digest=True).count() == 0


# --- sharding


@pytest.mark.parametrize("bucket", [5, 1000])
def test_sharding(spark, corpus, docs, bucket):
    out = sharding.shard_rows(docs, bucket_rows=bucket, payload=["doc_id", "text"]).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(corpus)))
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 8) and r.size == len((corpus[r.doc_id] or "").encode()) + 1 and r.text == corpus[r.doc_id] for r in out)
    seven = {r.doc_id: r.shard for r in sharding.shard_rows(docs, shards=7).collect()}
    assert all(seven[r.doc_id] in (r.shard, r.shard) or r.shard == 7 for r in out)
    assert sharding.shard_rows(docs.limit(0)).count() == 0
    again = sharding.shard_rows(docs, bucket_rows=bucket, payload=["doc_id", "text"]).collect()
    assert {r.doc_id: r.slot for r in again} == {r.doc_id: r.slot for r in out}


def test_sharding_columns(spark, docs, corpus):
    """crc32, and the law: the id and the number of shards alone decide, and one shard more takes rows only into itself."""
    import zlib

    out = {r.doc_id: r for r in sharding.shard_rows(docs, payload=["doc_id"]).collect()}
    assert all(out[k].text_crc32 == zlib.crc32((t or "").encode()) for k, t in enumerate(corpus))
    other = {r.doc_id: r for r in sharding.shard_rows(docs.withColumn("text", F.lit("same")), payload=["doc_id"]).collect()}
    assert {k: r.shard for k, r in out.items()} == {k: r.shard for k, r in other.items()}
    nine = {r.doc_id: r.shard for r in sharding.shard_rows(docs, shards=9, payload=["doc_id"]).collect()}
    assert nine == {k: r.grown_shard for k, r in out.items()} and any(v == 8 for v in nine.values())


def test_sharding_spreads_equal_rows(spark):
    """Rows of one id and text come into many buckets; slots are gapless and the same whatever the partitions."""
    rows = spark.range(0, 3000, 1, 5).selectExpr("if(id < 2000, 7, id) as doc_id", "if(id < 2000, 'hot', string(id % 3)) as text").unionByName(spark.createDataFrame([(None, None)] * 30, "doc_id long, text string"))
    dealt = sharding._spread(rows.selectExpr("xxhash64(doc_id, text) as scatter"), 10)
    assert dealt.groupBy("deal").count().agg(F.max("count")).first()[0] <= 10 and dealt.count() == 3030
    one, two = (sharding.shard_rows(x, bucket_rows=80).collect() for x in (rows, rows.repartition(3)))
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    for s in range(8):
        assert sorted(r.slot for r in one if r.shard == s) == list(range(sum(r.shard == s for r in one)))


def test_sharding_query_moves_whole_rows(spark, sf, monkeypatch):
    """The query's rows carry all columns through the shuffle, and its digests are made of the texts that arrive."""
    seen = []
    real = sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df: seen.append(df.schema.simpleString()) or real(df))
    out = {r.doc_id: r for r in queries.op7_sharding(spark, sf).collect()}
    columns = common.table(spark, sf, "documents").columns
    assert any("rows:array" in x and all(f"{c}:" in x for c in columns) for x in seen)
    import zlib

    texts_ = {r.doc_id: (r.text or "").encode() for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert {k: (len(t) + 1, zlib.crc32(t)) for k, t in texts_.items()} == {k: (r.size, r.text_crc32) for k, r in out.items()}


def test_write_shards(docs, tmp_path):
    sharding.write_shards(sharding.shard_rows(docs, shards=3, payload=["doc_id", "text"]), f"{tmp_path}/s")
    assert sorted(p.name for p in tmp_path.glob("s/shard=*")) == ["shard=0", "shard=1", "shard=2"]


# --- quality


def test_quality_counts(corpus, docs):
    t = F.col("text")
    got = docs.select("doc_id", F.size(quality.words(t)).alias("n"), quality.word_chars(t).alias("c"), quality.n_symbols(t).alias("s"), quality.n_dup_lines(t).alias("d"), quality.n_repeat_words(t).alias("r")).collect()
    for x in got:
        text = corpus[x.doc_id] or ""
        w = PLAIN.findall(text)
        count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        full = [y for y in text.split("\n") if PLAIN.search(y)]
        assert tuple(x)[1:] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(again)), x.doc_id


def test_cascade_order_changes_no_verdict(docs):
    rules = {k: v(lambda c: quality.COUNTS[c](F.col("text"))) for k, v in quality.RULES.items()}
    want = {r.doc_id: not any(tuple(r)[1:]) for r in docs.select("doc_id", *(v.alias(k) for k, v in rules.items())).collect()}
    got = {r.doc_id: r for r in quality.quality(docs, sample_rows=20).collect()}
    assert {k: r.kept for k, r in got.items()} == want and all((r.rejected_by is None) == r.kept for r in got.values())
    assert {r.doc_id: r.kept for r in quality.quality(docs, sample_rows=20, counts=("n_words", "n_repeat_words")).collect()} == want
    assert quality.order_rules({"a": (1.0, 0.1), "b": (0.1, 0.1), "c": (1.0, 0.9)}) == ["b", "c", "a"]
    assert quality.quality(docs.limit(0)).count() == 0


# --- near duplicates


def brute_classes(corpus):
    sets = []
    for t in corpus:
        w = PLAIN.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(corpus)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


def test_near_duplicates(spark, corpus, docs):
    size, comp = brute_classes(corpus)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (size[k], comp[k], comp[k] == k) for k in got}
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_near_duplicate_chains(spark, monkeypatch):
    """A group in which few texts are near its smallest id: links must be found across components, in small blocks too."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    out = []
    for i in range(120):
        w = list(base)
        for p in r.sample(range(80), r.randint(1, 5)):
            w[p] = f"x{i}_{p}"
        out.append(" ".join(w))
    monkeypatch.setattr(minhash, "MINORS", 4)
    monkeypatch.setattr(minhash, "PASSING", 11)
    monkeypatch.setattr(minhash, "PER_SALT", 7)
    size, comp = brute_classes(out)
    assert len(set(comp)) > 3
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(documents(spark, out)).collect()}
    assert got == dict(enumerate(comp))


def test_near_duplicates_repeated_and_other_ids(spark):
    """Ids that repeat, are null or are strings; rows are compared by their texts."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"q{i}" for i in range(30))
    rows = [("5", a), ("5", c), ("7", b), ("9", c), (None, a), (None, "own words only here now"), ("8", None), ("8", ""), ("3", "UPPER lower"), ("3", "upper LOWER")]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("node", F.lit("x")).repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect())
    want = [("5", 56, "5", True), ("5", 26, "5", True), ("7", 56, "5", False), ("9", 26, "5", False), ("None", 56, "5", False), ("None", 1, "None", True), ("8", 0, "8", True), ("8", 0, "8", True)]
    assert got == sorted([*want, ("3", 1, "3", True), ("3", 1, "3", True)])


def test_template_family_does_not_meet(spark):
    """Texts that share a template but are under the threshold leave nothing to compare; those over it are found."""
    r = random.Random(2)
    template = [f"t{i}" for i in range(150)]
    out = [" ".join([*template, *(f"u{i}_{k}" for k in range(r.randint(55, 75)))]) for i in range(300)]
    sets = [next(minhash.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))) for t in out]
    table = spark.createDataFrame([(i, bytearray(h.tobytes())) for i, h in enumerate(sets)], "node long, h binary")
    alone = spark.createDataFrame([(i, i) for i in range(300)], "node long, comp long")
    assert minhash._meeting(alone, table, 75).count() == 0
    out += [" ".join([*template, *(f"v{i // 2}_{k}" for k in range(60)), *(f"u{i}_{k}" for k in range(12))]) for i in range(20)]
    size, comp = brute_classes(out)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(documents(spark, out)).collect()}
    assert got == dict(enumerate(comp)) and len(set(comp)) == 310


def test_long_text_shingles(monkeypatch):
    text = " ".join(random.Random(3).choice("abcd") for _ in range(500))
    d, o = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    few = np.frombuffer(b"aa bb " + b"c" * 90, np.uint8)
    want = [next(minhash.shingle_sets(d, o)), next(minhash.shingle_sets(few, np.array([0, 96])))]
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 60)
    monkeypatch.setattr(minhash, "word_pieces", lambda x, w, k: common.word_pieces(x, w, k, 60))
    assert all((next(minhash.shingle_sets(x, np.array([0, len(x)]))) == y).all() for x, y in zip((d, few), want, strict=True))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    same = (minhash.signature(a, 512) == minhash.signature(b, 512)).mean()
    assert abs(same - 800 / 1200) < 0.08


# --- toxicity


def test_toxicity(spark):
    r = random.Random(6)
    bad = {"en": ["idiot", "scum"], "fr": ["vequta", "vejuee", "vequsse", "vejuais"]}
    rows, labels = [], []
    for i in range(700):
        lang = ["en", "fr"][i % 2]
        words = ["".join(r.choice(["th", "er", "an"] if lang == "en" else ["eau", "le", "oi"]) for _ in range(2)) for _ in range(r.randint(10, 60))]
        toxic = int(r.random() < 0.4)
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad[lang])
        rows.append((i, " ".join(words), lang))
        labels.append((i, 1, toxic))
    rows += [(5000 + i, t, None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, language.crc_part(F.col("doc_id"), 5) != 0)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [k for k, _, _ in labels if crc(k, 5) == 0]
    right = sum(got[k].predicted == labels[k][2] for k in held)
    assert right >= 0.93 * len(held) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    assert toxicity.fit(docs, marks.where("toxic = 1")) is None
    assert {x.predicted for x in toxicity.score(docs, None).collect()} == {0} and toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("local", [3000, 0])
def test_toxicity_learns_from_all_labelled_texts(spark, monkeypatch, local):
    """Long texts as well as short ones, in the driver or in the cluster; the cluster's counts are those of all texts to train on."""
    r = random.Random(8)
    rows = []
    for i in range(400):
        words = [r.choice(["th", "er", "an", "ing"]) + r.choice(["th", "er", "an"]) for _ in range(3000 if i % 2 else 40)]
        if i % 4 == 1:
            words[r.randrange(len(words))] = "idiot"
        rows.append((i, " ".join(words), ["en", "fr"][i // 2 % 3 == 0], int(i % 4 == 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(3, "doc_id")
    monkeypatch.setattr(toxicity, "LOCAL_ROWS", local, raising=False)
    m = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    got = {x.doc_id: x.predicted for x in toxicity.score(df, m).collect()}
    assert sum(got[i] == y for i, _, _, y in rows) >= 390


def test_toxicity_pools_in_parts(monkeypatch):
    some = [t or "" for t in texts(40, 8)]
    m = toxicity.Model(some, [i % 3 == 0 for i in range(len(some))], ["a"] * len(some), epochs=1)
    word, first = toxicity.buckets(*common.utf8(pa.array(some, pa.large_string())))
    best, _ = m._pool(m.row[word], first)
    for most in (1, 7, 1 << 16):
        assert np.allclose(m.pool_parts(m.row[word], first, most)[0], best, atol=1e-5)


def naive_maxima(m, t):
    """Maxima of each filter over every window of the embeddings, zero beyond the end, by plain loops."""
    word, _ = toxicity.buckets(*common.utf8(pa.array([t], pa.large_string())))
    emb = [m.emb[m.row[w]].sum(axis=0) for w in word]
    return [max((sum(emb[i + j] @ m.conv[k][j][:, f] for j in range(w) if i + j < len(emb)) for i in range(len(emb))), default=0.0) for k, w in enumerate(toxicity.WIDTHS) for f in range(toxicity.FILTERS)]


def test_toxicity_forward_pass(monkeypatch):
    """Maxima, logits and languages against plain loops: texts together, alone, and in small parts."""
    some = [t or "" for t in texts(40, 8)]
    m = toxicity.Model(some, [i % 3 == 0 for i in range(len(some))], [["a", "b"][i % 2] for i in range(len(some))], epochs=1)
    best = np.array([naive_maxima(m, t) for t in some])
    want = np.maximum(best + m.bias, 0) @ m.top + m.free
    data, offs = common.utf8(pa.array(some, pa.large_string()))
    word, first = toxicity.buckets(data, offs)
    logit, lang = m.logits(m.row[word], first)
    assert np.allclose(logit, want, atol=1e-4)
    pooled, at = m._pool(m.row[word], first)
    assert np.allclose(pooled, best, atol=1e-6) and all((at[i] >= 0).all() == (first[i + 1] > first[i]) for i in range(len(some)))
    for size in (1, 40, 300):
        monkeypatch.setattr(toxicity, "SCORE_BYTES", size)
        for i, t in enumerate(some):
            z, tongue = m.long_logits(np.frombuffer(t.encode(), np.uint8))
            assert np.allclose(z, logit[i], atol=1e-5) and tongue[0] == lang[i], (size, i)


@pytest.mark.parametrize("bits", [1, 17])
def test_toxicity_hashes_distinct_words(monkeypatch, bits):
    """A part's words are hashed to buckets once each (here: but for slots that several words share), scores and counts are those of all words."""
    r = random.Random(5)
    some = [" ".join(r.choice(["Fine", "words", "here", "and", "an", "idiot", "été"]) for _ in range(n)) for n in (400, 0, 1, 2, 300)] + ["", "x " * 500]
    m = toxicity.Model(some, [i % 2 for i in range(len(some))], ["a", "b"] * 3 + ["a"], epochs=1)
    data, offs = common.utf8(pa.array(some, pa.large_string()))
    word, first = toxicity.buckets(data, offs)
    want, tongue = m.logits(m.row[word], first)
    hashed, plain = [], toxicity.word_buckets
    monkeypatch.setattr(toxicity, "SLOT_BITS", bits, raising=False)
    monkeypatch.setattr(toxicity, "word_buckets", lambda d, s, e: hashed.append(len(s)) or plain(d, s, e))
    logit, lang = m.raw(data, offs)
    assert np.allclose(logit, want, atol=1e-5) and (lang == tongue).all()
    assert sum(hashed) <= (8 if bits == 17 else len(word))
    batch = pa.record_batch({"text": pa.array(some, pa.large_string()), "toxic": pa.array([0] * len(some), pa.int32()), "lang": pa.array([0] * len(some), pa.int32())})
    for size in (1 << 19, 50):  # with 50, texts longer than a part have several
        monkeypatch.setattr(toxicity, "SCORE_BYTES", size)
        got = pa.Table.from_batches(list(toxicity._count(1)([batch]))).to_pydict()
        assert dict(zip(got["bucket"], got["l0"], strict=True)) == collections.Counter(word.ravel().tolist())
        assert dict(zip(got["bucket"], got["n"], strict=True)) == collections.Counter(b for i in range(len(some)) for b in set(word[first[i] : first[i + 1]].ravel().tolist()))
    assert all(len(x) == 0 for x in toxicity.word_ids(data[:0], first[:0], first[:0]))


def test_toxicity_step(monkeypatch):
    """Gradients against differences of the loss, by distinct words as by all; steps in parts against the whole formula."""
    some = ["fine words here idiot here", "", "an idiot", "fine fine words and more words here", "x"] * 3
    y = np.array([1.0, 0, 1, 0, 0] * 3)
    monkeypatch.setattr(toxicity, "MIN_DOCS", 1)
    m = toxicity.Model(some, y.astype(int).tolist(), ["a"] * 15, epochs=1)
    word, ids, first = toxicity.distinct(*common.utf8(pa.array(some, pa.large_string())))
    rows = m.row[word]

    def loss():
        best, _ = m._pool(rows[ids], first)
        z = np.maximum(best + m.bias, 0) @ m.top + m.free
        return (np.logaddexp(0, z) - y * z).sum()

    g = m.gradient(rows[ids], first, y, *m._pool(rows[ids], first))
    near = m.gradient(rows, first, y, *m._pool(rows[ids], first), ids)
    assert all(np.allclose(g[k], near[k]) for k in m.NAMES)
    twice = m.gradient(rows, first, y, *m._pool(rows[ids], first), ids, near)
    assert all(np.allclose(2 * np.asarray(g[k]), twice[k]) for k in m.NAMES)
    for at in np.argwhere(np.abs(g["emb"]) > 0.01)[::7]:
        if at[0]:  # row 0 stays as it is
            old, m.emb[tuple(at)] = m.emb[tuple(at)], m.emb[tuple(at)] + 1e-6
            up = loss()
            m.emb[tuple(at)] = old
            assert abs((up - loss()) / 1e-6 - g["emb"][tuple(at)]) < 1e-3
    state, emb, x = m.moments(), m.emb.copy(), g["emb"] / 15 + toxicity.DECAY * m.emb
    monkeypatch.setattr(toxicity, "ADAM_ROWS", 3)
    m.adam(g, state, 15)
    x[0] = 0
    want = emb - 0.01 * x / (np.abs(x) + 1e-8)  # a first step: both moments are those of x itself
    assert np.allclose(m.emb, want) and not g["emb"].any()


@pytest.mark.parametrize("kind", ["bigint", "int", "string", "double"])
def test_toxicity_likely_rows(spark, kind):
    """The bitmap loses no labelled row and leaves out most others; ids whose equality is no equality of hashes all stay."""
    docs = spark.range(40000).selectExpr(f"cast(id as {kind}) as doc_id", "'en' as lang", "concat('t', id) as text").union(spark.sql(f"select cast(null as {kind}), 'en', 'x'"))
    marks = spark.range(-1000, 40000, 8).selectExpr(f"cast(id as {kind}) as doc_id", "0 as toxic").union(spark.sql(f"select cast(null as {kind}), 0"))
    near = toxicity._likely(docs, marks)
    assert near.columns == docs.columns and near.join(marks, "doc_id").count() == 5000
    assert near.count() == 40001 if kind == "double" else near.count() < 5000 + 0.15 * 35000
    assert toxicity.learned(docs, marks, F.lit(True)).count() == 5000
    other = toxicity._likely(docs, marks.withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)")))
    assert other.count() == 40001
    assert toxicity._likely(docs, marks.limit(0)).count() == (40001 if kind == "double" else 0)


def test_toxicity_lets_shuffle_files_go(spark, monkeypatch):
    """While a model is fitted, and no longer, a query's shuffle files go when it ends, without a call of the garbage collector."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" ")))
    monkeypatch.setattr(common, "release", lambda spark: None)
    monkeypatch.setattr(toxicity, "release", lambda spark: None)
    monkeypatch.setattr(toxicity, "LOCAL_ROWS", 0)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key), files()
    docs = spark.createDataFrame([(i, "en", f"word{i} and {'idiot' if i % 3 == 0 else 'more'}") for i in range(90)], "doc_id long, lang string, text string").repartition(2)
    keep = toxicity.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 3 = 0) as toxic"))
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert keep is not None and files() <= before and spark.conf.get(key) == was


def test_toxicity_ties_repeats_and_other_columns(spark):
    rows = [(i % 50, ["fine words here", "idiot words here"][i % 2], "en") for i in range(300)] + [(None, "idiot", None), (3, "another text", "fr"), (3, None, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("predicted", "toxic", "x", "__n", "__k"):
        df = df.withColumn(c, F.lit(c))
    marks = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(4, 1), (4, 0), (None, 1), (9, None), (8, 7)], "doc_id long, toxic int").withColumn("text", F.lit("t"))
    assert len(toxicity.sample(df, marks, F.lit(True))) == 50 and {t for t, y, _ in toxicity.sample(df, marks, F.col("doc_id") == 4)} == {"fine words here"}
    assert [y for _, y, _ in toxicity.sample(df, marks, F.col("doc_id") == 4)] == [1]
    one, two = (sorted(map(repr, toxicity.score(d, toxicity.fit(d, marks)).collect())) for d in (df, df.orderBy(F.rand(3))))
    assert one == two and len(one) == 303
    out = toxicity.score(df, toxicity.fit(df, marks))
    assert out.columns == ["doc_id", "text", "lang", "toxic", "x", "__n", "__k", "score", "predicted"]
    assert out.groupBy("text").agg(F.countDistinct("score").alias("n")).where("n > 1").count() == 0
