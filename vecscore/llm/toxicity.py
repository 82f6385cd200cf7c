"""Toxicity by a convolutional text classifier in NumPy.

Words (runs of letters, digits and non-ASCII characters, A-Z lowered) are hashed to 2**20 buckets, as a whole
and by their first 4, first 6 and last 4 bytes, since other languages build new words from known parts; a
word's embedding is the sum of the four. Buckets that at least `MIN_DOCS` training texts have get an
embedding, all others share a zero vector. Filters of
widths 1, 2 and 3 slide over the embeddings (zero beyond a text's end), each is max-pooled over the whole
text, and a logistic layer on the rectified maxima gives a logit. Training: Adam on the logistic loss, with
gradients through the maxima only; the first embedding coordinate starts as the bucket's smoothed
log odds, the others are random.

Thresholds are calibrated by language: a multinomial word model, learned on the same texts, tells a text's
language from its words alone; on texts not trained on, each language with enough of both labels gets
the logit threshold of best (weighted) accuracy over both labels, drawn towards the threshold of all. The score is the
logistic of the logit less the text's threshold, so 0.5 is the decision everywhere.

The model is fitted on all labelled texts, whole. Up to `LOCAL_ROWS` of `LOCAL_BYTES` in all are fitted by the driver. More stay in the cluster: word
counts, languages and thresholds come from counts over all of them, and in each epoch every part of the rows trains a copy of the model, the copies' mean being
the next epoch's start. A part makes about `STEPS` steps an epoch however many rows it has; thresholds are then exact to 1/64 of a logit. Labels of languages
that have under 10 held texts of a label are one class. Texts without a label are mostly kept out of the shuffle by a bitmap of the labelled ids, and a
query's shuffle files go when it ends. Every text is scored whole, a long one in parts of `SCORE_BYTES` that share the words a window can
lie over. Buckets, and products of embeddings and filters, are made once for each distinct word (by a 64-bit
hash) of a part of the texts, and taken from there wherever the word occurs.

Null and empty texts have no windows: all maxima are 0. Without both labels to learn from every score is 0. Rows are scored
by their text alone, so repeated rows are scored alike; of equal word scores the first language by name is taken, of equal
thresholds the middle one. An id with both labels counts as toxic; an id repeated with several texts is
learned from once, with the least of (language, text). An empty table gives an empty result. `score` and `predicted` replace
columns of these names; all others stay as they are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from .common import ALNUM, ANYCASE, LOWER, chunks, materialize, mix, release, span_hash, span_hashes, swept, text_column, utf8, word_pieces, word_spans

BITS = 20
MIN_DOCS = 8
PRIOR = 2.0
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
LOCAL_ROWS, LOCAL_BYTES = 3000, 1 << 24
STEPS, MOST_PARTS = 35, 64
BINS = 64
EPOCHS = 8
DECAY = 1e-4
SEED = 3
SCORE_BYTES = 1 << 19
SLOT_BITS, MAP_BITS = 17, 28
ADAM_ROWS = 2048
#: Weight of the share of clean texts that are kept, against that of toxic texts caught, where thresholds are set.
CLEAN = 3.0


PARTS = 4


def buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word (words by PARTS), and the number of the first word of each text (one more at the end)."""
    d = LOWER[data]
    s, e, first = word_spans(d, offs, ALNUM)
    return word_buckets(d, s, e), first


def word_buckets(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Buckets of the words d[s:e] of lower-cased bytes."""
    spans = ((s, e), (s, np.minimum(s + 4, e)), (s, np.minimum(s + 6, e)), (np.maximum(e - 4, s), e))
    cols = [mix(h + np.uint64(k)) >> np.uint64(64 - BITS) for k, h in enumerate(span_hashes(d, *spans))]
    return np.stack(cols, axis=1).astype(np.int32)


def firsts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that stand for all values of h, and for each value the number of the place with an equal one. A value that shares its
    slot with another may stand for itself more than once."""
    slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    stand = np.zeros(1 << SLOT_BITS, np.int32)
    stand[slot] = np.arange(len(h), dtype=np.int32)
    at = stand[slot]
    other = np.flatnonzero(h[at] != h)
    at[other] = other
    return compact(at, len(h))


def compact(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of ids (below n) that occur, ascending, and for each of ids its place among them."""
    if n > 8 * len(ids):
        return np.unique(ids, return_inverse=True)
    there = np.zeros(n, bool)
    there[ids] = True
    number = np.cumsum(there, dtype=np.int32)
    return np.flatnonzero(there), number[ids] - 1


def word_ids(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_buckets() of the distinct words of d[s:e], and the number of every word among these."""
    at, ids = firsts(span_hash(d, s, e))
    s, size = s[at], (e - s)[at]
    end = np.cumsum(size)
    own = d[np.repeat(s - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
    return word_buckets(own, end - size, end), ids


def distinct(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """buckets() by distinct words: their buckets, every word's number among them, and the first word of each text."""
    d = LOWER[data]
    s, e, first = word_spans(d, offs, ALNUM)
    return *word_ids(d, s, e), first


def sums(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the table's rows of each word."""
    got = table.take(rows[:, 0], axis=0)
    for part in range(1, PARTS):
        got += table.take(rows[:, part], axis=0)
    return got


def windows(got: np.ndarray, ids: np.ndarray, ends: np.ndarray, n: int, widths=range(len(WIDTHS))) -> np.ndarray:
    """Values of the filters (of these of WIDTHS) at the first n of the words `ids`, from the products of distinct words;
    ends: where texts end, beyond which a window sees zeros."""
    outs = []
    for k in widths:
        w, c = WIDTHS[k], sum(WIDTHS[:k]) * FILTERS
        out = got[c : c + FILTERS].take(ids[:n], axis=1)
        for j in range(1, w):
            v = got[c + j * FILTERS : c + (j + 1) * FILTERS].take(ids[j : j + n], axis=1)
            for q in range(1, j + 1):
                e = ends - q
                v[:, e[(e >= 0) & (e < v.shape[1])]] = 0
            out[:, : v.shape[1]] += v
        outs.append(out)
    return outs[0] if len(outs) == 1 else np.concatenate(outs)


class Model:
    def __init__(self, texts: list[str], labels: list[int], langs: list[str], epochs: int = EPOCHS):
        rng = np.random.default_rng(SEED)
        data, offs = utf8(pa.array(texts, pa.large_string()))
        got = [buckets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs, 1 << 18)]
        word = np.concatenate([w for w, _ in got])
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in got]))])
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        y = np.array(labels, np.float64)
        hold = rng.random(len(y)) < 0.25  # for the thresholds
        n1, n = np.zeros(1 << BITS), np.zeros(1 << BITS, np.int32)
        for i in np.flatnonzero(~hold):
            own = np.unique(word[first[i] : first[i + 1]])
            n[own] += 1
            n1[own] += y[i]
        known = np.flatnonzero(n >= MIN_DOCS)
        self._start(known, n[known], n1[known], y[~hold].sum(), (1 - y[~hold]).sum(), rng)
        del n1, n
        self._train(self.row[word], first, y, np.flatnonzero(~hold), epochs, rng)
        self._languages(self.row[word], doc, langs, ~hold)
        self._finish()
        parts = [self.logits(self.row[word[first[i] : first[min(i + 64, len(y))]]], first[i : i + 65] - first[i]) for i in range(0, len(y), 64)]
        self._calibrate(*(np.concatenate(x) for x in zip(*parts, strict=True)), y, hold)

    def _start(self, known, n, n1, t1, t0, rng):
        """Numbers of the known buckets and values before training, from texts (n) and toxic texts (n1) of each bucket and of all."""
        self.row = np.zeros(1 << BITS, np.int32)  # row 0: all other buckets
        self.row[known] = np.arange(1, len(known) + 1)
        odds = np.log((n1 + PRIOR) / (t1 + 2 * PRIOR)) - np.log((n - n1 + PRIOR) / (t0 + 2 * PRIOR))
        self.emb = np.zeros((len(known) + 1, DIM))
        self.emb[1:] = rng.normal(0, 0.05, (len(known), DIM))
        self.emb[1:, 0] = 0.25 * odds
        self.conv = [rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS]
        for c in self.conv:
            c[0, 0, : FILTERS // 2] += 0.5
        self.bias = np.zeros(len(WIDTHS) * FILTERS)
        self.top = np.full(len(WIDTHS) * FILTERS, 0.3)
        self.free = -1.0

    def _train(self, rows, first, y, docs, epochs, rng):
        state = self.moments()
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(docs), max(1, len(docs) // 64)):
                take = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
                cut = np.concatenate([[0], np.cumsum([first[i + 1] - first[i] for i in part])])
                g = self.gradient(rows[take], cut, y[part], *self._pool(rows[take], cut))
                self.adam(g, state, len(part))

    NAMES = ("emb", "bias", "top", "free", *range(len(WIDTHS)))

    def value(self, k):
        return self.conv[k] if isinstance(k, int) else getattr(self, k)

    def moments(self):
        zero = lambda: {k: np.zeros_like(np.asarray(self.value(k))) for k in self.NAMES}
        return {"m1": zero(), "m2": zero(), "step": 0}

    def gradient(self, own, cut, y, best, at, ids=None, g=None):
        """Sums over the texts of the loss's gradients, from their words' rows (by `ids` if the rows are of distinct words), maxima and the
        words where these start; added to g if given."""
        g = {} if g is None else g

        def add(k, x):
            g[k] = g[k] + x if k in g else x

        z = best + self.bias
        act = np.maximum(z, 0)
        err = 1 / (1 + np.exp(-(act @ self.top + self.free))) - y
        add("top", err @ act)
        add("free", err.sum())
        dz = err[:, None] * self.top * (z > 0) * (at >= 0)
        add("bias", dz.sum(axis=0))
        if "emb" not in g:
            g["emb"] = np.zeros_like(self.emb)
        end, last, hit, back = cut[1:], int(cut[-1]) - 1, [], []
        for k, w in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            grad = np.zeros_like(self.conv[k])
            for j in range(w):
                p = at[:, cols] + j
                ok = (at[:, cols] >= 0) & (p < end[:, None])
                d = dz[:, cols] * ok
                if last < 0:
                    continue
                p = np.clip(p, 0, last)
                r = own[p if ids is None else ids[p]] * ok[:, :, None]
                grad[j] += np.einsum("bf,bfd->df", d, self.emb[r].sum(axis=2))
                hit.append(r.reshape(-1, PARTS).T)
                back.append((d[:, :, None] * self.conv[k][j].T[None]).reshape(-1, DIM))
            add(k, grad)
        if hit:
            some, place = np.unique(np.concatenate([x.ravel() for x in hit]), return_inverse=True)
            for c in range(DIM):
                g["emb"][some, c] += np.bincount(place, np.concatenate([x[:, c] for x in back for _ in range(PARTS)]), len(some))
        return g

    def adam(self, g, state, n=1):
        """A step along the gradients g of n texts in all; g["emb"] is left as zeros."""
        state["step"] += 1
        step, m1, m2 = state["step"], state["m1"], state["m2"]

        def move(x, m1, m2):
            m1 *= 0.9
            m1 += 0.1 * x
            m2 *= 0.99
            m2 += 0.01 * np.square(x)
            root = np.sqrt(m2 / (1 - 0.99**step))
            root += 1e-8
            by = m1 / root
            by *= 0.01 / (1 - 0.9**step)
            return by

        g["emb"][0] = 0
        for at in range(0, len(self.emb), ADAM_ROWS):  # parts that a cache holds
            part = slice(at, at + ADAM_ROWS)
            emb, x = self.emb[part], g["emb"][part]
            x /= n
            x += DECAY * emb
            emb -= move(x, m1["emb"][part], m2["emb"][part])
            x.fill(0)
        for k in self.NAMES[1:]:
            x = g[k] / n
            if k == "top" or isinstance(k, int):
                x = x + 1e-4 * self.value(k)
            new = self.value(k) - move(x, m1[k], m2[k])
            if isinstance(k, int):
                self.conv[k] = new
            else:
                setattr(self, k, new)

    def copied(self) -> Model:
        """Another model of the same values, embeddings as 32-bit floats; training changes these in place and puts new arrays in place of the others."""
        m = Model.__new__(Model)
        m.__dict__.update(self.__dict__, conv=list(self.conv), emb=self.emb.astype(np.float32), free=np.array(float(self.free)))
        return m

    def pack(self) -> np.ndarray:
        return np.concatenate([np.asarray(self.value(k), float).ravel() for k in self.NAMES])

    def unpack(self, vals: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = np.asarray(self.value(k), float)
            new = vals[at : at + old.size].reshape(old.shape)
            at += old.size
            if isinstance(k, int):
                self.conv[k] = new
            else:
                setattr(self, k, new if old.ndim else float(new))

    def pool_parts(self, rows, cut, most: int = 1 << 16, ids=None):
        """_pool() by products of distinct words, `most` words at a time; with `ids` the rows are of distinct words."""
        ids = np.arange(len(rows)) if ids is None else ids
        filters = self._filters()
        n, every = len(cut) - 1, np.arange(len(WIDTHS) * FILTERS)
        best, at = np.full((n, len(every)), -np.inf), np.full((n, len(every)), -1)
        for lo in range(0, len(ids), most):
            hi = min(len(ids), lo + most)
            some, near = compact(ids[lo : hi + max(WIDTHS) - 1], len(rows))
            out = windows(filters @ sums(self.emb, rows[some]).astype(np.float32).T, near, cut[1:] - lo, hi - lo)
            a, b = int(np.searchsorted(cut, lo, side="right")) - 1, int(np.searchsorted(cut, hi))
            begin, stop = np.clip(cut[a:b], lo, hi) - lo, np.clip(cut[a + 1 : b + 1], lo, hi) - lo
            full = np.flatnonzero(begin < stop)
            if not len(full):
                continue
            top = np.array([out[:, x:y].argmax(axis=1) for x, y in zip(begin[full].tolist(), stop[full].tolist(), strict=True)]) + begin[full, None]
            val, i = out[every, top], a + full
            more = val > best[i]
            best[i] = np.where(more, val, best[i])
            at[i] = np.where(more, lo + top, at[i])
        return np.where(at >= 0, best, 0), at

    def _pool(self, rows, cut):
        """Maxima over each text of every filter, and the words where they start (-1: a text without words)."""
        n = len(cut) - 1
        best = np.zeros((n, len(WIDTHS) * FILTERS))
        at = np.full(best.shape, -1)
        some = np.flatnonzero(np.diff(cut) > 0)
        for k, w in enumerate(WIDTHS):
            out = np.zeros((len(rows), FILTERS))
            for j in range(w):
                v = (self.emb @ self.conv[k][j])[rows[j:]].sum(axis=1)
                if j:
                    last = np.zeros(len(rows), bool)
                    for q in range(1, j + 1):
                        e = cut[1:] - q
                        last[e[e >= 0]] = True
                    v = np.where(last[: len(v), None], 0, v)
                out[: len(v)] += v
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            for i in some:
                part = out[cut[i] : cut[i + 1]]
                a = part.argmax(axis=0)
                best[i, cols] = part[a, np.arange(FILTERS)]
                at[i, cols] = cut[i] + a
        return best, at

    def _languages(self, rows, doc, langs, fit):
        self.langs = sorted({x or "" for x in langs})
        code = np.array([self.langs.index(x or "") for x in langs])
        ok = fit[doc]
        count = np.zeros((len(self.emb), len(self.langs)))
        for part in range(PARTS):
            for c in range(len(self.langs)):
                count[:, c] += np.bincount(rows[ok & (code[doc] == c), part], minlength=len(count))
        self._say(count)

    def _say(self, count):
        """Words' log probabilities by language, from counts of (row, language)."""
        self.say = np.log((count + 0.5) / (count.sum(axis=0) + 0.5 * len(count)))
        self.say[0] = 0

    def _finish(self):
        """Embeddings and the language table side by side, and the filters."""
        self.table = np.hstack([self.emb, self.say]).astype(np.float32)
        self.filters = self._filters()

    def _filters(self):
        return np.hstack([self.conv[k][j] for k, w in enumerate(WIDTHS) for j in range(w)]).T.astype(np.float32)

    def pools(self, rows: np.ndarray, first: np.ndarray, more: bool = False, skip: int = 0, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: maxima of the filters, and language scores. With `more` the (one) text goes on, so that windows over its
        end don't count; its first `skip` words have had their language scores counted. With `ids` the rows are of distinct words."""
        ids = np.arange(len(rows)) if ids is None else ids
        n = len(first) - 1
        best = np.zeros((n, len(WIDTHS) * FILTERS))
        say = np.zeros((n, len(self.langs)))
        some = np.flatnonzero(np.diff(first) > 0)
        if len(some):
            own, start = sums(self.table, rows), first[:-1][some]
            got = self.filters @ own[:, :DIM].T
            for k, w in enumerate(WIDTHS):
                out = windows(got, ids, first[1:-1] if more else first[1:], len(ids), [k])
                if more:
                    out = out[:, : len(ids) - w + 1]
                best[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(out, start, axis=1).T
            if skip < len(ids):
                say[some] = np.add.reduceat(np.ascontiguousarray(own[:, DIM:].T).take(ids[skip:], axis=1), start, axis=1, dtype=np.float64).T
        return best, say

    def finish(self, best: np.ndarray, say: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.maximum(best + self.bias, 0)
        return z @ self.top + self.free, say.argmax(axis=1)

    def logits(self, rows: np.ndarray, first: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: logit, and number of its language."""
        return self.finish(*self.pools(rows, first, ids=ids))

    def long_logits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """logits() of one long text, in parts that share as many words as a window has beside its first."""
        over = max(WIDTHS) - 1
        best, say, end = np.full((1, len(WIDTHS) * FILTERS), -np.inf), np.zeros((1, len(self.langs))), 0
        held = None  # a part is pooled when it is known whether the text goes on

        def pool(rows, ids, number, more):
            nonlocal say, end
            b, one = self.pools(rows, np.array([0, len(ids)]), more, max(0, end - number), ids)
            if len(ids):
                np.maximum(best, b, out=best)
                say += one
                end = number + len(ids)

        for number, d, s, e in word_pieces(data, ANYCASE, over, SCORE_BYTES):
            if held is not None:
                pool(*held, True)
            word, ids = word_ids(LOWER[d], s, e)
            held = self.row[word], ids, number
        pool(*held, False)
        return self.finish(np.where(np.isfinite(best), best, 0), say)

    def _calibrate(self, logit, lang, y, hold, n=None):
        """Thresholds from logits, languages and labels of the held texts; n: how many there are of each row."""
        times = np.ones(len(y)) if n is None else n

        def best(z, t, n):
            cuts = np.unique(z)
            cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
            bad, fine = n[t == 1].sum(), n[t == 0].sum()
            o = np.argsort(z, kind="stable")
            under = np.searchsorted(z[o], cuts, side="right")
            low1, low0 = (np.concatenate([[0], np.cumsum((n * (t == x))[o])])[under] for x in (1, 0))
            rate = (bad - low1) / max(1, bad) + CLEAN * low0 / max(1, fine)
            top = np.flatnonzero(np.array(rate) >= max(rate) - 1e-12)
            return float(cuts[top[len(top) // 2]])

        whole = best(logit[hold], y[hold], times[hold]) if hold.any() and 0 < y[hold].mean() < 1 else 0.0
        self.cut = np.full(len(self.langs), whole)
        for c in range(len(self.langs)):
            own = hold & (lang == c)
            least = min(int(times[own & (y == 1)].sum()), int(times[own & (y == 0)].sum()))
            if least >= 10:
                self.cut[c] = (least * best(logit[own], y[own], times[own]) + 50 * whole) / (least + 50)

    def raw(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """logits() of texts, whatever their length."""
        if len(offs) == 2 and len(data) > SCORE_BYTES:
            return self.long_logits(data)
        word, ids, first = distinct(data, offs)
        return self.logits(self.row[word], first, ids)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        logit, lang = self.raw(data, offs)
        return 1 / (1 + np.exp(-np.clip(logit - self.cut[lang], -30, 30)))

    def shrink(self) -> Model:
        """What scoring needs."""
        for k in ("emb", "conv", "say"):
            delattr(self, k)
        return self


def learned(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, x: lang, text, toxic) of every labelled id to learn from."""
    marked = labels.where(learn & F.col("toxic").isin(0, 1))
    src = docs.select("doc_id", F.col("lang") if "lang" in docs.columns else F.lit("").alias("lang"), "text").where(F.col("text").isNotNull())
    marks = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return _likely(src, marked).join(marks, "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text", "toxic")).alias("x"))


def _likely(src: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of src with an id of `marked`, and a few of the others (by a broadcast bitmap of hashes), so that few texts without a label
    are shuffled. All rows where equal ids may have different hashes."""
    kind = src.schema["doc_id"].dataType
    if kind != marked.schema["doc_id"].dataType or not (isinstance(kind, IntegralType) or kind == StringType()):
        return src
    bits = 1 << min(MAP_BITS, max(15, (16 * marked.count()).bit_length()))
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(bits - 1))
    there = marked.select(F.shiftright(place, 15).alias("__block"), place.bitwiseAND(F.lit(32767)).alias("__at"))
    there = there.groupBy("__block").agg(F.bitmap_construct_agg("__at").alias("__map"))
    near = src.withColumn("__block", F.shiftright(place, 15)).withColumn("__at", place.bitwiseAND(F.lit(32767)).cast("int")).join(F.broadcast(there), "__block")
    return near.where("shiftright(cast(conv(hex(substring(__map, shiftright(__at, 3) + 1, 1)), 16, 10) as int), __at & 7) & 1 = 1").select(src.columns)


def _local(rows: DataFrame) -> list[tuple[str, int, str]]:
    return [(r[1][1], r[1][2], r[1][0]) for r in sorted(rows.collect(), key=lambda r: str(r[0]))]


def sample(docs: DataFrame, labels: DataFrame, learn: Column) -> list[tuple[str, int, str]]:
    """All (text, label, lang) to learn from, for tables that fit the driver."""
    return _local(learned(docs, labels, learn))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model | None:
    with swept(docs.sparkSession):
        rows = materialize(learned(docs, labels, F.lit(True) if learn is None else learn))
        n, size, low, high = rows.agg(F.count("*"), F.sum(F.octet_length("x.text")), F.min("x.toxic"), F.max("x.toxic")).first()
        if not n or low == high:
            return None
        if n <= LOCAL_ROWS and size <= LOCAL_BYTES:
            texts, y, langs = zip(*_local(rows), strict=True)
            return Model(list(texts), list(y), list(langs)).shrink()
        return _fit_parts(rows, n)


def _fit_parts(rows: DataFrame, n: int) -> Model:
    """The model of rows that stay in the cluster; what comes to the driver is bounded by the buckets, languages and bins."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    hold = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(4)) == 0
    rows = rows.select(hold.alias("hold"), F.coalesce("x.lang", F.lit("")).alias("lang"), F.col("x.toxic").cast("int").alias("toxic"), F.col("x.text").alias("text"))
    tongues = rows.where("hold").groupBy("lang").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a >= 10 and b >= 10")
    langs = [r[0] for r in tongues.orderBy("lang").select("lang").collect()]
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in enumerate(langs) for x in (v, k))), F.col("lang")), F.lit(len(langs))) if langs else F.lit(0)
    rows = rows.select("hold", code.cast("int").alias("lang"), "toxic", "text")
    train = rows.where("not hold")
    if train.rdd.getNumPartitions() > MOST_PARTS:
        train = train.coalesce(MOST_PARTS)
    parts = train.rdd.getNumPartitions()
    one = train.agg(F.count("*"), F.sum("toxic")).first()
    m = Model.__new__(Model)
    m.langs = [*langs, None]
    sums = [f"l{c}" for c in range(len(m.langs))]
    counted = materialize(train.mapInArrow(_count(len(m.langs)), f"bucket int, n long, n1 long, {', '.join(f'{c} long' for c in sums)}").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n", "n1", *sums))))
    got = counted.where(F.col("n") >= MIN_DOCS).toPandas().sort_values("bucket")
    total = counted.agg(*(F.sum(c) for c in sums)).first()
    m._start(got["bucket"].to_numpy(), got["n"].to_numpy(), got["n1"].to_numpy(), float(one[1] or 0), float(one[0] - (one[1] or 0)), np.random.default_rng(SEED))
    count = np.vstack([np.zeros(len(sums)), got[sums].to_numpy(np.float64)])
    count[0] = np.array([float(x or 0) for x in total]) - count.sum(axis=0)
    m._say(count)
    batch = max(64, -(-one[0] // (max(1, parts) * STEPS)))
    for _ in range(EPOCHS):
        bc = sc.broadcast(m)
        copies = train.mapInArrow(_epoch(bc, batch), "block int, part int, weight long, vals binary")
        mean = copies.groupBy("block").applyInPandas(_mean, "block int, vals binary").collect()
        if mean:
            m.unpack(np.concatenate([np.frombuffer(r[1], np.float32) for r in sorted(mean)]).astype(np.float64))
        bc.destroy()
        del copies
        release(spark)
    m._finish()
    bc = sc.broadcast(m)
    seen = rows.where("hold").mapInArrow(_bins(bc), "lang int, toxic int, bin int, n long").groupBy("lang", "toxic", "bin").agg(F.sum("n")).collect()
    at = np.array(sorted(tuple(r) for r in seen), np.float64).reshape(-1, 4)
    m._calibrate((at[:, 2] + 0.5) / BINS, at[:, 0].astype(int), at[:, 1], np.ones(len(at), bool), at[:, 3])
    return m.shrink()


def _texts(batch: pa.RecordBatch):
    """(first row, end, buckets of distinct words, numbers of all words among these, first words) of parts of a batch; a long text is
    hashed in pieces, each with distinct words of its own."""
    data, offs = utf8(text_column(batch, "text"))
    for i, j in chunks(offs, SCORE_BYTES):
        own, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        if j == i + 1 and len(own) > SCORE_BYTES:
            got = [word_ids(LOWER[d], s, e) for _, d, s, e in word_pieces(own, ANYCASE, 0, SCORE_BYTES)]
            before = np.cumsum([0, *(len(word) for word, _ in got)])
            ids = np.concatenate([x + k for (_, x), k in zip(got, before[:-1], strict=True)])
            yield i, j, np.concatenate([word for word, _ in got]), ids, np.array([0, len(ids)])
        else:
            yield i, j, *distinct(own, at)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _count(langs: int):
    """Texts, toxic texts and words by language of every bucket."""

    def run(batches):
        sums = np.zeros((2 + langs, 1 << BITS), np.int64)
        for batch in batches:
            y, lang = _column(batch, "toxic"), _column(batch, "lang")
            for i, j, word, ids, first in _texts(batch):
                for k in range(i, j):
                    all_ = word[ids[first[k - i] : first[k - i + 1]]].ravel()
                    own, times = np.unique(all_, return_counts=True)
                    sums[0, own] += 1
                    sums[1, own] += y[k]
                    sums[2 + lang[k], own] += times
        some = np.flatnonzero(sums[0])
        for at in range(0, len(some), 1 << 16):
            own = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(x[own]) for x in sums)], ["bucket", "n", "n1", *(f"l{c}" for c in range(langs))])

    return run


BLOCK = 1 << 16


def _epoch(bc, batch: int):
    """One pass over a part's rows from the common start; the copy's numbers in blocks."""

    def run(batches):
        m = bc.value.copied()
        state, g, held, seen = m.moments(), None, 0, 0
        for b in batches:
            y = _column(b, "toxic").astype(np.float64)
            for i, j, word, ids, first in _texts(b):
                rows = m.row[word]
                for k in range(0, j - i, batch):  # a step never has more than twice the rows
                    e = min(j - i, k + batch)
                    some, near = compact(ids[first[k] : first[e]], len(rows))
                    own, cut = rows[some], first[k : e + 1] - first[k]
                    g = m.gradient(own, cut, y[i + k : i + e], *m.pool_parts(own, cut, ids=near), near, g)
                    held += e - k
                    seen += e - k
                    if held >= batch:
                        m.adam(g, state, held)
                        g, held = {"emb": g["emb"]}, 0
        if held:
            m.adam(g, state, held)
        if seen:
            vals, part = m.pack().astype(np.float32), TaskContext.get().partitionId()
            for at in range(0, len(vals), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array([seen]), pa.array([vals[at : at + BLOCK].tobytes()], pa.binary())], ["block", "part", "weight", "vals"])

    return run


def _mean(copies):
    copies = copies.sort_values("part")
    total = sum(np.frombuffer(v, np.float32) * np.float64(w) for v, w in zip(copies["vals"], copies["weight"], strict=True))
    return copies.head(1)[["block"]].assign(vals=[(total / copies["weight"].sum()).astype(np.float32).tobytes()])


def _bins(bc):
    """Logits of held rows, counted in bins."""

    def run(batches):
        m, seen = bc.value, Counter()
        for batch in batches:
            data, offs = utf8(text_column(batch, "text"))
            y = _column(batch, "toxic")
            for i, j in chunks(offs, SCORE_BYTES):
                z, lang = m.raw(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                at = np.floor(np.clip(z, -1000, 1000) * BINS).astype(int)
                seen.update(zip(lang.tolist(), y[i:j].tolist(), at.tolist(), strict=True))
        if seen:
            rows = [(*k, n) for k, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 3 else pa.int32()) for k in range(4)], ["lang", "toxic", "bin", "n"])

    return run


def _score(bc, keep: list[str]):
    def run(batches):
        m = bc.value
        for batch in batches:
            data, offs = utf8(text_column(batch, "text"))
            score = np.zeros(batch.num_rows)
            for i, j in chunks(offs, SCORE_BYTES):
                if m is not None:
                    score[i:j] = m.scores(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, unless named) with score and predicted, which replace columns of these names."""
    keep = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    src = docs.select(*dict.fromkeys([*keep, "text"]))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keep)
    return src.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), keep), f"{ddl}, score double, predicted int")
