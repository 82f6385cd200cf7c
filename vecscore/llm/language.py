"""Language identification with a string kernel.

Two texts' blended-spectrum presence kernel is the number of byte n-grams (1 to 4, of the lower-cased UTF-8,
from a vocabulary) that both have, divided by the root of the product of their own numbers. A sample gives
Nyström landmarks Z: with K their kernel matrix, a text's features are k(x, Z) K**-1/2, and one-versus-rest
kernel ridge regression on the sample gives a weight vector for each language. Scoring is then two matrix
products for a batch: presence by landmarks, kernel values by K**-1/2 times weights.

The model is fitted on a bounded sample: of each language at most `per_lang` rows, and of all together at most
`SAMPLE` (an equal share for each; beyond `LANGS` languages those with the most ids, equal ones by name, and the
others are never predicted), texts of up to `fit_bytes` bytes, those with the least hashes of their ids. Every
language learned has a landmark. The vocabulary are the `vocab` n-grams that most sample texts have, equal ones by
slot. Every text is scored whole: presence matrices are made for as many rows as fit `ROWS` at a time, and a long text
is taken in parts of `PART` bytes that share the three bytes an n-gram can lie over.

Null texts and texts without a letter are `und` with score 0. Rows are scored by their text alone, so repeated rows are
scored alike, and of equal scores the first language by name is taken. An id repeated with several texts or languages
is learned from once, with the least language and then the least text; a null id is never learned from. If no row can be
learned from, every text is `und`; an empty table gives an empty result. Other columns of the input, whatever their
names, aren't in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, chunks, text_column, utf8

PER_LANG = 300
SAMPLE = 4800
LANGS = 512
FIT_BYTES = 1 << 14
VOCAB = 8192
LANDMARKS = 128
RIDGE = 1e-2
ROWS = 256
PART = 1 << 21
SIZES = (1, 2, 3, 4)
_BITS = 20
SHARPNESS = 4.0


def crc_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % parts


def _slots(d: np.ndarray, n: int) -> np.ndarray:
    """Slot of the n-gram from every position (the last n - 1 have none)."""
    m = len(d) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    code = np.full(m, n, np.uint64)
    for j in range(n):
        code = (code << np.uint64(8)) | d[j : j + m]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def presence(d: np.ndarray, offs: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """rows by width: 1 where a text has an n-gram; table maps slots to columns (-1: none). d is lower-cased."""
    rows = len(offs) - 1
    x = np.zeros(rows * width + 1, np.float32)  # the last cell takes what isn't in the vocabulary
    base = np.repeat(np.arange(rows, dtype=np.int64) * width, np.diff(offs))
    for n in SIZES:
        col = table[_slots(d, n)]
        cell = base[: len(col)] + col
        ok = col >= 0
        if n > 1:
            for j in range(1, n):  # n-grams over a text's end
                ok[np.maximum(offs[1:-1] - j, 0)[(offs[1:-1] - j >= 0) & (offs[1:-1] - j < len(ok))]] = False
        x[np.where(ok, cell, rows * width)] = 1
    return x[:-1].reshape(rows, width)


def long_parts(d: np.ndarray):
    """Parts of one text that share what an n-gram can lie over, lower-cased."""
    over = max(SIZES) - 1
    for at in range(0, max(1, len(d) - over), PART):
        yield LOWER[d[at : at + PART + over]]


def _pieces(data: np.ndarray, offs: np.ndarray):
    """Row ranges of bounded rows and bytes (but a long text stands alone)."""
    for i, j in chunks(offs, PART):
        for a in range(i, j, ROWS):
            b = min(j, a + ROWS)
            yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def traits(d: np.ndarray, offs: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """presence() of texts as they are, a long one by parts."""
    if len(offs) > 2 or len(d) <= PART:
        return presence(LOWER[d], offs, table, width)
    x = np.zeros((1, width), np.float32)
    for part in long_parts(d):
        np.maximum(x, presence(part, np.array([0, len(part)]), table, width), out=x)
    return x


class Model:
    """Languages, n-gram columns, landmark presence and the weights on kernel values."""

    def __init__(self, texts: list[str], langs: list[str], vocab: int = VOCAB, landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        landmarks = max(landmarks, len(self.langs))
        col = pa.array(texts, pa.large_string())
        data, offs = utf8(col)
        seen = np.zeros(1 << _BITS, np.int64)
        for i in range(len(texts)):
            d = LOWER[data[offs[i] : offs[i + 1]]]
            seen[np.unique(np.concatenate([_slots(d, n) for n in SIZES]))] += 1
        top = np.lexsort((np.arange(len(seen)), -seen))[:vocab]
        top = np.sort(top[seen[top] > 0])
        self.width = len(top)
        self.table = np.full(1 << _BITS, -1, np.int32)
        self.table[top] = np.arange(len(top))
        x = np.concatenate([traits(d, o, self.table, self.width) for _, _, d, o in _pieces(data, offs)])
        y = np.array([self.langs.index(v) for v in langs])
        turn = np.zeros(len(y), np.int64)  # landmarks: the languages in turn
        for c in range(len(self.langs)):
            turn[y == c] = np.arange((y == c).sum())
        z = np.lexsort((y, turn))[:landmarks]
        self.z = np.ascontiguousarray(x[z].T)
        self.z_norm = np.sqrt(np.maximum(self.z.sum(axis=0), 1))
        k = self.kernel(x)
        val, vec = np.linalg.eigh(k[z])
        keep = val > 1e-6 * val[-1]
        root = vec[:, keep] / np.sqrt(val[keep])
        f = np.hstack([k @ root, np.ones((len(y), 1))])
        goal = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weight = (1 / np.bincount(y))[y] * len(y) / len(self.langs)  # languages count alike
        a = (f * weight[:, None]).T @ f + ridge * len(y) * np.eye(f.shape[1])
        w = np.linalg.solve(a, (f * weight[:, None]).T @ goal)
        self.w, self.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.z) / (np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * self.z_norm)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language, and its share of the exponentiated scores."""
        s = SHARPNESS * (self.kernel(x) @ self.w + self.bias)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def has_letter(d: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; looked at in parts of PART bytes that cut no character."""
    out = np.zeros(len(offs) - 1, bool)
    for r in range(len(out)):
        at, end = int(offs[r]), int(offs[r + 1])
        while at < end and not out[r]:
            to = min(end, at + PART)
            while to < end and d[to] & 0xC0 == 0x80:
                to -= 1
            part = d[at:to]
            low = part | 0x20
            out[r] = bool(((low >= 97) & (low <= 122) & (part < 128)).any()) or part.max() > 127 and any(c.isalpha() for c in part.tobytes().decode())
            at = to
    return out


def least(rows: DataFrame, by: str, most: int | Column, seed: int) -> DataFrame:
    """Of each group of (doc_id, by) the `most` ids of least hash, each once. Groups' ids are counted and thinned by another hash to
    about four times as many before they are ranked, so that the ranking doesn't grow with the input; rows that repeat an id
    meet before the ranking, in partial aggregates."""
    most = most if isinstance(most, Column) else F.lit(most)
    n = rows.groupBy(by).agg(F.approx_count_distinct("doc_id", 0.02).alias("__n"))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / (4 * most)))
    thin = rows.join(F.broadcast(n), by).where(F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), step) == 0).select("doc_id", by).distinct()
    order = Window.partitionBy(by).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    return thin.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).select("doc_id", by)


def sample(docs: DataFrame, learn: Column, per_lang: int = PER_LANG, fit_bytes: int = FIT_BYTES) -> tuple[list[str], list[str]]:
    """Texts and languages of the rows to learn from: languages first, then ids, by a window over ids alone, then their texts."""
    src = docs.select("doc_id", "lang", "text").where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= fit_bytes))
    names = [r[0] for r in src.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()]
    if not names:
        return [], []
    ids = least(src.where(F.col("lang").isin(names)).select("doc_id", "lang"), "lang", min(per_lang, max(1, SAMPLE // len(names))), 5)
    rows = src.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).collect()  # SAMPLE rows at most
    rows.sort(key=lambda r: str(r[0]))
    return [r[1][1] for r in rows], [r[1][0] for r in rows]


def _score(bc):
    def run(batches):
        m = bc.value
        for batch in batches:
            data, offs = utf8(text_column(batch, "text"))
            lang = np.full(batch.num_rows, "und", object)
            score = np.zeros(batch.num_rows)
            for a, b, d, o in _pieces(data, offs):
                ok = has_letter(d, o)
                if m is not None and ok.any():
                    best, p = m.decide(traits(d, o, m.table, m.width))
                    lang[a:b][ok] = np.array(m.langs, object)[best[ok]]
                    score[a:b][ok] = p[ok]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, parts: int = 4, held: int = 2, per_lang: int = PER_LANG) -> DataFrame:
    """One row for each of docs: doc_id, held_out (not learned from), lang_pred, score."""
    out_part = crc_part(F.col("doc_id"), parts) == held
    texts, langs = sample(docs, ~F.coalesce(out_part, F.lit(True)), per_lang)
    model = Model(texts, langs) if len(set(langs)) > 0 else None
    bc = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", F.coalesce(out_part, F.lit(False)).alias("held_out"), "text")
    return src.mapInArrow(_score(bc), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
