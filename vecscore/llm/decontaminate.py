"""Benchmark decontamination: prefix-filtered set join of documents and benchmark windows.

A window is `width` consecutive words of an item (all its words, if it has fewer). A window's
set is its word 3-grams (all its words as one gram, where it has fewer than three). A document
contains a window only if it contains all its grams, so the overlap needed is the whole set and
the necessary prefix is one gram: the rarest, by its count over all documents. Documents' grams
are joined with these prefixes only; an occurrence fixes where the window would have to start
(positional bound) and end (length bound), and what is left is verified word by word.

Two passes over the documents: one counts the benchmark's grams, one joins. The benchmark is
used in blocks of at most `block_bytes` of text: a block is what is broadcast, so its size is
bounded whatever the benchmark's size. With more blocks there are more passes; each gives the hits of texts that have any by
the text's digest (128-bit BLAKE2b), and what all blocks found in a text is joined to the rows that have it. No row is
told by its id, so repeated and null ids change nothing: every row of docs is in the result once.

Nulls and empty texts have no words: no hits. An empty table gives an empty table; an empty benchmark hits nothing. Items without words match
nothing. Repeated item rows count as one item; the windows of an item without id hit, but it isn't listed. A document word that several windows
cover counts once. Several rarest grams: the leftmost is the prefix. A text of over 2 MiB is taken in parts that share a window's
words less one, so a worker holds a part's words. Kept columns may have any names but those of the result, which replaces them.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, ANYCASE, CHUNK_BYTES, LOWER, chunks, gram_starts, materialize, ngram_hash, span_hash, text_column, utf8, word_pieces, word_spans

GRAM = 3
BLOCK_BYTES = 2 << 20
RESULT = "n_words bigint, hits array<struct<s:int,e:int>>, items array<string>"
_BITS = 20


def _words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    s, e, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def _hashes(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return span_hash(raw, ends - np.array([len(w) for w in words]), ends)


class Windows:
    """Distinct windows of a block of items: words, items, grams."""

    def __init__(self, items: list[tuple], width: int):
        of: dict[tuple, set[str]] = {}
        for item, text in items:
            w = _words(text)
            if w:
                for i in range(max(1, len(w) - width + 1)):
                    named = of.setdefault(tuple(w[i : i + width]), set())
                    if item is not None:
                        named.add(str(item))
        self.words = list(of)
        self.items = [sorted(v) for v in of.values()]
        self.grams = []
        for w in self.words:
            self.grams.append(ngram_hash(_hashes(list(w)), min(GRAM, len(w))))
        self.sizes = sorted({min(GRAM, len(w)) for w in self.words})


def _bitmap(keys: np.ndarray) -> np.ndarray:
    t = np.zeros(1 << _BITS, np.bool_)
    t[keys >> np.uint64(64 - _BITS)] = True
    return t


def _find(h: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of h that are in the sorted keys, and where."""
    at = np.flatnonzero(bits[h >> np.uint64(64 - _BITS)])
    k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    ok = keys[k] == h[at]
    return at[ok], k[ok]


def _chunk_words(batch: pa.RecordBatch, name: str, overlap: int):
    """(first row, number of its first word, bytes, starts, ends, first word of each row, word hashes) of parts of bounded bytes; a long text comes
    in parts that share `overlap` words."""
    data, offs = utf8(text_column(batch, name))
    for i, j in chunks(offs):
        if j == i + 1 and offs[j] - offs[i] > CHUNK_BYTES:
            for number, d, s, e in word_pieces(data[offs[i] : offs[j]], ANYCASE, overlap):
                d = LOWER[d]
                yield i, number, d, s, e, np.array([0, len(s)]), span_hash(d, s, e)
        else:
            d, o = LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
            s, e, first = word_spans(d, o, ALNUM)
            yield i, 0, d, s, e, first, span_hash(d, s, e)


def _count_grams(text: str, bc):
    def run(batches):
        keys, sizes = bc.value
        bits, total = _bitmap(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, number, _, _, _, first, wh in _chunk_words(batch, text, GRAM - 1):
                for n in sizes:
                    at = gram_starts(first, n)
                    if number:  # grams within the shared words are counted already
                        at = at[at >= GRAM - n]
                    _, k = _find(ngram_hash(wh, n)[at], keys, bits)
                    total += np.bincount(k, minlength=len(keys))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["k", "n"])

    return run


def _join(text: str, keep: list[str], bc, sparse: bool = False):
    """Rows with n_words, hits and items; sparse: (key, hits, items) of texts that have hits, key being the digest of the text."""

    def run(batches):
        keys, by_key, words, whole, lengths, sizes, items = bc.value
        joined = [b" ".join(w) for w in words]
        bits = _bitmap(keys)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in by_key])])
        win = np.array([w for x in by_key for w, _ in x], np.int64)
        off = np.array([o for x in by_key for _, o in x], np.int64)
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            hits: list = [[] for _ in range(batch.num_rows)]
            found: list = [[] for _ in range(batch.num_rows)]
            for i, number, d, s, e, first, wh in _chunk_words(batch, text, max([*lengths, 1]) - 1):
                n_words[i : i + len(first) - 1] = number + np.diff(first)
                doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                cand_p, cand_w = [], []
                for n in sizes:
                    at = gram_starts(first, n)
                    p, k = _find(ngram_hash(wh, n)[at], keys, bits)
                    many = starts[k + 1] - starts[k]
                    x = np.repeat(starts[k] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    cand_p.append(np.repeat(at[p], many) - off[x])
                    cand_w.append(win[x])
                p, w = np.concatenate(cand_p), np.concatenate(cand_w)
                ok = (p >= 0) & (p + lengths[w] <= len(wh))  # positional and length bounds, within the chunk
                p, w = p[ok], w[ok]
                ok = doc_of[p] == doc_of[p + lengths[w] - 1]  # and within the document
                p, w = p[ok], w[ok]
                for n in np.unique(lengths[w]):
                    m = lengths[w] == n
                    h = np.zeros(m.sum(), np.uint64)
                    for j in range(n):
                        h = h * np.uint64(0x9FB21C651E98DF25) + wh[p[m] + j]
                    same = h == whole[w[m]]
                    pm, wm = p[m][same], w[m][same]
                    raw = d.tobytes() if len(pm) else b""
                    for a, b in dict.fromkeys(zip(pm.tolist(), wm.tolist(), strict=True)):
                        if b" ".join(raw[s[q] : e[q]] for q in range(a, a + n)) == joined[b]:
                            r = int(doc_of[a])
                            at = number + a - int(first[r])
                            hits[i + r].append((at, at + int(n)))
                            found[i + r] += items[b]
            merged = []
            for x in hits:
                y: list = []
                for a, b in sorted(x):
                    if y and a <= y[-1]["e"]:
                        y[-1]["e"] = max(b, y[-1]["e"])
                    else:
                        y.append({"s": a, "e": b})
                merged.append(y)
            spans = pa.array(merged, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
            items_ = pa.array([sorted(set(x)) for x in found], pa.list_(pa.string()))
            if sparse:
                rows = np.flatnonzero([bool(x) for x in merged])
                keys_ = pa.array(_digests(batch, text, rows), pa.binary())
                yield pa.RecordBatch.from_arrays([keys_, spans.take(pa.array(rows)), items_.take(pa.array(rows))], ["key", "hits", "items"])
            else:
                out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*out, pa.array(n_words), spans, items_], [*keep, "n_words", "hits", "items"])

    return run


def _digests(batch: pa.RecordBatch, text: str, rows) -> list[bytes]:
    data, offs = utf8(text_column(batch, text))
    return [hashlib.blake2b(data[offs[r] : offs[r + 1]], digest_size=16).digest() for r in rows]


def _word_counts(text: str, keep: list[str]):
    def run(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for i, number, _, _, _, first, _ in _chunk_words(batch, text, 0):
                n[i : i + len(first) - 1] = number + np.diff(first)
            out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n), pa.array(_digests(batch, text, range(batch.num_rows)), pa.binary())], [*keep, "n_words", "__key"])

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    block, size = [], 0
    for r in benchmark.select(F.col(item).cast("string"), text).toLocalIterator():
        if block and size + len(r[1] or "") > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1] or "")
    yield block


def _prepare(narrow: DataFrame, text: str, block: list[tuple], width: int):
    """The block's windows with their prefixes, broadcast: the rarest gram of each, by counts over all documents."""
    sc = narrow.sparkSession.sparkContext
    win = Windows(block, width)
    if not win.words:
        return sc.broadcast((np.zeros(1, np.uint64), [[]], [], np.zeros(0, np.uint64), np.zeros(0, np.int64), [1], []))
    keys = np.unique(np.concatenate(win.grams))
    count = np.zeros(len(keys), np.int64)
    got = narrow.mapInArrow(_count_grams(text, sc.broadcast((keys, win.sizes))), "k int, n bigint")
    for k, n in got.groupBy("k").agg(F.sum("n")).collect():  # one row for each gram of the block at most
        count[k] = n
    by: dict[int, list] = {}
    for w, grams in enumerate(win.grams):
        k = np.searchsorted(keys, grams)
        rarest = min(range(len(k)), key=lambda x: (count[k[x]], x))
        by.setdefault(int(k[rarest]), []).append((w, rarest))
    prefix = sorted(by)
    whole = np.zeros(len(win.words), np.uint64)
    for w, words in enumerate(win.words):
        for h in _hashes(list(words)):
            whole[w : w + 1] = whole[w : w + 1] * np.uint64(0x9FB21C651E98DF25) + h
    return sc.broadcast((keys[prefix], [by[k] for k in prefix], win.words, whole, np.array([len(w) for w in win.words]), win.sizes, win.items))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns (doc_id at least) with n_words, hits (merged word ranges), items (ids, sorted as
    strings), n_hit, n_items, contaminated. See the module's text for the method and the odd cases."""
    more = ["n_words", "hits", "items", "n_hit", "n_items", "contaminated"]
    keep = [c for c in (keep or [doc_id]) if c not in more]
    keep = keep if doc_id in keep else [doc_id, *keep]
    narrow = docs.select(text)
    wide = docs.select(*dict.fromkeys([*keep, text]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.select(*keep).schema.fields), RESULT])
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    first, second = next(blocks), next(blocks, None)
    parts: list[DataFrame] = []
    for block in chain([first], [] if second is None else [second], blocks):
        bc = _prepare(narrow, text, block, width)
        if second is None:
            parts.append(wide.mapInArrow(_join(text, keep, bc), schema))
        else:
            parts.append(narrow.mapInArrow(_join(text, [], bc, True), "key binary, hits array<struct<s:int,e:int>>, items array<string>").groupBy("key").agg(F.first("hits").alias("hits"), F.first("items").alias("items")))
    out = parts[0]
    if second is not None:  # what a text contains is joined to the rows that have it; a table of its own, so that the join may split a text that many rows have
        found = functools.reduce(DataFrame.unionAll, parts).groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = materialize(found.withColumnRenamed("key", "__key"))
        counted = wide.mapInArrow(_word_counts(text, keep), schema.replace(RESULT, "n_words bigint, __key binary"))
        none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
        out = counted.join(found, "__key", "left").select(*keep, "n_words", none("hits", "array<struct<s:int,e:int>>"), none("items", "array<string>"))
    covered = F.aggregate(
        F.array_sort("hits"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")),
    )["n"].cast("bigint")
    return out.withColumn("n_hit", covered).withColumn("n_items", F.size("items").cast("bigint")).withColumn("contaminated", F.col("n_hit") > 0)
