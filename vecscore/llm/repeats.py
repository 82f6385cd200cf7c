"""Suffix-array dedup: every byte that a 200-byte string covers which starts elsewhere too is cut.

Texts are judged as UTF-8 bytes; matches never cross texts. Suffixes are dealt so that any two that share
their first `length` bytes meet in one block: a window's bucket is the hash of its minimal 32-byte gram
(leftmost among ties), which depends on the window's bytes only. Consecutive windows with one minimum form
a run, and a run's bytes go to its bucket as one segment.

1. A pass over the texts finds the runs and each text's key; equal texts become one class, whose members
   are wholly covered if there are several and they are long enough.
2. Buckets that have one run only are dropped: their windows occur once. Texts with other runs are kept
   with those runs ("hit" texts).
3. Segments are cut from hit texts and equal ones counted. Buckets with over `hot` runs (an often repeated
   passage among many contexts) are dealt again by shorter parts: 16 windows with the hash of the bytes that
   all of them share; parts that still are too many, by single windows. Equal parts meet as counts, so a
   hot passage never meets in one task.
4. Buckets, in blocks of about a MB, are sorted by two-stage suffix sorting; neighbours whose common prefix
   is `length` bytes are repeats, as is all of a segment counted twice.
5. Repeated starts go back to the texts that have the segment and are merged to spans of bytes.

Odd cases: null texts are empty; texts under `length` bytes lose nothing; rows with equal texts (also with
equal ids) are copies of each other, hence cut wholly where long enough. Ids are only passed on, whatever their type. Extra columns are not read. An
empty table gives an empty table. Ties between equal minima go to the leftmost. Very long texts are taken in pieces of half a MB that share the bytes of a window less one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, mix, text_column, utf8
from .suffix_array import adjacent_common, big_endian_words, two_stage

LENGTH = 200
GRAM = 32
HOT = 4096
PART = 16
PIECE = 1 << 19
BLOCK = 1 << 19
_B = 0x9E3779B97F4A7C15
_POS = 24


def gram_hashes(d: np.ndarray) -> np.ndarray:
    """Hash of the GRAM (a power of 2) bytes from each position, made by doubling."""
    h, n = d.astype(np.uint64) + np.uint64(1), 1
    while n < GRAM:
        h = h[:-n] * np.uint64(pow(_B, n, 1 << 64)) + h[n:]
        n *= 2
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def runs(d: np.ndarray, offs: np.ndarray, length: int):
    """(text, first window, last window, minimum's place, bucket) of every run, counted from the text's start."""
    empty = np.zeros(0, np.int64)
    if len(d) < length:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    h = gram_hashes(d)
    low = (h >> np.uint64(_POS) << np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
    m = (sliding_min(low, length - GRAM + 1) & np.uint64((1 << _POS) - 1)).astype(np.int64)
    count = np.maximum(np.diff(offs) - length + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    p = np.repeat(offs[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    at = m[p]
    new = np.ones(len(p), np.bool_)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(p)) - 1
    from_ = offs[text[s]]
    return text[s], p[s] - from_, p[e] - from_, at[s] - from_, h[at[s]]


def _find_runs(length: int):
    def run(batches):
        for batch in batches:
            data, offs = utf8(text_column(batch, "text"))
            n = len(offs) - 1
            many = np.zeros(n, np.int64)
            out = [[], [], [], []]
            for i, j in chunks(offs, PIECE):
                o = offs[i : j + 1]
                if o[-1] - o[0] <= 2 * PIECE:
                    got = [(0, *runs(data[o[0] : o[-1]], o - o[0], length))]
                else:  # one long text: pieces that share length - 1 bytes
                    got = []
                    for a in range(int(o[0]), int(o[-1]) - length + 1, PIECE):
                        z = min(int(o[-1]), a + PIECE + length - 1)
                        got.append((a - int(o[0]), *runs(data[a:z], np.array([0, z - a]), length)))
                for shift, text, p, q, m, h in got:
                    many[i:j] += np.bincount(text, minlength=j - i)
                    for x, y in zip(out, (p + shift, q + shift, m + shift, h.view(np.int64)), strict=True):
                        x.append(y)
            p, q, m, h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            at = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
            cols = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (h, p.astype(np.int32), (q - p + 1).astype(np.int32), (m - p).astype(np.int32))]
            o = offs.tolist()
            keys = [hashlib.blake2b(data[o[r] : o[r + 1]], digest_size=16).digest() for r in range(n)]
            shas = [hashlib.sha256(data[o[r] : o[r + 1]]).hexdigest() for r in range(n)]
            ids = batch.column(batch.schema.get_field_index("id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offs)), pa.array(keys, pa.binary()), pa.array(shas, pa.string()), *cols], ["id", "n_bytes", "key", "sha", "h", "p", "len", "ahead"])

    return run


def _with_key(batches):
    for batch in batches:
        text = text_column(batch, "text")
        data, offs = utf8(text)
        o = offs.tolist()
        keys = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(o, o[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), text.cast(pa.string())], ["key", "text"])


def _segments(length: int, hot: int):
    """Of each hit text, its segments: bytes only where the text has them first."""

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            data, offs = utf8(text_column(batch, "text"))
            o = offs.tolist()
            out: list[list] = [[] for _ in range(7)]
            size = 0
            cut = col["hits"].offsets.to_numpy()
            fields = [col["hits"].values.field(n).to_numpy() for n in ("p", "len", "ahead", "h", "n")]
            for r, (key, copies) in enumerate(zip(col["key"].to_pylist(), col["copies"].to_pylist(), strict=True)):
                seen: set[bytes] = set()
                raw = data[o[r] : o[r + 1]].tobytes()
                for p, m, ahead, bucket, n in zip(*(f[cut[r] : cut[r + 1]].tolist() for f in fields), strict=True):
                    lo, end = p, p + m
                    while lo < end:
                        # parts end where the distance to the minimum is a multiple of PART: the same in every context
                        hi = min(end, lo + (p + ahead - lo) % PART + 1) if n > hot else end
                        seg = raw[lo : hi + length - 1]
                        sid = hashlib.blake2b(seg, digest_size=16).digest()
                        h = bucket
                        if n > hot:  # bytes that all windows of the part have in any context, and which part it is
                            near = (p + ahead - lo) // PART * PART
                            core = raw[p + ahead - near : p + ahead - near - PART + 1 + length]
                            h = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=near.to_bytes(2, "little")).digest(), "little", signed=True)
                        fresh = sid not in seen
                        seen.add(sid)
                        size += len(seg) if fresh else 0
                        for col_out, v in zip(out, (key, lo, h, sid, n > hot, copies, seg if fresh else None), strict=True):
                            col_out.append(v)
                        lo = hi
                if size > 4 << 20:
                    yield _segment_batch(out)
                    out, size = [[] for _ in range(7)], 0
            yield _segment_batch(out)

    return run


_SEG_SCHEMA = "key binary, p int, h bigint, sid binary, hot boolean, copies bigint, seg binary"


def _segment_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["key", "p", "h", "sid", "hot", "copies", "seg"])


def repeated_starts(segs: list[bytes], length: int) -> list[list[int]]:
    """For each segment the starts whose `length` bytes are in another place of the block too."""
    t = np.frombuffer(b"".join(segs), np.uint8)
    size = np.array([len(s) for s in segs])
    begin = np.cumsum(size) - size
    inside = np.arange(len(t)) - np.repeat(begin, size)
    wanted = inside <= np.repeat(size, size) - length
    words = big_endian_words(t)
    order = two_stage(t, wanted, length, words)
    lcp = adjacent_common(order, words, length)
    same = np.zeros(len(order) + 1, np.bool_)
    same[:-1] = lcp >= length
    hit = np.zeros(len(t), np.bool_)
    hit[order[same[:-1] | same[1:]]] = True
    return [np.flatnonzero(hit[b : b + s]).tolist() for b, s in zip(begin.tolist(), size.tolist(), strict=True)]


def _spans(starts: list[int]) -> list[dict]:
    out: list[dict] = []
    for s in starts:
        if out and s == out[-1]["e"]:
            out[-1]["e"] = s + 1
        else:
            out.append({"s": s, "e": s + 1})
    return out


_IV = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _sort_buckets(length: int):
    """Rows sorted by bucket; a bucket is never split."""

    def work(sids, segs, counts):
        ivs = [_spans(x) for x in repeated_starts(segs, length)] if len(segs) > 1 else [[]]
        ivs = [[{"s": 0, "e": len(s) - length + 1}] if c > 1 else iv for s, c, iv in zip(segs, counts, ivs, strict=True)]
        some = [(a, b) for a, b in zip(sids, ivs, strict=True) if b]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in some], pa.binary()), pa.array([b for _, b in some], _IV)], ["sid", "iv"])

    def run(batches):
        sids, segs, counts, size, last = [], [], [], 0, None
        for batch in batches:
            for h, sid, seg, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size > BLOCK and h != last:
                    yield work(sids, segs, counts)
                    sids, segs, counts, size = [], [], [], 0
                sids.append(sid)
                segs.append(seg)
                counts.append(c)
                size += len(seg)
                last = h
        if segs:
            yield work(sids, segs, counts)

    return run


def _digest(length: int):
    def run(batches):
        for batch in batches:
            data, offs = utf8(text_column(batch, "text"))
            raw, o = data.tobytes(), offs.tolist()
            spans, shas = [], []
            for r, iv in enumerate(batch.column(batch.schema.get_field_index("iv")).to_pylist()):
                cut: list[dict] = []
                for a, b in sorted((x["s"], x["e"] + length - 1) for x in iv):
                    if cut and a <= cut[-1]["e"]:
                        cut[-1]["e"] = max(cut[-1]["e"], b)
                    else:
                        cut.append({"s": a, "e": b})
                sha, at = hashlib.sha256(), o[r]
                for x in cut:
                    sha.update(raw[at : o[r] + x["s"]])
                    at = o[r] + x["e"]
                sha.update(raw[at : o[r + 1]])
                spans.append(cut)
                shas.append(sha.hexdigest())
            keys = batch.column(batch.schema.get_field_index("key"))
            yield pa.RecordBatch.from_arrays([keys, pa.array(spans, _IV), pa.array(shas, pa.string())], ["key", "cut", "cut_sha"])

    return run


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row for each of docs: doc_id, n_bytes, spans (maximal removed byte runs, s to e), kept_sha256."""
    if length % 8 or length < GRAM + 8:
        raise ValueError("length has to be a multiple of 8, of 56 at least")
    src = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    base = materialize(src.mapInArrow(_find_runs(length), f"id {kind}, n_bytes bigint, key binary, sha string, h array<bigint>, p array<int>, len array<int>, ahead array<int>"))
    classes = base.groupBy("key").agg(F.first("h").alias("h"), F.first("p").alias("p"), F.first("len").alias("len"), F.first("ahead").alias("ahead"))
    each = classes.where("size(h) > 0").select("key", F.explode(F.arrays_zip("h", "p", "len", "ahead")).alias("x")).select("key", "x.*")
    # a table of its own, so that the join below may split the partition of an often repeated bucket
    often = materialize(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    hits = each.join(often, "h").groupBy("key").agg(F.collect_list(F.struct("p", "len", "ahead", "h", "n")).alias("hits"))
    hits = materialize(hits)
    texts = src.select("text").mapInArrow(_with_key, "key binary, text string").groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    hit_texts = materialize(hits.join(texts, "key"))
    segments = materialize(hit_texts.mapInArrow(_segments(length, hot), _SEG_SCHEMA))

    # max() of the bytes takes the one row of a text that has them; equal sid, equal bytes
    distinct = materialize(segments.groupBy("h", "sid", "hot").agg(F.sum("copies").alias("n"), F.max("seg").alias("seg")))
    crowded = distinct.where("hot").groupBy("h").count().where(F.col("count") > hot).select("h")
    crowded = materialize(crowded)
    rest = distinct.join(crowded, "h", "left_anti") if crowded.limit(1).count() else distinct
    from pyspark.sql import Window

    blocks = rest.withColumn("in_bucket", F.count("*").over(Window.partitionBy("h"))).where("in_bucket > 1 or n > 1")
    found = blocks.select("h", "sid", "seg", "n").mapInArrow(_sort_buckets(length), "sid binary, iv array<struct<s:int,e:int>>")
    if crowded.limit(1).count():  # single windows: equal ones meet as counts
        windows = distinct.join(crowded, "h").select("sid", "n", "seg", F.explode(F.sequence(F.lit(0), F.length("seg") - length)).alias("s"))
        windows = windows.select("sid", "n", "s", F.sha2(F.substring("seg", F.col("s") + 1, F.lit(length)), 256).alias("w"))
        twice = windows.groupBy("w").agg(F.sum("n").alias("all")).where("all > 1").select("w")
        single = windows.join(twice, "w").groupBy("sid").agg(F.collect_list(F.struct("s", (F.col("s") + 1).alias("e"))).alias("iv"))
        found = found.unionAll(single)
    starts = segments.select("key", "sid", "p").join(found, "sid")
    starts = starts.select("key", F.transform("iv", lambda x: F.struct((x["s"] + F.col("p")).alias("s"), (x["e"] + F.col("p")).alias("e"))).alias("iv"))
    starts = starts.groupBy("key").agg(F.flatten(F.collect_list("iv")).alias("iv"))
    cuts = hit_texts.select("key", "text").join(starts, "key").mapInArrow(_digest(length), "key binary, cut array<struct<s:int,e:int>>, cut_sha string")
    cuts = materialize(cuts)
    copies = base.groupBy("key").agg(F.count("*").alias("copies"))
    known = copies.join(cuts, "key", "left").where("copies > 1 or cut is not null")
    out = base.select("id", "n_bytes", "key", "sha").join(known, "key", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    all_of = F.array(F.struct(F.lit(0).alias("s"), F.col("n_bytes").cast("int").alias("e")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    return out.select(
        F.col("id").alias(doc_id), "n_bytes", F.when(whole, all_of).otherwise(F.coalesce("cut", none)).alias("spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
