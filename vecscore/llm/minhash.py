"""Near-duplicate classes: circulant MinHash, banding, exact Jaccard verification, components.

Signatures. A shingle's 64-bit hash is mapped by the first permutation to one of D = 2**20 positions
(the finaliser of the hash, a bijection, cut to its upper bits); the second permutation is a table P of
the D positions. Coordinate k of a signature is the minimum of P circularly shifted by k over the set's
positions. Shifts of one table lie side by side, so all K coordinates of a shingle are one slice.

Candidates. Equal sets are one class before anything is joined. `bands` bands of `rows` coordinates
miss a pair at the threshold itself with probability (1 - 0.75**4)**48 = 1.2e-8, and less above it.

Links. A band's bucket can hold a large group of copies, so its pairs are not listed. First every
class is compared with the bucket's first one if their sizes allow a link, and components are formed. A pair inside one component
can't change the result, so only buckets that still span several components matter. Their classes go through a prefix
filter: shingles in order of rarity (those of one component first), a class is probed by as many of its first shingles as one of a link
must be among (a quarter of them), and found by as many as must hold one if it is the smaller of a pair (a seventh). So a family of
texts that share less than the threshold doesn't meet at all, whatever its size. Classes that meet in a shingle are joined to
groups by their largest component, and those outside it (the minor ones) are compared with all
of the group. A block of minor classes is an inverted index of their shingles; the group's
others stream past it once, so a group costs its classes times its blocks, not its pairs, and both sides
are salted. All comparisons are of full sets made from the whole texts: no link between components is lost.

Odd cases: null or blank texts have empty sets, are linked with nothing and kept. Ids may have any type that can be ordered and are
only results: classes have numbers of their own, so rows that repeat an id with other texts are compared like any others, and equal
texts get the same class; a row is kept if its id is its component's smallest, so all rows that repeat that id are. A null id is no smallest one unless its component has no
other; then the component is null and its rows are kept. An empty table gives an empty table. Extra columns are not read. A text of over
2 MiB is hashed in parts that share four words; its set is what a worker holds.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, NONSPACE, chunks, gram_starts, materialize, mix, ngram_hash, span_hash, text_column, utf8, word_pieces, word_spans
from .components import components

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 48, 4
D_BITS = 20
SEED = 20_26
PER_SALT = 256
MINORS, PASSING = 300, 1000


@functools.cache
def _circulant(width: int) -> np.ndarray:
    """View whose row i is P[i], P[i + 1], ... (circularly), `width` long."""
    p = np.random.default_rng(SEED).permutation(1 << D_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[: width - 1]]), width)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = SHINGLE):
    """The sorted distinct shingle hashes of each text of a chunk."""
    if len(offs) == 2 and len(data) > CHUNK_BYTES:  # a long text, in parts
        found, few = [], np.zeros(0, np.uint64)
        for number, d, s, e in word_pieces(data, NONSPACE, n - 1):
            wh = span_hash(LOWER[d], s, e)
            found.append(np.unique(ngram_hash(wh, n)))
            few = wh if not number and len(wh) < n else few
        yield ngram_hash(few, len(few)) if len(few) else np.unique(np.concatenate(found))
        return
    d = LOWER[data]
    s, e, first = word_spans(d, offs, NONSPACE)
    wh = span_hash(d, s, e)
    count = np.diff(first)
    at = gram_starts(first, n)
    h = ngram_hash(wh, n)[at]
    ends = np.cumsum(np.maximum(count - n + 1, 0))
    for r, c in enumerate(count.tolist()):
        if c >= n:
            yield np.unique(h[ends[r] - (c - n + 1) : ends[r]])
        elif c:
            yield ngram_hash(wh[first[r] : first[r] + c], c)
        else:
            yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray, width: int) -> np.ndarray:
    rows = _circulant(width)
    at = (mix(hashes.copy()) >> np.uint64(64 - D_BITS)).astype(np.int64)
    sig = np.full(width, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), 4096):
        np.minimum(sig, rows[at[i : i + 4096]].min(axis=0), out=sig)
    return sig


def set_key(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _sets(text: str, key: str, n: int, bands: int, rows: int):
    def run(batches):
        mult = np.array([pow(0xA0761D6478BD642F | 1, i + 1, 1 << 64) for i in range(rows)], np.uint64)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            data, offs = utf8(text_column(batch, text))
            size, keys, band = [], [], []
            for i, j in chunks(offs):
                for h in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n):
                    size.append(len(h))
                    if len(h):
                        keys.append(set_key(h))
                        sig = signature(h, bands * rows).astype(np.uint64).reshape(bands, rows)
                        band.append(mix((sig * mult).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
                    else:
                        keys.append(None)
                        band.append(np.zeros(0, np.int64))
            ids = batch.column(batch.schema.get_field_index(key))
            at = np.concatenate([[0], np.cumsum([len(b) for b in band])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*band, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(keys, pa.binary()), flat], ["id", "n_shingles", "set_key", "bands"])

    return run


def _hashes(n: int):
    """Rows (node, set_key, text) to (node, h): the set of those whose set is the class's."""

    def run(batches):
        for batch in batches:
            data, offs = utf8(text_column(batch, "text"))
            node, key = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            r = 0
            for i, j in chunks(offs):
                out: list = [[], []]
                for h in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n):
                    if len(h) and set_key(h) == key[r]:
                        out[0].append(node[r])
                        out[1].append(h.tobytes())
                    r += 1
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["node", "h"])

    return run


def _read(batch: pa.RecordBatch, at: int):
    """The sets of a binary column."""
    for x in batch.column(at):
        yield np.frombuffer(x.as_buffer(), np.uint64)


def _compare(percent: int):
    """Rows (hub, kind, id, h) sorted by hub, salt, kind: a hub's own row comes before its partners'."""

    def run(batches):
        hub_set, hub = np.zeros(0, np.uint64), None
        for batch in batches:
            hubs, kind, ids = (batch.column(i).to_pylist() for i in range(3))
            a, b = [], []
            for r, h in enumerate(_read(batch, 3)):
                if kind[r] == 0:
                    hub, hub_set = hubs[r], h.copy()
                elif hub == hubs[r]:
                    k = np.minimum(np.searchsorted(hub_set, h), len(hub_set) - 1)
                    both = int((hub_set[k] == h).sum())
                    if 100 * both >= percent * (len(h) + len(hub_set) - both):
                        a.append(ids[r])
                        b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links; b is the hub."""
    pairs = materialize(pairs)
    # tables of their own, so that the joins may split a hub's partition
    degree = materialize(pairs.groupBy("b").count().select("b", F.ceil(F.col("count") / PER_SALT).cast("int").alias("salts")))
    partner = pairs.join(degree, "b").select(F.col("b").alias("hub"), F.lit(1).alias("kind"), F.col("a").alias("node"), F.pmod(F.hash("a"), F.col("salts")).alias("salt"))
    own = degree.select(F.col("b").alias("hub"), F.lit(0).alias("kind"), F.col("b").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = partner.unionAll(own).join(sets, "node").select("hub", "kind", "node", "salt", "h")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "kind").select("hub", "kind", "node", "h")
    return rows.mapInArrow(_compare(percent), "a bigint, b bigint")


def _index(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, and for each the range of the owners that have it."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(h) for h in sets])
    k = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[k], return_index=True)
    return keys, np.append(first, len(flat)), owner[k]


def _compare_blocks(percent: int):
    """Rows (main, block, salt, kind, node, comp, h) sorted by group, block, salt, kind: a block's minor members (kind 0), then the members that pass by."""

    def run(batches):
        at, sets, ids, comps, made = None, [], [], [], None
        told: set[tuple] = set()
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            a, b = [], []
            for r, h in enumerate(_read(batch, 6)):
                where, kind, key, comp = tuple(c[r] for c in cols[:3]), cols[3][r], cols[4][r], cols[5][r]
                if where != at:
                    at, sets, ids, comps, made, told = where, [], [], [], None, set()
                if kind == 0:
                    sets.append(h.copy())
                    ids.append(key)
                    comps.append(comp)
                    continue
                if not sets:
                    continue
                made = made or _index(sets)
                keys, first, owner = made
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                k = k[keys[k] == h]
                many = first[k + 1] - first[k]
                x = np.repeat(first[k] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                both = np.bincount(owner[x], minlength=len(sets))
                for o in np.flatnonzero((100 + percent) * both >= percent * len(h)).tolist():
                    if 100 * int(both[o]) >= percent * (len(h) + len(sets[o]) - int(both[o])) and comps[o] != comp and (ids[o], comp) not in told:
                        told.add((ids[o], comp))
                        a.append(key)
                        b.append(ids[o])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _tokens(batches):
    """Rows (node, comp, h) to one for each shingle."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = list(_read(part, 2))
            n = np.array([len(h) for h in sets], np.int32)
            take = pa.array(np.repeat(np.arange(len(sets)), n))
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], ["node", "comp", "n", "g"])


def _meeting(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, comp): members (node, comp) that share a shingle of their prefixes, for shingles by which some other component's member may be linked.

    A link of sets x and y, y not larger, has at least t * |x| common shingles, and 2t / (1 + t) * |y|. So, all shingles in one order, some of
    the first |x| - t|x| + 1 of x is among the first |y| - 2t / (1 + t) |y| + 1 of y. Shingles of one component come
    first in the order, then by rarity: those are counted, not joined."""
    rows = materialize(members.join(sets, "node").select("node", "comp", "h").mapInArrow(_tokens, "node bigint, comp bigint, n int, g bigint"))
    shared = materialize(rows.groupBy("g").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g", "c"))
    own = rows.join(shared, "g").groupBy("node", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("gs"))
    n, t = F.col("n"), percent
    probe = n - F.ceil(n * t / 100) + 1 - (n - F.size("gs"))
    found = n - F.ceil(n * 2 * t / (100 + t)) + 1 - (n - F.size("gs"))
    prefix = own.withColumn("probe", probe.cast("int")).withColumn("found", found.cast("int")).where("probe > 0")
    prefix = prefix.select("node", "comp", "found", F.posexplode(F.slice("gs", F.lit(1), F.col("probe"))).alias("at", "x"))
    prefix = materialize(prefix.select(F.col("x.g").alias("key"), "node", "comp", (F.col("at") < F.col("found")).alias("is_found")))
    live = prefix.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("is_found").alias("any")).where("lo <> hi and any")
    return prefix.join(materialize(live.select("key")), "key", "left_semi").select("key", "node", "comp")


def _across(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of rows (key, node, comp): for a minor member at least one with each component it has links with."""
    sizes = apart.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"))
    group = materialize(apart.join(materialize(main), "key").select("main", "node", "comp").distinct())
    dealt = group.groupBy("main").agg(F.ceil(F.count_if(F.col("comp") != F.col("main")) / MINORS).cast("int").alias("blocks"), F.ceil(F.count("*") / PASSING).cast("int").alias("salts"))
    dealt = materialize(dealt)
    rows = group.join(dealt, "main")
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    minor = rows.where("comp <> main").select("main", F.pmod(F.hash("node"), F.col("blocks")).alias("block"), up_to("salts").alias("salt"), F.lit(0).alias("kind"), "node", "comp")
    passing = rows.select("main", up_to("blocks").alias("block"), F.pmod(F.hash("node"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "node", "comp")
    full = minor.unionAll(passing).join(sets, "node").select("main", "block", "salt", "kind", "node", "comp", "h")
    parts = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = full.repartition(parts, "main", "block", "salt").sortWithinPartitions("main", "block", "salt", "kind")
    return full.mapInArrow(_compare_blocks(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each of docs: doc_id, n_shingles, component_id, kept, n_links (classes with links only:
    verified links found, at least one for each member of a component of several classes)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    of_rows = materialize(src.mapInArrow(_sets("text", "id", shingle, bands, rows), f"id {kind}, n_shingles bigint, set_key binary, bands array<bigint>"))
    classes = of_rows.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    exploded = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = materialize(exploded.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("node", "n")).alias("low")).where("c > 1").select("key", "low"))
    members = materialize(exploded.join(shared, "key").select("key", "node", "n", "low"))
    nodes = members.select("node").distinct().join(classes.select("node", "set_key", F.xxhash64("rep").alias("k")), "node")
    # a row of each class by its smallest id; ids may repeat, so the set decides
    texts = src.select(F.xxhash64("id").alias("k"), F.xxhash64("text").alias("t"), "text").join(nodes, "k").dropDuplicates(["k", "node", "t"])
    sets = materialize(texts.select("node", "set_key", "text").mapInArrow(_hashes(shingle), "node bigint, h binary"))

    fits = 100 * F.least("n", "low.n") >= percent * F.greatest("n", "low.n")
    stars = members.where((F.col("node") != F.col("low.node")) & fits).select(F.col("node").alias("a"), F.col("low.node").alias("b")).distinct()
    links = materialize(_verify(stars, sets, percent))
    label = components(links)
    seen = members.select("key", "node").join(label.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    split = seen.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    apart = materialize(seen.join(split.select("key"), "key", "left_semi").select("node", "comp").distinct())
    links = materialize(links.unionAll(_across(_meeting(apart, sets, percent), sets, percent)).distinct())
    label = components(links).withColumnRenamed("id", "node")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of = classes.select("set_key", "rep", "node").join(label, "node", "left").join(degree, "node", "left").select("set_key", "rep", F.coalesce("comp", "node").alias("comp"), "n_links")
    least = of.groupBy("comp").agg(F.min("rep").alias("component"))
    of = materialize(of.join(least, "comp").select("set_key", "component", "n_links"))
    lone = F.coalesce("set_key", F.encode(F.xxhash64("id").cast("string"), "utf-8"))  # so that empty sets don't meet in one task
    out = of_rows.select("id", "n_shingles", F.col("set_key").isNull().alias("lone"), lone.alias("set_key")).join(of, "set_key", "left")
    comp = F.when(F.col("lone"), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(doc_id), "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("id"), comp.isNull()).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
