"""Shared pieces of the text operators: table access, checkpoints, byte-level NumPy helpers.

The NumPy helpers work on Arrow string buffers (UTF-8 bytes plus offsets) in chunks of
bounded size, so that the memory of a Python worker does not depend on the table.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
HASH_STEP, HASH_SPAN = 1 << 18, 1 << 16
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir; one is set here only where it is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(at)


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lower_ascii(c: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as plain strings, null as empty."""
    at = [i for i, n in enumerate(batch.schema.names) if n == name][0]
    col = batch.column(at)
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return col


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array, without a copy."""
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    d = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges of about `most` bytes; a longer text stands alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def slices(batch: pa.RecordBatch, name: str, most: int = CHUNK_BYTES):
    """The batch in parts of about `most` bytes of text, so that what is made of a part stays small."""
    _, offs = utf8(text_column(batch, name))
    for i, j in chunks(offs, most):
        yield batch.slice(i, j - i)


def powers() -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for a piece of span_hashes(): a table of bounded size."""
    if not _POW:
        for key, b in (("b", _B), ("i", _BINV)):
            p = np.full(HASH_STEP + HASH_SPAN, b, np.uint64)
            p[0] = 1
            _POW[key] = np.multiply.accumulate(p)
    return _POW["b"], _POW["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (in place where it can be)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def class_table(chars: str, inside: bool) -> np.ndarray:
    """A byte is of a word if it is (or isn't) one of the ASCII characters given."""
    t = np.full(256, not inside)
    for c in chars:
        t[ord(c)] = inside
    return t


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters, all that isn't ASCII.
ALNUM = class_table("0123456789abcdefghijklmnopqrstuvwxyz", True)
ALNUM[128:] = True
#: The same before lower-casing.
ANYCASE = ALNUM.copy()
ANYCASE[65:91] = True
#: Words [^\x20\x09-\x0D]+.
NONSPACE = class_table(" \t\n\x0b\x0c\r", False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of each text (one more at the end)."""
    n = len(data)
    w = np.zeros(n + 2, np.bool_)
    w[1:-1] = is_word[data]
    begin = w[1:] & ~w[:-1]
    end = w[:-1] & ~w[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    both = inner[w[inner] & w[inner + 1]]  # a text's end inside what would else be one word
    begin[both] = True
    end[both] = True
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    return s, e, np.searchsorted(s, offs)


def word_pieces(d: np.ndarray, is_word: np.ndarray, overlap: int, most: int = CHUNK_BYTES):
    """(number of the first word, bytes, starts, ends) of parts of one text that cut no word and share `overlap` words: memory is that of a part."""
    at, number = 0, 0
    while True:
        size = most
        while True:
            end = min(len(d), at + size)
            if end < len(d):
                gap = np.flatnonzero(~is_word[d[at:end]])
                end = at + int(gap[-1]) + 1 if len(gap) else at
            s, e, _ = word_spans(d[at:end], np.array([0, end - at]), is_word)
            if end == len(d) or len(s) > overlap:
                break
            size *= 2
        yield number, d[at:end], s, e
        if end == len(d):
            return
        number += len(s) - overlap
        at = at + int(s[len(s) - overlap]) if overlap else end


def span_hashes(data: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """64-bit hashes of data[s:e] for every span of each list (s, e), s ascending.

    Bytes are taken in pieces of HASH_STEP, so that memory doesn't grow with a text; spans of over HASH_SPAN bytes
    are hashed one by one."""
    p, inv = powers()
    out = [np.zeros(len(s), np.uint64) for s, _ in spans]
    for base in range(0, len(data), HASH_STEP):
        d = data[base : base + HASH_STEP + HASH_SPAN]
        acc = np.zeros(len(d) + 1, np.uint64)
        np.cumsum((d.astype(np.uint64) + np.uint64(1)) * p[: len(d)], out=acc[1:])
        for (s, e), h in zip(spans, out, strict=True):
            i, j = np.searchsorted(s, (base, base + HASH_STEP))
            a, n = s[i:j] - base, e[i:j] - s[i:j]
            short = np.minimum(n, HASH_SPAN)
            h[i:j] = mix((acc[a + short] - acc[a]) * inv[a] + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for (s, e), h in zip(spans, out, strict=True):
        for k in np.flatnonzero(e - s > HASH_SPAN):
            h[k] = int.from_bytes(hashlib.blake2b(data[s[k] : e[k]], digest_size=8).digest(), "little")
        if len(h) and s[-1] >= len(data):  # empty spans at the very end
            h[s >= len(data)] = mix(np.zeros(1, np.uint64))[0]
    return out


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return span_hashes(data, (s, e))[0]


_C = [pow(0xA0761D6478BD642F | 1, i + 1, 1 << 64) for i in range(4096)]


def ngram_hash(wh: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (also across texts; callers mask those)."""
    m = len(wh) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h += wh[j : j + m] * np.uint64(_C[j % 4096])
    return mix(h)


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the words that start n consecutive words of one text; first as of word_spans."""
    count = np.diff(first)
    k = np.maximum(count - n + 1, 0)
    total = int(k.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.repeat(first[:-1] - (np.cumsum(k) - k), k)
    return at + np.arange(total)


def pass_schema(df: DataFrame, keep: list[str], more: str) -> str:
    """DDL of the kept columns, then of the result's; result columns replace kept ones of the same name."""
    new = {x.split()[0].strip("`") for x in more.split(", ")}
    kept = [f for f in df.schema.fields if f.name in keep and f.name not in new]
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), more])


def rank_hash(*cols) -> Column:
    return F.xxhash64(*cols)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def swept(spark: SparkSession):
    """Shuffle files of a query made within go when it ends, not when Spark's cleaner finds that nothing refers to them (from Spark 4.1 on).
    For queries that run once: a second run makes the files again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def materialize(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared checkpoint folder and read again: lineage ends here, and
    a lost executor costs no more than what reads them next. The files go when the session's JVM ends."""
    import uuid

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    release(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own in a written table, so that a number means the same row in every later pass."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))
