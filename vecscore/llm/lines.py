"""Line dedup by winnowing over line hashes.

A repeated run is `run` consecutive lines, or fewer consecutive lines that have at least `long_words` words
together (the first and the last of them some), whose like starts earlier in the corpus: at a smaller id, or
before it in the same text. Every line of a later run is deleted.

1. Winnowing. Each window (of run lines, or a shorter one of enough words) selects its least line hash, the
   leftmost of equal ones; equal windows select equal fingerprints, so a shared run can't be missed.
   Only selected lines are emitted, once each: fewer rows than lines.
2. Join. Fingerprints are counted (partially aggregated); the positions of those that occur more than once
   go back to their texts.
3. Extension. In its text a joined position is extended line by line, up and down, as long as it stays the
   selected line: this gives the windows around it, whose bytes are digested (128-bit BLAKE2b).
4. Places of one digest meet as a partially aggregated minimum, so that a passage that a third of all texts have
   is one row for each task and is never listed by pairs. All places but the first are the later runs;
   longer runs are the union of their windows.

Positions of a fingerprint are joined through its count instead of pairwise: pairs grow with the square of a
common line's count, and the first place alone may lie among other lines than a run's earlier like.

Rows are told apart by a number given when they are written to the shared folder, never by their id, so rows
that repeat an id or a text are texts of their own: the earlier one is that of the smaller id (null ids first),
then of the smaller text hash, then of the smaller number. Lines are parts between LF bytes, compared as bytes; blank lines
count as lines, but a window of blank lines only is no run. Null texts have no lines and stay null; a text whose
lines are all deleted becomes empty. An empty table gives an empty table. A very long text is hashed in pieces of
bounded size; its bytes and the places of its lines are what a worker holds. Ids have to be comparable; other columns may have any names but
n_lines and n_removed, which the result replaces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ANYCASE, CHUNK_BYTES, chunks, fresh, gram_starts, materialize, mix, numbered, slices, span_hash, text_column, utf8

RUN = 3
LONG_WORDS = 40


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and the number of each text's first line (one more at the end). A text without bytes has one empty line."""
    cut = np.flatnonzero(data == 10)
    s = np.sort(np.concatenate([offs[:-1], cut + 1]), kind="stable")
    e = np.sort(np.concatenate([offs[1:], cut]), kind="stable")
    n = np.diff(np.searchsorted(cut, offs)) + 1
    return s, e, np.concatenate([[0], np.cumsum(n)])


def words_between(d: np.ndarray, s: np.ndarray, e: np.ndarray, step: int = CHUNK_BYTES) -> np.ndarray:
    """Number of words in each line, counted in pieces."""
    upto = np.zeros((2, len(s)), np.int64)  # words that start before, the first byte apart
    places, total = (np.minimum(s + 1, e), e), 0
    for base in range(0, len(d) + 1, step):
        w = ANYCASE[d[max(0, base - 1) : base + step]]
        begin = np.flatnonzero(w[1:] & ~w[:-1]) + max(1, base)
        for k, x in enumerate(places):
            i, j = np.searchsorted(x, (base, base + step))
            upto[k, i:j] = total + np.searchsorted(begin, x[i:j])
        total += len(begin)
    some = s < e
    return upto[1] - upto[0] + (some & ANYCASE[d[np.minimum(s, len(d) - 1)]] if len(d) else 0)


def selected(d: np.ndarray, o: np.ndarray, run: int, long_words: int):
    """(starts, ends, first lines) as of line_spans, and of every window (lines, first line, selected line) by number of lines."""
    s, e, first = line_spans(d, o)
    fp = mix(span_hash(d, s, e) + np.uint64(3))
    blank = s == e
    many = words_between(d, s, e)
    windows = []
    for n in range(1, run + 1):
        at = gram_starts(first, n)
        if n == run:
            at = at[~np.all([blank[at + k] for k in range(n)], axis=0)]
        else:
            at = at[(many[at] > 0) & (many[at + n - 1] > 0) & (sum(many[at + k] for k in range(n)) >= long_words)]
        windows.append((n, at, at + np.argmin(np.stack([fp[at + k] for k in range(n)]), axis=0)))
    return s, e, first, fp, windows


def _winnow(run: int, long_words: int):
    def work(batches):
        for batch in batches:
            data, offs = utf8(text_column(batch, "text"))
            row = batch.column(0).to_numpy()
            for i, j in chunks(offs, CHUNK_BYTES // 4):
                _, _, first, fp, windows = selected(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], run, long_words)
                least = np.unique(np.concatenate([x for _, _, x in windows]))
                doc = np.searchsorted(first, least, side="right") - 1
                p = (least - first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(fp[least].view(np.int64)), pa.array(row[i + doc]), pa.array(p)], ["fp", "row", "p"])

    return work


def _extend(run: int, long_words: int):
    """Rows (row, id, tie, text, at: its joined positions) to the windows around these."""

    def work(batches):
        for batch in (part for b in batches for part in slices(b, "text", CHUNK_BYTES // 4)):
            data, offs = utf8(text_column(batch, "text"))
            s, e, first, _, windows = selected(data, offs, run, long_words)
            hits = batch.column(3)
            lens = np.diff(hits.offsets.to_numpy())
            joined = np.zeros(len(s), np.bool_)
            joined[hits.flatten().to_numpy() + np.repeat(first[:-1], lens)] = True
            raw, begin, end = data.tobytes(), s.tolist(), e.tolist()
            for n, at, least in windows:
                at = at[joined[least]]
                doc = np.searchsorted(first, at, side="right") - 1
                win = [hashlib.blake2b(raw[begin[a] : end[a + n - 1]], digest_size=16, salt=b"%d" % n).digest() for a in at.tolist()]
                take = pa.array(doc)
                cols = [batch.column(k).take(take) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(win, pa.binary()), *cols, pa.array((at - first[doc]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32))], ["win", "row", "id", "tie", "p", "n"])

    return work


def repeated_lines(rows: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text", run: int = RUN, long_words: int = LONG_WORDS) -> DataFrame:
    """(row, lines): the numbers (from 0) of each text's lines to delete; only texts that lose any. rows: a written table whose column `row` numbers it."""
    kind = rows.schema[doc_id].dataType.simpleString()
    src = rows.where(F.col(text).isNotNull()).select(F.col(row).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    prints = materialize(src.select("row", "text").mapInArrow(_winnow(run, long_words), "fp bigint, row bigint, p int"))
    # counts and first places are tables of their own, so that the joins with them may split what is often repeated
    often = materialize(prints.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"))
    places = materialize(prints.join(often, "fp", "left_semi").groupBy("row").agg(F.collect_list("p").alias("at")))
    near = src.join(places.hint("merge"), "row").select("row", "id", F.xxhash64("text").alias("tie"), "at", "text").mapInArrow(_extend(run, long_words), f"win binary, row bigint, id {kind}, tie bigint, p int, n int")
    near = materialize(near)
    place = F.struct("id", "tie", "row", "p")
    first = near.groupBy("win").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("win", F.col("first.row").alias("first_row"), F.col("first.p").alias("first_p"))
    later = near.join(materialize(first), "win").where("row <> first_row or p <> first_p")
    lines = later.select("row", F.explode(F.sequence("p", F.col("p") + F.col("n") - 1)).alias("line")).distinct()
    return lines.groupBy("row").agg(F.collect_list("line").alias("lines"))


def _cut(keep: list[str], text: str, lines: str):
    def work(batches):
        for batch in (part for b in batches for part in slices(b, text)):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts, total, gone = [], [], []
            for t, drop in zip(col[text].to_pylist(), col[lines].to_pylist(), strict=True):
                parts = t.split("\n") if t is not None else []
                drop = set(drop or ())
                texts.append("\n".join(x for k, x in enumerate(parts) if k not in drop) if drop else t)
                total.append(len(parts))
                gone.append(len(drop))
            cols = [pa.array(texts, pa.string()) if c == text else col[c] for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*keep, "n_lines", "n_removed"])

    return work


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with the text less its repeated lines, n_lines (before) and n_removed; these replace columns of the same names."""
    docs = docs.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")))
    row, lines = fresh(docs, "__row"), fresh(docs, "__lines")
    rows = numbered(docs, row)
    cut = repeated_lines(rows, row, doc_id, text, run, long_words).select(F.col("row").alias(row), F.col("lines").alias(lines))
    joined = rows.join(cut.hint("merge"), row, "left").select(*docs.columns, lines)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(_cut(docs.columns, text, lines), f"{ddl}, n_lines bigint, n_removed bigint")
