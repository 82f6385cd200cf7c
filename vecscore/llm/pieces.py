"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text gets a leading space; spaces are written as U+2581 in pieces. It is cut before every run of spaces, which
no piece crosses, into marked words. The distinct marked words of a batch are sorted, so that each shares
its longest known prefix with the one before: a depth-first walk over the trie they form. For every
depth the walk keeps the surviving last piece and the vocabulary nodes still open; the
next word keeps all that belongs to the shared prefix and goes on behind it.

The model at hand is a merge (BPE) model, whose encoding isn't the segmentation of greatest total score, so
the trellis has the constraint that makes it exact: the encoding of any prefix has one last piece, and it is
the piece whose pair with the last piece of the rest is stable, that is, encoded by merging as those two
pieces again. So a state keeps one survivor, its last piece, and a transition is open or not. Whether a pair
is stable is found by merging its few characters once (highest score first, leftmost among equals) and kept.
A character that is no piece takes part in no merge and is written as byte pieces.

Vocabulary and scores are read from the model file by the driver and broadcast (bounded by the model); the
model is never trained or changed. Known words are kept between batches, `KEEP` at most.

Long texts are taken in parts of `SLICE` characters, cut before runs of spaces. A word of over `LONG` characters (no blank in
it) is walked by itself, `LONG` characters at a time: the pieces up to the last place that all open segmentations
share are settled and written out, and the walk goes on from there, so that it holds what is still open only.

Null and empty texts have no pieces and decode to an empty text. U+2581 in a text decodes as a space; all
else round-trips. Rows are encoded by their text alone, so repeated rows get the same pieces; of pairs with equal scores the
leftmost is merged. An empty table gives an empty result. Result columns replace input columns of their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = Path("/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
KEEP = 200_000
SLICE = 1 << 20
LONG = 1 << 14
WORD = re.compile(r" +[^ ]*|[^ ]+")
PAIRS = 2_000_000
BLOCK = 1 << 16


class Vocabulary:
    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        """pieces: the text of each id ('' for control, unknown and byte pieces); byte_ids: the ids of the 256 bytes."""
        self.pieces, self.scores, self.byte_ids = pieces, scores, byte_ids
        self.root: dict = {}
        for i, p in enumerate(pieces):
            node = self.root
            for c in p.replace(MARK, " "):
                node = node.setdefault(c, {})
            if p:
                node[""] = i
        self.text = [p.replace(MARK, " ") for p in pieces]
        self.ids = {p.replace(MARK, " "): i for i, p in enumerate(pieces) if p}
        self.stable: dict[tuple[int, int], bool] = {}
        self.spell = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.spell[i] = bytes([b])

    @classmethod
    def load(cls, path: str | Path = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
        n = sp.vocab_size()
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(n)]
        pieces = [sp.id_to_piece(i) if plain[i] else "" for i in range(n)]
        inside = [p for p in pieces if MARK in p.lstrip(MARK)]
        if inside or not all(sp.is_byte(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("a model with byte pieces and without pieces across words is needed")
        return cls(pieces, [sp.get_score(i) for i in range(n)], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the pair whose whole scores most first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            top, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (top is None or self.scores[k] > top):
                    top, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_stable(self, before: int, piece: int) -> bool:
        """Whether merging keeps these two pieces as they are; before is -1 at a word's start or behind an unknown character."""
        known = self.stable.get((before, piece))
        if known is None:
            if len(self.stable) > PAIRS:
                self.stable = {}
            two = [self.text[piece]] if before < 0 else [self.text[before], self.text[piece]]
            known = self.stable[before, piece] = self.merge("".join(two)) == two
        return known

    def _walk(self, word: str, begin: int, back: list, open_: list) -> None:
        """Appends, for each character of word from begin on, (start, id) of the last piece before it ends, and the open (start, node)."""
        root, stable, check = self.root, self.stable.get, self.is_stable
        for at in range(begin, len(word)):
            c = word[at]
            nodes, last = [], None
            for start, node in open_[at]:
                node = node.get(c)
                if node is not None:
                    nodes.append((start, node))
                    if last is None:
                        piece = node.get("")
                        if piece is not None:
                            ok = stable((back[start][1], piece))
                            if check(back[start][1], piece) if ok is None else ok:
                                last = (start, piece)
            node = root.get(c)
            if node is not None:
                nodes.append((at, node))
                if last is None and "" in node:
                    last = (at, node[""])
            back.append(last or (at, -1))
            open_.append(nodes)

    def _trace(self, word: str, at: int, back: list) -> list[int]:
        """Ids of the pieces of word[:at]."""
        ids: list[int] = []
        while at:
            start, i = back[at]
            ids += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(word[start:at].encode())]
            at = start
        ids.reverse()
        return ids

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each word; words are walked in sorted order."""
        out = {}
        back, open_ = [(0, -1)], [[]]  # by depth: (start, id) of the last piece, (start, node) of the open nodes
        before = ""
        for word in sorted(words):
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del back[depth + 1 :], open_[depth + 1 :]
            self._walk(word, depth, back, open_)
            out[word] = tuple(self._trace(word, len(word), back))
            before = word
        return out

    def encode_long(self, word: str) -> array:
        """Ids of one word, in parts: what every open segmentation begins with is settled."""
        out = array("i")
        back, open_, part = [(0, -1)], [[]], ""
        for at in range(0, len(word), LONG):
            done = len(part)
            part += word[at : at + LONG]
            self._walk(part, done, back, open_)
            end = len(part)
            heads = {end, *(start for start, _ in open_[end])}  # pieces to come begin at one of these
            while len(heads) > 1:
                last = max(heads)
                heads.remove(last)
                heads.add(back[last][0])
            (cut,) = heads
            out.extend(self._trace(part, cut, back))
            back = [(0, back[cut][1]), *((start - cut, i) for start, i in back[cut + 1 :])]
            open_ = [[], *([(start - cut, node) for start, node in nodes] for nodes in open_[cut + 1 :])] if cut < end else [[]]
            part = part[cut:]
        out.extend(self._trace(part, len(part), back))
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """What the ids spell, with the leading space; `BLOCK` ids at a time."""
        return b"".join(b"".join(map(self.spell.__getitem__, ids[i : i + BLOCK].tolist())) for i in range(0, len(ids), BLOCK))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(np.asarray(ids, np.int32))[1:].decode("utf-8", "replace")


def _slices(text: str):
    """The text behind its leading space, in parts that end before a run of spaces."""
    t, at = " " + text.replace(MARK, " "), 0
    while at < len(t):
        end = min(len(t), at + SLICE)
        while 0 < end < len(t) and not (t[end] == " " and t[end - 1] != " "):
            end = t.find(" ", end + 1)
            end = len(t) if end < 0 else end
        yield t[at:end]
        at = end


class Known(dict):
    """Ids of known words; words that aren't kept, long ones above all, are encoded when they are asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.long = vocabulary.encode_long

    def __missing__(self, word: str) -> array:
        return self.long(word)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, Known(vocabulary)

    def _learn(self, words: Iterable[str]) -> None:
        """Makes all words but the long ones known."""
        words = set(words)
        new = words - self.known.keys()
        if len(self.known) + len(new) > KEEP:
            new = words
            self.known.clear()
        self.known.update(self.v.encode_words(w for w in new if len(w) <= LONG))

    def _ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; texts are to have about SLICE characters together, a longer one is taken in parts."""
        lists = [WORD.findall(" " + t.replace(MARK, " ")) if t and len(t) <= SLICE else [] for t in texts]
        self._learn(chain.from_iterable(lists))
        return [self._ids(words) if len(t) <= SLICE else self._long(t) for t, words in zip(texts, lists, strict=True)]

    def _long(self, text: str) -> np.ndarray:
        ids = []
        for part in _slices(text):
            words = WORD.findall(part)
            self._learn(words)
            ids.append(self._ids(words))
        return np.concatenate(ids)


def _groups(texts: list[str | None]):
    """Texts of about SLICE characters together."""
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(t or "")
        if size >= SLICE:
            yield group
            group, size = [], 0
    yield group


def _encode(bc, keep: list[str], text: str, digest: bool):
    def run(batches):
        enc = Encoder(bc.value)
        for batch in batches:
            ids, same, sha = [], [], []
            for group in _groups(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                for t, x in zip(group, enc.encode(group), strict=True):
                    if digest:
                        same.append(enc.v.decode_bytes(x)[1:] == t.replace(MARK, " ").encode())
                        sha.append(hashlib.sha256(np.ascontiguousarray(x, "<i4")).hexdigest())
                        ids.append(len(x))
                    else:
                        ids.append(x)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if digest:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], [*keep, "n_pieces", "ids_sha256", "round_trip"])
            else:
                n = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([*cols, lists, pa.array(n)], [*keep, "piece_ids", "n_pieces"])

    return run


def encode(docs: DataFrame, model: str | Path = MODEL, text: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """The kept columns (all, unless named) with piece_ids and n_pieces; with digest, n_pieces, ids_sha256 (of the ids
    as little-endian 32-bit numbers) and round_trip (the ids decode to the text) instead. These replace columns of their names."""
    more = ("piece_ids", "n_pieces", "ids_sha256", "round_trip")
    keep = [c for c in (keep or docs.columns) if c not in more]
    src = docs.select(*dict.fromkeys([*keep, text]))
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields if f.name in keep)
    bc = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    return src.mapInArrow(_encode(bc, keep, text, digest), ddl + ("n_pieces bigint, ids_sha256 string, round_trip boolean" if digest else "piece_ids array<int>, n_pieces bigint"))


def _decode(bc, keep: list[str]):
    def run(batches):
        v = bc.value
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            texts = [v.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else ()) for x in batch.column(batch.schema.get_field_index("piece_ids"))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], [*keep, "decoded"])

    return run


def decode(encoded: DataFrame, model: str | Path = MODEL, keep: list[str] | None = None) -> DataFrame:
    """The kept columns with `decoded`, the text of piece_ids."""
    keep = [c for c in (keep or encoded.columns) if c != "decoded"]
    src = encoded.select(*dict.fromkeys([*keep, "piece_ids"]))
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields if f.name in keep)
    return src.mapInArrow(_decode(encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model)), keep), ddl + "decoded string")
