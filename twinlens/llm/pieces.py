"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The distinct words of a block are laid end to end. Hashes of all their substrings
up to the longest piece are looked up in the sorted hashes of the pieces of that
length. Words of equal length then advance together: at each character the best
way to reach it is a maximum over piece lengths, whose argument is the backpointer.

The result is the segmentation with the greatest sum of the model's piece scores
(the unigram objective; of equal sums the one whose last piece is longest). A model
file trained as BPE gives its pieces and scores all the same; the segmentation then is
the first of the library's n-best search over the file taken as a unigram model, not
that of BPE merges.

Only models that leave characters as they are (no normalisation but the space
mark) are taken.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.texts import Rolling, blocks, codes, column, ddl, mapped, ranges, unused

MARK = "▁"
_MARK = ord(MARK)
#: Added to the least score for a character that no piece covers.
UNKNOWN_PENALTY = -10.0
CACHE_WORDS = 400_000
_SECOND = np.uint64(0xD6E8FEB86659FD93)


class Pieces(NamedTuple):
    """A model as arrays; its size is that of the vocabulary."""

    length: list[np.ndarray]  #: by piece length: sorted hashes,
    check: list[np.ndarray]  #: a second hash of each, against chance hits,
    ids: list[np.ndarray]
    scores: list[np.ndarray]
    unknown_id: int
    unknown_score: float
    byte_ids: np.ndarray | None
    apart: np.ndarray  #: sorted code points that longer pieces hold; others stand alone
    prefix: bool  #: a space mark goes in front of every text
    text: list[bytes]  #: what each id decodes to


def load(model_file: str) -> Pieces:
    """Read pieces and scores of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    probe = "xﬁ ①\tÁ  y "
    shown = sp.normalize(probe)
    if shown.removeprefix(MARK) != probe.replace(" ", MARK):
        raise ValueError(f"{model_file} changes characters; only models without normalisation are taken")
    bytes_of, normal, text = {}, [], []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_of[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            text.append(b"" if sp.is_control(i) else " ⁇ ".encode())
        else:
            text.append(piece.replace(MARK, " ").encode())
            if not sp.is_unused(i):
                normal.append((piece, i, sp.get_score(i)))
    if any(MARK in p.lstrip(MARK) for p, _, _ in normal):
        raise ValueError(f"{model_file} has pieces that run over a space")
    longest = max(len(p) for p, _, _ in normal)
    out = Pieces([], [], [], [], sp.unk_id(), 0, None, np.zeros(0), shown.startswith(MARK), text)
    for k in range(1, longest + 1):
        own = [x for x in normal if len(x[0]) == k]
        cp, bounds = codes([p for p, _, _ in own])
        first, second = Rolling(cp).spans(bounds[:-1], bounds[1:]), Rolling(cp, _SECOND).spans(bounds[:-1], bounds[1:])
        order = np.argsort(first)
        out.length.append(first[order])
        out.check.append(second[order])
        out.ids.append(np.array([i for _, i, _ in own], np.int32)[order])
        out.scores.append(np.array([s for _, _, s in own])[order])
    return out._replace(
        unknown_score=min(s for _, _, s in normal) + UNKNOWN_PENALTY,
        byte_ids=np.array([bytes_of[b] for b in range(256)], np.int32) if len(bytes_of) == 256 else None,
        apart=np.array(sorted({ord(c) for p, _, _ in normal if len(p) > 1 for c in p}), np.uint32),
    )


def viterbi(cp: np.ndarray, start: np.ndarray, length: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each word). A word is
    ``cp[start : start + length]``. An uncovered character is ``-1 - code point``."""
    n_chars = len(cp)
    first, second = Rolling(cp), Rolling(cp, _SECOND)
    word_end = np.zeros(n_chars, np.int64)
    at = ranges(start, length)
    word_end[at] = np.repeat(start + length, length)
    score, piece = {}, {}
    for k, keys in enumerate(pieces.length, 1):
        own = at[at + k <= word_end[at]]
        score[k], piece[k] = np.full(n_chars, -np.inf), np.full(n_chars, -1, np.int32)
        if len(keys) and len(own):
            h = first.spans(own, own + k)
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            own, place = own[hit], place[hit]
            sure = second.spans(own, own + k) == pieces.check[k - 1][place]
            own, place = own[sure], place[sure]
            score[k][own], piece[k][own] = pieces.scores[k - 1][place], pieces.ids[k - 1][place]
        if k == 1:
            bare = at[piece[1][at] < 0]
            score[1][bare], piece[1][bare] = pieces.unknown_score, -1
    found_word, found_at, found_id = [], [], []
    order = np.argsort(length, kind="stable")
    sizes, begin = np.unique(length[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), begin, np.append(begin[1:], len(order)), strict=True):
        group = order[a:b]
        base = start[group]
        best = np.full((size + 1, len(group)), -np.inf)
        best[0] = 0
        back = np.zeros((size + 1, len(group)), np.int16)
        for i in range(1, size + 1):
            ks = range(min(i, len(pieces.length)), 0, -1)
            options = np.stack([best[i - k] + score[k][base + i - k] for k in ks])
            pick = options.argmax(0)  # the first of equals: the longest piece
            best[i] = options[pick, np.arange(len(group))]
            back[i] = ks[0] - pick
        place = np.full(len(group), size)
        live = np.arange(len(group))
        while len(live):
            k = back[place[live], live]
            place[live] -= k
            flat = base[live] + place[live]
            ids = np.empty(len(live), np.int64)
            for size_k in np.unique(k):
                some = k == size_k
                ids[some] = piece[size_k][flat[some]]
            ids = np.where(ids < 0, -1 - cp[flat].astype(np.int64), ids)
            found_word.append(group[live])
            found_at.append(place[live])
            found_id.append(ids)
            live = live[place[live] > 0]
    if not found_word:
        return np.zeros(0, np.int64), np.zeros(len(start), np.int64)
    word, pos, ids = np.concatenate(found_word), np.concatenate(found_at), np.concatenate(found_id)
    order = np.lexsort((pos, word))
    return ids[order], np.bincount(word, minlength=len(start))


class Encoder:
    """Encodes blocks of texts; keeps the ids of up to ``CACHE_WORDS`` words."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _spelled(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, or the unknown id, in place of uncovered characters."""
        bare = ids < 0
        if not bare.any():
            return ids.astype(np.int32), count
        if self.pieces.byte_ids is None:
            return np.where(bare, self.pieces.unknown_id, ids).astype(np.int32), count
        raw = [np.frombuffer(chr(-1 - i).encode("utf-8", "surrogatepass"), np.uint8) for i in ids[bare].tolist()]
        size = np.ones(len(ids), np.int64)
        size[bare] = [len(r) for r in raw]
        out = np.repeat(ids, size)
        out[np.repeat(bare, size)] = self.pieces.byte_ids[np.concatenate(raw)]
        word = np.repeat(np.arange(len(count)), count)
        return out.astype(np.int32), np.bincount(word, weights=size, minlength=len(count)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start and, last, end)."""
        p = self.pieces
        front = MARK if p.prefix else ""
        cp, bounds = codes([front + t.replace(" ", MARK) if t else "" for t in texts])
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        mark = cp == _MARK
        place = np.minimum(np.searchsorted(p.apart, cp), len(p.apart) - 1)
        alone = p.apart[place] != cp
        cut = np.zeros(len(cp), bool)
        cut[1:] = (mark[1:] & ~mark[:-1]) | alone[1:] | alone[:-1]
        cut[bounds[:-1][bounds[:-1] < len(cp)]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(cp)))
        key = Rolling(cp).spans(start, start + length) ^ length.astype(np.uint64)
        kinds, example, at = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self._forget()
        known = self._find(kinds) >= 0
        fresh = example[~known]
        if len(fresh):
            size = length[fresh]
            ids, count = viterbi(cp[ranges(start[fresh], size)], np.cumsum(size) - size, size, p)
            ids, count = self._spelled(ids, count)
            keys = np.concatenate([self.keys, kinds[~known]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])[order]
            self.count = np.concatenate([self.count, count])[order]
            self.ids = np.concatenate([self.ids, ids])
        slot = self._find(kinds)[at]
        count = self.count[slot]
        out = self.ids[ranges(self.start[slot], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        ends = total[np.searchsorted(start, bounds)]
        if p.byte_ids is None:  # unknown characters side by side are one unknown piece
            again = np.zeros(len(out), bool)
            again[1:] = (out[1:] == p.unknown_id) & (out[:-1] == p.unknown_id)
            again[ends[:-1][ends[:-1] < len(out)]] = False
            out, ends = out[~again], ends - np.concatenate([[0], np.cumsum(again)])[ends]
        return out, ends

    def _find(self, kinds: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(kinds), -1)
        at = np.minimum(np.searchsorted(self.keys, kinds), len(self.keys) - 1)
        return np.where(self.keys[at] == kinds, at, -1)


def decode(ids: np.ndarray, ends: np.ndarray, pieces: Pieces) -> list[str]:
    """The text of each run of ids. Bytes that are no UTF-8 become U+FFFD."""
    size = np.array([len(t) for t in pieces.text], np.int64)
    table = np.frombuffer(b"".join(pieces.text), np.uint8)
    first = np.cumsum(size) - size
    own = size[ids]
    raw = table[ranges(first[ids], own)].tobytes()
    at = np.concatenate([[0], np.cumsum(own)])[ends]
    skip = 1 if pieces.prefix else 0
    return [raw[a + (skip if raw[a : a + 1] == b" " else 0) : b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def _mapped(docs: DataFrame, model_file: str, keep: list[str], text_col: str, extra: str, names: tuple[str, ...], fn) -> DataFrame:
    text = unused([*keep, *names], "_text")
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    shipped = docs.sparkSession.sparkContext.broadcast(load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _ENCODERS:
            _ENCODERS[model_file] = Encoder(shipped.value)
        encoder = _ENCODERS[model_file]
        for block in blocks(batches, text):
            texts = column(block, text)
            ids, ends = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in keep], *fn(texts, ids, ends, encoder.pieces)], names=[*keep, *names])

    return mapped(rows, run, f"{ddl(docs.select(*keep))}, {extra}")


def encode(docs: DataFrame, model_file: str, keep: list[str], text_col: str = "text", out: str = "ids") -> DataFrame:
    """The ``keep`` columns and the ids of each text; none for a null or empty text. A row per row of ``docs``."""
    return _mapped(
        docs, model_file, keep, text_col, f"{out} array<int>", (out,),
        lambda texts, ids, ends, p: [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))],
    )


def decoded(coded: DataFrame, model_file: str, keep: list[str], ids_col: str = "ids", out: str = "text") -> DataFrame:
    """The ``keep`` columns and the text of each array of ids; null for null."""
    shipped = coded.sparkSession.sparkContext.broadcast(load(model_file))
    rows = coded.select(*keep, F.col(ids_col).cast("array<int>").alias(ids_col)) if ids_col not in keep else coded.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, ids_col)
            ends = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            flat = np.concatenate([np.asarray(x or (), np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
            texts = [None if x is None else t for x, t in zip(lists, decode(flat, ends, shipped.value), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, out])

    return mapped(rows, run, f"{ddl(coded.select(*keep))}, {out} string")


def checked(docs: DataFrame, model_file: str, keep: list[str], text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each text: ``keep``, n_ids, ids_crc32 (of the ids as
    little-endian 32-bit integers), round_trip (the ids give the text back; a null
    text counts as empty; false where a text holds the space mark itself), and the
    ids if wanted. Kept columns called like a new one stay; the new one then gets an
    underscore in front."""

    def both(texts, ids, ends, p) -> list[pa.Array]:
        back = decode(ids, ends, p)
        raw = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        same = [(t or "") == b for t, b in zip(texts, back, strict=True)]
        out = [pa.array(np.diff(ends), pa.int32()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
        return out + ([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))] if with_ids else [])

    kinds = {"n_ids": "int", "ids_crc32": "long", "round_trip": "boolean"} | ({"ids": "array<int>"} if with_ids else {})
    names: tuple[str, ...] = ()
    for n in kinds:
        names += (unused([*keep, *names], n),)
    kinds = ", ".join(f"{n} {t}" for n, t in zip(names, kinds.values(), strict=True))
    return _mapped(docs, model_file, keep, text_col, kinds, names, both)
