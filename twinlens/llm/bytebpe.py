"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is cut by the tokenizer's pattern; each match is encoded by itself. The leaves of a
word's segment tree are its byte positions. A leaf holds the rank of the
token that starts there joined with the next one (and the position, so equal ranks go to
the leftmost), an inner node the least of its two children, so the root says which pair to
merge next. A merge changes three leaves: the merged token's, its left neighbour's and that of
the token which is gone; each change climbs the tree once.

Words of like length climb together: one row of a matrix is one word's tree, and every
numpy step merges one pair in each word that still has one. Longer words are rare and
use a tree of their own in a list.

Ids are those of the public library for the same ranks and pattern. Its tables of letters
and digits are of one version of Unicode, those of the pattern module here may be
newer: texts with characters that only the newer one knows may be cut otherwise.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.texts import blocks, column, ddl, mapped, ranges, unused

CACHE_WORDS = 250_000
#: Words of more bytes have a tree of their own.
LONG = 64
#: So many trees climb together.
ROWS = 1 << 14
#: Rank of a pair that is no token; also what a leaf without a pair holds.
NONE = 1 << 30
_SHIFT = 32


class Ranks(NamedTuple):
    """A vocabulary as arrays; its size is that of the vocabulary."""

    ids: dict[bytes, int]
    byte_ids: np.ndarray  #: id of each single byte
    pairs: np.ndarray  #: sorted (left id << 32 | right id) of every pair of tokens that joins to a token,
    merged: np.ndarray  #: and the token's id, which is its rank
    text: list[bytes]  #: what each id decodes to


def load(ranks_file: str) -> Ranks:
    """Read a file of lines ``base64(token) rank``."""
    ids = {}
    with open(ranks_file, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ids[base64.b64decode(token)] = int(rank)
    missing = [b for b in range(256) if bytes([b]) not in ids]
    if missing:
        raise ValueError(f"{ranks_file} has no token for byte {missing[0]}")
    if max(ids.values()) >= NONE:
        raise ValueError(f"{ranks_file} has ranks of {NONE} or more")
    found = {}
    for token, rank in ids.items():
        for k in range(1, len(token)):
            left, right = ids.get(token[:k]), ids.get(token[k:])
            if left is not None and right is not None:
                found[left << _SHIFT | right] = rank
    pairs = np.array(sorted(found), np.int64)
    text = [b""] * (max(ids.values()) + 1)
    for token, rank in ids.items():
        text[rank] = token
    return Ranks(ids, np.array([ids[bytes([b])] for b in range(256)], np.int64), pairs, np.array([found[p] for p in pairs.tolist()], np.int64), text)


def joined(left: np.ndarray, right: np.ndarray, ranks: Ranks) -> np.ndarray:
    """The id (and rank) of each pair's join; ``NONE`` where there is no such token."""
    if not len(ranks.pairs):
        return np.full(left.shape, NONE)
    key = left << _SHIFT | right
    at = np.minimum(np.searchsorted(ranks.pairs, key), len(ranks.pairs) - 1)
    return np.where(ranks.pairs[at] == key, ranks.merged[at], NONE)


def merge_together(words: list[bytes], width: int, ranks: Ranks) -> list[bytes]:
    """The ids (little-endian, 32 bits) of words of at most ``width`` bytes, a power of two, one tree each."""
    n = len(words)
    size = np.array([len(w) for w in words])
    filled = np.arange(width) < size[:, None]
    ids = np.zeros((n, width), np.int64)
    ids[filled] = ranks.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    place = np.arange(width)
    tree = np.full((n, 2 * width), NONE << _SHIFT, np.int64)
    rank = np.full((n, width), NONE)
    rank[:, :-1] = np.where(filled[:, 1:], joined(ids[:, :-1], ids[:, 1:], ranks), NONE)
    tree[:, width:] = rank << _SHIFT | place
    for level in range(width.bit_length() - 2, -1, -1):
        a, b = 1 << level, 2 << level
        tree[:, a:b] = np.minimum(tree[:, 2 * a : 2 * b : 2], tree[:, 2 * a + 1 : 2 * b : 2])
    # live neighbours; ``size`` stands for the end, -1 for the start
    after = np.minimum(place + 1, size[:, None])
    before = np.broadcast_to(place - 1, (n, width)).copy()
    alive = filled.copy()
    live = np.flatnonzero(tree[:, 1] >> _SHIFT < NONE)
    while len(live):
        best = tree[live, 1]
        at = best & ((1 << _SHIFT) - 1)
        gone = after[live, at]
        ids[live, at] = best >> _SHIFT
        alive[live, gone] = False
        nxt = after[live, gone]
        after[live, at] = nxt
        inner = nxt < size[live]
        before[live[inner], nxt[inner]] = at[inner]
        right = np.full(len(live), NONE)
        right[inner] = joined(ids[live[inner], at[inner]], ids[live[inner], nxt[inner]], ranks)
        prev = before[live, at]
        has = prev >= 0
        left = joined(ids[live[has], prev[has]], ids[live[has], at[has]], ranks)
        rows = np.concatenate([live, live, live[has]])
        leaf = np.concatenate([at, gone, prev[has]])
        tree[rows, width + leaf] = np.concatenate([right, np.full(len(live), NONE), left]) << _SHIFT | leaf
        node = (width + leaf) >> 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node >>= 1
        live = live[tree[live, 1] >> _SHIFT < NONE]
    flat, ends = ids[alive].astype("<u4").tobytes(), 4 * np.cumsum(alive.sum(1))
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def merge_alone(word: bytes, ranks: Ranks) -> bytes:
    """The ids (little-endian, 32 bits) of one word of any length: the same tree in a list."""
    n = len(word)
    width = 1 << max(1, (n - 1).bit_length())
    ids = ranks.byte_ids[np.frombuffer(word, np.uint8)]
    first = np.full(2 * width, NONE << _SHIFT, np.int64)
    if n > 1:
        first[width : width + n - 1] = joined(ids[:-1], ids[1:], ranks) << _SHIFT | np.arange(n - 1)
    for level in range(width.bit_length() - 2, -1, -1):
        a, b = 1 << level, 2 << level
        first[a:b] = np.minimum(first[2 * a : 2 * b : 2], first[2 * a + 1 : 2 * b : 2])
    tree, token = first.tolist(), ids.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    text, id_of, low, none = ranks.text, ranks.ids, (1 << _SHIFT) - 1, NONE << _SHIFT

    def put(leaf: int, value: int) -> None:
        node = width + leaf
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return  # nothing above changes either
            tree[node] = least
            node >>= 1

    def pair(a: int, b: int) -> int:
        found = id_of.get(text[token[a]] + text[token[b]])
        return none if found is None else found << _SHIFT | a

    while tree[1] < none:
        at = tree[1] & low
        gone = after[at]
        token[at], token[gone] = tree[1] >> _SHIFT, -1
        nxt = after[at] = after[gone]
        put(gone, none)
        if nxt < n:
            before[nxt] = at
            put(at, pair(at, nxt))
        else:
            put(at, none)
        if before[at] >= 0:
            put(before[at], pair(before[at], at))
    return np.array([t for t in token if t >= 0], "<u4").tobytes()


class Encoder:
    """Encodes texts; the ids of a word are kept while it stays in the cache, which
    holds two generations of ``CACHE_WORDS`` words."""

    def __init__(self, ranks: Ranks, pattern: str):
        import regex

        self.ranks = ranks
        self.cut = regex.compile(pattern)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = np.array([len(t) for t in ranks.text], np.int64)
        self.size, self.first, self.table = size, np.cumsum(size) - size, np.frombuffer(b"".join(ranks.text), np.uint8)

    def _learn(self, missing: set[str]) -> None:
        """Ids of words that are in neither generation, as little-endian 32-bit integers."""
        waiting: dict[int, list[tuple[str, bytes]]] = {}
        for word in missing:
            raw = word.encode()
            whole = self.ranks.ids.get(raw)
            if whole is not None:
                self.new[word] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.new[word] = merge_alone(raw, self.ranks)
            else:
                waiting.setdefault(1 << (len(raw) - 1).bit_length(), []).append((word, raw))
        for width, group in waiting.items():
            for at in range(0, len(group), ROWS):
                some = group[at : at + ROWS]
                for (word, _), ids in zip(some, merge_together([raw for _, raw in some], width, self.ranks), strict=True):
                    self.new[word] = ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; none for null."""
        split = [self.cut.findall(t) if t else [] for t in texts]
        if len(self.new) > CACHE_WORDS:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        missing = set().union(*split).difference(new)
        new.update((w, old[w]) for w in missing.intersection(old))
        self._learn(missing.difference(old))
        return [b"".join(map(new.__getitem__, ws)) for ws in split]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes that each run of ids stands for."""
        ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
        own = self.size[ids]
        raw = self.table[ranges(self.first[ids], own)].tobytes()
        ends = np.concatenate([[0], np.cumsum(own)])[np.cumsum([0, *[len(c) // 4 for c in coded]])]
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(ranks_file: str, pattern: str, shipped) -> Encoder:
    """One encoder, with its cache, for all tasks of a Python worker."""
    key = (ranks_file, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(shipped.value, pattern)
    return _ENCODERS[key]


def _mapped(docs: DataFrame, ranks_file: str, pattern: str, keep: list[str], column_: str, kind: str, extra: dict[str, str], fn) -> DataFrame:
    """The ``keep`` columns and what ``fn`` makes of each value of a column; new columns give way to kept names."""
    names = []
    for n in extra:
        names.append(unused([*keep, *names], n))
    own = unused([*keep, *names], "_in")
    rows = docs.select(*keep, F.col(column_).cast(kind).alias(own))
    shipped = docs.sparkSession.sparkContext.broadcast(load(ranks_file))  # as large as the vocabulary
    schema = ", ".join([ddl(docs.select(*keep))] * bool(keep) + [f"`{n}` {t}" for n, t in zip(names, extra.values(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_file, pattern, shipped)
        for block in blocks(batches, own) if kind == "string" else batches:
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in keep], *fn(encoder, column(block, own))], names=[*keep, *names])

    return mapped(rows, run, schema)


def _lists(coded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(c) // 4 for c in coded]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32)))


def encode(docs: DataFrame, ranks_file: str, pattern: str, keep: list[str], text_col: str = "text", out: str = "ids") -> DataFrame:
    """The ``keep`` columns and the ids of each text (array<int>); none for a null or empty
    text. A row per row of ``docs``; a kept column called ``out`` stays and the new one gets an underscore."""
    return _mapped(docs, ranks_file, pattern, keep, text_col, "string", {out: "array<int>"}, lambda e, texts: [_lists(e.encode(texts))])


def decode(coded: DataFrame, ranks_file: str, keep: list[str], ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """The ``keep`` columns and the bytes of each array of ids; null for null. Ids alone need not
    be whole characters, so the result is binary. A null or unknown id fails the job."""

    def run(e: Encoder, lists: list) -> list[pa.Array]:
        found = e.decode([np.asarray(x or (), "<u4").tobytes() for x in lists])
        return [pa.array([None if x is None else b for x, b in zip(lists, found, strict=True)], pa.binary())]

    return _mapped(coded, ranks_file, "", keep, ids_col, "array<int>", {out: "binary"}, run)


def checked(docs: DataFrame, ranks_file: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids: ``keep``, n_tokens, ids_sha256 (lowercase hex of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded bytes) and
    round_trip (these are the text's bytes). A null text counts as empty. A row per row of ``docs``."""

    def both(e: Encoder, texts: list) -> list[pa.Array]:
        coded = e.encode(texts)
        back = e.decode(coded)
        digest = lambda raws: pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string())
        same = [(t or "").encode() == b for t, b in zip(texts, back, strict=True)]
        return [pa.array([len(c) // 4 for c in coded], pa.int64()), digest(coded), digest(back), pa.array(same, pa.bool_())]

    names = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "round_trip": "boolean"}
    return _mapped(docs, ranks_file, pattern, keep, text_col, "string", names, both)
