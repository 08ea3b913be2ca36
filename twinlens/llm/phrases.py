"""Collocations counted over a prefix-free parse.

Each text becomes a row of tokens: its lower-cased words, and a break wherever
punctuation or a line end lies between two of them. A window of ``WINDOW`` tokens whose hash
has its low bits clear is a trigger. Chunks run from one trigger to the end of the next,
so neighbours overlap by a trigger, and where they are cut depends on the words there
only: a passage that many texts share is cut alike in all of them. Equal chunks become one
entry of a dictionary with its parse frequency. Phrases are then counted
inside the distinct chunks, weighted by frequency; a phrase counts in the chunk where it starts
before the closing trigger, which gives every occurrence exactly one chunk, as no phrase
is longer than a trigger and one word.

Phrases of two words are counted by the low bits of their hash first, those of three only where both their
pairs are frequent, and single words only where they are part of a frequent pair. Bitmaps of
a fixed size tell what may be frequent; more phrases fill them and let more through, which
costs time and changes nothing, as the last pass counts the phrases themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.llm.bitmaps import added, bitmap, marked
from twinlens.llm.texts import Rolling, as_batch, blocks, column, mapped, mixed, ranges
from twinlens.operators.hotkeys import lookup
from twinlens.session import stored

#: Words of a phrase, at most; a trigger has one token less.
LONGEST = 3
WINDOW = LONGEST - 1
#: One window in so many is a trigger (a power of two).
RATE = 16
#: Characters that end a piece, and those between words.
BREAKS = ".,;:!?\n\v\f\r"
SPACES = " \t"
LEAST_COUNT = 10
#: A phrase goes if a longer candidate around it has this share (in hundredths) of its occurrences.
COVERED = 50
TOP = 2000
NO_LANGUAGE = "und"
#: Bits of a map of hashes.
MAP_BITS = 1 << 25
#: Bits of a hash by which it is counted, the low 24 of them within a bucket; at least those of a map.
KEY_BITS = 36
#: Hashes that a task gathers before it adds them up.
GATHERED = 1 << 21
#: Bytes of chunks that are looked at together.
CHUNK_BYTES = 3 << 20
#: A language's phrases are ranked in so many parts first.
RANK_PARTS = 64
_BREAK = np.uint64(0x1D8E4E27C47D124F)  # the hash of a break token
_STEP = np.uint64(0x9E3779B97F4A7C15)

_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in SPACES]] = 1
_CLASS[[ord(c) for c in BREAKS]] = 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in a row."""
    return mixed(a * _STEP ^ mixed(b + _STEP))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every run of bytes that are neither space nor break."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _CLASS[data] == 0
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    return start, end, Rolling(data).spans(start, end) if len(start) else np.zeros(0, np.uint64)


def parse(texts: list[str | None], rate: int = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of all texts: (text, where the chunk starts and ends in) and bytes. In a chunk
    words are followed by a space or, as a break, a new line; a text's last one ends with two breaks."""
    raw = [(t or "").encode() for t in texts]
    data = _LOW[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    start, end, h = _words(data)
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros((2, 0), np.int64), np.zeros(0, np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    doc = np.searchsorted(ends, start, side="right")
    broken = np.concatenate([[0], np.cumsum(_CLASS[data] == 2)])
    last = np.append(doc[1:] != doc[:-1], True)
    brk = np.append(broken[start[1:]] > broken[end[:-1]], True)  # a break follows the word
    # tokens: every word, its break, and a second break after a text's last word
    size = 1 + brk + last
    token = np.cumsum(size) - size
    total = int(size.sum())
    tok = np.full(total, _BREAK)
    tok[token] = h
    tok_doc = np.repeat(doc, size)
    # the words and what follows them, as bytes
    length = end - start + 1 + last
    at = np.cumsum(length) - length
    out = np.full(int(length.sum()), 32, np.uint8)
    out[ranges(at, end - start)] = data[ranges(start, end - start)]
    after = at + (end - start)
    out[after[brk]] = 10
    out[after[last] + 1] = 10
    tok_start, tok_end = np.zeros(total, np.int64), np.zeros(total, np.int64)
    tok_start[token], tok_end[token] = at, after
    own = token[brk] + 1
    tok_start[own], tok_end[own] = after[brk], after[brk] + 1
    own = token[last] + 2
    tok_start[own], tok_end[own] = after[last] + 1, after[last] + 2
    # triggers: windows of two tokens of one text, and the two breaks at its end
    window = np.flatnonzero(tok_doc[1:] == tok_doc[:-1])
    first = np.searchsorted(tok_doc, tok_doc[window])
    trigger = (_pairs(tok[window], tok[window + 1]) & np.uint64(rate - 1)) == 0
    trigger |= np.append(tok_doc[1:] != tok_doc[:-1], True)[window + 1]
    close = window[trigger & (window > first)]
    same = np.zeros(len(close), bool)
    same[1:] = tok_doc[close[1:]] == tok_doc[close[:-1]]
    opening = np.where(same, np.append(-1, close[:-1]), np.searchsorted(tok_doc, tok_doc[close]))
    return tok_doc[close], np.stack([tok_start[opening], tok_end[close + 1]]), out


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rate: int = RATE) -> DataFrame:
    """(lang, chunk, n): the distinct chunks of each language and how often the parse has them."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            doc, (a, b), data = parse(column(block, "text"), rate)
            if len(doc):
                size = b - a
                ends = np.concatenate([[0], np.cumsum(size)])
                wide = pa.Array.from_buffers(pa.large_string(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[ranges(a, size)])])
                yield pa.RecordBatch.from_arrays([block.column("lang").take(pa.array(doc)), wide.cast(pa.string())], names=["lang", "chunk"])

    return mapped(rows, run, "lang string, chunk string").groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("n"))


def gathered(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of chunks put together up to about ``limit`` bytes."""
    kept, size = [], 0
    for block in blocks(batches, "chunk", limit):
        own = block.nbytes
        if kept and size + own > limit:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, size = [], 0
        kept.append(block)
        size += own
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


class Grams:
    """The phrases that count in the chunks of a block."""

    def __init__(self, block: pa.RecordBatch):
        chunks = column(block, "chunk")
        raw = [c.encode() for c in chunks]
        self.data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        size = np.array([len(r) + 1 for r in raw], np.int64)
        start, end, h = _words(self.data)
        ends = np.cumsum(size)
        chunk = np.searchsorted(ends, start, side="right")
        # tokens before each byte: one per word and one per new line
        breaks = np.concatenate([[0], np.cumsum(self.data == 10)])
        before = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(self.data) + 1))]) + np.append(breaks, breaks[-1])
        token = before[start]
        closing = before[ends[chunk]] - WINDOW
        self.start, self.end, self.chunk, self.token = start, end, chunk, token
        self.counts = token < closing  # else it counts in the chunk that follows
        self.weight = np.asarray(block.column("n").to_numpy(zero_copy_only=False), np.int64)
        seed = np.asarray(block.column("seed").to_numpy(zero_copy_only=False), np.int64).view(np.uint64)[chunk]
        self.word = mixed(h + seed)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, hash) of each phrase of so many words."""
        k = size - 1
        at = np.flatnonzero(self.counts[: len(self.start) - k or None]) if len(self.start) > k else np.zeros(0, np.int64)
        at = at[at + k < len(self.start)]
        at = at[(self.chunk[at + k] == self.chunk[at]) & (self.token[at + k] == self.token[at] + k)]
        h = self.word[at]
        for j in range(1, size):
            h = _pairs(h, self.word[at + j])
        return at, h

    def of_pairs(self, bits: np.ndarray) -> np.ndarray:
        """Hashes of the words of all pairs in the map, each once."""
        near = np.flatnonzero((self.chunk[1:] == self.chunk[:-1]) & (self.token[1:] == self.token[:-1] + 1))
        near = near[marked(_pairs(self.word[near], self.word[near + 1]), bits)]
        return np.unique(np.concatenate([self.word[near], self.word[near + 1]]))

    def both_pairs(self, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Whether both pairs of the three words from each place on are in the map."""
        pair = _pairs(self.word[:-1], self.word[1:])
        return marked(pair[at], bits) & marked(pair[at + 1], bits)


def _packed(key: np.ndarray, n: np.ndarray, kind: int, least: int) -> pa.RecordBatch:
    """Ascending hashes of ``KEY_BITS``, a row for each bucket. Counts end at ``least``, as no more is asked of them."""
    bucket = (key >> np.uint64(24)).astype(np.int64) + (kind << (KEY_BITS - 24))
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(key)])
    ends = np.append(first, len(key))
    count = np.minimum(n, least).astype(np.min_scalar_type(least))
    low = np.ascontiguousarray(key.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    cells = lambda data, size: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), cells(low, 3), cells(count, count.itemsize)], names=["bucket", "low", "n"])


def _unpacked(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(kind and hash, count) of rows of ``_packed``."""
    low = np.frombuffer(b"".join(column(batch, "low")), np.uint8).reshape(-1, 3).astype(np.uint64)
    n = np.frombuffer(b"".join(column(batch, "n")), np.min_scalar_type(least)).astype(np.int64)
    size = pc.binary_length(batch.column("low")).to_numpy(zero_copy_only=False) // 3
    bucket = np.repeat(batch.column("bucket").to_numpy(zero_copy_only=False).astype(np.uint64), size)
    return bucket << np.uint64(24) | low[:, 2] << np.uint64(16) | low[:, 1] << np.uint64(8) | low[:, 0], n


def _frequent(chunks: DataFrame, pick, least: int) -> DataFrame:
    """(kind, h): the low ``KEY_BITS`` of hashes that are counted at least so often. ``pick`` gives (hashes, counts)
    of each kind for a block of chunks. What travels is four bytes or so for each hash of a task; hashes alike in their low
    bits count as one, so some that are rarer may be told as well."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for block in gathered(batches):
            for kind, (h, n) in enumerate(pick(Grams(block))):
                own = kept.setdefault(kind, [])
                own.append((h & np.uint64((1 << KEY_BITS) - 1), n))
                if sum(len(h) for h, _ in own) > GATHERED:
                    own[:] = [added(own)]
                    if len(own[0][0]) > GATHERED // 2:
                        yield _packed(*own[0], kind, least)
                        own.clear()
        for kind, own in kept.items():
            if own:
                yield _packed(*added(own), kind, least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("h", pa.int64())])

        def often(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            key, n = added([(key, n)])
            key = key[n >= least].astype(np.int64)
            return as_batch(schema, (key >> KEY_BITS).astype(np.int32), key & ((1 << KEY_BITS) - 1))

        key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            more = _unpacked(batch, least)
            key, n = np.concatenate([key, more[0]]), np.concatenate([n, more[1]])
            # the last bucket may go on in the next batch
            open_ = key >> np.uint64(24) == np.uint64(batch.column("bucket")[-1].as_py())
            yield often(key[~open_], n[~open_])
            key, n = key[open_], n[open_]
        yield often(key, n)

    packed = mapped(chunks, tell, "bucket long, low binary, n binary")
    return mapped(packed.repartition("bucket").sortWithinPartitions("bucket"), count, "kind int, h long")


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, rate: int = RATE) -> DataFrame:
    """(lang, words, phrase, n): all phrases of 2 to ``LONGEST`` words that occur at least ``least``
    times, the words they are made of (and some others), and with 0 words and an empty phrase the number of
    all words of the language. Null texts are empty."""
    spark = docs.sparkSession
    chunks = stored(dictionary(docs, text_col, lang_col, rate), "chunks").withColumn("seed", F.xxhash64("lang"))

    def pairs(g: Grams) -> list[tuple[np.ndarray, np.ndarray]]:
        at, h = g.of(2)
        return [(h, g.weight[g.chunk[at]])]

    two = spark.sparkContext.broadcast(bitmap(_frequent(chunks, pairs, least), MAP_BITS))

    def triples_and_words(g: Grams) -> list[tuple[np.ndarray, np.ndarray]]:
        at, h = g.of(3)
        likely = g.both_pairs(at, two.value)
        own = g.of_pairs(two.value)
        return [(h[likely], g.weight[g.chunk[at[likely]]]), (own, np.full(len(own), least, np.int64))]

    found = stored(_frequent(chunks, triples_and_words, least), "frequent")
    three, one = (spark.sparkContext.broadcast(bitmap(found.where(F.col("kind") == kind), MAP_BITS)) for kind in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "words", "phrase", "n"]
        for block in gathered(batches):
            g = Grams(block)
            langs = block.column("lang")
            every, _ = g.of(1)
            total = np.bincount(g.chunk[every], weights=g.weight[g.chunk[every]], minlength=block.num_rows).astype(np.int64)
            sums = pa.table({"lang": langs, "n": total}).group_by("lang").aggregate([("n", "sum")])
            yield pa.RecordBatch.from_arrays([sums["lang"].combine_chunks(), pa.array([0] * len(sums), pa.int32()), pa.array([""] * len(sums)), sums["n_sum"].combine_chunks()], names=names)
            for size, bits in ((1, one), (2, two), (3, three)):
                at, h = g.of(size)
                likely = marked(h, bits.value)
                if size == 3:
                    likely &= g.both_pairs(at, two.value)
                at, h = at[likely], h[likely]
                if not len(at):
                    continue
                order = np.argsort(h, kind="stable")
                new = np.append(True, h[order][1:] != h[order][:-1])
                n = np.add.reduceat(g.weight[g.chunk[at]][order], np.flatnonzero(new))
                first = at[order[new]]
                a, length = g.start[first], g.end[first + size - 1] - g.start[first]
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                text = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(g.data[ranges(a, length)])])
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(g.chunk[first])), pa.array(np.full(len(first), size, np.int32)), text, pa.array(n)], names=names)

    found = mapped(chunks, run, "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return found.where((F.col("words") < 2) | (F.col("n") >= least))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (left right)), exact for counts below 10^15."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of ``counts`` that no longer one covers."""
    word = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(word, a, n), " ")
    many = found.where("words > 1")
    # each cut looks up its two parts
    entry = lambda cut, side, text: F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), text.alias("part"))
    cuts = F.when(F.col("words") == 2, F.array(entry(1, "l", part(1, 1)), entry(1, "r", part(2, 1)))).otherwise(
        F.array(entry(1, "l", part(1, 1)), entry(1, "r", part(2, 2)), entry(2, "l", part(1, 2)), entry(2, "r", part(3, 1)))
    )
    asked = stored(many.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(cuts).alias("e")).select("lang", "phrase", "words", "a", "e.*"), "parts")
    known = lookup(asked, found.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("c")), ["lang", "part"])
    sides = known.groupBy("lang", "phrase", "words", "a", "cut").agg(F.max(F.when(F.col("side") == "l", F.col("c"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("c"))).alias("r"))
    best = sides.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("s"))
    inner = many.where("words = 3").select("lang", F.col("n").alias("longer"), F.explode(F.array(part(1, 2), part(2, 2))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("a")))
    return free.select("lang", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), F.col("s.score").alias("score"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, top: int = TOP, rate: int = RATE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score,
    then count (both descending), then phrase.

    A null language is ``und``, a null text is empty; rows alike count each. A text without two
    words in a piece adds to n only, and an empty table gives no row. Other columns play no part."""
    found = stored(counts(docs, text_col, lang_col, least, rate), "phrases")
    n = found.where("words = 0").select("lang", "n")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the last window reads RANK_PARTS * top rows of a language at most, however many there are
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = scored(found).withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
