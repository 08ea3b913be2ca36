"""Token ids in flat unsigned integer files with 64-bit document offsets.

A store is a folder with one group of files per part:

* ``tokens-*.bin``: the ids of all documents of the part, one after the other,
  as little-endian unsigned 16-bit integers if the vocabulary fits, else 32-bit;
* ``offsets-*.bin``: little-endian signed 64-bit integers, one more than the part
  has documents: where each document's ids start within the part;
* ``ids-*.bin``: the documents' ids as signed 64-bit integers (null: -2^63).

``manifest.parquet`` lists the parts in ascending order of document id. A part's
base, the number of ids before it in the whole store, is the prefix sum of the
manifest's counts, so no task needs to know another one's. Files have a name of
their own for each attempt of a task and only the manifest's names count: an
attempt that is lost or runs twice leaves a file that nobody reads.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm.texts import as_batch, blocks, column, mapped
from twinlens.session import fresh_path

NO_ID = -(1 << 63)
CACHE_WORDS = 500_000
#: New words that go to the library as one text.
TOGETHER = 500
#: How a token says that it ends a run, and what runs are in ASCII text.
RUN_END = "</w>"
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Texts of Latin-1 letters, digits, ASCII marks and plain white space: in lower case, what else there is, and runs of marks.
_LATIN_LOW = bytes(b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE else b for b in range(256))
_ODD = bytes(b for b in range(256) if not (b in b"\t\n\r" or 32 <= b < 127 or b >= 0xC0 and b not in (0xD7, 0xF7)))
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")
_RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.IGNORECASE)
MANIFEST = "part int, tokens_file string, offsets_file string, ids_file string, docs long, tokens long"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


class WordEncoder:
    """Ids of whole texts by a tokenizer that never joins text across white space.

    Texts are cut at ASCII white space, and each distinct word is encoded by the
    library once while it stays in the cache, which holds two generations of
    ``CACHE_WORDS`` words. New words go to the library many at a time, as one text with spaces
    between them. The library ends each run of letters, each digit and each run of other characters
    with a token of its own kind, so the number of such runs in a word tells where its ids
    end; it is certain for ASCII words and for words of letters only. ASCII texts are
    lower-cased before, as the library does it anyway, which makes fewer distinct words.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.encoder.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  #: ids that end a run
        self.last[[i for token, i in vocabulary.items() if token.endswith(RUN_END)]] = True
        probe = "Aß, 3x. Ǆ's"
        if [self._alone(w) for w in (probe, probe.lower(), probe.replace(" ", " \n"))] != [sum((self._alone(w) for w in probe.split()), [])] * 3:
            raise ValueError(f"{tokenizer_file} does not lower-case, or joins text across white space")
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.width = np.dtype("<u2") if self.encoder.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    def _alone(self, text: str) -> list[int]:
        return self.encoder.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _runs(word: str) -> int:
        """The number of runs in a word; 0 where it is not certain."""
        if word.isascii():
            if word.isalpha():
                return 1
            return 0 if "<|" in word else len(_RUN.findall(word))
        return int(word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha())

    def _together(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes."""
        texts = [w.decode() for w in words]
        runs = np.array([self._runs(t) for t in texts], np.int64)
        out, size = [b""] * len(words), self.width.itemsize
        sure = np.flatnonzero(runs > 0)
        groups = [sure[at : at + TOGETHER] for at in range(0, len(sure), TOGETHER)]
        alone = np.flatnonzero(runs == 0).tolist()
        for group, enc in zip(groups, self.encoder.encode_batch_fast([" ".join([texts[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids, own = np.array(enc.ids, np.int64), np.cumsum(runs[group])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != own[-1]:  # the library knows other letters
                alone += group.tolist()
                continue
            raw, cut = ids.astype(self.width).tobytes(), ends[own - 1] * size
            for k, a, b in zip(group.tolist(), np.append(0, cut[:-1]).tolist(), cut.tolist(), strict=True):
                out[k] = raw[a:b]
        for k, enc in zip(alone, self.encoder.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False), strict=True):
            out[k] = np.array(enc.ids, self.width).tobytes()
        return out

    @staticmethod
    def _words(text: str) -> list[bytes]:
        """The words of a text, with the ids of the text."""
        if "<|" in text:  # special tokens have their own case
            return text.encode().split()
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:  # letters before combining marks compose otherwise in lower case
            return text.encode().split()
        ascii_only = text.isascii()
        if len(raw.translate(None, _ODD)) == len(raw):
            raw = _MARKS.sub(rb" \g<0>", raw.translate(_LATIN_LOW))
            return (raw if ascii_only else raw.decode("latin-1").encode()).split()
        return (raw.translate(_LOW) if ascii_only else text.encode()).split()

    def encode(self, texts: list[str | None], end: int | None = None) -> list[bytes]:
        """The ids of each text as bytes, with ``end`` after them."""
        tail = b"" if end is None else np.array([end], self.width).tobytes()
        split = [self._words(t) if t else [] for t in texts]
        if len(self.new) > CACHE_WORDS:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        missing = set().union(*split).difference(new)
        fresh = list(missing.difference(old))
        if len(fresh) < len(missing):
            new.update((w, old[w]) for w in missing.difference(fresh))
        new.update(zip(fresh, self._together(fresh), strict=True))
        return [b"".join(map(new.__getitem__, ws)) + tail for ws in split]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(tokenizer_file: str) -> WordEncoder:
    """One encoder, with its cache, for all tasks of a Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = WordEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def write_store(
    docs: DataFrame, path: str, tokenizer_file: str, end: int | None = None, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Encode ``docs`` in ascending order of id (null ids first, equal ids by the
    digest of their text) and write a store below ``path``, which all executors
    must reach. A null text has no ids but ``end``. Ids are whole numbers above -2^63, which
    stands for null; other ids fail the job. Returns ``path``."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = pa.schema(
        [("part", pa.int32()), ("tokens_file", pa.string()), ("offsets_file", pa.string()), ("ids_file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = word_encoder(tokenizer_file)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, base = _store(path)
        files = [f"{kind}-{part:06d}-{name}.bin" for kind in ("tokens", "offsets", "ids")]
        outs, docs_n, at = None, 0, 0
        for block in blocks(batches, "text"):
            if outs is None:
                fs.create_dir(base, recursive=True)
                outs = [fs.open_output_stream(f"{base}/{f}") for f in files]
                outs[1].write(np.zeros(1, "<i8").tobytes())
            coded = encoder.encode(column(block, "text"), end)
            offsets = at + np.cumsum([len(c) // encoder.width.itemsize for c in coded])
            outs[0].write(b"".join(coded))
            outs[1].write(offsets.astype("<i8").tobytes())
            outs[2].write(np.array([NO_ID if i is None else i for i in column(block, "doc_id")], "<i8").tobytes())
            at, docs_n = int(offsets[-1]), docs_n + len(coded)
        if outs is not None:
            for o in outs:
                o.close()
            yield as_batch(schema, [part], *[[f] for f in files], [docs_n], [at])

    mapped(rows, write, MANIFEST).write.parquet(f"{path}/manifest.parquet")
    return path


def manifest(spark: SparkSession, path: str) -> list[dict]:
    """The parts in order, each with its base: a row per part, summed on the driver."""
    rows = [r.asDict() for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest.parquet").orderBy("part").collect()]
    bases = accumulate((r["tokens"] for r in rows), initial=0)
    firsts = accumulate((r["docs"] for r in rows), initial=0)
    return [r | {"base": b, "first_doc": d} for r, b, d in zip(rows, bases, firsts)]  # noqa: B905


def open_part(path: str, part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token ids, offsets, document ids) of a part: memory-mapped where the folder is a mounted one."""
    fs, base = _store(path)

    def load(name: str, dtype: str) -> np.ndarray:
        whole = f"{base}/{name}"
        size = fs.get_file_info(whole).size
        if not size:
            return np.zeros(0, dtype)
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(whole, dtype, "r")
        with fs.open_input_file(whole) as f:
            return np.frombuffer(f.read_buffer(), dtype)

    size = fs.get_file_info(f"{base}/{part['tokens_file']}").size
    width = "<u4" if part["tokens"] and size // part["tokens"] == 4 else "<u2"
    return load(part["tokens_file"], width), load(part["offsets_file"], "<i8"), load(part["ids_file"], "<i8")


def read_store(spark: SparkSession, path: str, with_ids: bool = False, rows_per_batch: int = 2000) -> DataFrame:
    """One row per document, read from the files: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit
    integers) and, if wanted, the ids."""
    parts = manifest(spark, path)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    if not parts:
        return spark.createDataFrame([], ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                tokens, offsets, ids = open_part(path, part)
                for at in range(0, part["docs"], rows_per_batch):
                    off = np.asarray(offsets[at : at + rows_per_batch + 1])
                    some = np.asarray(tokens[off[0] : off[-1]]).astype("<u4")
                    own = off - off[0]
                    raw = memoryview(some).cast("B")
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                    doc = [None if i == NO_ID else i for i in np.asarray(ids[at : at + rows_per_batch]).tolist()]
                    cols = [doc, part["base"] + off[:-1], np.diff(off), crc]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(some, pa.int64())))
                    yield as_batch(schema, *cols)

    listed = spark.createDataFrame(
        [(p["part"], p["tokens_file"], p["offsets_file"], p["ids_file"], p["docs"], p["tokens"], p["base"]) for p in parts], MANIFEST + ", base long"
    )
    return listed.repartition(max(1, min(len(parts), 4096)), "part").mapInArrow(read, ddl)


def round_trip(docs: DataFrame, tokenizer_file: str, end: int | None = None) -> DataFrame:
    """Write a store to the shared folder and read it back."""
    spark = docs.sparkSession
    return read_store(spark, write_store(docs, fresh_path(spark, "tokens"), tokenizer_file, end))


