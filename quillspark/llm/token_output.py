"""Token ids as binary files, with a shared zstandard dictionary.

Documents are range-partitioned and sorted by id, encoded with a tokenizer of
the ``tokenizers`` library, and written as segments.  A segment is one binary
value::

    magic "QTOK1"  | width of an id in bytes (1) | hash of the dictionary (8)
    | n documents (4) | n null marks (1 each) | n ids of documents (8 each)
    | n + 1 offsets of frames (8 each) | n token counts (4 each)
    | n zstandard frames, one for each document

Numbers are little-endian.  One document is read by its offset alone, without
decompressing others.  The dictionary is trained on the serialized id arrays
of a bounded sample and is stored beside the segments; a reader refuses a
segment that names another one.  Segments are written by Spark's own Parquet writer (columns file,
segment, n_tokens, payload), so that they reach any store that Spark writes
to, and a lost executor's output is written again as a whole.

The encoder cuts texts only where the tokenizer's pattern always ends a
pre-token (single spaces and line breaks between visible characters; a comma
or full stop behind an ASCII letter).  Distinct pieces go to the tokenizer
once; the ids are those of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnp as T
from .common import scratch_path, shuffle_partitions, small_batches, table, tidy

MAGIC = b"QTOK1"
END = 0
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 20_000, 64 << 10
#: Distinct pieces that one Python process remembers, and bytes of text that it encodes at once.
CACHE, PIECE = 700_000, 512 << 10
#: New pieces that go to the tokenizer at once.
AT_ONCE = 8192
SEGMENT_TOKENS = 1_000_000
LEVEL = 3


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_solid = np.zeros(256, bool)
_solid[0x21:0x7F] = True
_begins = _solid.copy()
_begins[0xC3:0xF5] = True
_begins[[0xE1, 0xE2, 0xE3]] = False
_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True


def cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin, the beginnings of non-empty texts included."""
    n = len(raw)
    start = np.zeros(n + 1, bool)
    if n > 2:
        wide = np.zeros(n + 3, np.uint8)
        wide[3:] = raw
        back = wide[2 : n + 2]  # the byte before
        ends = _solid[back] | ((back >= 0x80) & (wide[1 : n + 1] != 0xC2) & ~np.isin(wide[:n], (0xE1, 0xE2, 0xE3)))
        follows = np.zeros(n, bool)
        follows[:-1] = _begins[raw[1:]]
        first = np.zeros(n, bool)
        first[off[:-1][off[:-1] < n]] = True
        last = np.zeros(n, bool)
        last[off[1:][off[1:] > 0] - 1] = True
        alone = ends & follows & ~first & ~last
        start[:n] = alone & ((raw == 0x20) | (raw == 0x0A))
        start[1:] |= alone & (raw == 0x0A)
        start[:n] |= ((raw == 0x2E) | (raw == 0x2C)) & _letter[back]
    if n:
        start[off[:-1]] = True
    return np.flatnonzero(start[:n])


def _cuttable(tokenizer) -> bool:
    """Whether ``cuts`` holds for a tokenizer: the common byte-level pattern, nothing before it, and no special token that a cut could part."""
    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    tokens = [t["content"] for t in spec.get("added_tokens", [])]
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(c in t for t in tokens for c in " \n.,")


class _Grown:
    """An array that grows at its end; what lies behind its values is 0."""

    def __init__(self, dtype, *first):
        self.data, self.n = np.zeros(1 << 12, dtype), 0
        self.add(np.array(first, dtype))

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end + 16 > len(self.data):
            data = np.zeros((end + end // 2) // 16 * 16 + 64, self.data.dtype)
            data[: self.n] = self.data[: self.n]
            self.data = data
        self.data[self.n : end] = values
        self.n = end


class Encoder:
    """Encodes texts piece by piece and remembers the ids of pieces; a piece is known by its bytes, which its hash only finds."""

    def __init__(self, path: str):
        # Tasks fill the cores; threads of the library's own would take memory without sparing time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.cuttable = _cuttable(self.tokenizer)
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        # Of each slot: where its ids begin and how many there are, where its bytes begin and how many.  Slot 0 is the end id, without bytes.
        self.begin, self.length, self.flat = _Grown(np.int64, 0), _Grown(np.int32, 1), _Grown(f"<u{self.width}", END)
        self.text_at, self.text_size, self.text = _Grown(np.int64, 0), _Grown(np.int32, 0), _Grown(np.uint8)
        self.used = _Grown(bool, True)

    def _forget(self) -> None:
        """Drops the pieces that came only once, and all of them where most came again."""
        keep = self.used.data[self.slot]
        keys, slot = self.keys[keep], self.slot[keep]
        parts = [(g.data[slot].astype(np.int64), n.data[slot].astype(np.int64), v.data) for g, n, v in ((self.begin, self.length, self.flat), (self.text_at, self.text_size, self.text))]
        self._reset()
        if len(keys) > CACHE // 2:
            return
        for (begin, length, values), (g, n, v) in zip(parts, ((self.begin, self.length, self.flat), (self.text_at, self.text_size, self.text)), strict=True):
            g.add(v.n + np.cumsum(length) - length)
            n.add(length)
            v.add(values[T.ragged(begin, length)])
        self.used.add(np.zeros(len(keys), bool))
        self.keys, self.slot = keys, np.arange(1, len(keys) + 1, dtype=np.int32)

    def _add(self, pieces: list[bytes], keys: np.ndarray | None = None) -> np.ndarray:
        """Slots of new pieces; those with (ascending) keys are found again."""
        ids = []
        # The library's own records of a piece are large, so only some are alive at once.
        for lo in range(0, len(pieces), AT_ONCE):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces[lo : lo + AT_ONCE]], add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        size = np.fromiter(map(len, pieces), np.int32, len(pieces))
        slot = np.arange(self.begin.n, self.begin.n + len(ids), dtype=np.int32)
        self.begin.add(self.flat.n + np.cumsum(length, dtype=np.int64) - length)
        self.length.add(length)
        self.flat.add(np.fromiter(chain.from_iterable(ids), self.flat.data.dtype, int(length.sum())))
        self.text_at.add(self.text.n + np.cumsum(size, dtype=np.int64) - size)
        self.text_size.add(size)
        self.text.add(np.frombuffer(b"".join(pieces), np.uint8))
        self.used.add(np.zeros(len(pieces), bool))
        if keys is not None:
            at = np.searchsorted(self.keys, keys)
            self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slot)
        return slot

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its end id, and the offsets of the texts in them."""
        n = len(off) - 1
        start = cuts(raw, off) if self.cuttable else np.unique(off[:-1][np.diff(off) > 0])
        words = T.Words.__new__(T.Words)
        words.raw, words.key, words.start, words.end = raw, 0, start, np.append(start[1:], len(raw)) if len(start) else start
        first = np.searchsorted(start, off)
        u, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self._forget()
        where = np.searchsorted(self.keys, u)
        known = np.zeros(len(u), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == u[inside]
        self.used.data[self.slot[where[known]]] = True
        if not known.all():
            data = raw.tobytes()
            new = np.flatnonzero(~known)
            self._add([data[a:b] for a, b in zip(start[at[new]].tolist(), words.end[at[new]].tolist(), strict=True)], u[new])
        slots = self.slot[np.searchsorted(self.keys, u)][inverse] if len(u) else np.zeros(0, np.int64)
        size = words.end - words.start
        same = size == self.text_size.data[slots]
        same[same] = T.same_bytes(raw, start[same], self.text.data, self.text_at.data[slots[same]], size[same], self.text.data.view("<u8"))
        if not same.all():
            # Other bytes under the same hash: encoded by themselves.
            other = np.flatnonzero(~same)
            slots[other] = self._add([raw[start[i] : words.end[i]].tobytes() for i in other.tolist()])
        slots = np.insert(slots, first[1:], 0)
        length = self.length.data[slots]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat.data[T.ragged(self.begin.data[slots], length)]
        return ids, total[first + np.arange(n + 1)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for each Python process, so that its tasks share what it remembers."""
    return Encoder(path)


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """From the first ``SAMPLE_DOCS`` documents by a hash of id and text: of each a slice of up to ``SAMPLE_CHARS`` characters, at a place that the hash gives."""
    drawn = docs.select("text", F.xxhash64("doc_id", "text", F.lit("dictionary")).alias("drawn"))
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    slices = drawn.select("drawn", F.col("text").substr((F.pmod("drawn", room) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    # Each task keeps its first ones, so no more than that many a task are merged.
    text = slices.orderBy("drawn", "text").limit(SAMPLE_DOCS).toArrow()["text"].combine_chunks()
    encoder, samples = Encoder(path), []
    for _, _, raw, off in T.pieces(text):
        ids, at = encoder(raw, off)
        ids = ids.astype(f"<u{encoder.width}")
        samples += [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or b"\0" * 8)[-DICTIONARY_BYTES:]


def _hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:8]


def pack(doc_ids: np.ndarray, null: np.ndarray, ids: list[np.ndarray], compressor, width: int, digest: bytes) -> bytes:
    frames = [compressor.compress(x.astype(f"<u{width}").tobytes()) for x in ids]
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    return b"".join([MAGIC, bytes([width]), digest, struct.pack("<I", len(ids)), null.astype(np.uint8).tobytes(), doc_ids.astype("<i8").tobytes(), offsets.tobytes(), np.array([len(x) for x in ids], "<u4").tobytes(), *frames])


class Segment:
    """Reads a payload; ``segment[i]`` decompresses one document."""

    def __init__(self, payload: bytes, dictionary: bytes):
        if payload[:5] != MAGIC or payload[6:14] != _hash(dictionary):
            raise ValueError("not a segment of this dictionary")
        self.width, self.n = payload[5], struct.unpack_from("<I", payload, 14)[0]
        at, n = 18, self.n
        self.null = np.frombuffer(payload, np.uint8, n, at).astype(bool)
        self.doc_ids = np.frombuffer(payload, "<i8", n, at + n)
        self.offsets = np.frombuffer(payload, "<u8", n + 1, at + 9 * n).astype(np.int64)
        self.counts = np.frombuffer(payload, "<u4", n, at + 17 * n + 8).astype(np.int64)
        self.base, self.payload = at + 21 * n + 8, payload
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> np.ndarray:
        frame = memoryview(self.payload)[self.base + self.offsets[i] : self.base + self.offsets[i + 1]]
        return np.frombuffer(self.decompressor.decompress(frame), f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, where: str, path: str | None = None) -> bytes:
    """Writes doc_id, text as segments into ``where``; returns the dictionary (also stored there).

    Null text: the end id alone.  Null doc_id: marked, sorted first.  Repeated
    rows are written as often as they come, rows of one id (or none) in order of a hash of the text, so that
    they are dealt over tasks as well.  Ids are integers (others fail).
    An empty table gives a folder without segments.  Other columns are ignored.
    """
    path = path or default_tokenizer()
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, path)

    def run(batches):
        from pyspark import TaskContext

        encoder, digest = encoder_of(path), _hash(dictionary)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        file, number = TaskContext.get().partitionId(), 0
        keys, nulls, held, size = [], [], [], 0

        def flush():
            nonlocal keys, nulls, held, size, number
            payload = pack(np.array(keys, np.int64), np.array(nulls, bool), held, compressor, encoder.width, digest)
            out = pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "segment": pa.array([number], pa.int32()), "n_tokens": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})
            keys, nulls, held, size = [], [], [], 0
            number += 1
            return out

        for batch in batches:
            column = batch.column(0)
            ids_of, null = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
            for lo, hi, raw, off in T.pieces(batch.column(1), PIECE):
                ids, at = encoder(raw, off)
                keys += ids_of[lo:hi].tolist()
                nulls += null[lo:hi].tolist()
                held += [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                size += len(ids)
                if size >= SEGMENT_TOKENS:
                    yield flush()
        if held:
            yield flush()

    docs = docs.withColumn("salt", F.xxhash64("text"))
    ordered = docs.repartitionByRange(shuffle_partitions(spark), "doc_id", "salt").sortWithinPartitions("doc_id", "salt", "text").select("doc_id", "text")
    with small_batches(spark):
        ordered.mapInArrow(tidy(run), "file int, segment int, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{where}/segments")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{where}/dictionary")
    return dictionary


def read(spark, where: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of what ``write`` left in ``where``; start counts the ids of all documents before."""
    return _read(spark, where, "ids array<int>", lambda x: x.view("<i4"), pa.list_(pa.int32()))


def _read(spark, where: str, field: str, value, kind) -> DataFrame:
    dictionary = bytes(spark.read.parquet(f"{where}/dictionary").first()["dictionary"])
    segments = spark.read.schema("file int, segment int, n_tokens long, payload binary").parquet(f"{where}/segments")
    # One row for each file that was written, not for each document.
    files = segments.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    inside = segments.select("file", "segment", "n_tokens").withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = inside.join(files, "file").select("file", "segment", (F.col("before") + F.col("file_start")).alias("begin"))
    name = field.split()[0]

    def run(batches):
        for batch in batches:
            for begin, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(payload.as_py(), dictionary)
                start = begin + np.cumsum(s.counts) - s.counts
                for lo in range(0, len(s), 2000):
                    hi = min(lo + 2000, len(s))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(s.doc_ids[lo:hi], mask=s.null[lo:hi]), "start": pa.array(start[lo:hi]), "n_tokens": pa.array(s.counts[lo:hi]), name: pa.array([value(s[i]) for i in range(lo, hi)], kind)})

    joined = segments.select("file", "segment", "payload").join(starts, ["file", "segment"]).select("begin", "payload")
    return joined.mapInArrow(tidy(run), f"doc_id long, start long, n_tokens long, {field}")


def write_and_digest(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    where = scratch_path(spark, "tokens")
    write(docs, where)
    return _read(spark, where, "ids_crc32 long", lambda x: zlib.crc32(x.tobytes()), pa.int64())


def query(spark, sf_dir: str) -> DataFrame:
    return write_and_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
