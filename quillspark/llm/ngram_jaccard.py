"""N-gram Jaccard join by parity sketches.

Two documents link if the Jaccard similarity of their sets of 5-word shingles
is 0.8 or more, so that they differ in at most D = (|A| + |B|) // 9 shingles.

Sketches.  Within a size band a document's shingles are dealt over m > D
segments by hash, and each segment is the XOR (parity) of its shingles'
64-bit hashes.  D differing shingles touch at most D segments, so by the pigeonhole
principle linked documents agree in at least m - D segments.  They are joined on
(band, segment, parity).  A document also joins the next band if a partner
can be there.  Empty segments are no keys.  A pair can only be missed if
both documents have m - D or more empty segments; such documents (few, small)
also join on the least |A| - ceil(0.8 |A|) + 1 of their shingles, of which linked
documents must share one.  No pair is missed.

Filter.  A second sketch, of 2 to 4 bits for each shingle, has bit hash(s)
flipped for every shingle s.  The Hamming distance of two such sketches is a lower
bound of the number of differing shingles; pairs over D are dropped.

Check.  What is left is compared shingle by shingle: 64-bit hashes, by a key that is new in
every run, find the shingles that are the same in a document or in two, and their words are compared byte by
byte before they count as one.

Groups.  Documents with equal words (a 128-bit digest of them; of the sorted set for
sets under ``SMALLEST``) are one class and join once.  A key shared
by up to ``ALL_PAIRS`` classes gives all pairs; a larger one links all to
one of them, and is kept.  After the components of the checked links are
known, only kept keys that still hold several components are looked at again:
pairs across components that pass the filter are checked, first the nearest
ones of each class, then all that are still across
components.  So copies are not expanded into all pairs, yet no component
misses a link.  The members of such a key are dealt over chunks of a few megabytes of
sketches, and those outside its largest component meet every chunk, so no
task holds a whole key.

Keys travel as packed arrays: 6 bytes of hash and 2 of a local index for each.
They are dealt over blocks of about ``BLOCK_KEYS`` keys, which a task takes one after another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as T
from .common import map_texts, shuffle_partitions, stored, table, temporary, tidy
from .components import components

K = 5
SMALLEST = 4  # smaller sets link only with equal ones
ALL_PAIRS = 8
#: Pairs of a class that are checked at a time across components; the last round has no bound.
NEAREST = (8, None)
LEAVES = 1000
IDS_BROADCAST = 500_000
#: Join keys of a block, about; one that has more is passed in several turns.
BLOCK_KEYS = 1_000_000
#: Bytes of bit sketches of a chunk of a key's members.
CHUNK_BYTES = 2 << 20
U = np.uint64


def _shingles(words: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, their texts, first words and last words; not distinct."""
    h, counts = words.hashes(), words.counts()
    at = np.flatnonzero(T.window_starts(words.first, K))
    value, doc = [T.windows(h, K)[at]], [T.text_of(words.first)[at]]
    at, last = [at], [at + K - 1]
    for k in range(1, K):
        # A text of fewer words is one shingle.
        short = np.flatnonzero(counts == k)
        if len(short):
            value.append(T.mix(T.windows(h, k)[words.first[short]] + U(k)))
            doc.append(short)
            at.append(words.first[short])
            last.append(words.first[short] + k - 1)
    return tuple(map(np.concatenate, (value, doc, at, last)))


def distinct_shingles(words: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text in ascending order, offsets of the texts (texts + 1), first byte and length of each.

    ``words``: of texts whose words are joined by one space.  Shingles are distinct if their bytes are, so a
    hash occurs twice where two of a text have the same.
    """
    value, doc, at, last = _shingles(words)
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    value, doc = value[order], doc[order]
    start = words.start[at[order]]
    length = words.end[last[order]] - start
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    again = np.flatnonzero(~new)
    same = length[again] == length[again - 1]
    same[same] = T.same_bytes(words.raw, start[again[same]], words.raw, start[again[same] - 1], length[again[same]])
    if not same.all():
        group = np.cumsum(new) - 1
        for g in np.unique(group[again[~same]]).tolist():
            seen = set()
            for i in np.flatnonzero(group == g).tolist():
                own = words.raw[start[i] : start[i] + length[i]].tobytes()
                new[i] = own not in seen
                seen.add(own)
    return value[new], np.searchsorted(doc[new], np.arange(len(words.first))), start[new], length[new]


def shingles(words: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """``distinct_shingles`` without the places."""
    return distinct_shingles(words)[:2]


def _split(raw: np.ndarray, off: np.ndarray, key: int) -> T.Words:
    """The lower-cased words of each text, joined by one space."""
    data, at = T.Words(T.LOWER[raw], off).joined()
    return T.Words(data, at, key=key)


def class_digests(words: T.Words, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each text that are equal for texts of equal words, and for equal sets of fewer than ``SMALLEST`` shingles."""
    whole = words.raw.tobytes()
    bounds = words.offsets.tolist()
    out = np.zeros((len(n), 2), "<i8")
    for i, (a, b, size) in enumerate(zip(bounds[:-1], bounds[1:], n.tolist(), strict=True)):
        own = whole[a:b]
        if 0 < size < SMALLEST:
            w = own.split(b" ")
            own = b"\n".join(sorted({b" ".join(w[j : j + K]) for j in range(max(1, len(w) - K + 1))}))
        out[i] = np.frombuffer(hashlib.blake2b(own, digest_size=16).digest(), "<i8")
    return np.ascontiguousarray(out[:, 0]), np.ascontiguousarray(out[:, 1])


def _sketches(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    n = np.diff(first)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    bits[n == 0] = 0
    base = np.concatenate([[0], np.cumsum(bits)])
    doc = T.text_of(first)
    at = base[doc] + (T.mix(value + U(37)) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def signatures(docs: DataFrame, hash_key: int) -> DataFrame:
    """doc_id, text, ... -> doc_id, n, h1, h2, sketch."""

    def make():
        def run(raw, off):
            words = _split(raw, off, hash_key)
            value, first = shingles(words)
            return [np.diff(first), *class_digests(words, np.diff(first)), pa.array(_sketches(value, first), pa.binary())]

        return run

    return map_texts(docs.select("doc_id", "text"), make, "n long, h1 long, h2 long, sketch binary")


def bands(most: int) -> list[int]:
    """Least sizes of the bands, up to one beyond ``most``."""
    out = [SMALLEST]
    while out[-1] <= most * 2:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def keys(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys and the text of each."""
    n = np.diff(first)
    if not len(n) or n.max(initial=0) < SMALLEST:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = np.array(bands(int(n.max())), np.int64)
    docs = np.flatnonzero(n >= SMALLEST)
    own = np.searchsorted(low, n[docs], side="right") - 1
    up = 5 * n[docs] >= 4 * low[own + 1]
    doc, band = np.concatenate([docs, docs[up]]), np.concatenate([own, own[up] + 1])
    size, top = n[doc], low[band + 1] - 1
    most = 2 * top // 9
    m = most + 1 + 2 + most // 16
    base = np.concatenate([[0], np.cumsum(m)])
    entry = np.repeat(np.arange(len(doc)), size)
    v = T.mix(value[T.ragged(first[doc], size)])
    segment = base[entry] + (((v >> U(32)) * m[entry].astype(np.uint64)) >> U(32)).astype(np.int64)
    parity, filled = np.zeros(int(base[-1]), np.uint64), np.zeros(int(base[-1]), bool)
    np.bitwise_xor.at(parity, segment, T.mix(v + U(41)))
    filled[segment] = True
    of = np.repeat(np.arange(len(doc)), m)
    number = np.arange(int(base[-1])) - base[of]
    key = T.mix(parity ^ T.mix((band[of].astype(np.uint64) << U(40)) + number.astype(np.uint64)))[filled]
    key_doc = doc[of][filled]
    empty = m - np.bincount(of[filled], minlength=len(doc))
    differ = (size + np.minimum(5 * size // 4, top)) // 9
    sparse = np.unique(doc[empty >= m - differ])
    if len(sparse):
        ranked = T.mix(value + U(53))
        rest = [np.sort(ranked[first[d] : first[d + 1]])[: int(n[d] - -(-4 * n[d] // 5) + 1)] for d in sparse.tolist()]
        key = np.concatenate([key, *(T.mix(r + U(59)) for r in rest)])
        key_doc = np.concatenate([key_doc, np.repeat(sparse, [len(r) for r in rest])])
    return key, key_doc


FOUND = "gid long, a long, b long"


def join_keys(docs: DataFrame, n_shingles: int, hash_key: int, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """Classes (h1) that share a key: pairs (a, b), and (gid, a) for the classes of a key that has more than ``ALL_PAIRS``.

    ``n_shingles``: the sum over all documents, about three times the number of keys.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    blocks = max(parts, n_shingles // (3 * block_keys))

    def send(batches):
        for batch in batches:
            for top in range(0, batch.num_rows, 60_000):
                for _, _, raw, off in T.pieces(batch.column(0).slice(top, 60_000)):
                    words = _split(raw, off, hash_key)
                    value, first = shingles(words)
                    h1, _ = class_digests(words, np.diff(first))
                    _, one = np.unique(h1, return_index=True)
                    use = np.zeros(len(h1), bool)
                    use[one] = True
                    key, doc = keys(value[np.repeat(use, np.diff(first))], np.concatenate([[0], np.cumsum(np.where(use, np.diff(first), 0))]))
                    del value, words
                    if not len(key):
                        continue
                    block = (key % U(blocks)).astype(np.uint32)
                    order = np.argsort((block.astype(np.uint64) << U(32)) | doc.astype(np.uint64), kind="stable")
                    key, doc, block = key[order] >> U(16), doc[order], block[order]
                    begin = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
                    # Each row names the classes that it uses.
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])
                    place = np.cumsum(new) - 1
                    ends = np.append(begin[1:], len(block))
                    local = (place - np.repeat(place[begin], ends - begin)).astype("<u2").tobytes()
                    classes = h1[doc[new]].astype("<i8").tobytes()
                    packed = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                    spans = list(zip(begin.tolist(), ends.tolist(), place[begin].tolist(), [*place[begin[1:]].tolist(), int(place[-1]) + 1], strict=True))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array((block[begin] % parts).astype(np.int32)),
                            "block": pa.array(block[begin].astype(np.int32)),
                            "keys": pa.array([packed[6 * a : 6 * b] for a, b, _, _ in spans], pa.binary()),
                            "docs": pa.array([local[2 * a : 2 * b] for a, b, _, _ in spans], pa.binary()),
                            "classes": pa.array([classes[8 * c : 8 * d] for _, _, c, d in spans], pa.binary()),
                        }
                    )

    def meet(batches):
        at, held, size = None, [], 0

        def flush():
            turns = -(-size // block_keys)
            for turn in range(turns):
                yield from _met([_unpacked(row, turn, turns) for row in held], at, blocks, ALL_PAIRS)
            held.clear()

        for batch in batches:
            for block, *row in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                if block != at:
                    yield from flush()
                    at, size = block, 0
                held.append([x.as_py() for x in row])
                size += len(held[-1][0]) // 6
        yield from flush()

    sent = docs.select("text").mapInArrow(tidy(send), "part int, block int, keys binary, docs binary, classes binary")
    return sent.repartition(parts, "part").sortWithinPartitions("block").select("block", "keys", "docs", "classes").mapInArrow(tidy(meet), FOUND)


def _unpacked(row: list[bytes], turn: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and classes of the keys of this turn."""
    k = np.zeros((len(row[0]) // 6, 8), np.uint8)
    k[:, :6] = np.frombuffer(row[0], np.uint8).reshape(-1, 6)
    key, cls = k.view("<u8").ravel(), np.frombuffer(row[2], "<u8")[np.frombuffer(row[1], "<u2")]
    if turns == 1:
        return key, cls
    now = (key >> U(16)) % U(turns) == turn
    return key[now], cls[now]


def _met(parts: list[tuple[np.ndarray, np.ndarray]], at: int, blocks: int, all_pairs: int):
    key, cls = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls = key[new], cls[new]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    pairs = [np.zeros((0, 2), np.uint64)]
    for s in range(2, all_pairs + 1):
        b = begin[size == s]
        for i in range(s - 1):
            for j in range(i + 1, s):
                pairs.append(np.stack([cls[b + i], cls[b + j]], 1))
    b, s = begin[size > all_pairs], size[size > all_pairs]
    pairs.append(np.stack([np.repeat(cls[b], s - 1), cls[T.ragged(b + 1, s - 1)]], 1))
    pairs = np.concatenate(pairs)
    if len(pairs):
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(1)
        pairs = pairs[new].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["gid", "a", "b"])
    if len(b):
        gid = np.repeat(key[b] * U(blocks) + U(at), s).view(np.int64)
        member = np.ascontiguousarray(cls[T.ragged(b, s)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(member), pa.nulls(len(gid), pa.int64())], names=["gid", "a", "b"])


def _folded(sketch: bytes, bits: int) -> np.ndarray:
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 64 > bits:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(na: int, nb: int, a: bytes, b: bytes) -> bool:
    if 5 * min(na, nb) < 4 * max(na, nb):
        return False
    bits = 8 * min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, bits) ^ _folded(b, bits)).sum()) <= (na + nb) // 9


def _filtered(pairs: DataFrame) -> DataFrame:
    """a, b, na, nb, sa, sb -> the pairs (a, b) that the bit sketches leave."""

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keep = [i for i, (_, _, na, nb, sa, sb) in enumerate(zip(*columns, strict=True)) if may_link(na, nb, sa, sb)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def check(docs: DataFrame, pairs: DataFrame, hash_key: int, ids_broadcast: int = IDS_BROADCAST) -> DataFrame:
    """The pairs (a, b) of document ids whose similarity is 0.8 or more, shingle by shingle.

    A document is sent once for each centre a that it is compared with; the
    leaves of a centre are dealt over groups of about ``LEAVES``.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEAVES).alias("_n"))
    dealt = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("_n")))
    roles = dealt.select(F.col("a").alias("id"), "a", "part", F.lit(0).alias("role")).distinct().unionByName(dealt.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("role")))
    ids = stored(roles.select("id").distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    # Texts that nothing is compared with stay where they are, while the list of ids is small enough to send around.
    if ids.count() <= ids_broadcast:
        texts = texts.join(F.broadcast(ids), "id", "left_semi")

    def make():
        def run(raw, off):
            data, at = T.Words(T.LOWER[raw], off).joined()
            whole = data.tobytes()
            return [pa.array([whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())]

        return run

    def compare(batches):
        at, centres = None, []
        for batch in batches:
            a_out, b_out = [], []
            for doc, a, part, role, own in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if (a, part) != at:
                    at, centres = (a, part), []
                x = ShingleSet(own.as_py(), hash_key)
                if role == 0:
                    centres.append(x)
                elif any(100 * (both := c.shared(x)) >= 80 * (len(c) + len(x) - both) for c in centres):
                    a_out.append(a)
                    b_out.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    sets = map_texts(texts.join(roles, "id").select("id", "a", "part", "role", "text"), make, "own binary")
    return sets.repartition(shuffle_partitions(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(tidy(compare), "a long, b long").distinct()


class ShingleSet:
    """The distinct shingles of one text of lower-cased words that are joined by one space."""

    def __init__(self, joined: bytes, hash_key: int = 0):
        self.raw = np.frombuffer(joined, np.uint8)
        words = T.Words(self.raw, np.array([0, len(joined)]), key=hash_key)
        self.value, _, self.start, self.length = distinct_shingles(words)
        self.repeats = bool((self.value[1:] == self.value[:-1]).any())

    def __len__(self) -> int:
        return len(self.value)

    def _spelled(self) -> set[bytes]:
        whole = self.raw.tobytes()
        return {whole[a : a + n] for a, n in zip(self.start.tolist(), self.length.tolist(), strict=True)}

    def shared(self, other: ShingleSet) -> int:
        """How many shingles both have, byte by byte."""
        if self.repeats or other.repeats:  # one hash of several shingles
            return len(self._spelled() & other._spelled())
        _, i, j = np.intersect1d(self.value, other.value, assume_unique=True, return_indices=True)
        alike = self.length[i] == other.length[j]
        i, j = i[alike], j[alike]
        return int(T.same_bytes(self.raw, self.start[i], other.raw, other.start[j], self.length[i]).sum())


def _again(members: DataFrame, known: DataFrame, reps: DataFrame, most: int | None) -> DataFrame:
    """Pairs across components, among the classes of each kept key, that the bit sketches leave; of each class the ``most`` nearest in each chunk."""
    m = members.join(reps.select("h1", "rep", F.length("sketch").alias("w")), "h1").join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    kinds = m.groupBy("gid", "component").agg(F.sum("w").alias("w"), F.count("*").alias("c"))
    mixed = kinds.groupBy("gid").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("kinds"), F.sum("w").alias("all")).where("kinds > 1")
    rest = kinds.join(mixed, "gid").where("component <> top.component").groupBy("gid").agg(F.sum("w").alias("rest"))
    chunks = lambda w: F.ceil(F.col(w) / CHUNK_BYTES).cast("int")
    plan = stored(mixed.join(rest, "gid").select("gid", F.col("top.component").alias("top"), chunks("all").alias("n"), chunks("rest").alias("k")), "plan")
    m = m.select("gid", "rep", "component").join(plan, "gid").join(reps.select("rep", F.col("n").alias("size"), "sketch"), "rep")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Each member goes to its own chunk, for every share of the rest; the rest goes to every chunk.
    fields = ["gid", "rep", "component", "size", "sketch"]
    own = m.select(*fields, F.lit(False).alias("asks"), deal("n").alias("chunk"), "k").select(*fields, "asks", "chunk", every("k").alias("share"))
    asking = m.where("component <> top").select(*fields, F.lit(True).alias("asks"), deal("k").alias("share"), "n").select(*fields, "asks", every("n").alias("chunk"), "share")

    def run(group: pa.Table) -> pa.Table:
        rep, n, component, asks = (group.column(c).to_numpy() for c in ("rep", "size", "component", "asks"))
        sketch = group.column("sketch").to_pylist()
        bits = 8 * min(map(len, sketch))
        folded = np.stack([_folded(s, bits) for s in sketch])
        del sketch
        there = np.flatnonzero(~asks)
        a_out, b_out = [], []
        for i in np.flatnonzero(asks).tolist():
            other = there[(component[there] != component[i]) & (5 * np.minimum(n[there], n[i]) >= 4 * np.maximum(n[there], n[i]))]
            apart = np.bitwise_count(folded[other] ^ folded[i]).sum(1)
            near, apart = other[apart <= (n[other] + n[i]) // 9], apart[apart <= (n[other] + n[i]) // 9]
            if most is not None and len(near) > most:
                near = near[np.argsort(apart, kind="stable")[:most]]
            a_out.append(np.minimum(rep[near], rep[i]))
            b_out.append(np.maximum(rep[near], rep[i]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_out, b_out))
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    return own.unionByName(asking).groupBy("gid", "chunk", "share").applyInArrow(run, "a long, b long").distinct()


def linked(docs: DataFrame, block_keys: int = BLOCK_KEYS, ids_broadcast: int = IDS_BROADCAST) -> DataFrame:
    """doc_id, text, ... -> doc_id, n_shingles, component_id; one row for each row.

    Null or empty texts, and texts without words: n_shingles 0, a component of
    their own.  Texts of fewer than five words have one shingle, the whole
    sequence.  Rows that share a doc_id are one document, which has all their links.  A null doc_id is
    linked with nothing and has a null component.  Ids are integers (others fail).  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hash_key = T.new_key()
    sig = stored(signatures(docs, hash_key), "signatures")
    with temporary(docs.sparkSession) as keep:
        of_class = stored(_components_of_classes(docs, sig, hash_key, block_keys, ids_broadcast), "classes")
        keep(of_class)
    out = sig.drop("sketch").join(of_class, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("_c")).otherwise(F.col("doc_id"))).alias("component_id"))


def _components_of_classes(docs: DataFrame, sig: DataFrame, hash_key: int, block_keys: int, ids_broadcast: int) -> DataFrame:
    """h1, h2, _c."""
    classes = sig.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    reps = stored(sig.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "h1", "h2"]).select(F.col("doc_id").alias("rep"), "n", "h1", "h2", "sketch").dropDuplicates(["rep", "h1", "h2"]), "reps")
    n_shingles = reps.agg(F.sum("n")).first()[0] or 0
    found = stored(join_keys(docs.where("doc_id is not null"), n_shingles, hash_key, block_keys), "found")
    left, right = (reps.select(F.col("h1").alias(x), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    pairs = found.where("gid is null").select("a", "b").distinct()
    # Sizes first: the sketches of pairs that differ too much in size are not fetched.
    pairs = pairs.join(left.drop("sa"), "a").join(right.drop("sb"), "b").where("ra <> rb and 5 * least(na, nb) >= 4 * greatest(na, nb)")
    pairs = pairs.join(left.select("a", "ra", "sa"), ["a", "ra"]).join(right.select("b", "rb", "sb"), ["b", "rb"])
    ordered = pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "na", "nb", "sa", "sb")
    near = stored(_filtered(ordered).distinct(), "near")
    # Rows that share an id keep their classes together.
    several = sig.where("n > 0 and doc_id is not null").groupBy("doc_id").agg((F.min("h1") != F.max("h1")).alias("x")).where("x").select("doc_id")
    shared = sig.join(several, "doc_id", "left_semi").where("n > 0").join(classes, ["h1", "h2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = stored(check(docs, near, hash_key, ids_broadcast).unionByName(shared), "checked")
    known = components(links)
    members = found.where("gid is not null").select("gid", F.col("a").alias("h1"))
    for most in NEAREST:
        left_over = stored(_again(members, known, reps, most), "again")
        if not left_over.limit(1).count():
            break
        new = stored(left_over.join(near, ["a", "b"], "left_anti"), "untried")
        if new.limit(1).count():
            known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(check(docs, new, hash_key, ids_broadcast)))
            near = near.unionByName(new)
    return classes.join(known, classes["rep"] == known["node"], "left").select("h1", "h2", F.coalesce("component", "rep").alias("_c"))


def query(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
r AS (SELECT s.* FROM s SEMI JOIN f USING (h)),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM r x JOIN r y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), c AS (
  SELECT a AS node, b AS other FROM l UNION SELECT c.node, l.b FROM c JOIN l ON c.other = l.a
), m AS (SELECT node, min(other) AS m FROM c GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""
