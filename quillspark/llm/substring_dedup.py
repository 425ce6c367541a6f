"""Substring dedup by relative Lempel-Ziv factors.

The corpus is its own reference, cut into reference blocks.  A window of 35
words belongs to the block that its minimizer (the least hash of the 8-word
sequences in it) names, so equal windows meet in one block, and the windows
that follow each other in a text mostly go to the same block, as one run.  Only
blocks that could hold a match of a run are asked; every block indexes all its runs.

Parsing is greedy.  At a window that the index knows from another place, the
factor is extended word by word against the reference for as long as the words
agree.  The next look-up is then at the factor's boundary: the first window
that isn't inside the factor.  So a window that lies across two factors is
looked up itself, and none is missed.  Factors span at least 35 words; the words
they cover are the duplicate spans.  All occurrences count, the first one too.

A word of a run is known by the window that ends in it.  Two windows are taken for equal if their 64-bit hashes are and those of their minimizers.
Words are hashed by a key that is new in every run, so no text can bring a false match about; by
chance, it takes two windows of one minimizer (they share eight words) with equal hashes, a probability of about 2**-64 a pair.

Skew: texts held together (about 2 MB) are first factored against themselves,
and send each distinct window once.  A passage that is in a third of all
texts thus reaches its block once for each such piece, not once for each text.
Blocks hold about ``BLOCK_BYTES`` of text and are indexed one after another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as T
from .common import shuffle_partitions, stored, table, tidy

WINDOW, GRAM = 35, 8
BLOCK_BYTES = 32 << 20
#: Windows of a run that are parsed in one go.
STRETCH = 256
RUN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("count", "<u4"), ("anchor", "<u8")])
DOC = np.dtype([("id", "<i8"), ("key", "<i8")])
FACTOR = "doc_id long, key long, start int, words int, from_doc_id long, from_start int"


def _runs(doc: np.ndarray, pos: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Beginnings of maximal runs of consecutive positions of one document, with equal values of ``same``."""
    if not len(doc):
        return np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    for s in same:
        new[1:] |= s[1:] != s[:-1]
    return np.flatnonzero(new)


def _places(h: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index: a number for each different window, whether it occurs again, and where (its first place; of a first place, the second)."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    apart = anchor[order[1:]] != anchor[order[:-1]]
    if (apart & ~new[1:]).any():
        order = np.lexsort((anchor, h))
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (anchor[order[1:]] != anchor[order[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(h)))
    group = np.cumsum(new) - 1
    number, source, again = (np.empty(len(h), t) for t in (np.int64, np.int64, bool))
    number[order], again[order] = group, size[group] > 1
    source[order] = np.where(new, order[np.minimum(begin[group] + 1, len(h) - 1)], order[begin[group]])
    return number, again, source


def _extended(number: np.ndarray, p: np.ndarray, p_end: np.ndarray, q: np.ndarray, q_end: np.ndarray) -> np.ndarray:
    """How many windows from p on equal those from q on, up to both ends; each one more is one more word."""
    most = np.minimum(p_end - p, q_end - q)
    got, on, step = np.zeros(len(p), np.int64), np.arange(len(p)), 8
    while len(on):
        t = got[on, None] + np.arange(step)
        inside = t < most[on, None]
        t = np.minimum(t, most[on, None] - 1)
        equal = inside & (number[p[on, None] + t] == number[q[on, None] + t])
        whole = equal.all(1)
        got[on] += np.where(whole, step, equal.argmin(1))
        on = on[whole]
        step = min(2 * step, STRETCH)
    return got


def factors(places: tuple[np.ndarray, np.ndarray, np.ndarray], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Greedy factors of runs of windows against all of them (``_places``): (doc, start, windows, source doc, source start)."""
    number, again, source = places
    n = len(number)
    if not n:
        return (np.zeros(0, np.int64),) * 5
    begin = _runs(doc, pos)
    length = np.diff(np.append(begin, n))
    end = np.repeat(begin + length, length)
    inside = np.arange(n) - np.repeat(begin, length)
    p = np.flatnonzero(inside % STRETCH == 0)
    stop = np.minimum(p + STRETCH, end[p])
    following = np.append(np.where(again, np.arange(n), n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    out = []
    while True:
        p = following[p]
        on = p < stop
        p, stop = p[on], stop[on]
        if not len(p):
            break
        q = source[p]
        size = _extended(number, p, stop, q, end[q])
        out.append(np.stack([p, size, q]))
        p = p + size
    f, size, q = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return doc[f], pos[f], size, doc[q], pos[q]


def _cut(column_ids, keys, text, hash_key):
    """Windows of each piece of texts: (documents, window hashes, text, position, block value)."""
    for lo, hi, raw, off in T.pieces(text):
        words = T.Words(raw, off, key=hash_key)
        h = words.hashes()
        w = T.windows(h, WINDOW)
        at = np.flatnonzero(T.window_starts(words.first, WINDOW))
        if not len(at):
            continue
        block = T.sliding_min(T.windows(h, GRAM), WINDOW - GRAM + 1)
        doc = T.text_of(words.first)[at]
        docs = np.zeros(hi - lo, DOC)
        docs["id"], docs["key"] = column_ids[lo:hi], keys[lo:hi]
        yield docs, w[at], doc, at - words.first[doc], block[at]


def _table(docs: np.ndarray, f: tuple[np.ndarray, ...]) -> dict:
    d, start, n, sd, sp = f
    return {"doc_id": docs["id"][d], "key": docs["key"][d], "start": start.astype(np.int32), "words": (n + WINDOW - 1).astype(np.int32), "from_doc_id": docs["id"][sd], "from_start": sp.astype(np.int32)}


FACTOR_TYPE = np.dtype([("doc_id", "<i8"), ("key", "<i8"), ("start", "<i4"), ("words", "<i4"), ("from_doc_id", "<i8"), ("from_start", "<i4")])


ID, KEY, SPANS = "quill__id", "quill__key", "quill__spans"


def keyed(docs: DataFrame) -> DataFrame:
    """Adds what tells rows apart: an id (0 for null) and a hash of id and text."""
    return docs.withColumns({ID: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), KEY: F.xxhash64("doc_id", "text")})


def find_factors(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every duplicate factor of ``keyed`` documents, with its source.  There are as many blocks as have ``block_bytes`` of text on average."""
    spark = docs.sparkSession
    parts, hash_key = shuffle_partitions(spark), T.new_key()
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4 * parts, n_bytes // block_bytes)

    def send(batches):
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for docs_, h, doc, pos, anchor in _cut(ids, keys, batch.column(2), hash_key):
                places = _places(h, anchor)
                own = factors(places, doc, pos)
                found = np.zeros(len(own[0]), FACTOR_TYPE)
                for name, column in _table(docs_, own).items():
                    found[name] = column
                _, first = np.unique(places[0], return_index=True)
                first.sort()
                h, doc, pos, anchor = h[first], doc[first], pos[first], anchor[first]
                block = (T.mix(anchor) % np.uint64(n)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                h, doc, pos, block, anchor = h[order], doc[order], pos[order], block[order], anchor[order]
                begin = _runs(doc, pos, block, anchor)
                count = np.diff(np.append(begin, len(h)))
                blocks, at = np.unique(block[begin], return_index=True)
                runs = np.zeros(len(begin), RUN)
                runs["start"], runs["count"], runs["anchor"] = pos[begin], count, anchor[begin]
                out = {"part": [], "block": [], "docs": [], "runs": [], "hashes": [], "found": []}
                for i, b in enumerate(blocks.tolist()):
                    lo, hi = at[i], at[i + 1] if i + 1 < len(at) else len(begin)
                    used, index = np.unique(doc[begin[lo:hi]], return_inverse=True)
                    part = runs[lo:hi]
                    part["doc"] = index
                    last = begin[hi] if hi < len(begin) else len(h)
                    for name, v in (("part", b % parts), ("block", b), ("docs", docs_[used].tobytes()), ("runs", part.tobytes()), ("hashes", h[begin[lo] : last].astype("<u8").tobytes()), ("found", found.tobytes() if not i else b"")):
                        out[name].append(v)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k in ("part", "block") else pa.binary()) for k, v in out.items()})

    def index(batches):
        at, held = None, []

        def flush():
            if not held:
                return
            docs_, runs, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            count = runs["count"].astype(np.int64)
            f = factors(_places(hashes, np.repeat(runs["anchor"], count)), np.repeat(runs["doc"].astype(np.int64), count), T.ragged(runs["start"].astype(np.int64), count))
            if len(f[0]):
                yield pa.RecordBatch.from_pydict(_table(docs_, f))

        docs_before = 0
        for batch in batches:
            for block, *row in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                if block != at:
                    yield from flush()
                    at, docs_before = block, 0
                names, runs, hashes, own = (x.as_py() for x in row)
                d, r = np.frombuffer(names, DOC), np.frombuffer(runs, RUN).copy()
                r["doc"] += docs_before
                docs_before += len(d)
                held.append((d, r, np.frombuffer(hashes, "<u8")))
                if own:
                    own = np.frombuffer(own, FACTOR_TYPE)
                    yield pa.RecordBatch.from_pydict({k: np.ascontiguousarray(own[k]) for k in FACTOR_TYPE.names})
        yield from flush()

    sent = docs.select(ID, KEY, "text").mapInArrow(tidy(send), "part int, block int, docs binary, runs binary, hashes binary, found binary")
    return sent.repartition(parts, "part").sortWithinPartitions("block").select("block", "docs", "runs", "hashes", "found").mapInArrow(tidy(index), FACTOR)


def remove(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Replaces ``text`` by its kept words, joined by one space; adds n_words and n_removed.

    A word goes if a window of 35 consecutive words covers it whose words also
    begin at any other place, same text included; windows are judged on the
    input.  Null or empty text: no words, an empty text.  Repeated rows are
    duplicates of each other.  Null ids and other columns pass through; columns named like the
    added ones, and those that begin with quill__, are replaced.  Ids are integers (others fail).
    """
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("n_words", "n_removed") and not c.lower().startswith("quill__")))
    found = stored(find_factors(keyed(docs), block_bytes), "factors")
    spans = found.groupBy(F.col("doc_id").alias(ID), F.col("key").alias(KEY)).agg(F.collect_set(F.struct("start", "words")).alias(SPANS))
    rows = keyed(docs).join(spans, [ID, KEY], "left").drop(ID, KEY)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            column, spans = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index(SPANS))
            for lo, hi, raw, off in T.pieces(column):
                words, part = T.Words(raw, off), spans.slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), np.asarray(pa.compute.list_value_length(part).fill_null(0)))
                flat = part.flatten()
                start = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64) + words.first[doc]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + flat.field("words").to_numpy(zero_copy_only=False), -1)
                keep = np.cumsum(edge)[:-1] == 0
                at = np.flatnonzero(keep)
                n_kept = np.bincount(T.text_of(words.first)[at], minlength=hi - lo)
                length = words.end[at] - words.start[at]
                # Each kept word takes its bytes and a space.
                data = np.full(int(length.sum()) + len(at), 0x20, np.uint8)
                data[T.ragged(np.cumsum(length + 1) - length - 1, length)] = raw[T.ragged(words.start[at], length)]
                ends = np.concatenate([[0], np.cumsum(length + 1)])[np.concatenate([[0], np.cumsum(n_kept)])]
                whole = data.tobytes()
                texts = pa.array([whole[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()).cast(pa.string())
                counts = words.counts()
                own = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in names]
                yield pa.RecordBatch.from_arrays([*own, texts, pa.array(counts), pa.array(counts - n_kept)], names=[*names, "text", "n_words", "n_removed"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return rows.mapInArrow(tidy(run), StructType([*kept, StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())]))


def query(spark, sf_dir: str) -> DataFrame:
    out = remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), m AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM x) WHERE n > 1
), g AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM m
), t AS (
  SELECT d.r, d.doc_id, len(w) AS n, w, coalesce(l.l, []) AS l FROM d LEFT JOIN (SELECT r, list(i) AS l FROM g GROUP BY r) l USING (r)
), k AS (
  SELECT t.r, string_agg(w[i], ' ' ORDER BY i) AS s, count(*) AS c
  FROM (SELECT r, w, unnest(range(1, n + 1)) AS i FROM t) t LEFT JOIN g USING (r, i) WHERE g.r IS NULL GROUP BY t.r
)
SELECT t.doc_id, t.n::BIGINT AS n_words, (t.n - coalesce(k.c, 0))::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM t LEFT JOIN k USING (r)
"""
