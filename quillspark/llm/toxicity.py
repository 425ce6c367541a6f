"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic
text.  A window is one word (set between a space and a padding, since the
compressor looks for no matches in the last bytes of its input).  Its distance
is how much longer it is when compressed with the ordinary dictionary than
with the toxic one.  Distance, toxic length and the window's own length form a cell, whose
weight is the log ratio of its shares of the windows of toxic and of ordinary
calibration documents.  A document's score comes from how many of its windows
reach each threshold of that weight, by a logistic calibration.

Most windows of a toxic document are ordinary.  The toxic dictionary is
therefore trained on those windows of toxic documents that occur in
significantly more toxic than ordinary documents of the training rows.

Fitting uses a bounded sample of the labelled rows (about ``max_docs`` of each
class, chosen by a hash of the id, whole texts of at most ``max_bytes`` a class) in one task; half of it
trains the dictionaries, the other half the calibration.  Scoring covers all windows of all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as T
from .common import drawn_below, fit_in_a_task, held_out, map_texts, table

LEVEL, PAD = 19, b" " * 12
STEPS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0)
ORDINARY_BYTES, TOXIC_BYTES = 256 << 10, 64 << 10
Z_MIN = 4.0
CACHE = 1_000_000
CELLS = 32 * 64 * 16
#: Bytes of text handled at once while fitting.
FIT_PIECE = 512 << 10


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=48, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or PAD


class _Lengths:
    """Compressed lengths of windows with one dictionary."""

    def __init__(self, content: bytes):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        self.c = zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, windows: list[bytes]) -> np.ndarray:
        ends = np.cumsum(np.fromiter(map(len, windows), np.int64, len(windows)))
        segments = np.empty((len(windows), 2), dtype="<u8")
        segments[:, 1] = np.diff(ends, prepend=0)
        segments[:, 0] = ends - np.diff(ends, prepend=0)
        out = self.c.multi_compress_to_buffer(zstandard.BufferWithSegments(b"".join(windows), segments.tobytes()), threads=1)
        return np.fromiter(map(len, out), np.int64, len(windows))


class Distance:
    """Distances of the distinct words of texts; known ones are remembered, up to ``CACHE`` of them."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _Lengths(ordinary), _Lengths(toxic)
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, words: T.Words, hashes: np.ndarray) -> np.ndarray:
        u, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, u)
        known = np.zeros(len(u), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == u[inside]
        values = np.empty(len(u), np.int64)
        values[known] = self.values[at[known]]
        if (new := np.flatnonzero(~known)).size:
            raw = words.raw.tobytes()
            at = first[new]
            w = [b" " + raw[a:b] + PAD for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
            short = self.toxic(w)
            size = np.minimum(words.end[at] - words.start[at], 15)
            values[new] = (np.clip(self.ordinary(w) - short + 8, 0, 31) * 64 + np.minimum(short, 63)) * 16 + size
            if len(self.keys) > CACHE:
                self.keys, self.values = u, values
            else:
                keys = np.concatenate([self.keys, u[new]])
                order = np.argsort(keys, kind="stable")
                self.keys, self.values = keys[order], np.concatenate([self.values, values[new]])[order]
        return values[inverse]


def _split(raw: np.ndarray, off: np.ndarray) -> tuple[T.Words, np.ndarray]:
    words = T.Words(T.LOWER[raw], off)
    return words, words.hashes()


def features(distance: Distance, weights: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    words, hashes = _split(raw, off)
    n = len(off) - 1
    if not len(words):
        return np.zeros((n, len(STEPS) + 2))
    w, text = weights[distance(words, hashes)], T.text_of(words.first)
    out = [np.log1p(np.diff(words.first))]
    out += [np.log1p(np.bincount(text[w >= t], minlength=n)) for t in STEPS]
    most = np.zeros(n)
    np.maximum.at(most, text, w)
    return np.stack([*out, most], axis=1)


def _cell_weights(distance: Distance, text, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    count = np.zeros((2, CELLS))
    for lo, _, raw, off in T.pieces(text, FIT_PIECE):
        words, h = _split(raw, off)
        doc = T.text_of(words.first) + lo
        cells = distance(words, h)
        for k in (0, 1):
            count[k] += np.bincount(cells[use[doc] & (y[doc] == k)], minlength=CELLS)
    return np.log((count[1] + 0.5) / (count[1].sum() + 1)) - np.log((count[0] + 0.5) / (count[0].sum() + 1))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    ridge = np.eye(len(b)) * 0.05
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (p - y)) + ridge @ b)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "b": b}


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, max_bytes: int = 64 << 20, max_windows: int = 400_000) -> dict:
    """Learns from rows of ``docs`` that ``labels`` marks and that aren't held out.

    The sample is bounded: about ``max_docs`` documents of each class, chosen by a hash of the id, with ``max_bytes`` of text in all (the
    text that reaches it is cut there, later ones are left out); the ordinary dictionary is trained on every n-th of its windows, so that
    about ``max_windows`` remain.  Scores read whole texts.

    Without an ordinary or a toxic document in the sample, the model gives every text the share of toxic labels.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, max_docs / v) for k, v in n.items()}
    drawn = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    chosen = marks.where(drawn_below(drawn, F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))))
    # At most about 2 * max_docs (id, label) pairs are broadcast.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("drawn", drawn)
    total = sum(n.values())
    model = {"prior": n.get(1, 0) / total if total else 0.0}

    def run(batches):
        held, size = {0: [], 1: []}, {0: 0, 1: 0}
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if size[y] < max_bytes:
                    own = text.as_buffer().to_pybytes()[: max_bytes - size[y]]
                    held[y].append(own.decode("utf-8", "ignore"))
                    size[y] += len(own)
        y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
        return _fit(pa.array(held[0] + held[1], pa.large_string()), y, share, max_windows)

    return model | (fit_in_a_task(rows.select("toxic", "text", "drawn", "doc_id"), ["drawn", "doc_id", "toxic", "text"], run) or {})


def _copies(text, y: np.ndarray) -> np.ndarray:
    """Which texts repeat the least 3-word hash of an earlier text of their class: copies and near copies, which would make any rare word of theirs look telling."""
    least = []
    for _, _, raw, off in T.pieces(text, FIT_PIECE):
        words, h = _split(raw, off)
        w = T.windows(h, 3) if len(h) >= 3 else h
        inside = [slice(a, max(a + 1, b - 2)) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        least += [int(w[s].min(initial=2**64 - 1)) if b > a else None for s, a, b in zip(inside, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
    seen, out = set(), np.zeros(len(y), bool)
    for i, key in enumerate(zip(y.tolist(), least, strict=True)):
        out[i] = key in seen
        seen.add(key)
    return out


def _fit(text, y: np.ndarray, share: dict, max_windows: int) -> dict:
    fresh = np.flatnonzero(~_copies(text, y))
    text, y = text.take(pa.array(fresh)), y[fresh]
    if min((y == 1).sum(), (y == 0).sum()) < 4:
        return {}
    half = np.zeros(len(y), bool)
    for k in (0, 1):
        half[np.flatnonzero(y == k)[::2]] = True
    toxic, ordinary = _samples(text, y, half, max_windows)
    model = {"ordinary": _dictionary(ordinary, ORDINARY_BYTES), "toxic": _dictionary(toxic, TOXIC_BYTES)}
    del toxic, ordinary
    distance = Distance(model["ordinary"], model["toxic"])
    model["weights"] = _cell_weights(distance, text, y, ~half)
    x = np.concatenate([features(distance, model["weights"], raw, off) for _, _, raw, off in T.pieces(text, FIT_PIECE)])[~half]
    weight = np.where(y == 1, 1 / share.get(1, 1), 1 / share.get(0, 1))[~half]
    return model | _logistic(x, y[~half], weight)


def _samples(text, y: np.ndarray, half: np.ndarray, max_windows: int) -> tuple[list[bytes], list[bytes]]:
    """Windows for the toxic and for the ordinary dictionary, from the documents of ``half``."""
    # Documents that hold each window, all and toxic ones, piece by piece: no document is in two pieces.
    parts = []
    for lo, _, raw, off in T.pieces(text, FIT_PIECE):
        words, h = _split(raw, off)
        doc = T.text_of(words.first) + lo
        h, doc = h[half[doc]], doc[half[doc]]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        u, inverse = np.unique(h[new], return_inverse=True)
        parts.append((u, np.bincount(inverse, weights=y[doc[new]], minlength=len(u)), np.bincount(inverse, minlength=len(u))))
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    k1, k = (np.bincount(inverse, weights=np.concatenate([p[i] for p in parts]), minlength=len(keys)) for i in (1, 2))
    del parts, inverse
    n1, n0 = max(1, (half & (y == 1)).sum()), max(1, (half & (y == 0)).sum())
    p = k / (n1 + n0)
    z = (k1 / n1 - (k - k1) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    telling = keys[(z >= Z_MIN) & (k1 >= 2)]
    toxic, ordinary = [], []
    total = 0
    for _, _, raw, off in T.pieces(text, FIT_PIECE):
        total += len(T.Words(raw, off))
    stride = max(1, total // max_windows)
    for lo, _, raw, off in T.pieces(text, FIT_PIECE):
        words, h = _split(raw, off)
        doc = T.text_of(words.first) + lo
        low = words.raw.tobytes()
        cut = lambda at: [b" " + low[a:b] + PAD for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]  # noqa: B023, E731
        ordinary += cut(np.flatnonzero(half[doc] & (y[doc] == 0))[::stride])
        if len(telling):
            toxic += cut(np.flatnonzero(half[doc] & (y[doc] == 1) & (telling[np.minimum(np.searchsorted(telling, h), len(telling) - 1)] == h)))
    return toxic or ordinary[:1], ordinary


def score(docs: DataFrame, model: dict, drop_text: bool = False) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: more likely toxic), computed from the whole text alone.

    A null or empty text is scored as a text without windows.  Other columns,
    null ids and repeated rows pass through; a column named score is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        if "b" not in m:
            return lambda raw, off: [np.full(len(off) - 1, m["prior"])]
        distance = Distance(m["ordinary"], m["toxic"])

        def run(raw, off):
            x = (features(distance, m["weights"], raw, off) - m["mean"]) / m["scale"]
            return [1 / (1 + np.exp(-np.clip(x @ m["b"][:-1] + m["b"][-1], -30, 30)))]

        return run

    return map_texts(docs, make, "score double", drop_text=drop_text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, drop_text=True)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
