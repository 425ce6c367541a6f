"""Language identification with n-gram filters that answer for all languages at once.

The filter is a bit-sliced Bloom filter: a table whose slots hold one bit for
each language.  The slots of an n-gram's two hashes, and-ed, are the bitmask of all
languages that (probably) contain the n-gram.  A text is decided by the
popcounts of its n-grams' masks per language, corrected for the share of false
positives that the fill of each language's bits implies.

Fitting takes about ``max_docs`` labelled rows of each language and
``max_total`` of all (every row of a rarer language), chosen by a hash of the id, in one task, and ``max_bytes`` of text of each language (the text that
reaches it is cut there, later ones are left out).  The filter has as many slots as the language with the most n-grams needs.  An n-gram belongs to a
language if it occurs there more than once and at a tenth at least of the
highest rate that any language has.  Prediction reads whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as T
from .common import drawn_below, fit_in_a_task, held_out, map_texts, table

ORDERS = (3, 5)
#: Slots of the filter for each n-gram of the largest language, at least.
ROOM = 32
UNKNOWN = "und"

#: Lower-cased ASCII letters and the bytes of other characters stay; all else is a space.
_FOLD = T.LOWER.copy()
_FOLD[:128][~((T.LOWER[:128] >= 97) & (T.LOWER[:128] <= 122))] = 32


def grams(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of folded bytes, and the text of each; none crosses a text's end."""
    size = len(raw) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    folded = _FOLD[raw].astype(np.uint64)
    v = folded[:size].copy()
    for j in range(1, n):
        v = (v << np.uint64(8)) | folded[j : j + size]
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = text[:size] == text[n - 1 :]
    return T.mix(v[inside] + np.uint64(n << 56)), text[:size][inside]


class Model:
    """``planes``: tables of up to 64 languages each, of ``slots`` (a power of two); ``wrong``: share of false positives by language."""

    def __init__(self, langs: list[str], prior: int, members: list[np.ndarray]):
        self.langs, self.prior = langs, prior
        self.planes, self.wrong = [], []
        self.slots = 1 << max(16, (ROOM * max(map(len, members), default=1) - 1).bit_length())
        for lo in range(0, len(langs), 64):
            own = members[lo : lo + 64]
            kind = np.uint8 if len(own) <= 8 else np.uint16 if len(own) <= 16 else np.uint64
            plane = np.zeros(self.slots, kind)
            for i, h in enumerate(own):
                bit = kind(1 << i)
                for s in self._slots(h):
                    plane[np.unique(s)] |= bit
                self.wrong.append(float(((plane & bit) > 0).mean() ** 2))
            self.planes.append(plane)
        self.wrong = np.minimum(np.array(self.wrong), 0.999)

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = np.uint64(self.slots - 1)
        return (h & last).astype(np.int64), ((h >> np.uint64(32)) & last).astype(np.int64)

    def counts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Corrected popcounts: (texts, languages)."""
        n = len(off) - 1
        hits, total = np.zeros((len(self.langs), n)), np.zeros(n)
        for order in ORDERS:
            h, text = grams(raw, off, order)
            first = np.searchsorted(text, np.arange(n + 1))
            total += np.diff(first)
            a, b = self._slots(h)
            for p, plane in enumerate(self.planes):
                mask = plane[a] & plane[b]
                for i in range(min(64, len(self.langs) - 64 * p)):
                    c = np.concatenate([[0], np.cumsum((mask >> plane.dtype.type(i)) & plane.dtype.type(1), dtype=np.int64)])
                    hits[64 * p + i] += c[first[1:]] - c[first[:-1]]
        corrected = (hits - total * self.wrong[:, None]) / (1 - self.wrong[:, None])
        return np.maximum(corrected, 0).T


class _Counts:
    """Distinct n-grams of one language with their counts."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.bytes = 0

    def add(self, h: np.ndarray) -> None:
        self.held.append(h)
        if sum(map(len, self.held)) > 4_000_000:
            self.merge()

    def merge(self) -> None:
        u, n = np.unique(np.concatenate(self.held or [self.keys[:0]]), return_counts=True)
        self.keys, where = np.unique(np.concatenate([self.keys, u]), return_inverse=True)
        self.n = np.bincount(where, weights=np.concatenate([self.n, n]), minlength=len(self.keys)).astype(np.int64)
        self.held = []


def members(counts: list[_Counts]) -> list[np.ndarray]:
    """The n-grams that belong to each language: met twice, and at a tenth at least of the highest rate of any."""
    rates = [c.n / max(c.n.sum(), 1) for c in counts]
    keys, where = np.unique(np.concatenate([c.keys for c in counts]), return_inverse=True)
    highest = np.zeros(len(keys))
    np.maximum.at(highest, where, np.concatenate(rates))
    ends = np.cumsum([0, *(len(c.keys) for c in counts)])
    return [c.keys[(c.n >= 2) & (r >= highest[where[a:b]] / 10)] for c, r, a, b in zip(counts, rates, ends[:-1], ends[1:], strict=True)]


def fit(rows: DataFrame, max_docs: int = 1500, max_total: int = 30_000, max_bytes: int = 32 << 20) -> Model | None:
    """Learns from the rows of ``rows`` (doc_id, text, lang); None if no row has both text and lang."""
    rows = rows.where("text is not null and lang is not null")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    langs = sorted(n)
    max_docs = max(1, min(max_docs, max_total // len(langs)))
    # One row for each language.
    share = rows.sparkSession.createDataFrame([(k, min(1.0, max_docs / n[k])) for k in langs], "lang string, share double")
    drawn = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("langid"))
    chosen = rows.select("lang", "text", drawn.alias("drawn")).join(F.broadcast(share), "lang").where(drawn_below(F.col("drawn"), F.col("share")))

    def run(batches):
        counts = {k: _Counts() for k in langs}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = counts[lang]
                raw = np.frombuffer(text.as_buffer(), np.uint8)[: max_bytes - c.bytes]
                c.bytes += len(raw)
                for order in ORDERS:
                    c.add(grams(raw, np.array([0, len(raw)]), order)[0])
        for c in counts.values():
            c.merge()
        return Model(langs, langs.index(max(langs, key=lambda k: n[k])), members([counts[k] for k in langs]))

    return fit_in_a_task(chosen.select("lang", "text", "drawn"), ["drawn", "lang", "text"], run)


def identify(docs: DataFrame, model: Model | None, drop_text: bool = False) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the language's share of all corrected popcounts).

    ``und`` with score 0: a null text, one without a letter, or any text if
    there is no model.  A text whose n-grams no language knows gets the most
    frequent language, with score 0; ties go to the first language by name.
    Repeated rows and other columns pass through (but one named quill__letter).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    lettered = docs.withColumn("quill__letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def make():
        m = held.value

        def run(raw, off):
            n = len(off) - 1
            if m is None:
                return [pa.array([UNKNOWN] * n), np.zeros(n)]
            c = m.counts(raw, off)
            total = c.sum(1)
            best = np.where(total > 0, c.argmax(1), m.prior)
            score = np.where(total > 0, c.max(1) / np.where(total > 0, total, 1), 0.0)
            return [pa.array(m.langs).take(pa.array(best)), score]

        return run

    out = map_texts(lettered, make, "lang_pred string, score double", drop_text=drop_text)
    return out.withColumns({"lang_pred": F.when(F.col("quill__letter"), F.col("lang_pred")).otherwise(F.lit(UNKNOWN)), "score": F.when(F.col("quill__letter"), F.col("score")).otherwise(F.lit(0.0))}).drop("quill__letter")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model, drop_text=True)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
