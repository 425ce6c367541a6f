"""Benchmark decontamination with an FM-index for each training shard.

A shard is the texts of one partition that are held together, about 2 MB (or one text
that is longer).  Its symbols are the words that occur in the benchmark; any
other word, and the end of a text, is a separator.  A phrase cannot contain a
separator, so runs of symbols that are shorter than the shortest phrase hold
no occurrence and shrink to their separator.  The shard's suffixes are sorted
by prefix doubling, which gives the Burrows-Wheeler transform; a wavelet
matrix over it answers rank queries.  All phrases are searched backwards at once,
one symbol a step.  Occurrences are located by walking back to sampled suffix
positions, checked word by word, and merged into spans.

The benchmark is broadcast in blocks of ``BLOCK_CHARS`` characters, so no
broadcast outgrows that bound; a larger benchmark takes several passes, whose
spans are merged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as T
from .common import map_texts, table

N = 13
END, SEPARATOR, WORDS = 0, 1, 2
SAMPLE = 8
BLOCK_CHARS = 2_000_000


def _split(raw: np.ndarray, off: np.ndarray, key: int) -> T.Words:
    return T.Words(T.LOWER[raw], off, T.ALNUM, key)


class Phrases:
    """The distinct windows of a block of benchmark items, as rows of symbols."""

    def __init__(self, items: list[tuple[int, str]], n: int = N):
        self.ids, self.key = [None if i is None else str(i) for i, _ in items], T.new_key()
        raw, off = T.buffers(pa.array([t or "" for _, t in items], pa.large_string()))
        words = _split(raw[off[0] : off[-1]], off - off[0], self.key)
        data = words.raw.tobytes()
        spelled = [data[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
        known = dict(zip(spelled, words.hashes().tolist(), strict=True))
        #: Words of the symbols from ``WORDS`` on, in order of their hashes, and these.
        self.spelled = sorted(known, key=lambda w: (known[w], w))
        self.vocabulary = np.array([known[w] for w in self.spelled], np.uint64)
        #: Hashes that several words have.
        self.shared = np.unique(self.vocabulary[1:][self.vocabulary[1:] == self.vocabulary[:-1]])
        self.symbol = {w: i + WORDS for i, w in enumerate(self.spelled)}
        symbols = [self.symbol[w] for w in spelled]
        seen: dict[tuple, int] = {}
        self.items: list[list[int]] = []
        distinct = []
        for item, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            k = min(n, b - a)
            for j in range(a, b - k + 1 if k else a):
                row = tuple(symbols[j : j + k])
                if row not in seen:
                    seen[row] = len(distinct)
                    distinct.append(row)
                    self.items.append([])
                if item not in self.items[seen[row]]:
                    self.items[seen[row]].append(item)
        self.length = np.array([len(s) for s in distinct], np.int64)
        self.longest, self.shortest = int(self.length.max(initial=0)), int(self.length.min(initial=0))
        #: Last symbol first, as backward search takes them; padded with 0.
        self.backward = np.zeros((len(distinct), self.longest), np.int64)
        for i, s in enumerate(distinct):
            self.backward[i, : len(s)] = s[::-1]

    def symbols(self, words: T.Words) -> np.ndarray:
        """The symbol of each word, by its hash; of a hash that several words of the benchmark have, by its bytes."""
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        out = np.where(self.vocabulary[at] == h, at + WORDS, SEPARATOR)
        for i in np.flatnonzero(np.isin(h, self.shared)).tolist() if len(self.shared) else ():
            out[i] = self.symbol.get(words.raw[words.start[i] : words.end[i]].tobytes(), SEPARATOR)
        return out


class Wavelet:
    """A wavelet matrix of symbols: rank(c, i), how often c is among the first i."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ranks = bits, [], []
        for b in range(bits - 1, -1, -1):
            one = (symbols >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(one) - self.ranks[-1][-1]))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        begin, end = np.zeros(len(i), np.int64), np.asarray(i, np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, up = self.ranks[level], ((c >> b) & 1).astype(bool)
            b1, e1 = ones[begin], ones[end]
            begin = np.where(up, self.zeros[level] + b1, begin - b1)
            end = np.where(up, self.zeros[level] + e1, end - e1)
        return end - begin


class FMIndex:
    """Of a sequence that ends with the one END in it."""

    def __init__(self, s: np.ndarray, n_symbols: int):
        n, step = len(s), 1
        order = np.argsort(s, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], (s[order][1:] != s[order][:-1]).cumsum()])
        while rank.max() < n - 1:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + ahead
            order = np.argsort(key, kind="stable")
            rank[order] = np.concatenate([[0], (key[order][1:] != key[order][:-1]).cumsum()])
            step *= 2
        self.n = n
        self.bwt = s[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n_symbols))])
        self.wavelet = Wavelet(self.bwt, max(1, int(n_symbols - 1).bit_length()))
        #: Suffix positions are kept where they are multiples of SAMPLE.
        self.sampled = order % SAMPLE == 0
        self.kept_before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.kept = order[self.sampled]

    def search(self, backward: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase."""
        lo, hi = np.zeros(len(length), np.int64), np.full(len(length), self.n, np.int64)
        for step in range(backward.shape[1]):
            on = np.flatnonzero((length > step) & (lo < hi))
            if not len(on):
                break
            c = backward[on, step]
            lo[on] = self.first[c] + self.wavelet.rank(c, lo[on])
            hi[on] = self.first[c] + self.wavelet.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(on := np.flatnonzero(~self.sampled[rows])):
            c = self.bwt[rows[on]]
            rows[on] = self.first[c] + self.wavelet.rank(c, rows[on])
            steps[on] += 1
        return self.kept[self.kept_before[rows]] + steps


def _occurrences(p: Phrases, words: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and phrase of every occurrence in a shard."""
    none = np.zeros(0, np.int64)
    if not len(p.length) or not len(words):
        return none, none
    symbol = p.symbols(words)
    ends = np.zeros(len(symbol) + 1, bool)
    ends[words.first] = True
    begins = (symbol != SEPARATOR) & (np.concatenate([[True], symbol[:-1] == SEPARATOR]) | ends[:-1])
    stops = (symbol != SEPARATOR) & (np.concatenate([symbol[1:] == SEPARATOR, [True]]) | ends[1:])
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long = stop - begin >= p.shortest
    begin, stop = begin[long], stop[long]
    if not len(begin):
        return none, none
    size = stop - begin + 1  # each run and its separator
    base = np.cumsum(size) - size
    sequence, place = np.full(int(size.sum()) + 1, SEPARATOR, np.int64), np.full(int(size.sum()) + 1, -1, np.int64)
    inside = np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
    target, source = np.repeat(base, size - 1) + inside, np.repeat(begin, size - 1) + inside
    sequence[target], place[target] = symbol[source], source
    sequence[-1] = END
    index = FMIndex(sequence, WORDS + len(p.vocabulary))
    lo, hi = index.search(p.backward, p.length)
    count = hi - lo
    phrase = np.repeat(np.arange(len(count)), count)
    if not len(phrase):
        return none, none
    rows = np.repeat(lo, count) + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
    first = place[index.locate(rows)]
    # Equal hashes aren't yet equal words: spell out each word of an occurrence once.
    used = np.unique(np.repeat(first, p.length[phrase]) + np.arange(int(p.length[phrase].sum())) - np.repeat(np.cumsum(p.length[phrase]) - p.length[phrase], p.length[phrase]))
    wrong = np.zeros(len(symbol) + 1, np.int64)
    for i in used.tolist():
        wrong[i + 1] = words.raw[words.start[i] : words.end[i]].tobytes() != p.spelled[symbol[i] - WORDS]
    wrong = np.cumsum(wrong)
    good = wrong[first + p.length[phrase]] == wrong[first]
    return first[good], phrase[good]


SPANS = "array<struct<begin:int,end:int>>"


def _pass(docs: DataFrame, phrases: Phrases) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(phrases)

    def make():
        p = held.value

        def run(raw, off):
            words, n = _split(raw, off, p.key), len(off) - 1
            first, phrase = _occurrences(p, words)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + p.length[phrase], -1)
            covered = np.cumsum(edge)[:-1] > 0
            text = T.text_of(words.first)
            change = np.diff(np.concatenate([[0], covered, [0]]).astype(np.int8))
            begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            # A run of covered words may go on in the next text: cut it there.
            cut = words.first[1:-1]
            cut = cut[(cut > 0) & (cut < len(words))]
            cut = cut[covered[cut] & covered[cut - 1]]
            begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
            spans: list[list] = [[] for _ in range(n)]
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                t = int(text[b])
                spans[t].append({"begin": b - int(words.first[t]), "end": e - int(words.first[t])})
            items: list[set] = [set() for _ in range(n)]
            for f, q in zip(first.tolist(), phrase.tolist(), strict=True):
                items[int(text[f])].update(p.items[q])
            found = [sorted({p.ids[i] for i in x} - {None}) for x in items]
            hit = np.concatenate([[0], np.cumsum(covered)])
            return [words.counts(), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(found, pa.list_(pa.string())), hit[words.first[1:]] - hit[words.first[:-1]]]

        return run

    return map_texts(docs, make, f"n_words long, spans {SPANS}, items array<string>, n_hit long", drop_text=False)


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    rows, size, some = [], 0, False
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= block_chars:
            yield Phrases(rows)
            rows, size, some = [], 0, True
    if rows or not some:
        yield Phrases(rows)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds n_words, spans (of words that lie in an occurrence of a window), n_hit, items, contaminated.

    A window is 13 consecutive words of an item, or a whole item of fewer
    words; an item without words has none.  ``contaminated``: at least a 20th
    of the words are hit.  A null or empty text has no words and isn't
    contaminated.  An item without an id hits words but is not listed.  Items that share an
    id count once.  Other columns pass through, those with the names
    of added ones, or beginning with quill__, are replaced; repeated rows stay.
    """
    docs = docs.select(*(c for c in docs.columns if not c.lower().startswith("quill__")))
    out = None
    for phrases in blocks(benchmark, block_chars):
        if out is None:
            out = _pass(docs, phrases)
            continue
        before = {c: f"quill__{c}" for c in ("n_words", "spans", "items", "n_hit")}
        out = _pass(out.withColumnsRenamed(before), phrases)
        both = F.concat("quill__spans", "spans")
        hit = F.array_distinct(F.flatten(F.transform(both, lambda s: F.sequence(s["begin"], s["end"] - 1))))
        out = out.withColumns({"spans": F.array_sort(F.array_distinct(both)), "items": F.concat("quill__items", "items"), "n_hit": F.size(hit).cast("long")}).drop(*before.values())
    out = out.withColumn("items", F.array_sort(F.array_distinct("items")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), l AS (SELECT DISTINCT k FROM p),
c AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS i FROM d, l)
), m AS (
  SELECT doc_id, i, c.k, item FROM c JOIN p ON c.k = p.k AND c.win = p.win
), h AS (
  SELECT doc_id, count(DISTINCT x)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*)::BIGINT AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
