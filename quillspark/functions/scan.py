"""Counting many patterns in one pass over a text.

All literal terms go into one automaton (goto and fail links, over UTF-8 bytes, flattened into a table of
state x byte).  A batch of texts is one byte array; it is cut into thousands of lanes, each begun early by the length
of the longest term, and all lanes take one step at a time, as numpy gathers.  Word boundaries are
checked at the hits alone.  So work is a few gathers a byte, whatever the number of terms.

A pattern that stands for finitely many literals (alternatives, small classes, optional parts, word boundaries) is expanded into
them.  Another pattern is a regular expression that runs only on texts in which the automaton has found a
literal that the pattern requires.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
import unicodedata
from collections import deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?Ud)"
#: Literals that one pattern is expanded into at most; beyond, it stays a regular expression.
EXPANDED = 256
#: Bytes that are scanned at once, and lanes of a scan.
CHUNK, LANES = 4 << 20, 16384
#: Stands between texts; no UTF-8 text holds it.
BETWEEN = 0xFF


class Term(NamedTuple):
    """A literal, and whether a word boundary is asked for on its left and right."""

    text: str
    left: bool = False
    right: bool = False


def is_word(char: str) -> bool:
    """Letters, marks, digits and connectors."""
    return unicodedata.category(char)[0] in "LM" or unicodedata.category(char) in ("Nd", "Nl", "Pc") or char in "‌‍"


BOUNDARY = object()


def _sequences(tree) -> list[list] | None:
    """What a parsed pattern stands for: lists of characters and ``BOUNDARY``; None if that isn't finite and small."""
    out: list[list] = [[]]
    for op, value in tree:
        if op is sre.LITERAL:
            more = [[chr(value)]]
        elif op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) or (o, v) == (sre.CATEGORY, sre.CATEGORY_DIGIT) for o, v in value):
            more = [[chr(c)] for o, v in value for c in ([v] if o is sre.LITERAL else range(v[0], v[1] + 1) if o is sre.RANGE else range(48, 58))]
        elif op is sre.BRANCH:
            parts = [_sequences(t) for t in value[1]]
            more = None if None in parts else [x for p in parts for x in p]
        elif op is sre.SUBPATTERN:
            more = _sequences(value[3])
        elif op is sre.MAX_REPEAT and value[1] != sre.MAXREPEAT and value[1] <= 3:
            part = _sequences(value[2])
            more = None
            if part is not None and len(part) ** value[1] <= EXPANDED:
                more = []
                for n in range(value[0], value[1] + 1):
                    some: list[list] = [[]]
                    for _ in range(n):
                        some = [a + b for a in some for b in part]
                    more += some
        elif op is sre.AT and value is sre.AT_BOUNDARY:
            more = [[BOUNDARY]]
        else:
            return None
        if more is None or len(out) * len(more) > EXPANDED:
            return None
        out = [a + b for a in out for b in more]
    return out


def can_overlap(a: Term, b: Term) -> bool:
    """Whether an occurrence of ``b`` can begin inside of one of ``a`` (not both at one place, if they are equal)."""
    for k in range(len(a.text)):
        shared = a.text[k : k + len(b.text)]
        if not b.text.startswith(shared) or (k == 0 and a == b):
            continue
        if b.left and k and is_word(a.text[k - 1]) == is_word(b.text[0]):
            continue
        end = k + len(b.text)
        if end < len(a.text) and b.right and is_word(b.text[-1]) == is_word(a.text[end]):
            continue
        if end > len(a.text) and a.right and is_word(a.text[-1]) == is_word(b.text[len(shared)]):
            continue
        return True
    return False


def terms_of(pattern: str, apart: bool = True) -> list[Term] | None:
    """The literals that a pattern stands for; None for a regular expression proper.

    With ``apart`` also None if two of the literals can overlap in a text, as the number of matches then depends on where those before end.
    A digit class stands for the ASCII digits.
    """
    found = _sequences(sre_parser.parse(pattern))
    if found is None:
        return None
    terms = []
    for s in found:
        chars, inner = "".join(c for c in s if c is not BOUNDARY), True
        for i, c in enumerate(s):
            if c is BOUNDARY and 0 < i < len(s) - 1 and BOUNDARY not in (s[i - 1], s[i + 1]):
                inner &= is_word(s[i - 1]) != is_word(s[i + 1])
        if not chars:
            return None
        if inner:
            terms.append(Term(chars, s[0] is BOUNDARY, s[-1] is BOUNDARY))
    terms = list(dict.fromkeys(terms))
    return None if apart and any(can_overlap(a, b) for a in terms for b in terms) else terms


def required(pattern: str) -> list[str] | None:
    """Literals of which every match holds at least one, as long as can be told; None if there are none."""
    best: list[str] | None = None

    def offer(texts: list[str]) -> None:
        nonlocal best
        if texts and all(texts) and (best is None or min(map(len, texts)) > min(map(len, best))):
            best = texts

    run = ""
    for op, value in sre_parser.parse(pattern):
        if op is sre.LITERAL:
            run += chr(value)
            offer([run])
            continue
        run = ""
        some = _sequences([(op, value)])
        if some is not None and op in (sre.SUBPATTERN, sre.BRANCH):
            offer(["".join(c for c in s if c is not BOUNDARY) for s in some])
    return best


class Automaton:
    """Of byte strings: ``table[state | byte]`` is the next state, a multiple of 256, and each state lists the strings that end there.

    States in which a string ends are the last ones, from ``first_hit`` on.
    """

    def __init__(self, strings: list[bytes]):
        goto: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for i, s in enumerate(strings):
            at = 0
            for b in s:
                if b not in goto[at]:
                    goto[at][b] = len(goto)
                    goto.append({})
                    ends.append([])
                at = goto[at][b]
            ends[at].append(i)
        table = np.zeros((len(goto), 256), np.int32)
        fail, queue = [0] * len(goto), deque(goto[0].values())
        for b, n in goto[0].items():
            table[0, b] = n
        while queue:
            at = queue.popleft()
            table[at] = table[fail[at]]
            ends[at] = ends[at] + ends[fail[at]]
            for b, n in goto[at].items():
                fail[n] = int(table[fail[at], b])
                table[at, b] = n
                queue.append(n)
        order = sorted(range(len(goto)), key=lambda n: (bool(ends[n]), n))
        number = np.empty(len(goto), np.int32)
        number[order] = np.arange(len(goto))
        self.root, self.first_hit = int(number[0]) << 8, sum(not e for e in ends) << 8
        self.table = (number[table[order]] << 8).ravel()
        ends = [ends[n] for n in order]
        self.n_ends = np.array([len(e) for e in ends])
        self.first_end = np.cumsum(self.n_ends) - self.n_ends
        self.ends = np.array([i for e in ends for i in e], np.int64)
        self.reach = max(map(len, strings), default=0)

    def hits(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last byte, string) of every occurrence in the bytes."""
        if not len(raw) or not self.reach:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = int(min(LANES, max(1, len(raw) // 256)))
        width, early = -(-len(raw) // lanes), self.reach - 1
        padded = np.full(early + lanes * width, BETWEEN, np.uint8)
        padded[early : early + len(raw)] = raw
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (early + width, lanes), (1, width)))
        state = np.full(lanes, self.root, np.int32)
        seen = np.empty((width, lanes), np.int32)
        for i in range(early + width):
            state = self.table.take(state | steps[i])
            if i >= early:
                seen[i - early] = state
        place = np.flatnonzero(seen >= self.first_hit)
        step, lane = np.divmod(place, lanes)
        state = seen.ravel()[place] >> 8
        n = self.n_ends[state]
        which = np.repeat(self.first_end[state], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(lane * width + step, n), self.ends[which]


def _code_points(raw: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Of the characters whose first bytes stand at ``lead``."""
    b = [raw[np.minimum(lead + i, len(raw) - 1)].astype(np.int64) for i in range(4)]
    low = [x & 0x3F for x in b]
    two, three = (b[0] & 0x1F) << 6 | low[1], (b[0] & 0x0F) << 12 | low[1] << 6 | low[2]
    four = (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]
    return np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0, b[0] < 0xF8], [b[0], two, three, four], 0)


ASCII_WORD = np.array([is_word(chr(i)) for i in range(128)] + [False] * 128)


def _words_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character with a byte at each place is one of a word; places outside are none."""
    inside = (at >= 0) & (at < len(raw))
    at = np.where(inside, at, 0)
    out = ASCII_WORD[raw[at]] & inside
    high = np.flatnonzero(inside & (raw[at] >= 0x80) & (raw[at] != BETWEEN))
    if len(high):
        lead = at[high]
        for _ in range(3):
            lead = np.where((raw[lead] & 0xC0) == 0x80, np.maximum(lead - 1, 0), lead)
        points, back = np.unique(_code_points(raw, lead), return_inverse=True)
        out[high] = np.array([is_word(chr(p)) if p < 0x110000 else False for p in points.tolist()])[back]
    return out


class Counter:
    """Counts of terms in Arrow columns of texts.

    ``groups``: lists of terms.  The count of a group is the number of occurrences of its terms, or, if
    ``distinct``, of its terms that occur.
    """

    def __init__(self, groups: list[list[Term]], distinct: bool):
        self.entries = list(dict.fromkeys(t for g in groups for t in g))
        strings = list(dict.fromkeys(t.text for t in self.entries))
        self.automaton = Automaton([s.encode() for s in strings])
        self.length = np.array([len(s.encode()) for s in strings], np.int64)
        number = {s: i for i, s in enumerate(strings)}
        self.string = np.array([number[t.text] for t in self.entries], np.int64)
        self.left, self.right = (np.array([getattr(t, side) for t in self.entries], bool) for side in ("left", "right"))
        self.starts_word, self.ends_word = (np.array([is_word(t.text[i]) for t in self.entries], bool) for i in (0, -1))
        place = {t: i for i, t in enumerate(self.entries)}
        self.member = np.zeros((len(self.entries), len(groups)), np.int64)
        for g, terms in enumerate(groups):
            for t in terms:
                self.member[place[t], g] = 1
        self.distinct = distinct

    def _chunk(self, raw: np.ndarray, begin: int, end: int, edges: np.ndarray, counts: np.ndarray) -> None:
        """Adds the occurrences that end in ``raw[begin:end]``."""
        back = max(0, begin - self.automaton.reach + 1)
        last, string = self.automaton.hits(raw[back:end])
        last += back
        new = last >= begin
        last, string = last[new], string[new]
        text = np.searchsorted(edges, last, side="right") - 1
        before, after = _words_at(raw, last - self.length[string]), _words_at(raw, last + 1)
        for e, s in enumerate(self.string.tolist()):
            good = string == s
            if self.left[e]:
                good &= before != self.starts_word[e]
            if self.right[e]:
                good &= after != self.ends_word[e]
            counts[:, e] += np.bincount(text[good], minlength=len(counts))

    def __call__(self, column: pa.Array) -> pa.Array:
        column = column.cast(pa.large_string())
        filled = column.fill_null("") if column.null_count else column
        _, off, data = filled.buffers()
        off = np.frombuffer(off, np.int64)[filled.offset : filled.offset + len(filled) + 1]
        own = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        # One byte before each text keeps them apart.
        edges = off[:-1] - off[0] + np.arange(len(filled))
        raw = np.full(len(own) + len(filled), BETWEEN, np.uint8)
        here = np.ones(len(raw), bool)
        here[edges] = False
        raw[here] = own
        counts = np.zeros((len(filled), len(self.entries)), np.int64)
        for begin in range(0, len(raw), CHUNK):
            self._chunk(raw, begin, min(begin + CHUNK, len(raw)), edges, counts)
        of_groups = ((counts > 0) if self.distinct else counts).astype(np.int64) @ self.member
        n = of_groups.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(filled) + 1, n, dtype=np.int32) if n else np.zeros(len(filled) + 1, np.int32)), pa.array(of_groups.ravel().astype(np.int32)))
        return lists if not column.null_count else pa.compute.if_else(column.is_valid(), lists, pa.scalar(None, lists.type))


def count_groups(text: Column, groups: list[list[Term]], distinct: bool = False) -> Column:
    """array<int>: for each group the occurrences of its terms, or how many of its terms occur; null for a null text."""
    counter: list[Counter] = []

    def scan(column: pa.Array) -> pa.Array:
        if not counter:
            counter.append(Counter(groups, distinct))
        return counter[0](column)

    return F.arrow_udf(scan, "array<int>")(text)


def counts(text: Column, patterns: list[list[str]]) -> list[Column]:
    """For each list of patterns the number of their matches, each pattern counted by itself."""
    groups: list[list[Term]] = []
    out = []
    for some in patterns:
        literal = [(p, terms_of(p)) for p in some]
        plain, rest = [t for _, t in literal if t is not None], [p for p, t in literal if t is None]
        # A term that two patterns of a list share counts for each.
        layers: list[list[Term]] = [[]]
        for terms in plain:
            free = next((x for x in layers if not set(x) & set(terms)), None)
            if free is None:
                layers.append(free := [])
            free += terms
        places = list(range(len(groups), len(groups) + len(layers)))
        groups += layers
        guarded = []
        for p in rest:
            need = required(p)
            guarded.append((p, None if need is None else len(groups)))
            if need is not None:
                groups.append([Term(s) for s in need])
        out.append((places, guarded))
    hits = count_groups(text, groups)
    columns = []
    for places, guarded in out:
        total = sum((F.get(hits, F.lit(i)) for i in places[1:]), F.get(hits, F.lit(places[0])))
        for p, place in guarded:
            n = F.regexp_count(text, F.lit(FLAGS + p))
            total = total + (n if place is None else F.when(F.get(hits, F.lit(place)) > 0, n).otherwise(F.when(text.isNotNull(), 0)))
        columns.append(total)
    return columns
