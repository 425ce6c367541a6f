"""Words of equal hashes: none can be made, and where hashes are equal, bytes decide."""

import numpy as np
import pytest

from quillspark.llm import decontaminate, ngram_jaccard, substring_dedup
from quillspark.llm import textnp as T

#: Had one hash under the mixer with public constants of an earlier version.
PAIR = ("5xxnmnzs99zz9z79", "5wex9qbiybnd8nqn")


def hashes(text, key):
    raw = np.frombuffer(text.encode(), np.uint8)
    return T.Words(raw, np.array([0, len(raw)]), key=key).hashes()


def test_hashes_depend_on_the_key():
    text = " ".join([*PAIR, "a", "eightbyt", "ninebytes", "x" * 64, "y" * 65])
    seen = [hashes(text, k) for k in (0, 1, T.new_key(), T.new_key())]
    assert all(len(set(h.tolist())) == 7 for h in seen)
    assert all((a != b).all() for i, a in enumerate(seen) for b in seen[:i])


@pytest.fixture
def poor(monkeypatch):
    """Hashes of one bit."""
    right = T.Words.hashes
    monkeypatch.setattr(T.Words, "hashes", lambda self: right(self) & np.uint64(1))


@pytest.mark.usefixtures("poor")
def test_shingles_by_bytes():
    texts = [b"a b c d e f g a b c d e", b"a b c d e f h a b c d e", b"a b", b"", b"q w e r t y u i o p"]
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := t.split()) else set() for t in texts]
    own = [ngram_jaccard.ShingleSet(t) for t in texts]
    assert [len(x) for x in own] == [len(s) for s in sets]
    assert [[x.shared(y) for y in own] for x in own] == [[len(a & b) for b in sets] for a in sets]
    whole = b"".join(texts)
    words = ngram_jaccard._split(np.frombuffer(whole, np.uint8), np.cumsum([0, *map(len, texts)]), 0)
    assert np.diff(ngram_jaccard.shingles(words)[1]).tolist() == [len(s) for s in sets]


@pytest.mark.usefixtures("poor")
def test_benchmark_items_by_bytes():
    items = [(1, PAIR[0]), (2, PAIR[1]), (3, "one two three")]
    p = decontaminate.Phrases(items)
    for text, want in ((PAIR[0], [(0, 0)]), (PAIR[1], [(0, 1)]), ("other", []), (f"x {PAIR[1]} one two three two three", [(1, 1), (2, 2)])):
        raw = np.frombuffer(text.encode(), np.uint8)
        first, phrase = decontaminate._occurrences(p, decontaminate._split(raw, np.array([0, len(raw)]), p.key))
        assert sorted((f, p.items[q][0]) for f, q in zip(first.tolist(), phrase.tolist(), strict=True)) == want


def test_the_pair_in_every_operator(spark):
    a, b = PAIR
    other = [f"w{i}" for i in range(40)]
    rows = [(1, f"a b c d {a} a b c d {b}"), (2, " ".join([*other[:20], a, *other[20:]])), (3, " ".join([*other[:20], b, *other[20:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_shingles"] for r in ngram_jaccard.linked(docs).collect()} == {1: 6, 2: 37, 3: 37}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove(docs).collect()} == {1: 0, 2: 0, 3: 0}
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    assert {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(docs, bench).collect()} == {1: ["1", "2"], 2: ["1"], 3: ["2"]}
