"""Anchors and their contexts."""

import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltworks.llm import anchors, induced_sort

SMALL = anchors.Shape(8, 4, anchors.byte_units)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=5))
def test_each_window_is_in_one_context(texts):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    text, place, extent, gram, context = anchors.anchored(anchors.byte_units(b"".join(raw)), bounds, SMALL)
    chosen, contents, seen = {}, {}, Counter()
    for t, p, e, g, c in zip(text.tolist(), place.tolist(), extent.tolist(), gram.tolist(), context.tolist()):
        low, high = p - (e >> anchors.AFTER), p + (e & (1 << anchors.AFTER) - 1)
        assert contents.setdefault(c, (p - low, raw[t][low:high])) == (p - low, raw[t][low:high])
        for begin in range(low, high - SMALL.length + 1):
            seen[t, begin] += 1
            assert chosen.setdefault(raw[t][begin : begin + SMALL.length], (g, p - begin)) == (g, p - begin)
    assert seen == Counter((t, i) for t, x in enumerate(raw) for i in range(len(x) - SMALL.length + 1))


def test_no_window_is_looked_at_twice(spark):
    """Near copies with one edit each: contexts that overlap would sort a window around an edit several times."""
    text = "".join(map(chr, np.random.default_rng(3).integers(97, 123, 1500)))
    docs = spark.createDataFrame([(i, text[:at] + "?" + text[at + 1 :]) for i, at in enumerate((400, 700, 1100))], "doc_id long, text string")
    shape = induced_sort.SHAPE
    _, different = anchors.texts_of(docs, "doc_id", "text")
    rows = anchors.judged(anchors.anchors(different, shape, False), anchors.frequent(different, shape), False)
    some = anchors.contexts(different, rows.filter("open"), shape, False, induced_sort.stored_bytes)
    windows = Counter((r.key, i) for r in some.select("key", "low", "high").collect() for i in range(r.low, r.high - shape.length + 1))
    assert windows and max(windows.values()) == 1


def test_periods(spark):
    """Windows that repeat within their own context's reach."""
    texts = ["a" * 450, "ab" * 150 + "c" + "ab" * 120, "xyz" * 70, "abcdefg" * 60 + "a" * 210, "a" * 199, "b" * 200, "b" * 199 + "c"]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = {}
    for n, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want[n] = (int(gone.sum()), hashlib.sha256(np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()).hexdigest())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in induced_sort.byte_dedup(docs).collect()} == want
