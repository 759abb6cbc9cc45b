"""Every alignment that verifies has a seed: by enumeration of the masks, and against a search of all alignments."""

from itertools import combinations

import numpy as np
import pytest

from siltworks.llm import decontamination as dc


def test_masks_leave_no_pair_of_substitutions_without_a_seed():
    reads = [{at + i for i, c in enumerate(m) if c == "1"} for m in dc.MASKS for at in range(12 - len(m) + 1)]
    assert len({len(m) for m in dc.MASKS}) == 1 and all(m[0] == m[-1] == "1" for m in dc.MASKS)
    assert [p for p in combinations(range(12), 2) if not any(r.isdisjoint(p) for r in reads)] == []


def best(doc, item, window=12):
    """The largest share of equal tokens in a window, over all alignments."""
    width, out = min(window, len(item)), 0.0
    for shift in range(-len(item) + 1, len(doc)):
        same = [0 <= j + shift < len(doc) and doc[j + shift] == t for j, t in enumerate(item)]
        out = max(out, max(sum(same[i : i + width]) for i in range(len(same) - width + 1)) / width)
    return out


def test_substitutions_against_all_alignments(spark):
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]
    items = [word(int(n)) for n in [12] * 8 + [*range(13, 21)] * 2 + [110, 140]]
    docs = []
    for item in items:
        for subs in (1, 2, 2, 3, 3, 4):
            t = list(item[-20:])
            for at in rng.choice(len(t), subs, replace=False):
                t[at] = "zz"
            docs.append(word(int(rng.integers(0, 9))) + t[int(rng.integers(0, 3)) :] + word(int(rng.integers(0, 9))))
    want = {}
    for d, doc in enumerate(docs):
        held = {k: best(doc, item) for k, item in enumerate(items)}
        want[d] = ([k for k, v in held.items() if v >= 0.8], max((v for v in held.values() if v >= 0.8), default=0.0))
    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(rows)], f"{key} long, text string")
    got = dc.decontamination(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert {r.doc_id: r["items"] for r in got} == {d: k for d, (k, _) in want.items()}
    assert {r.doc_id: r.agreement for r in got} == pytest.approx({d: v for d, (_, v) in want.items()})


def test_short_items_against_all_alignments(spark):
    rng = np.random.default_rng(13)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 60, n)]
    items = [word(n) for n in range(1, 12) for _ in range(2)] + [word(15)]
    docs = [word(int(n)) for n in rng.integers(1, 40, 30)]
    for item in items:
        for subs in (0, 1, 2):
            t = list(item)
            for at in rng.choice(len(t), min(subs, len(t)), replace=False):
                t[at] = "zz"
            docs += [word(int(rng.integers(0, 4))) + t + word(int(rng.integers(0, 4))), t[1:], t[:-1]]
    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(rows)], f"{key} long, text string")
    got = dc.decontamination(frame(docs, "doc_id"), frame(items, "item_id"), short=True).collect()
    assert {r.doc_id: r["items"] for r in got} == {d: [k for k, item in enumerate(items) if best(doc, item) >= 0.8] for d, doc in enumerate(docs)}


def test_query_finds_short_items_and_scripts_without_spaces(spark, tmp_path):
    from siltworks.llm.queries import op10_decontamination

    docs = [(1, "Well: what is a lemma? Ask."), (2, "今天我们学习世界上最高的山峰叫什么名字吧"), (3, "nothing of it"), (4, "他说水的沸点是多少度呢")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "What is a lemma?"), (8, "世界上最高的山峰叫什么名字？"), (9, "水的沸点是多少度？")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.doc_id: r["items"] for r in op10_decontamination(spark, str(tmp_path)).collect()} == {1: "7", 2: "8", 3: "", 4: "9"}
