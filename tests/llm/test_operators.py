"""The ten operators against brute force, exact round trips and held-out labels, and on nulls, empty tables, ties and long texts."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.llm import anchors, chat_format, decontamination, exact_dedup, induced_sort, near_dedup, suffix_trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, more=""):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def mixture(spark):
    """Copies, near copies, shared passages, repeats within a text, nulls, empty and very long texts, repeated rows."""
    rng = np.random.default_rng(3)
    base = [sentence(rng, int(n)) for n in rng.integers(1, 200, 40)]
    passage, rows = sentence(rng, 70), []
    for i, t in enumerate(base):
        rows.append((i, t, f"s{i % 3}"))
    for i in range(40, 60):  # copies and near copies
        words = base[i - 40].split()
        if i % 2 and len(words) > 60:
            words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), None))
    rows += [(60 + k, f"{sentence(rng, 5 + k)} {passage} {sentence(rng, 9)}", "s0") for k in range(8)]
    rows += [(70, passage + " x " + passage, "s1"), (71, None, "s2"), (72, "", "s2"), (73, " \n ", None), (74, "é漢" * 300, "s1"), (75, "ab " * 3000, "s1"), (76, sentence(rng, 20_000), "s1"), (3, base[3], "s0"), (80, base[5].replace(" ", "\n\t"), "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, mixture):
    return frame(spark, mixture).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\|user|>", "<|end|>\n", "<<SYS>>x<</SYS>>", "\\", "<\\\\/s>", "", None, "é😀[INST\\]"]
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate([("user", nasty[c]), ("assistant", nasty[c + 3]), ("we|ird\n\\p", nasty[c + 6])])]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.read_back(chat_format.chat_format(chat_format.as_chains(conv))).collect()
    assert len(out) == 3
    for r in out:
        mine = [(role, x or "") for c, _, role, x in rows if c == r.tree]
        assert [(t.role, t.text) for t in r.turns] == mine
        assert list(r.loss_texts) == [x for role, x in mine if role == "assistant"]
        inside = "".join(x for x in [r.conversation] if x)
        assert not re.search(r"</s>|\[/?INST\]|<</?SYS>>", inside) and inside.count("<|end|>") == 3
    assert chat_format.chat_format(chat_format.as_chains(conv.filter("false"))).count() == 0


def test_chat_roles_repeats_and_long_conversations(spark):
    roles = ["</s>", "[INST]", "a|b\n%7C%25\\x00", "\x00\x01", "", None, "assistant", "<|end|>\n"]
    rows = [(1, t, r, f"text {t}") for t, r in enumerate(roles)]
    rows += [(2, 5, "user", "same"), (2, 5, "user", "same"), (2, 5, "assistant", "tied"), (2, None, "user", "first")]
    rows += [(3, t, ("user", "assistant")[t % 2], f"{t} </s>") for t in range(700)]
    rows += [(4, 0, "user", "x" * 300_000), (None, 0, "user", "no id")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit("x"), "tree": F.lit(1)})
    out = {r.tree: r for r in chat_format.read_back(chat_format.chat_format(chat_format.as_chains(conv))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r or "", f"text {k}") for k, r in enumerate(roles)]
    assert not re.search(r"</?s>|\[/?INST\]", out[1].conversation) and out[1].conversation.count("<|end|>") == len(roles)
    assert [t.text for t in out[2].turns] == ["first", "tied", "same", "same"]
    assert [t.text for t in out[3].turns] == [f"{t} </s>" for t in range(700)] and len(out[3].loss_texts) == 350
    assert len(out[4].turns[0].text) == 300_000 and out[None].turns[0].text == "no id"


def test_reply_trees_with_cycles(spark):
    """Leaves below a cycle beside a long chain: neither paths nor rounds come from the cycle."""
    rows = [("t", 0, 1), ("t", 1, 0)] + [("t", 10 + k, k % 2) for k in range(20)] + [("c", k, k - 1 if k else None) for k in range(200)] + [("s", 7, 7)]
    trees = spark.createDataFrame(rows, "tree string, node int, parent int").withColumn("score", F.lit(1.0))
    got = chat_format.root_to_leaf(trees).collect()
    assert [(r.tree, r.leaf, r.node) for r in sorted(got, key=lambda r: r.depth)] == [("c", 199, k) for k in range(200)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("<>[]\\|/sINSTY e\n", max_size=12), min_size=1, max_size=20))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert r.t == r.u and not re.search(r"</?s>|\[/?INST\]|</?SYS>>|<\|", r.e)


def test_reply_trees(spark):
    #      1 -> 2 -> 4      two leaves below 2, one below 3
    rows = [("a", 1, None, 0.0), ("a", 2, 1, 5.0), ("a", 3, 1, 1.0), ("a", 4, 2, 1.0), ("a", 5, 2, 2.0), ("b", 1, 99, None), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0)]
    trees = spark.createDataFrame(rows, "tree string, node int, parent int, score double")
    got = defaultdict(list)
    for r in sorted(chat_format.root_to_leaf(trees).collect(), key=lambda r: (r.tree, r["rank"], r.depth)):
        got[r.tree, r["rank"]].append(r.node)
    assert dict(got) == {("a", 1): [1, 2, 5], ("a", 2): [1, 2, 4], ("a", 3): [1, 3], ("b", 1): [1]}
    assert {r.leaf for r in chat_format.root_to_leaf(trees, 1).collect()} == {5, 1}


# 3


def test_exact_dedup(docs, mixture, empty):
    norm = {}
    groups = defaultdict(list)
    for i, t, _ in mixture:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(mixture)
    for r in rows:
        text = next(k for k, v in groups.items() if r.doc_id in v)
        assert (r.keep_id, r.group_size, r.text_sha256) == (min(groups[text]), len(groups[text]), hashlib.sha256(text.encode()).hexdigest())
        norm[r.doc_id] = r.kept
    assert sum(r.kept for r in rows) == len(groups)  # one of the rows that repeat id 3
    assert Counter(r.doc_id for r in rows if r.kept)[3] == 1
    assert exact_dedup.exact_dedup(empty).count() == 0
    stay = exact_dedup.without_copies(docs).collect()
    assert sorted(r.doc_id for r in stay) == sorted(min(v) for v in groups.values()) and set(stay[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_exact_dedup_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (2, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == [(-1, -1, False), (-1, -1, True), (-1, 2, False), (2, 2, True)]


# 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80))
def test_suffix_array(values):
    t = np.array([*values, 0], np.int32)
    assert induced_sort.suffix_array(t, 258).tolist() == sorted(range(len(t)), key=lambda i: t.tolist()[i:])


def test_suffix_array_spills(monkeypatch):
    monkeypatch.setattr(induced_sort, "QUEUE_BYTES", 64)
    t = np.array([*np.random.default_rng(0).integers(1, 5, 500), 0], np.int32)
    assert induced_sort.suffix_array(t, 258).tolist() == sorted(range(len(t)), key=lambda i: t.tolist()[i:])


def brute_bytes(rows):
    count = Counter()
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    for _, b in raw:
        count.update(b[i : i + 200] for i in range(len(b) - 199))
    out = Counter()
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i, len(b), int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot,burning,often,combined", [(2_000, 20_000, 32, 4_000_000), (2, 20_000, 2, 1), (2, 20_000, 2, 4_000_000), (2, 3, 2, 500)])
def test_byte_dedup(docs, mixture, empty, monkeypatch, hot, burning, often, combined):
    for name, value in {"HOT": hot, "BURNING": burning, "OFTEN": often, "COMBINED": combined, "ENGINE_BYTES": 5_000 * hot, "HELD_BYTES": 5_000 * hot}.items():
        monkeypatch.setattr(anchors, name, value)
    assert Counter(tuple(r) for r in induced_sort.byte_dedup(docs).collect()) == brute_bytes(mixture)
    assert induced_sort.byte_dedup(empty).count() == 0


# 6


# 7


def brute_words(rows):
    first, out = {}, Counter()
    every = sorted(((i, WORD.findall(t or "")) for i, t, _ in rows), key=lambda r: r[0])
    for i, w in every:
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in every:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot,burning,often,combined,group", [(2_000, 20_000, 32, 4_000_000, 20_000), (2, 20_000, 2, 1, 2), (2, 20_000, 2, 4_000_000, 30), (2, 3, 2, 500, 5)])
def test_substring_dedup(docs, mixture, empty, monkeypatch, hot, burning, often, combined, group):
    for name, value in {"HOT": hot, "BURNING": burning, "OFTEN": often, "COMBINED": combined, "ENGINE_BYTES": 5_000 * hot, "HELD_BYTES": 5_000 * hot}.items():
        monkeypatch.setattr(anchors, name, value)
    monkeypatch.setattr(suffix_trees, "GROUP", group)
    assert Counter(tuple(r) for r in suffix_trees.substring_dedup(docs).collect()) == brute_words(mixture)
    assert suffix_trees.substring_dedup(empty).count() == 0


# 9


def brute_links(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (WORD.findall(t or "") for _, t, _ in rows)]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), 1 << 62), rows[i][0])
    return Counter((rows[i][0], least[find(i)], links[i]) for i in range(n))


@pytest.mark.parametrize("tile", [512, 2])
def test_near_dedup(spark, docs, mixture, empty, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rng = np.random.default_rng(4)
    base = sentence(rng, 80).split()
    group = []
    for i in range(30):  # a group in which not all pairs are linked
        words = list(base)
        for k in rng.choice(80, 2, replace=False):
            words[k] = f"v{i}"
        group.append((200 + i, " ".join(words), "s"))
    rows = mixture + group
    got = Counter(tuple(r) for r in near_dedup.near_dedup(frame(spark, rows).repartition(3)).collect())
    assert got == brute_links(rows)
    assert near_dedup.near_dedup(empty).count() == 0


def test_pruning_keeps_what_can_reach():
    least = near_dedup.least_agreements()
    assert least == sorted(least) and least[-1] < 0.8 * near_dedup.HASHES - 4 * (0.16 * near_dedup.HASHES) ** 0.5
    assert least[-1] > 0.4 * near_dedup.HASHES


def test_components(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y"), ("y", "z"), ("q", "q")]
    got = {r.u: r.root for r in near_dedup.components(spark.createDataFrame(chain, "u string, v string")).collect()}
    assert got == {f"{i:03}": "000" for i in range(1, 41)} | {"y": "x", "z": "x"}


# 10


def test_decontamination(spark, docs, empty):
    rng = np.random.default_rng(10)
    items = [(k, sentence(rng, n)) for k, n in enumerate([15, 30, 60, 5, 300])] + [(9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def changed(text, every):
        return " ".join("zz" if every and i % every == every - 1 else w for i, w in enumerate(text.split()))

    rows = [(1, f"{sentence(rng, 30)} {items[0][1].upper()}! {sentence(rng, 3)}", "s"), (2, changed(items[1][1], 9), "s"), (3, changed(items[2][1], 2), "s"), (4, f"oh {items[3][1]}", "s"), (5, items[4][1][400:], "s"), (6, None, "s"), (7, "", "s"), (8, sentence(rng, 500), "s"), (8, items[0][1], "s")]
    got = {r.doc_id: (r["items"], r.contaminated) for r in decontamination.decontamination(frame(spark, rows), bench).collect()}
    assert got == {1: ([0], True), 2: ([1], True), 3: ([], False), 4: ([3], True), 5: ([4], True), 6: ([], False), 7: ([], False), 8: ([0], True)}
    assert {r.doc_id for r in decontamination.without_contaminated(frame(spark, rows), bench).collect()} == {3, 6, 7}
    assert decontamination.decontamination(empty, bench).count() == 0
    assert decontamination.decontamination(docs, bench.filter("false")).filter("contaminated").count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(11)
    items = [(k, sentence(rng, 40)) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, f"{sentence(rng, 9)} {t}", "s") for k, t in items]
    whole = sorted(map(str, decontamination.decontamination(frame(spark, rows), bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_SEEDS", 400)
    assert sorted(map(str, decontamination.decontamination(frame(spark, rows), bench).collect())) == whole
