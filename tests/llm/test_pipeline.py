"""The corpus pipeline against brute force, stage by stage, and on nulls, repeats, empty tables and clashing names."""

import re

import numpy as np
import pytest

import corpus_pipeline
from siltworks.llm import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n))


def rows_of(rng):
    rows = [(i, sentence(rng, int(rng.integers(8, 90))), f"s{i % 3}") for i in range(300)]
    for i in range(0, 300, 4):
        words = rows[i][1].split()
        words.insert(int(rng.integers(0, len(words))), "nitwit")
        rows[i] = (i, " ".join(words), rows[i][2])
    item = sentence(rng, 20)
    rows += [(400, rows[1][1].replace(" ", "\n\t"), "s9"), (401, rows[2][1], None), (2, rows[2][1], "s2")]  # exact copies and a repeated row
    for k in range(5):  # near copies
        words = (rows[5][1] + " " + sentence(np.random.default_rng(3), 60)).split()
        words[k] = f"changed{k}"
        rows.append((500 + k, " ".join(words), "s1"))
    rows += [(600, f"{sentence(rng, 9)} {item} {sentence(rng, 9)}", "s0"), (601, item.upper(), "s0")]  # benchmark leaks
    rows += [(700, None, "s0"), (701, "", None), (702, " \n", "s1"), (703, sentence(rng, 4000), "s2"), (None, sentence(rng, 30), "s2")]
    return rows, [(1, item), (2, None), (3, "")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    rows, items = rows_of(rng)
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", "y") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, key string, digest string")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int("nitwit" in (t or ""))) for i, t, _ in rows if i is not None and i < 300], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def without_exact(rows):
    """Of texts that are equal but for white space, one row with the smallest id."""
    kept = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    return list(kept.values())


def without_near(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (WORD.findall(r[1] or "") for r in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (rows[i][1] or "") == (rows[j][1] or ""):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r), r, key=lambda r: (r[0] is None, r[0] or 0))
    return list(least.values())


def without_leaks(rows, items):
    def tokens(t):
        return [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]

    def held(doc, item):
        width = min(12, len(item))
        for shift in range(-len(item) + 1, len(doc)):
            same = [0 <= j + shift < len(doc) and doc[j + shift] == t for j, t in enumerate(item)]
            if max((sum(same[k : k + width]) for k in range(len(item) - width + 1)), default=0) >= 0.8 * width:
                return True
        return False

    return [r for r in rows if not any(tokens(t) and held(tokens(r[1]), tokens(t)) for _, t in items)]


def test_every_stage_against_brute_force(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, want = docs.columns, rows
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    of = toxicity.scorer(model)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.cut(stage(spark, docs, folder))
        if k == 0:
            want = [r for r, s in zip(want, of([r[1] for r in want])) if s < toxicity.REJECT]
            gone = {r[0] for r in rows} - {r[0] for r in want}
            assert all("nitwit" in r[1] for r in rows if r[0] in gone) and len(gone) >= 70  # clean documents stay
        else:
            want = {1: without_exact, 2: without_near, 3: lambda x: without_leaks(x, items)}[k](want)
        got = docs.select("doc_id", "text", "source").collect()
        assert docs.columns == columns, name
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want)), name
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in want)
    assert all(r.size == len(WORD.findall(next(t for i, t, _ in want if i == r.doc_id) or "")) and r.taken <= 2 * r.size for r in out)
    taken = {}
    for r in out:
        taken.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(a - t) <= 45 for a, t in taken.values())


def test_empty_tables(spark, tables, tmp_path):
    folder, _, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
