"""Toxicity: held-out labels, several scripts, an independent subsequence kernel, edges."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.llm import toxicity

DOCS = "doc_id long, text string, lang string"


def sentence(rng, n, letters):
    return " ".join("".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(n))


ALPHABETS = {"latin": ("abcdefgh", ["blockhead", "nitwit", "dunce"]), "accents": ("abcéèêhü", ["béhacé", "cèhaüa", "hébècê"]), "cyrillic": ("абвгдежз", ["болван", "тупица", "дурак"]), "greek": ("αβγδεζηθ", ["βλάκας", "χαζός", "ηλίθιος"])}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows, marks = [], []
    for i in range(2400):
        letters, insults = ALPHABETS[list(ALPHABETS)[i % 4]]
        words = sentence(rng, int(rng.integers(10, 60)), letters).split()
        if i % 3 == 0:
            words.insert(int(rng.integers(0, len(words))), insults[int(rng.integers(0, 3))])
        rows.append((i, " ".join(words), list(ALPHABETS)[i % 4]))
        marks.append((i, int(i % 3 == 0)))
    rows += [(5000, None, ""), (5001, "", ""), (5002, "x " * 50_000 + "nitwit", ""), (5003, "you n i t w i t", ""), (5004, "a block-head!", ""), (5005, "some blockxhead", ""), (5006, "ab" * 3000 + "nitwit", "")]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int")
    return docs, labels, toxicity.train(docs, labels)


def test_held_out_texts_of_every_script(data):
    docs, labels, model = data
    got = toxicity.scored(docs, model).join(docs, "doc_id").join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("lang", "toxic", (F.col("score") >= toxicity.REJECT).alias("bad")).collect()
    for lang in ALPHABETS:
        bad, clean = ([r.bad for r in got if r.lang == lang and r.toxic == y] for y in (1, 0))
        assert len(bad) > 40 and np.mean(bad) >= 0.95 and np.mean(clean) <= 0.02, lang


def test_edges(spark, data):
    docs, labels, model = data
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert got[5000] == got[5001] < 0.3 and all(got[i] >= toxicity.REJECT for i in range(5002, 5006)) and 0 <= got[5006] <= 1
    assert toxicity.without_toxic(docs, model).count() == sum(s < toxicity.REJECT for s in got.values())
    empty = docs.filter("false")
    assert toxicity.scored(empty, model).count() == 0 and toxicity.without_toxic(empty, model).count() == 0
    for some in (labels.filter("false"), labels.filter("toxic = 0")):
        assert toxicity.scored(docs, toxicity.train(docs, some)).filter("score >= 0.7").count() == 0
    repeated = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert len(toxicity.labelled_sample(repeated, labels, "doc_id", "text", "toxic", 2000, 20_000)[0]) == len(toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 2000, 20_000)[0])


def kernel(a: str, b: str) -> float:
    """The kernel of two words of one window, by its definition: all triples of places within reach, and all stretches of four and five."""

    def features(word):
        word, out = f"\1{word}\1", {}
        for i, j, k in combinations(range(len(word)), 3):
            if k - i <= toxicity.REACH:
                key = word[i] + word[j] + word[k]
                out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i - 2)
        for n, w in toxicity.WHOLE.items():
            for i in range(len(word) - n + 1):
                out[word[i : i + n]] = out.get(word[i : i + n], 0.0) + w
        return out, toxicity.NORMS[len(word)]

    (x, nx), (y, ny) = features(a), features(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / (nx * ny)


def test_folded_scores_equal_sums_over_landmarks():
    words, marks, alpha = ["idiot", "idxiot", "other", "é", "дурак", "ab"], ["idiot", "moron", "дурак"], np.array([0.7, -0.2, 0.4])
    codes = toxicity.windows(marks)[0]
    features = toxicity.Features(codes)
    weights = np.zeros(toxicity.TABLE, np.float32)
    weights[features.kinds] = features.vectors(codes) @ alpha
    direct = [sum(a * kernel(w, m) for a, m in zip(alpha, marks)) for w in words]
    assert toxicity.line(toxicity.windows(words)[0], weights) == pytest.approx(direct, abs=1e-5)
    assert kernel("idiot", "idxiot") > 3 * kernel("idiot", "other")


def test_every_letter_is_in_a_window():
    for n in range(1, 60):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        codes, of = toxicity.windows(["a", word, "b"])
        mine = codes[of == 1]
        assert len(mine) == max(1, -(-(n + 2 - toxicity.WIDTH) // toxicity.STEP) + 1) and (codes[of == 0][0][:3] > 0).all()
        assert {tuple(r[r > 0]) for r in mine} and mine[0][0] == 1 and mine[-1][mine[-1] > 0][-1] == 1


def test_a_long_word_is_learnt_whole():
    """An insult at the end of a very long word counts, in training too."""
    rng = np.random.default_rng(1)
    texts = [sentence(rng, 20, "abcdefgh") + " " + "ghab" * (5 + i % 7) + ("nitwit" if i % 2 else "") for i in range(300)]
    model = toxicity.fitted(texts, np.arange(300) % 2)
    got = model.scores(np.array([toxicity.evidence(model.values(sorted(toxicity.words_of(t))).tolist()) for t in ("abc " + "hgba" * 9 + "nitwit", "abc " + "hgba" * 9)]))
    assert got[0] >= toxicity.REJECT > got[1]
