"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks, trained on labelled texts.

A sentence is looked at through windows of WIDTH letters: each word between two marks for its ends, and the parts of longer words. The kernel
of two windows is the sum, over all sequences of three letters or marks, of the product of their gap-weighted counts: a sequence counts with
DECAY to the power of the letters that it skips, over stretches of at most REACH letters. Inserted letters thus lengthen some stretches and
leave the rest, so `idxiot` stays close to `idiot`. Stretches of four and five letters side by side count too, which tells stems apart that
share most threes. The kernel of two sentences is that of their closest windows, so that clean words around an insult don't dilute it. A text scores as its highest window, and every further word above NEAR adds what it is above. Runs of single letters (`i d i o t`)
count as one word, and what is no letter or digit within a word (`i-d-i-o-t`) is passed over.

Letters of all scripts count, and accents too: digits, a to z and the Latin letters with accents have codes of their own, and all other
letters share those that are left, so no script is without features.

Nyström: windows are mapped to their kernel values with a set of landmarks, whitened by the landmarks' own kernel matrix, and a linear
machine is trained there. As the kernel has an explicit (sparse) feature map, the sum over landmarks is folded into one weight for each
sequence of three codes, which gives exactly the same scores at a cost that doesn't depend on the number of landmarks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, whole

#: Codes: 0 pads, 1 marks the end of a word, then digits and a to z, then the letters from U+00DF to U+00FF, then shared ones.
SIZE = 128
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SHARED = len(LETTERS) + 2
CODES = np.array([SHARED + (c * 40_503 >> 4) % (SIZE - SHARED) for c in range(256)], np.uint8)
CODES[[ord(c) for c in LETTERS]] = np.arange(2, SHARED)
CODES[1] = 1
DECAY, REACH, WIDTH, STEP = 0.8, 6, 9, 2
#: The patterns of three places of a window, and the weight of each.
PLACES = [(i, j, k, DECAY ** (k - i - 2)) for i in range(WIDTH) for k in range(i + 2, min(i + REACH + 1, WIDTH)) for j in range(i + 1, k)]
#: Stretches of so many letters count whole, too, with these weights; their codes are hashed into LONG more places of the table.
WHOLE, LONG = {4: 1.0, 5: 1.0}, 1 << 20
TABLE = SIZE**3 + LONG
#: The norm of a window of as many letters and marks if all its sequences differ.
NORMS = np.array([max(1.0, sum(w * w for _, _, k, w in PLACES if k < n) + sum(w * w * max(0, n - k + 1) for k, w in WHOLE.items())) ** 0.5 for n in range(WIDTH + 1)], np.float32)
REJECT = 0.7
#: Training: the cost of errors; the weight of a negative window; the value below which a witness is doubted; the share of toxic texts from which a
#: window counts as toxic although clean texts have it. Scoring: the value above which further windows add to a text's evidence.
COST, NEGATIVE, DOUBT, SURE, NEAR = 8.0, 0.3, -0.5, 0.9, -0.2
REMEMBERED, SLICE = 150_000, 256  # scores of words that a worker keeps; texts scored at once

_INSERTED = re.compile(r"[\W_]+")


def letters(word: str) -> str:
    """A word without what is no letter or digit, if anything else is left. Words are lower case by then."""
    return word if word.isalnum() else _INSERTED.sub("", word) or word


def words_of(text: str) -> set[str]:
    """The distinct words of the whole text, and its runs of three or more single characters as words."""
    tokens = text.lower().split()
    out = set(tokens)
    single = bytes(map((1).__eq__, map(len, tokens)))
    if b"\1\1\1" in single:
        out.update("".join(tokens[m.start() : m.end()]) for m in re.finditer(b"\1{3,}", single))
    return out


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of each word as rows of codes, and the word that each belongs to. Every letter of a word is in one."""
    bare = [letters(w) for w in words]
    size = np.array([len(w) + 2 for w in bare], np.int64)
    points = np.frombuffer(("\1" + "\1\1".join(bare) + "\1").encode("utf-32-le", "surrogatepass"), np.uint32) if bare else np.zeros(0, np.uint32)
    flat = np.where(points < 256, CODES[points & 0xFF], SHARED + ((points.astype(np.uint64) * np.uint64(40_503)) >> np.uint64(4)) % np.uint64(SIZE - SHARED)).astype(np.uint8)
    many = np.maximum(0, -(-(size - WIDTH) // STEP)) + 1
    of = np.repeat(np.arange(len(words)), many)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    end = np.cumsum(size)
    start = np.minimum(end[of] - size[of] + nth * STEP, np.maximum(end[of] - WIDTH, end[of] - size[of]))
    at = start[:, None] + np.arange(WIDTH)
    return np.where(at < end[of][:, None], flat[np.minimum(at, len(flat) - 1)], 0).astype(np.uint8), of


def sequences(c: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pattern of places: the code of the sequence there in each window, 0 where it is beyond the end, and its weight."""
    col = c.T.astype(np.int32)
    for i, j, k, w in PLACES:
        yield np.where(col[k] > 0, (col[i] * SIZE + col[j]) * SIZE + col[k], 0), w
    for n, w in WHOLE.items():
        for i in range(WIDTH - n + 1):
            yield np.where(col[i + n - 1] > 0, stretch(col, i, n), 0), w


def stretch(col: np.ndarray, i: int, n: int) -> np.ndarray:
    """The place in the table of the n codes from i on."""
    h = col[i].astype(np.uint32)
    for k in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + col[i + k].astype(np.uint32) * np.uint32(0x9E3779B1)
    return (SIZE**3 + ((h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39) >> np.uint32(12))).astype(np.int32)


def norms(c: np.ndarray) -> np.ndarray:
    return NORMS[(c > 0).sum(1)]


def line(c: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of the weights of the sequences of each window, by its norm. The weight of every sequence that ends in padding is 0."""
    out = np.zeros(len(c), np.float32)
    pair = None
    for part in np.array_split(np.arange(len(c)), max(1, len(c) // 20_000)):
        col = np.ascontiguousarray(c[part].T.astype(np.int32))
        total, last = np.zeros(len(part), np.float32), None
        for i, j, k, w in PLACES:
            if last != (i, j):
                pair, last = (col[i] * SIZE + col[j]) * SIZE, (i, j)
            total += np.float32(w) * weights.take(pair + col[k])
        for n, w in WHOLE.items():
            for i in range(WIDTH - n + 1):
                total += np.float32(w) * np.where(col[i + n - 1] > 0, weights.take(stretch(col, i, n)), 0)
        out[part] = total / norms(c[part])
    return out


class Features:
    """The feature map over those sequences that the landmarks have: no others change a kernel value with them."""

    def __init__(self, marks: np.ndarray):
        self.kinds = np.unique(np.concatenate([s for s, _ in sequences(marks)]))
        self.kinds = self.kinds[self.kinds > 0]
        self.number = np.zeros(TABLE, np.int32)
        self.number[self.kinds] = np.arange(1, len(self.kinds) + 1)

    def times(self, c: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """The feature vectors of windows, times a matrix with a row of zeros and one for each kind of sequence."""
        out = np.zeros((len(c), matrix.shape[1]), np.float32)
        for part in np.array_split(np.arange(len(c)), max(1, len(c) * matrix.shape[1] // 2_000_000)):
            for s, w in sequences(c[part]):
                out[part] += np.float32(w) * matrix[self.number[s]]
            out[part] /= norms(c[part])[:, None]
        return out

    def vectors(self, c: np.ndarray) -> np.ndarray:
        """Kinds x windows."""
        out = np.zeros((len(self.kinds) + 1, len(c)), np.float32)
        for s, w in sequences(c):
            out[self.number[s], np.arange(len(c))] += np.float32(w)
        return out[1:] / norms(c)


@dataclass
class Toxicity:
    """A trained machine: the weight of each sequence, the bias, and the scale that turns values into scores."""

    weights: np.ndarray
    bias: float
    middle: float
    slope: float

    def values(self, words: list[str]) -> np.ndarray:
        """Of each word, the value of its highest window."""
        out = np.full(len(words), -9.0)
        if words:
            c, of = windows(words)
            np.maximum.at(out, of, line(c, self.weights) + self.bias)
        return out

    def __getstate__(self):
        """Few of the weights aren't 0, so only these travel."""
        at = np.flatnonzero(self.weights)
        return at.astype(np.int32), self.weights[at], self.bias, self.middle, self.slope

    def __setstate__(self, state):
        at, values, self.bias, self.middle, self.slope = state
        self.weights = np.zeros(TABLE, np.float32)
        self.weights[at] = values

    def scores(self, values: np.ndarray) -> np.ndarray:
        """0 to 1; the middle value between the classes gets REJECT."""
        x = self.slope * (values - self.middle) + np.log(REJECT / (1 - REJECT))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """The linear support vector machine with squared hinge loss, by Newton's method. The last column of x is 1, for the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        inside = np.flatnonzero(y * (x @ w.astype(np.float32)) < 1)
        square, right = ridge.copy(), np.zeros(x.shape[1])
        for part in np.array_split(inside, max(1, len(inside) // 4000)):  # a few rows at a time, so that x isn't copied whole
            some = x[part]
            heavy = some * (2 * c * weight[part, None]).astype(np.float32)
            square += heavy.T @ some
            right += y[part] @ heavy
        new = np.linalg.solve(square, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def odds(toxic: np.ndarray, clean: np.ndarray, nt: int, nn: int) -> np.ndarray:
    return np.log((toxic + 0.1) / (nt + 1)) - np.log((clean + 0.1) / (nn + 1))


def evidence(values: list[float]) -> float:
    """The value of a text: that of its highest word, and what the others are above NEAR."""
    top = max(values, default=-9.0)
    return top if top <= NEAR else NEAR + sum(v - NEAR for v in values if v > NEAR)


class Bags:
    """Texts as sets of words, and words as sets of windows, all numbered."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.bags = [np.sort(np.fromiter({number.setdefault(w, len(number)) for w in words_of(t)}, np.int32)) for t in texts]
        self.words = list(number)
        parts = [windows(self.words[i : i + 20_000]) for i in range(0, len(self.words), 20_000)]
        c = np.concatenate([np.zeros((0, WIDTH), np.uint8), *[p[0] for p in parts]])
        of = np.concatenate([np.zeros(0, np.int64), *[p[1] + 20_000 * i for i, p in enumerate(parts)]])
        raw, inverse = np.unique(np.ascontiguousarray(c).view([("", np.uint8)] * WIDTH).ravel(), return_inverse=True)
        self.codes = raw.view(np.uint8).reshape(-1, WIDTH)
        # Words in order, so that the windows of a word lie side by side.
        self.window, self.begin = inverse.astype(np.int32), np.searchsorted(of, np.arange(len(self.words) + 1))

    def of_words(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values[self.window], self.begin[:-1]) if len(self.words) else np.zeros(0)

    def of_texts(self, words: np.ndarray) -> np.ndarray:
        return np.array([evidence(words[b].tolist()) for b in self.bags])

    def windowed(self, which: np.ndarray) -> list[np.ndarray]:
        """The distinct windows of each of some texts."""
        size = np.diff(self.begin)
        out = []
        for b in (b for b, y in zip(self.bags, which) if y):
            n = size[b]
            out.append(np.unique(self.window[np.repeat(self.begin[b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]) if len(b) else np.zeros(0, np.int32))
        return out


def stem_odds(bags: Bags, toxic: np.ndarray, nt: int, nn: int) -> np.ndarray:
    """For each word the best odds of its stems, which are its first letters within its first window: many words share one."""
    best = np.full(len(bags.words), -np.inf)
    for n in range(3, WIDTH):
        number: dict[str, int] = {}
        stem = np.array([number.setdefault(letters(w)[:n], len(number)) if len(w) >= n else -1 for w in bags.words], np.int64)
        count = np.zeros((2, len(number)))
        for b, y in zip(bags.bags, toxic):
            s = np.unique(stem[b])
            count[int(y), s[s >= 0]] += 1
        value = np.append(np.sqrt(count[1]) * np.maximum(0, odds(count[1], count[0], nt, nn)), -np.inf)  # the last is for words without such a stem
        best = np.maximum(best, value[stem])
    return best


def fitted(texts: list[str], toxic: np.ndarray, landmarks: int = 448, negatives: int = 12_000, rounds: int = 5, seed: int = 5, folds: int = 3) -> Toxicity:
    """Trains on texts with labels. The cut is set by values that machines gave to texts which they hadn't seen: each of `folds` parts, by a
    hash, is scored by a machine that the others trained."""
    toxic = np.asarray(toxic, float)
    fold = np.array([zlib.crc32(t.encode()) % folds for t in texts], int)
    best = np.full(len(texts), np.nan)
    for k in range(folds):
        seen = fold != k
        if seen.all() or len(set(toxic[seen])) < 2:
            continue
        part = _trained(Bags([t for t, s in zip(texts, seen) if s]), toxic[seen], landmarks, negatives, rounds, seed)
        rest = Bags([t for t, s in zip(texts, seen) if not s])
        best[~seen] = rest.of_texts(rest.of_words(line(rest.codes, part.weights) + part.bias))
        del part, rest
    bags = Bags(texts)
    model = _trained(bags, toxic, landmarks, negatives, rounds, seed)
    if len(texts):
        own = np.isnan(best)
        if own.any():
            best[own] = bags.of_texts(bags.of_words(line(bags.codes, model.weights) + model.bias))[own]
        model.middle, model.slope = cutoff(best, toxic)
    return model


def _trained(bags: Bags, toxic: np.ndarray, landmarks: int, negatives: int, rounds: int, seed: int) -> Toxicity:
    """A clean text has no toxic window; a toxic text has at least one, its witness, chosen anew in each round."""
    nt, nn = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    rng = np.random.default_rng(seed)
    bad, good = (bags.windowed(toxic == k) for k in (1, 0))
    ct, cn = (np.bincount(np.concatenate([np.zeros(0, np.int32), *b]), minlength=len(bags.codes)) for b in (bad, good))
    clean, among = cn, np.flatnonzero(cn)
    if not ct.any() or not cn.any():
        return Toxicity(np.zeros(TABLE, np.float32), -1.0 + 2.0 * bool(ct.any()), 0.0, 1.0)
    sure = (ct + 0.1) / nt / ((ct + 0.1) / nt + cn / nn)  # the share of toxic texts among those with the window, if both classes were as large
    # At first a witness is what tells toxic texts apart by counts: the window itself, or the stem of the word that it begins.
    telling = np.sqrt(ct) * np.maximum(0, odds(ct, cn, nt, nn))
    np.maximum.at(telling, bags.window[bags.begin[:-1]], stem_odds(bags, toxic, nt, nn))
    witness = np.bincount(np.array([b[np.argmax(telling[b])] for b in bad if len(b)], np.int64), minlength=len(bags.codes))
    order = np.lexsort((np.arange(len(bags.codes)), -witness * sure))
    marks = order[: min(landmarks * 3 // 4, int((witness > 0).sum()))]
    marks = np.concatenate([marks, rng.choice(among, min(len(among), landmarks - len(marks)), replace=False)])
    features = Features(bags.codes[marks])
    phi = features.vectors(bags.codes[marks])
    value, vector = np.linalg.eigh((phi.T @ phi).astype(np.float64))
    keep = value > 1e-6 * value.max()
    phi = np.vstack([np.zeros((1, phi.shape[1]), np.float32), phi])  # sequences without a number have no weight
    project = phi @ (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)  # Nyström: kernel values with the landmarks, whitened
    del phi, vector
    hard = np.zeros(len(bags.codes), bool)
    hard[rng.choice(among, min(len(among), negatives), replace=False)] = True
    hard[np.lexsort((np.arange(len(clean)), -clean))[:2000]] = True
    model = Toxicity(np.zeros(TABLE, np.float32), 0.0, 0.0, 1.0)
    for r in range(rounds):
        pos = np.flatnonzero((witness > 0) & (sure > 0.5))
        neg = np.flatnonzero(hard & (clean > 0) & ~((witness > 0) & (sure > SURE)))
        x = np.ones((len(pos) + len(neg), project.shape[1] + 1), np.float32)
        x[:, :-1] = features.times(bags.codes[np.concatenate([pos, neg])], project)
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        weight = np.r_[np.sqrt(witness[pos]) * sure[pos] ** 2, np.full(len(neg), NEGATIVE)]
        w, bias = machine(x, y, weight, COST)
        model.weights, model.bias = np.zeros(TABLE, np.float32), bias
        model.weights[features.kinds] = project[1:] @ w.astype(np.float32)
        score = line(bags.codes, model.weights) + bias
        best = [b[np.argmax(score[b])] for b in bad if len(b)]
        best = [k for k in best if score[k] > DOUBT or r < 1]  # a text without any window near the others' teaches nothing
        witness = np.bincount(np.array(best, np.int64), minlength=len(bags.codes))
        hard[np.lexsort((np.arange(len(clean)), np.where(clean > 0, -score, np.inf)))[: 1000 * (r + 1)]] = True
    return model


def cutoff(best: np.ndarray, toxic: np.ndarray, wrong: float = 3.0, blur: float = 0.1) -> tuple[float, float]:
    """The value that separates the texts with the least cost, a clean one that is rejected weighing as `wrong` toxic ones that stay, and a slope.
    Values are blurred, so that the cut keeps its distance from where many texts are."""
    v = np.clip(best, -3, 3)
    at = np.linspace(v.min() - 0.5, v.max() + 0.5, 801)
    above = 1 / (1 + np.exp(np.clip((at[:, None] - v) / blur, -50, 50)))
    cost = ((1 - above) * toxic + wrong * above * (1 - toxic)).sum(1)
    least = np.flatnonzero(cost <= cost.min() + 1e-3)
    return float(at[least[len(least) // 2]]), float(4 / max(0.25, np.std(v[best > -9]) if (best > -9).any() else 1.0))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, longest: int) -> tuple[list[str], np.ndarray]:
    """At most `most` labelled texts of each class, of at most `longest` characters, chosen by a hash of the id. Held-out ids aren't among them."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out(F.col("id")))
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("t")).filter(F.length("t").between(1, longest))
    order = F.xxhash64("id", F.lit(3))
    ids = ids.filter("y = 1").orderBy(order).limit(most).unionByName(ids.filter("y = 0").orderBy(order).limit(most))
    # Rows that share an id give one text, so that what is collected is bounded by `most` and `longest`.
    rows = texts.join(F.broadcast(ids.groupBy("id").agg(F.max("y").alias("y"))), "id").groupBy("id", "y").agg(F.min("t").alias("t")).orderBy("id").select("t", "y").collect()
    return [r.t for r in rows], np.array([r.y for r in rows], dtype=float)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 2000, longest: int = 20_000, **options) -> Toxicity:
    """Trains on a bounded sample of labelled rows: `most` texts a class of `longest` characters at most, none of them held out.

    Rows without a label, with null ids or null texts aren't learnt from. Without any row of a class all texts get the score of the other.
    """
    texts, toxic = labelled_sample(docs, labels, id_col, text_col, label_col, most, longest)
    return fitted(texts, toxic, **options)


def scorer(model: Toxicity):
    """A function from a list of texts to their scores that remembers the words it has seen."""
    seen: dict[str, float] = {}

    def run(texts: list[str | None]) -> np.ndarray:
        # A few texts at a time, so that the words of a whole Arrow batch are never held at once.
        return np.concatenate([np.zeros(0), *[some(texts[i : i + SLICE]) for i in range(0, len(texts), SLICE)]])

    def some(texts: list[str | None]) -> np.ndarray:
        bags = [words_of(t) if t else set() for t in texts]
        new = set().union(*bags) - seen.keys() if bags else set()
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = set().union(*bags)
        new = list(new)
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            seen.update(zip(part, model.values(part).tolist()))
        get = seen.__getitem__
        return model.scores(np.array([evidence(list(map(get, b))) for b in bags]))

    return run


def scored(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row. Null and empty texts are scored like texts without any toxic word."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))

    def run(batches):
        of = scorer(model)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def without_toxic(docs: DataFrame, model: Toxicity, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of docs that score below `reject`, with all their columns."""
    where = docs.columns.index(text_col)

    def run(batches):
        of = scorer(model)
        for b in slices(batches):
            yield b.filter(pa.array(of(b.column(where).cast(pa.string()).to_pylist()) < reject))

    return docs.mapInArrow(run, docs.schema)
