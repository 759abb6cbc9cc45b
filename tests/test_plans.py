"""Orders, costs, plans and recipes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from siltworks.functions import scorers
from siltworks.plans import order, profile
from siltworks.plans.order import Cost
from siltworks.plans.pipeline import Step, funnel, lower, with_args
from siltworks.plans.recipes import RECIPES, recipe
from siltworks.plans.spec import PlanSpec, planned, run


def steps(n, after=None, fixed=()):
    return [Step(str(i + 1), "text_length", after=tuple(map(str, (after or {}).get(i + 1, ()))), fixed=i + 1 in fixed) for i in range(n)]


def test_linear_extensions():
    assert len(list(order.linear_extensions(steps(3)))) == 6
    assert len(list(order.linear_extensions(steps(5, {3: [1], 4: [1], 5: [3]})))) == 15
    assert len(list(order.linear_extensions(steps(5, fixed=(3,))))) == 4
    assert len(list(order.linear_extensions(steps(6), most=7))) == 7


def test_bad_relations():
    with pytest.raises(ValueError):
        order.relations(steps(2, {1: [2], 2: [1]}))
    with pytest.raises(KeyError):
        order.relations(steps(1, {1: [9]}))
    with pytest.raises(NotImplementedError):
        order.relations([Step("a", "text_length"), Step("a", "text_length")])


def test_cheapest_is_optimal():
    rng = random.Random(7)
    for _ in range(40):
        n = 6
        some = steps(n, {k: [rng.randint(1, k - 1)] for k in range(2, n + 1) if rng.random() < 0.4}, fixed=(4,) if rng.random() < 0.3 else ())
        costs = [Cost(rng.random(), rng.random() * 100, rng.random(), rng.choice([1.0, 0.5, 2.0])) for _ in some]
        best = min(order.plan_cost(p, costs, 100) for p in itertools.permutations(range(n)) if order.legal(some, p))
        found = order.cheapest(some, costs, 100)
        assert order.legal(some, found) and order.plan_cost(found, costs, 100) == pytest.approx(best)


def test_policies():
    some = [Step("m", "clean_email", fixed=True), Step("slow", "word_repetition"), Step("fast", "text_length"), Step("mid", "alnum_ratio", after=("slow",))]
    assert [some[i].tag for i in order.fastest_filters_first(some)] == ["m", "fast", "slow", "mid"]
    free = steps(4)
    assert [free[i].tag for i in order.shrinking_first(free, {"1": 0.5, "3": 0.2, "4": 3.0})] == ["3", "1", "2", "4"]


def test_affine():
    assert profile.affine([1, 2, 3], [3, 5, 7]) == pytest.approx((2, 1))
    assert profile.affine([1, 1, 2], [3, 5, 7]) == (0.0, 5.0)
    assert profile.affine([1, 2, 3], [7, 5, 3]) == (0.0, 5.0)
    assert profile.affine([1, 2, 3], [0, 3, 6])[1] == 0.0


def test_cache_point():
    some = steps(3)
    costs = [Cost(base=5), Cost(base=0.001, grows=0.5), Cost(base=1)]
    assert order.cache_point([0, 1, 2], some, costs, 10, 1e-6, passes=3) == 3
    random_last = [*some[:2], Step("3", "text_length", random=True)]
    assert order.cache_point([0, 1, 2], random_last, costs, 10, 1e-6, passes=3) == 2
    assert order.cache_point([0, 1, 2], some, costs, 10, 1e6, passes=3) is None


def test_plan_round_trip(spark):
    df = spark.createDataFrame([(i, "word " * i) for i in range(20)], "doc_id int, text string")
    some = [Step("email", "clean_email", fixed=True), Step("len", "text_length", low=10), Step("rep", "word_repetition", {"n": 2}, high=0.95), Step("words", "words_num", high=15)]
    costs = [Cost(base=1), Cost(base=1, keeps=0.9), Cost(base=50, keeps=0.5), Cost(base=5, keeps=0.7)]
    spec = planned(some, costs, passes=3, partitions=3)
    assert PlanSpec.load(spec.save()) == spec and "email" in spec.show()
    expected = sorted(r.doc_id for r in lower(df, some).collect())
    assert sorted(r.doc_id for r in run(df, some, spec).collect()) == expected
    with pytest.raises(ValueError):
        run(df, some, PlanSpec(("len", "email", "rep", "words")))


def test_funnel_and_filters_agree(spark):
    df = spark.createDataFrame([(i, "ab cd! " * i) for i in range(12)], "doc_id int, text string")
    some = [Step("len", "text_length", low=8), Step("special", "special_ratio", high=0.5), Step("rep", "char_repetition", {"n": 3}, high=0.9)]
    rows = funnel(df, some).orderBy("step").collect()
    assert rows[0].rows_in == 12 and rows[-1].rows_out == lower(df, some).count()


@pytest.mark.parametrize("name", RECIPES)
def test_recipes(spark, name):
    """Declared and planned order keep the same rows, and the words of a model may be in a table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = with_args(recipe(name), flagged_ratio={"listed": ("idiot",)}, stopwords_ratio={"listed": ("the", "of")}, language_score={"model": scorers.fit_language(docs)}, perplexity={"model": scorers.fit_words(docs, most=50)})
    assert len({s.tag for s in some}) == len(some)
    rows = docs.select("doc_id", "text")
    best = profile.planned(rows, some)
    assert sorted(s.tag for s in best) == sorted(s.tag for s in some) and order.legal(some, [some.index(s) for s in best])
    whole = with_args(some, perplexity={"model": scorers.fit_words(docs)})
    assert {tuple(r) for r in lower(rows, some).collect()} == {tuple(r) for r in lower(rows, with_args(best, perplexity={"model": scorers.fit_words(docs)})).collect()}
    assert funnel(rows, whole).orderBy(F.desc("step")).first().rows_out == lower(rows, whole).count()


def test_code_recipe_keeps_code(spark):
    """No document of the tables is code, so here is some."""
    rng = random.Random(3)
    names, marks = ["x", "yy", "abc", "idx", "total", "i", "j", "n"], ["", " +", " =", "[0]", "(1)"]
    code = "".join("    " * (k % 3) + " ".join(rng.choice(names) + rng.choice(marks) for _ in range(4 + k % 9)) + "\n" for k in range(40))
    docs = spark.createDataFrame([(1, "# copyright\n# me\n" + code), (2, code[:100]), (3, "/* Copyright me */\n" + code), (4, None), (5, "x " * 600)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in lower(docs, recipe("redpajama_code")).collect()}
    assert set(got) == {1, 3} and got[1] == code.strip() and got[3].strip() == code.strip()


def test_profile_and_thresholds(spark):
    df = spark.createDataFrame([(i, "x" * (i % 50 + 1)) for i in range(200)], "doc_id int, text string")
    costs = profile.measured(df, [Step("m", "clean_email", fixed=True), Step("len", "text_length", low=26)], rows=90)
    assert costs[1].keeps == pytest.approx(0.5, abs=0.2) and costs[0].grows == pytest.approx(1)
    got = profile.thresholds(df.selectExpr("cast(doc_id as double) as s"), "s", (0.9,), False).first()
    assert got.threshold == pytest.approx(19.9)
