"""Text operators against literals and plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.functions import fixed, kernels, measures, text
from siltworks.functions.measures import Doc
from siltworks.operators.registry import OPERATORS

SPECIALS = fixed.special_characters()


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def many(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", column(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


SAMPLES = ["", " ", "a", "\n\n", "one\ntwo\n", "x\r\ny\x85z ", "Tab\tand  spaces ", "“Quoted” — text…", "don't #stop! (now)", "é è à, ñandú.", "　wide　", "😀 ok 😀", "... ---", "http://a.b/c d//e //f", "1234 x1y2", "A" * 30 + " b", "l1\n\nl3", "\tx\t\ty\t"]


def test_email(spark):
    assert one(spark, "write to Jo.Do+x@mail.example.org now", text.clean_email) == "write to  now"
    assert one(spark, "Jo@MAIL.org", text.clean_email) == "Jo@MAIL.org"  # domains are lower case


def test_links():
    assert kernels.clean_links("see http://a.example/x(y) and www.b.example/z end") == "see  and  end"
    assert kernels.clean_links("WWW2.x.example stays gone, mail:mel too, a.b c") == " stays gone,  too, a.b c"
    slow = "a." * 3000 + "(" * 50
    assert kernels.clean_links(slow).endswith("(" * 50)


@pytest.mark.parametrize("value,expected", [("/* Copyright 2024 Example */\nprint('kept')", "\nprint('kept')"), ("# license\n// generated\n\nprint('kept')", "print('kept')"), ("/* other */\n# x\ny", "/* other */\n# x\ny"), ("x\n# y", "x\n# y"), ("# only", "")])
def test_copyright(spark, value, expected):
    assert one(spark, value, text.clean_copyright) == expected


def test_whitespace_and_punctuation(spark):
    table = {ord(a): b for a, b in fixed.PUNCTUATION.items()}
    assert many(spark, SAMPLES, text.normalize_punctuation) == [s.translate(table) for s in SAMPLES]
    spaces = {ord(c): " " for c in fixed.SPACES}
    assert many(spark, SAMPLES, text.normalize_whitespace) == [s.strip().translate(spaces) for s in SAMPLES]
    assert one(spark, "A café — with two tables.", text.normalize_punctuation) == "A café  -  with two tables."


def _strip(w):
    return w.strip("".join(SPECIALS))


def _words(t, lower):
    found = [w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w]
    return [w for w in (_strip(w.lower() if lower else w) for w in found) if w]


def test_statistics(spark):
    assert many(spark, SAMPLES, text.text_length) == [len(s) for s in SAMPLES]
    assert many(spark, SAMPLES, text.words_num) == [len(_words(s, False)) for s in SAMPLES]
    assert many(spark, SAMPLES, lambda c: text.words(c, lower=True)) == [_words(s, True) for s in SAMPLES]
    lines = [s.splitlines() for s in SAMPLES]
    assert many(spark, SAMPLES, text.maximum_line_length) == [max(map(len, x), default=0) for x in lines]
    assert many(spark, SAMPLES, text.average_line_length) == [len(s) / len(x) if x else 0.0 for s, x in zip(SAMPLES, lines)]
    assert many(spark, SAMPLES, text.special_ratio) == pytest.approx([sum(c in SPECIALS for c in s) / len(s) if s else 0 for s in SAMPLES])
    assert many(spark, SAMPLES, text.alnum_ratio) == pytest.approx([sum(c.isalnum() for c in s) / len(s) if s else 0 for s in SAMPLES])


def test_listed_words(spark):
    assert one(spark, "good bad text", lambda c: text.listed_ratio(c, ["bad"])) == pytest.approx(1 / 3)
    assert one(spark, "", lambda c: text.listed_ratio(c, ["bad"])) == 0
    assert one(spark, "(BAD)!", lambda c: text.listed_ratio(c, ["bad"])) == 1


def test_word_mappers(spark):
    assert one(spark, "a http://x b\n\nwww.y\tz", text.remove_words_with) == "a b\nz"
    assert one(spark, "//a", text.remove_words_with) == "//a"  # only what is left after stripping counts
    assert one(spark, "a " + "b" * 30 + "\n" + "c" * 20 + "!" * 20, lambda c: text.remove_long_words(c, 1, 25)) == "a\n" + "c" * 20 + "!" * 20


def test_captions_and_instructions(spark):
    assert one(spark, 'A "dog" runs!!  Far.\n', text.clean_caption) == "a dog runs far"
    assert one(spark, " ".join("abcdef"), lambda c: text.truncate_caption(c, 3)) == "a b c"
    row = spark.createDataFrame([(" Solve the problem. ", "2 + 2", "4", None)], "a string, b string, c string, d string")
    assert row.select(text.join_nonempty(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0] == "Solve the problem.\n\n2 + 2\n\n4"


def _char_repetition(t, n):
    c = Counter(t[i : i + n] for i in range(len(t) - n + 1))
    top = min(int(math.sqrt(len(c))), sum(v > 1 for v in c.values())) if c else 0
    return sum(sorted(c.values(), reverse=True)[:top]) / sum(c.values()) if top > 0 else 0.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé\n 漢😀.", max_size=60), max_size=4), st.integers(1, 6))
def test_repetition(texts, n):
    for t in texts:
        assert measures.char_repetition(Doc(t), n) == pytest.approx(_char_repetition(t, n))
        w = _words(t, True)
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        assert measures.word_repetition(Doc(t), n) == pytest.approx(sum(v for v in c.values() if v > 1) / sum(c.values()) if c else 0)


def test_unicode():
    assert [kernels.fix_unicode(t) for t in ("é", "ok\r\n", "CafÃ©", "‘ﬁne’\x07", "é")] == ["é", "ok\n", "Café", "'fine'", "é"]


def test_alpha_per_token():
    assert [measures.alpha_per_token(Doc(t), lambda t: ["ab", "12"] if t else []) for t in ("ab12", "")] == [1.0, 0.0]


ARGS = {"flagged_ratio": {"listed": ("ab", "don't")}, "stopwords_ratio": {"listed": ("spaces", "漢")}, "remove_long_words": {"max_len": 3}}


def test_both_forms_of_every_operator_agree(spark):
    """The Column expression and the function of one document."""
    rng = np.random.default_rng(0)
    alphabet = list("ab1 \n\t.,-—“é漢😀@/\u2003\x85\r—") + ["http", "a@b.cd", "//x", "/* copyright */", "# c\n", "ABCDEFGHIJ"]
    texts = SAMPLES + ["".join(rng.choice(alphabet, int(rng.integers(0, 40)))) for _ in range(300)]
    for name, op in OPERATORS.items():
        if not (op.column and op.one):
            continue
        args = ARGS.get(name, {})
        native = many(spark, texts, op.build(**args))
        if op.kind == "map":
            assert native == [op.one(t, **args) for t in texts], name
        else:
            assert [float(v) for v in native] == pytest.approx([float(op.one(Doc(t), **args)) for t in texts]), name


def test_null_text(spark):
    from siltworks.plans.pipeline import Step, lower

    df = spark.createDataFrame([(1, None)], "doc_id int, text string")
    assert lower(df, [Step("e", "clean_email"), Step("n", "text_length", high=0)]).collect()[0].text == ""
    assert np.isclose(lower(df, [Step("r", "char_repetition", {"n": 3})], annotate=True).first().stat_r, 0)
