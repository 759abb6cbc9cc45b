"""Surrogates: nothing detected is left, the same stays the same, different stays different, and formats hold."""

import re

import pytest
from pyspark.sql import functions as F

from siltworks.llm.pii import luhn, mod97, pii_surrogates

KEY = "a key"


def replaced(spark, texts, key=KEY):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r.text for r in pii_surrogates(docs, key).orderBy("doc_id").collect()]


def test_values_go_and_the_rest_stays(spark):
    values = ["ann.b_1@mail.example.com", "+1 (499) 555-6503", "174.91.180.241", "078-05-1120", "2123465659789240", "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e", "DE89 3704 0044 0532 0130 00", "fe80:0:0:0:1:2:3:4a", "+49 30 1234567"]
    texts = [f"Before,\n {v} – after 2024-01-15, v1.2.3 and 12.5%!! x@y {v}" for v in values]
    out = replaced(spark, texts)
    for v, t, o in zip(values, texts, out):
        got = re.fullmatch(r"(?s)Before,\n (.*) – after 2024-01-15, v1\.2\.3 and 12\.5%!! x@y (.*)", o)
        assert got and got[1] == got[2] and v not in o, (t, o)
        if "." not in v:
            assert re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub(r"\d", "0", got[1]))) is not None and len(got[1]) == len(v)
    assert out == replaced(spark, texts) and out != replaced(spark, texts, key="other")


def test_one_value_in_many_forms_stays_one(spark):
    out = replaced(spark, ["A.b@x.example.com", "say A.B@X.EXAMPLE.COM", "(499) 555-6503", "499-555-6503", "4111 1111 1111 1111", "4111-1111-1111-1111", "c@x.example.com"])
    assert out[0].lower() == out[1][4:].lower() and out[1][4:].isupper()
    assert re.sub(r"\D", "", out[2]) == re.sub(r"\D", "", out[3]) and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", out[2])
    assert out[4].replace(" ", "") == out[5].replace("-", "")
    assert out[6].split("@")[1] == out[0].split("@")[1].lower()


def test_check_sums_hold(spark):
    out = replaced(spark, ["4111111111111111", "DE89370400440532013000", "GB29NWBK60161331926819"])
    sums = spark.createDataFrame([(out[0], out[1], out[2])], "a string, b string, c string").select(luhn(F.col("a")), mod97(F.col("b")), mod97(F.col("c"))).first()
    assert tuple(sums) == (0, 1, 1) and out[1][:2] == "DE" and out[2][:2] == "GB" and "4111111111111111" not in out


def test_names_keep_gender_script_and_reference(spark):
    out = replaced(spark, ["Mr. John Smith met Mary Jones. Smith said no; Smithson did not.", "Mrs. Smith and SMITH", "Госпожа Петрова", "王小明先生"])
    found = re.fullmatch(r"Mr\. (\w+) (\w+) met (\w+) (\w+)\. (\w+) said no; Smithson did not\.", out[0])
    he, smith, she, jones, again = found.groups()
    assert smith == again and smith != jones and he.endswith(("ander", "ric", "ton", "bert", "win")) and she.endswith(("ina", "ella", "ara", "ette", "ia"))
    assert out[1].startswith(f"Mrs. {smith} and ")
    assert re.fullmatch("Госпожа [А-Я][а-я]+", out[2]) and "Петрова" not in out[2]
    assert out[3].endswith("先生") and "王小明" not in out[3] and re.fullmatch("[一-鿿]+", out[3])


def test_collisions_are_drawn_again(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@one.example.com" for a in letters] + [f"192.168.0.{i}" for i in range(200)]
    out = replaced(spark, mails)
    assert len(set(out)) == len(mails) and not set(out) & set(mails)


def test_a_key_is_needed_and_cues_name_people(spark):
    with pytest.raises(ValueError):
        replaced(spark, ["a@b.example.com"], "")
    out = replaced(spark, ["Hello, my name is Zebulon Quark. Quark it is.", "He said Zebulon Quark", "Dear All Members", "ich heiße Ötzi Übel"])
    assert "Quark" not in out[0] and "Zebulon" not in out[0] and out[1] == "He said Zebulon Quark" and "Übel" not in out[3]


@pytest.mark.parametrize("column", ["text", "kind"])
def test_edges(spark, column):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x" * 200_000, "c"), (None, "é1.2.3.4漢 " * 300, None), (5, "a@b.example.com", "d"), (5, "a@b.example.com", "d"), (6, "a." * 50_000 + "@" + "b." * 50_000, "e"), (7, "$1 \\ a@b.example.com $0", None)]
    schema = f"doc_id long, {column} string, k string, canon string, pii_count string, `a.b` int"
    docs = spark.createDataFrame([(i, t, k, k, k, 1) for i, t, k in rows], schema)
    got = pii_surrogates(docs, KEY, text_col=column)
    assert set(got.columns) == {"doc_id", column, "k", "canon", "pii_count", "pii_kinds", "a.b"}
    out = got.collect()
    assert len(out) == len(rows) and sum(r.doc_id == 5 for r in out) == 2 and len({r[column] for r in out if r.doc_id == 5}) == 1
    by_id = {r.doc_id: r for r in out}
    assert by_id[1][column] is None and by_id[2][column] == "" and by_id[3][column] == rows[2][1] and by_id[3].pii_count == 0
    assert by_id[None].pii_count == 300 and "1.2.3.4" not in by_id[None][column]
    assert by_id[7][column].startswith("$1 \\ ") and by_id[7][column].endswith(" $0") and by_id[7][column][5:-3] == by_id[5][column]
    assert pii_surrogates(docs.limit(0), KEY, text_col=column).count() == 0
