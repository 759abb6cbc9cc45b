"""Media filters, their recipes, manifests, word lists and subsets."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siltworks.operators import media, rows
from siltworks.plans import order, profile
from siltworks.plans.pipeline import Step
from siltworks.sources import readers

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def scorer():
    calls = []

    def run(text, paths):
        calls.append(text)
        return [len(text) / 10 + len(p) for p in paths]

    return run


def test_scores_by_part(spark):
    text = "<image>\nab <|__dj__eoc|><image> <image>\nabcd <|__dj__eoc|>no image <|__dj__eoc|>"
    df = spark.createDataFrame([(1, text, ["x", "yy", "z"]), (2, "plain", []), (3, None, None)], "i int, text string, paths array<string>")
    got = {r.i: r.s for r in media.scored(df, media.records.image_chunks(F.col("text"), F.col("paths")), "length", scorer, "s").collect()}
    assert got[1] == [pytest.approx([1.2]), pytest.approx([2.4, 1.4])] and got[2] == [] and got[3] == []
    kept = lambda **o: [r.i for r in media.scored(df, media.records.image_chunks(F.col("text"), F.col("paths")), "length", scorer, "s").filter(media.score_kept(F.col("s"), 1.5, 2.0, **o)).orderBy("i").collect()]
    assert kept() == [1, 2, 3] and kept(any_or_all="all") == [2, 3] and kept(reduce_mode="max") == [2, 3]
    with pytest.raises(ValueError):
        kept(reduce_mode="median")
    with pytest.raises(ValueError):
        kept(any_or_all="some")


def test_a_scorer_is_loaded_where_it_runs(spark):
    """What load() makes can't be pickled, and need not be."""

    def load():
        lock = __import__("threading").Lock()
        return lambda text, paths: [float(os.getpid()) if lock else 0.0 for _ in paths]

    df = spark.createDataFrame([(1, "t", ["a"])], "i int, text string, paths array<string>")
    got = media.scored(df, media.each_part(F.col("text"), F.col("paths")), "pid", load, "s").first().s
    assert got[0][0] != os.getpid()


def test_placement(spark):
    assert media.placement(spark, "cpu") is None and media.placement(spark, "gpu") is None  # no GPU here
    with pytest.raises(ValueError):
        media.placement(spark, "tpu")


def test_records_of_images_and_videos(spark):
    df = spark.createDataFrame([("a.png", None), (None, ["b.png", "/c.png"]), (None, None)], "image string, images array<string>")
    assert [r.images for r in media.rooted_records(media.image_records(df), "/root").collect()] == [["/root/a.png"], ["/root/b.png", "/c.png"], []]
    videos = spark.createDataFrame([("v", 1, None, None, "more")], "video_id string, sentence_id int, videos array<string>, text string, x string")
    assert tuple(media.video_output(videos).first()) == ("v", 1, [], "")


def test_media_recipes():
    for name in ("llava_pretrain", "general_video_refine", "video_self_evolution", "running_example"):
        steps = media.media_recipe(name)
        assert len({s.tag for s in steps}) == len(steps)
    video = {s.tag: s for s in media.media_recipe("video_self_evolution")}
    assert len(video) == 5 and (video["sandbox_video_motion"].low, video["sandbox_video_motion"].high) == (3.0, 20.0) and video["sandbox_video_nsfw"].resource == "gpu"
    example = media.media_recipe("running_example")
    assert order.order_count(example) == sum(1 for _ in order.linear_extensions(example)) == 12
    assert len(media.CATALOG) == 7 and all(set(gpu) <= set(ops) for _, ops, gpu in media.CATALOG.values())


def test_word_lists(spark, tmp_path):
    for name, words in (("stopwords_a.json", {"en": ["the"], "de": ["der"]}), ("stopwords_b.json", {"en": ["of"]}), ("flagged.json", {"all": ["x"]}), ("notes.txt", {})):
        (tmp_path / name).write_text(json.dumps(words))
    assert readers.word_lists(spark, str(tmp_path), "stopwords") == {"en": ["the", "of"], "de": ["der"], "all": ["the", "of", "der"]}
    assert readers.word_lists(spark, str(tmp_path), "flagged") == {"all": ["x"]}
    with pytest.raises(ValueError):
        readers.word_lists(spark, str(tmp_path), "nothing")


def test_caption_manifest(spark, tmp_path):
    row = lambda **o: json.dumps({"id": "7", "image": "a.png", "conversations": [{"from": "human", "value": "?"}, {"from": "gpt", "value": " two cats \n"}], **o})
    good = tmp_path / "good.jsonl"
    good.write_text(row() + "\n\n" + row(id=None, image="/b.png") + "\n")
    assert [tuple(r) for r in readers.caption_manifest(spark, str(good), "/root", 2).collect()] == [("7", "/root/a.png", "two cats"), ("/b.png", "/b.png", "two cats")]
    with pytest.raises(ValueError):
        readers.caption_manifest(spark, str(good), rows=3)
    for broken in (row(image=""), row(conversations=[]), "no json"):
        bad = tmp_path / "bad.jsonl"
        bad.write_text(row() + "\n" + broken + "\n")
        with pytest.raises(Exception, match="line 2"):
            readers.caption_manifest(spark, str(bad)).collect()


def test_subsets(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(20)], "n int, own string").repartition(3)
    size = F.length("own") + 1
    assert [r.n for r in rows.byte_prefix(df, 56, size, ["n"]).orderBy("n").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        rows.byte_prefix(df, 56, size, ["n"], least_rows=6)
    assert [r.n for r in rows.exact_prefix(df, 6, size, 66, ["n"], done=4).orderBy("n").collect()] == [4, 5]
    for n, most in ((6, 65), (21, 10_000)):
        with pytest.raises(ValueError):
            rows.exact_prefix(df, n, size, most, ["n"])


def test_lines_in_source_order(spark, tmp_path):
    """A small file that comes last by size must not come last by place."""
    (tmp_path / "a.txt").write_text("a0\na1\n")
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(5000)))
    (tmp_path / "c.txt").write_text("c0\n")
    assert [r.value for r in readers.lines(spark, str(tmp_path), max_samples=4).collect()] == ["a0", "a1", "b0", "b1"]
    got = [r.value for r in readers.lines(spark, str(tmp_path), rank_spec=(2500, 1)).collect()]
    assert got == ["a1", "b2499", "b4999"]


def test_names_that_clash(spark):
    df = spark.createDataFrame([(i, i, i, i, i) for i in range(9)], "n int, at int, part int, place int, ordinal int")
    got = rows.with_ordinal(df, [F.desc("n")], "k").orderBy("k").collect()
    assert [(r.n, r.k) for r in got] == [(8 - k, k) for k in range(9)] and got[0].asDict().keys() == {"n", "at", "part", "place", "ordinal", "k"}
    assert [r.n for r in rows.prefix(df, 3, ["n"]).orderBy("n").collect()] == [0, 1, 2]
    assert rows.with_ordinal(df.filter("false"), ["n"]).count() == 0


def test_plan_options(spark):
    df = spark.createDataFrame([(i, "word " * (i % 40)) for i in range(200)], "doc_id int, text string")
    steps = [Step("m", "clean_email", fixed=True), Step("rep", "char_repetition", {"n": 5}, high=1.0), Step("len", "text_length", low=150)]
    tags = lambda **o: [s.tag for s in profile.plan(df, steps, profile.PlanOptions(**o))[0]]
    assert tags() == tags(policy="fastest") == tags(most_orders=1) == ["m", "len", "rep"] and tags(reorder=False) == ["m", "rep", "len"]
    assert tags(policy="shrinking")[0] == "m" and profile.plan(df, steps, profile.PlanOptions(cache=True, read_seconds_a_byte=0.0))[1] == 3
    with pytest.raises(ValueError):
        tags(policy="luck")
