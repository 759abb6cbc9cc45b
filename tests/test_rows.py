"""Sources, rows, records, streams and tensors."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.functions import audio, images, scorers
from siltworks.operators import records, rows
from siltworks.plans.pipeline import Step
from siltworks.sources import readers
from siltworks.streaming import stream


def test_lines_shards_and_prefix(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"l{i}\n" for i in range(12)))
    assert [r.value for r in readers.lines(spark, str(tmp_path), max_samples=5).collect()] == [f"l{i}" for i in range(5)]
    got = [sorted(r.value for r in readers.lines(spark, str(tmp_path), (3, k)).collect()) for k in range(3)]
    assert sum(map(len, got)) == 12 and got[1] == sorted(["l1", "l4", "l7", "l10"])
    with pytest.raises(ValueError):
        readers.lines(spark, str(tmp_path), max_samples=0)


def test_files(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"file_{i}.txt").write_text(f"hello {i}\nworld\n")
    paths = [os.path.basename(r.path) for r in readers.files(spark, str(tmp_path), rank_spec=(3, 1)).orderBy("path").collect()]
    assert paths == ["file_1.txt", "file_4.txt", "file_7.txt"]
    with pytest.raises(TypeError):
        readers.files(spark, 5)
    assert [r.line for r in readers.file_lines(spark, str(tmp_path / "file_3.txt")).orderBy("line_no").collect()] == ["hello 3", "world"]


def test_json(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "a"}\n{"raw_content": "b", "text": "c"}\n{}\n')
    assert [r.raw_content for r in readers.json_lines(spark, str(tmp_path / "x.jsonl")).collect()] == ["a", "b", ""]
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "array.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert sorted(r.value for r in readers.json_array(spark, str(tmp_path / "array.json")).collect()) == ['{"a":1}', '{"a":2}']


def test_batches(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 8)], "x int")
    got = [[y["x"] for y in b["items"]] for b in rows.batch(df, 3, ["x"]).orderBy("batch").collect()]
    assert got == [[1, 2, 3], [4, 5, 6], [7]]
    assert rows.batch(df, 3, ["x"], drop_last=True).count() == 2
    assert rows.batch(df, 1, ["x"]).count() == 7


def test_fusion_and_caches(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "x")
    plus = lambda d: d.withColumn("x", F.col("x") + 1)
    out = rows.fused(df, [plus, lambda d: d.filter("x % 2 = 0"), plus])
    assert {r.x for r in out.collect()} == {3, 5, 7, 9, 11}
    with pytest.raises(ValueError):
        rows.fused(df, [plus])
    calls = spark.sparkContext.accumulator(0)
    path = str(tmp_path / "cache")
    a = rows.stored(out, path)
    b = rows.stored(df, path)  # complete, so it is read and df isn't computed
    assert a.count() == b.count() == 5 and rows.cached(out).count() == 5 and calls.value == 0


def test_byte_prefix(spark):
    df = spark.createDataFrame([(i, "x" * 9) for i in range(10)], "i int, t string")
    assert rows.byte_prefix(df, 35, F.octet_length("t") + 1, ["i"]).count() == 3
    assert rows.byte_prefix(df, 1, F.octet_length("t") + 1, ["i"]).count() == 1


def test_detection(spark):
    imgs = spark.createDataFrame([(1, "a", 100, 50), (2, "b", 10, 10)], "id long, file_name string, width int, height int")
    notes = spark.createDataFrame([(7, 1, [1.0, 2.0, 3.0, 4.0], 5), (6, 1, [0.0, 0.0, 1.0, 1.0], 4)], "id long, image_id long, bbox array<double>, category_id long")
    got = {r.image_id: (r.boxes, r.labels) for r in readers.detection(imgs, notes).collect()}
    assert got == {1: ([[0, 0, 1, 1], [1, 2, 4, 6]], [4, 5]), 2: ([], [])}
    assert readers.detection(imgs, notes, empty=False).count() == 1
    assert readers.detection(imgs, notes, relative=True).filter("image_id = 1").first().boxes[1] == [0.01, 0.04, 0.04, 0.12]


def test_web(spark):
    urls = spark.createDataFrame([("u1",), ("u2",)], "url string")
    pages = spark.createDataFrame([("u1", "<p>")], "url string, html string")
    assert {r.url: r.content for r in readers.web(urls, pages=pages).collect()} == {"u1": bytearray(b"<p>"), "u2": None}
    assert sorted(bytes(r.content) for r in readers.web(urls, fetch=lambda u, s: u.encode()).collect()) == [b"u1", b"u2"]
    with pytest.raises(RuntimeError):
        readers.web(urls, timeout=0)


def test_records(spark):
    turns = spark.createDataFrame([(1, 0, "q"), (1, 1, " a "), (2, 0, "only"), (3, 0, "q"), (3, 1, "  ")], "conv_id int, turn int, text string")
    assert [tuple(r) for r in records.captions(turns).collect()] == [(1, "<image>\na <|__dj__eoc|>")]
    df = spark.createDataFrame([("<image> one <|__dj__eoc|><image><image> two", ["a", "b", "c"])], "t string, p array<string>")
    got = df.select(records.image_chunks(F.col("t"), F.col("p")).alias("x")).first().x
    assert [(c.text, c.paths) for c in got] == [("one", ["a"]), ("two", ["b", "c"])]
    assert records.byte_size("124KB") == 124 * 1024 and records.byte_size(5) == 5
    with pytest.raises(ValueError):
        records.byte_size("x")
    shapes = spark.sql("select array(named_struct('width', 100, 'height', 50), named_struct('width', 10, 'height', 50)) as s, cast(array() as array<struct<width:int,height:int>>) as e")
    row = shapes.select(records.image_aspect(F.col("s"), 1.0, 3.0).alias("any"), records.image_aspect(F.col("s"), 1.0, 3.0, "all").alias("all"), records.image_aspect(F.col("e"), 1.0, 3.0, "all").alias("none")).first()
    assert tuple(row) == (True, False, True)


def test_splits_matches_rounds(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "i int, g int")
    assert records.splits(df, {"a": 2, "b": 3}, ["i"]).groupBy("split").count().orderBy("split").collect()[1]["count"] == 3
    assert records.rounds(df, "g", ["i"]).filter("round = 3").count() == 1
    with pytest.raises(Exception, match="not 3 rows"):
        records.rounds(df, "g", ["i"], 3).collect()
    with pytest.raises(Exception, match="no partner"):
        records.matched(df, spark.createDataFrame([(0,)], "i int"), "i").collect()


def test_tokens_and_boxes(spark):
    df = spark.createDataFrame([(1, [5, 6, 7])], "row_id int, ids array<int>")
    assert df.select(records.token_ids(F.col("ids"), 2)).first()[0] == [1, 6, 7, 2]
    table = spark.createDataFrame([(5, [0.5]), (6, [0.6])], "token int, vector array<double>")
    assert records.embedded(df, "ids", table).first().vectors == [[0.5], [0.6]]
    b = spark.sql("select array(array(0d, 0d, 2d, 1d)) as b, array(3) as l, array(0d, 0d, 1d, 2d) as r")
    assert b.select(records.boxes_resized(F.col("b"), F.col("r"))).first()[0] == [[0.0, 0.0, 2.0, 0.5]]
    assert b.select(records.boxes_overlap(F.col("b"), F.col("r"))).first()[0] == [0.5]
    assert b.select(records.boxes_kept(F.col("b"), F.col("l"))).first()[0] == []
    assert b.select(records.boxes_flipped(F.col("b"), F.lit(4.0))).first()[0] == [[2.0, 0.0, 4.0, 1.0]]
    assert b.select(records.boxes_sane(F.col("b"), F.lit(4), F.lit(4))).first()[0] == [[0.0, 0.0, 2.0, 1.0]]


def test_images(spark):
    raw = b"P6 4 3 255\n" + bytes(range(36))
    x = images.decode(raw)
    assert x.shape == (3, 4, 3) and images.size_of(raw) == (4, 3)
    df = spark.createDataFrame([(bytearray(raw),)], "content binary")
    assert readers.images(df).first().image.height == 3
    for f in (images.grayscale, images.autocontrast, images.equalize, images.flip, lambda v: images.rotated(v, 20), lambda v: images.sharpness(v, 1.5), lambda v: images.gaussian_blur(v, 1.0), lambda v: images.solarize(v), lambda v: images.posterize(v, 3), lambda v: images.hue(v, 0.1), lambda v: images.cutout(v, images.draws(1, 0, 1, "c"), 2)):
        assert f(x).shape == x.shape and f(x).dtype == np.uint8
    assert (images.rotated(x, 0) == x).all() and (images.resized(x, 3, 4) == x).all() and (images.hue(x, 0) == x).all()
    one = lambda k: images.rand_augment(x, images.draws(1, 0, k, "ra"))
    assert (one(5) == one(5)).all()
    assert images.simclr_view(x, images.draws(1, 0, 1, "s")).shape == (244, 244, 3)
    views = images.multi_crop(x, lambda tag: images.draws(1, 0, 1, tag), "swav")
    assert len(views) == 8 and views[0].shape == (224, 224, 3)


def test_audio():
    t = np.arange(8000) / 8000
    x = np.sin(2 * np.pi * 1000 * t).astype(np.float32)
    assert np.abs(audio.istft(audio.stft(x), len(x)) - x)[400:-400].max() < 1e-3
    s = audio.spectrogram(audio.time_stretch(x))
    assert s.sum(1).argmax() == 50 and s.shape[1] == 101
    assert len(audio.resample(x, 8000, 4000)) == 4000
    rng = images.draws(0, 0, 0, "m")
    assert audio.mel(audio.frequency_mask(audio.time_mask(s, rng), rng)).shape == (256, 101)


def test_scorers(spark):
    docs = spark.createDataFrame([("the cat and the dog in the house " * 3, "en"), ("der hund und die katze in dem haus " * 3, "de")], "text string, lang string")
    model = scorers.fit_language(docs)
    assert model.predict("the dog and the cat")[0] == "en" and model.predict("die katze und der hund")[0] == "de"
    words = scorers.fit_words(docs)
    assert words.perplexity("the cat") < words.perplexity("zzz qqq") and words.perplexity("") == 0


def test_stream(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame([(1, "long enough text"), (2, "x")], "doc_id int, text string").coalesce(1).write.parquet(src)
    steps = [Step("email", "clean_email"), Step("len", "text_length", low=5), Step("rep", "char_repetition", {"n": 3}, high=0.9)]

    def go():
        q = stream.run(stream.table_stream(spark, src, "doc_id int, text string"), steps, out, mark)
        q.awaitTermination()
        return spark.read.parquet(out).count()

    assert go() == 1
    spark.createDataFrame([(3, "another long text")], "doc_id int, text string").coalesce(1).write.mode("append").parquet(src)
    assert go() == 2 and go() == 2  # a replay adds nothing
