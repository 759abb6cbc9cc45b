"""Chains over tensors: detection augmentation, orders, draws by record, audio and tokens."""

import io
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.functions import audio, detection, images
from siltworks.plans import tensors
from siltworks.plans.order import legal, linear_extensions, order_count


def example(seed=0, height=60, width=80):
    rng = np.random.default_rng(seed)
    return {"image": rng.integers(0, 256, (height, width, 3), np.uint8), "boxes": [[5.0, 5.0, 40.0, 30.0], [50.0, 20.0, 75.0, 55.0]], "labels": [1, 2]}


def ppm(x):
    return b"P6 %d %d 255\n" % (x.shape[1], x.shape[0]) + x.tobytes()


def test_zoom_out_keeps_what_boxes_show():
    for k in range(20):
        e = example(k)
        z = detection.zoom_out(e, np.random.default_rng(k))
        for old, new in zip(e["boxes"], z["boxes"]):
            (a, b, c, d), (p, q, r, s) = map(int, old), map(int, new)
            assert (z["image"][q:s, p:r] == e["image"][b:d, a:c]).all()
        assert 60 <= z["image"].shape[0] <= 240 and z["image"].shape[1] <= 320


def test_iou_crop_then_sanitize():
    smaller = 0
    for k in range(60):
        e = example(k)
        c = detection.iou_crop(e, np.random.default_rng(k))
        tall, wide = c["image"].shape[:2]
        s = detection.sanitized(c)
        smaller += (tall, wide) != (60, 80)
        assert len(s["boxes"]) == len(s["labels"]) >= 1 and (s["boxes"] >= 0).all() and (s["boxes"][:, 2:] <= (wide, tall)).all()
        assert tall >= 18 and wide >= 24 and 0.4 < wide / tall < 2.1
    assert smaller > 20
    none = {**example(), "boxes": [], "labels": []}
    assert detection.iou_crop(none, np.random.default_rng(0)) is none and len(detection.sanitized(none)["boxes"]) == 0


def test_overlaps_flips_and_distortion():
    assert detection.overlaps(np.array([[0, 0, 2, 2], [1, 1, 3, 3], [5, 5, 5, 5]], float), (0, 0, 2, 2)) == pytest.approx([1, 1 / 7, 0])
    e = example()
    f = detection.flipped(e)
    assert f["boxes"].tolist() == [[40, 5, 75, 30], [5, 20, 30, 55]] and (detection.flipped(f)["image"] == e["image"]).all()
    d = detection.distorted(e, np.random.default_rng(1))
    assert d["image"].shape == e["image"].shape and (d["image"] != e["image"]).any() and d["boxes"] == e["boxes"]
    assert detection.to_tensor(e)["image"].shape == (3, 60, 80) and detection.to_tensor(e)["image"].max() <= 1


def test_chains_are_legal_and_can_be_reordered(spark):
    assert order_count(tensors.CHAINS["coco"]) == sum(1 for _ in linear_extensions(tensors.CHAINS["coco"])) == 30
    assert order_count(tensors.CHAINS["commonvoice"]) == 1
    for steps in tensors.CHAINS.values():
        assert legal(steps, range(len(steps)))
    df = spark.createDataFrame([(k, bytearray(ppm(example(k)["image"]))) for k in range(3)] + [(9, None)], "id int, raw binary")
    usual = {r.id: r.tensor for r in tensors.chain(df, "simclr", "id", "raw").collect()}
    again = {r.id: r.tensor for r in tensors.chain(df.repartition(2), "simclr", "id", "raw").collect()}
    assert usual[9] is None and usual[0].shape == [244, 244, 3] and usual == again and usual[0].data != usual[1].data
    other = tensors.chain(df.filter("id = 0"), "simclr", "id", "raw", order=[0, 1, 5, 2, 3, 4, 6, 7]).first().tensor
    assert other.shape == [244, 244, 3]
    with pytest.raises(ValueError):
        tensors.chain(df, "simclr", "id", "raw", order=[0, 1, 3, 2, 4, 5, 6, 7])
    assert tensors.chain(df, "simclr", "id", "raw", epoch=1).first().tensor.data != usual[0].data


def test_detection_chain():
    out = tensors.applied(example(), tensors.CHAINS["coco"], 7)
    assert out["image"].shape[0] == 3 and len(out["boxes"]) == len(out["labels"])
    assert (tensors.applied(example(), tensors.CHAINS["coco"], 7)["image"] == out["image"]).all()


def test_speech_chain(spark):
    t = np.arange(16000) / 16000
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes((np.sin(2 * np.pi * 440 * t) * 20000).astype("<i2").tobytes())
    df = spark.createDataFrame([("a", bytearray(raw.getvalue()))], "id string, raw binary")
    got = tensors.chain(df, "commonvoice", "id", "raw").first().tensor
    assert got.shape[0] == 256 and got.shape[1] == 102  # 81 frames at 8 kHz, over 1 / 0.8 times the time
    s = np.abs(np.random.default_rng(0).normal(size=(5, 9))) ** 2
    assert audio.stretched(s, 1.0) == pytest.approx(s) and audio.stretched(s).shape == (5, 12)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_byte_pairs(spark, name):
    path = f"/opt/tokenizers/{name}"
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([(1, "the cat and the dog " * 200), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.tokens for r in tensors.token_rows(df, "text", path).collect()}
    assert len(got[1]) == 256 and got[1][0] == 1 and got[1][-1] == 2 and got[2] == got[3] == [1, 2]
    first = tensors.encoder(path)("the cat")
    few = tensors.token_rows(df.filter("id = 1"), "text", path, vocabulary={first[0]: 7}).first().tokens
    assert set(few) == {1, 8, 2}
