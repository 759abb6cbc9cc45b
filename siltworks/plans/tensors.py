"""Chains over images, detections, audio and tokens as data: steps with their order constraints, run over Arrow batches with draws by record.

A step's random draws depend on seed, epoch, record and tag, and not on where or in which order steps run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import audio, detection, images
from ..functions.scorers import loaded
from ..operators import records
from .order import legal
from .pipeline import Step

#: What each step does with a value and a generator.
STEPS: dict[str, Callable[[Any, np.random.Generator], Any]] = {
    "decode": lambda x, _: images.decode(x),
    "float": lambda x, _: images.to_float(x),
    "crop_244": lambda x, rng: images.random_resized_crop(x, rng, 244),
    "maybe_flip": lambda x, rng: images.flip(x) if rng.random() < 0.5 else x,
    "jitter": lambda x, rng: images.color_jitter(x, rng),
    "gray": lambda x, _: images.grayscale(x),
    "blur_11": lambda x, rng: images.gaussian_blur(x, rng.uniform(0.1, 2.0), 11),
    "normalize": lambda x, _: images.normalized(x, 0.1307, 0.3081),
    "zoom": detection.zoom_out,
    "iou_crop": detection.iou_crop,
    "sanitize": lambda x, _: detection.sanitized(x),
    "flip_boxes": lambda x, _: detection.flipped(x),
    "distort": detection.distorted,
    "tensor": lambda x, _: detection.to_tensor(x),
    "read_wav": lambda x, _: audio.read_wav(x),
    "resample": lambda x, _: audio.resample(*x),
    "spectrogram": lambda x, _: audio.spectrogram(x),
    "stretch": lambda x, _: audio.stretched(x),
    "time_mask": audio.time_mask,
    "frequency_mask": audio.frequency_mask,
    "mel": lambda x, _: audio.mel(x),
}


def _random(tag: str, op: str, after: tuple[str, ...] = ()) -> Step:
    return Step(tag, op, after=after, random=True)


#: The chains in declared order. Fixed steps stay; the others may move within their constraints.
CHAINS: dict[str, tuple[Step, ...]] = {
    "simclr": (Step("read", "decode", fixed=True), Step("float", "float"), _random("crop", "crop_244"), _random("flip", "maybe_flip", ("crop",)), _random("jitter", "jitter"), Step("gray", "gray"), _random("blur", "blur_11"), Step("normalize", "normalize", after=("float",))),
    "coco": (_random("zoom", "zoom"), _random("crop", "iou_crop", ("zoom",)), Step("sanitize", "sanitize", after=("crop",)), Step("flip", "flip_boxes", after=("sanitize",)), _random("distort", "distort"), Step("tensor", "tensor")),
    "commonvoice": (Step("read", "read_wav", fixed=True), Step("resample", "resample", fixed=True), Step("spectrum", "spectrogram", fixed=True), Step("stretch", "stretch"), _random("time_mask", "time_mask", ("stretch",)), _random("frequency_mask", "frequency_mask", ("time_mask",)), Step("mel", "mel", fixed=True)),
}
#: Records to a batch are the caller's (operators.rows.batch); tokens are Columns but for the tokenizer (token_rows).


def applied(value: Any, steps: Sequence[Step], record: Any, seed: int = 0, epoch: int = 0) -> Any:
    """One value through the steps, in their order, which must be legal."""
    for s in steps:
        value = STEPS[s.op](value, images.draws(seed, epoch, record, s.tag))
    return value


def chain(df: DataFrame, name: str, record: str, column: str, out: str = "tensor", order: Sequence[int] | None = None, seed: int = 0, epoch: int = 0) -> DataFrame:
    """df with out: shape (array of int) and values (array of float) of what the chain makes of a binary column. Null stays null."""
    steps = list(CHAINS[name])
    if order is not None and not legal(steps, order):
        raise ValueError("this order breaks a constraint of the chain")
    steps = [steps[i] for i in order] if order is not None else steps
    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string("struct<shape: array<int>, data: array<float>>"))])
    at, key = df.columns.index(column), df.columns.index(record)
    kind = pa.struct([("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float32()))])

    def run(batches):
        for b in batches:
            made = []
            for raw, k in zip(b.column(at).to_pylist(), b.column(key).to_pylist()):
                x = None if raw is None else np.asarray(applied(raw, steps, k, seed, epoch))
                made.append(None if x is None else {"shape": list(x.shape), "data": x.astype(np.float32).ravel().tolist()})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def encoder(path: str) -> Callable[[str], list[int]]:
    """The byte-pair encoder of a tokenizers file (.json), or of a list of ranks in tiktoken's form."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    words = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(path, pat_str=words, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_rows(df: DataFrame, text: str, path: str, out: str = "tokens", most: int = 254, vocabulary: dict[int, int] | None = None) -> DataFrame:
    """df with out: the ids of a text, cut to `most`, perhaps renumbered (ids that the vocabulary lacks go), between their marks."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    at = df.columns.index(text)

    def run(batches):
        encode = loaded(f"tokenizer {path}", lambda: encoder(path))
        for b in batches:
            ids = [encode(t or "")[:most] for t in b.column(at).to_pylist()]
            ids = ids if vocabulary is None else [[vocabulary[i] for i in row if i in vocabulary] for row in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema).withColumn(out, records.token_ids(F.col(out), most))
