"""Filters over images and videos: headers as Columns, model scores from any scorer, loaded once a worker; and their recipes as data.

A scorer is made by load(), which runs in the worker and nowhere else, so no model is pickled. It gets the text of a part of a record and the
paths that the part names, and gives a score for each. Reductions over the scores are Columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.scorers import loaded
from ..plans.pipeline import Step, lower
from . import records

Scorer = Callable[[str, list[str]], Sequence[float]]


def placement(spark: SparkSession, resource: str):
    """The resource profile of a step: one GPU a task where the cluster has any to offer and the step asks for it, else None."""
    if resource not in ("cpu", "gpu"):
        raise ValueError(f"cpu or gpu, not {resource!r}")
    if resource == "cpu" or not int(spark.conf.get("spark.executor.resource.gpu.amount", "0")):
        return None
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource("gpu", 1)).build


def scored(df: DataFrame, parts: Column, name: str, load: Callable[[], Scorer], out: str, resource: str = "cpu") -> DataFrame:
    """df with out: for each part (text, paths) the scores of its paths. Parts without paths have none; a null array of parts is empty."""
    kind = T._parse_datatype_string("array<array<double>>")
    given = df.withColumn(out, F.coalesce(parts, F.array().cast("array<struct<text:string,paths:array<string>>>")))
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    where = given.columns.index(out)

    def run(batches):
        scorer = loaded(name, load)
        for b in batches:
            got = [[[float(x) for x in scorer(p["text"], list(p["paths"] or ()))] if p["paths"] else [] for p in row] for row in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != where], pa.array(got, pa.list_(pa.list_(pa.float64())))], names=[*[n for n in b.schema.names if n != out], out])

    return given.mapInArrow(run, schema, profile=placement(df.sparkSession, resource))


def score_kept(scores: Column, low: float | None, high: float | None, reduce_mode: str = "avg", any_or_all: str = "any") -> Column:
    """Whether any or all parts have a reduced score within the bounds; true without any part that has scores."""
    some = F.filter(scores, lambda s: F.size(s) > 0)
    return records.reduced(F.transform(some, lambda s: records.score_bounds(records.reduced_score(s, reduce_mode), low, high)), any_or_all)


def one_part(text: Column, paths: Column) -> Column:
    """The whole record as one part, for scorers that look at a record's paths alone or with its whole text."""
    return F.array(F.struct(text.alias("text"), paths.alias("paths")))


def each_part(text: Column, paths: Column) -> Column:
    """Each path as a part of its own, so that bounds hold for each."""
    return F.transform(paths, lambda p: F.struct(text.alias("text"), F.array(p).alias("paths")))


# Records


def image_records(df: DataFrame) -> DataFrame:
    """images: a list, from images or from the one path in image; without either it is empty."""
    found = [F.col("images")] if "images" in df.columns else []
    found += [F.when(F.col("image").isNotNull(), F.array("image"))] if "image" in df.columns else []
    return df.withColumn("images", F.coalesce(*found, F.array().cast("array<string>")))


def rooted_records(df: DataFrame, root: str, column: str = "images") -> DataFrame:
    return df.withColumn(column, tx.rooted(F.col(column), root))


def video_output(df: DataFrame) -> DataFrame:
    """(video_id, sentence_id, videos, text): what a video recipe hands on. A null list is empty, a null text too."""
    return df.select("video_id", "sentence_id", F.coalesce("videos", F.array().cast("array<string>")).alias("videos"), tx.text_of("text").alias("text"))


# Recipes

_UNIFORM, _KEYFRAMES = {"frames": "uniform", "frame_num": 3}, {"frames": "all_keyframes", "frame_num": 3}
#: The scorer, its bounds and its options of each media filter. GPU filters ask for one.
MEDIA: dict[str, tuple[str, float | None, float | None, dict[str, Any], str]] = {
    "image_text_similarity": ("image_text_similarity", 0.20315419, 1.0, {}, "gpu"),
    "image_text_matching": ("image_text_matching", 0.44930778, 1.0, {}, "gpu"),
    "video_aesthetics": ("video_aesthetics", 0.31767486, 1.0, _UNIFORM, "gpu"),
    "video_text_similarity": ("video_text_similarity", 0.16571071, 1.0, _KEYFRAMES, "gpu"),
    "video_motion": ("video_motion", 0.25, 10000.0, {"sampling_fps": 2}, "cpu"),
    "video_nsfw": ("video_nsfw", None, 0.34847191, _KEYFRAMES, "gpu"),
    "video_watermark": ("video_watermark", None, 0.96510297, _KEYFRAMES, "gpu"),
    "sandbox_video_nsfw": ("video_nsfw", None, 0.000195383, _UNIFORM, "gpu"),
    "sandbox_video_text_similarity": ("video_text_similarity", 0.306337, 1.0, _UNIFORM, "gpu"),
    "sandbox_video_motion": ("video_motion", 3.0, 20.0, {"sampling_fps": 2}, "cpu"),
    "sandbox_video_aesthetics": ("video_aesthetics", 0.418164, 1.0, _UNIFORM, "gpu"),
    "sandbox_video_duration": ("video_duration", 2.0, 100000.0, {}, "cpu"),
}


def media_step(name: str, **more: Any) -> Step:
    scorer, low, high, options, resource = MEDIA[name]
    return Step(name, "media", {"scorer": scorer, **options}, low, high, resource=resource, **more)


#: The bounds of the image headers and of the running example's predicates.
HEADERS = (Step("image_aspect", "header", {"low": 0.333, "high": 3.0}), Step("image_shape", "header", {"width": (1, 727), "height": (1, 606)}), Step("image_bytes", "header", {"high": "124KB"}))


def media_recipe(name: str) -> list[Step]:
    """The steps of a recipe over images or videos, in declared order: text steps, header steps and media steps."""
    from ..plans.recipes import recipe

    if name == "llava_pretrain":
        return [*recipe("llava_pretrain_text"), *HEADERS, media_step("image_text_similarity"), media_step("image_text_matching")]
    if name == "general_video_refine":
        text = [Step("lang", "language_score", {"lang": "en"}, 0.26311219), Step("ppl", "perplexity", {}, None, 7376.81378)]
        return [*text, *map(media_step, ("video_aesthetics", "video_text_similarity", "video_motion", "video_nsfw", "video_watermark"))]
    if name == "video_self_evolution":
        return [media_step(f"sandbox_video_{k}") for k in ("nsfw", "text_similarity", "motion", "aesthetics", "duration")]
    if name == "running_example":
        # The thresholds come from a calibration, which keeps a share of the rows at each predicate.
        ends = ("ppl", "safety", "aesthetic")
        return [
            Step("normalize", "normalize_punctuation"),
            Step("ppl", "perplexity", {}, None, 4000.0, after=("normalize",)),
            Step("safety", "media", {"scorer": "image_safety"}, None, 0.9),
            Step("aesthetic", "media", {"scorer": "image_aesthetic"}, 0.1, resource="gpu"),
            Step("clip", "media", {"scorer": "image_text_similarity"}, 0.2, after=ends, resource="gpu"),
            Step("blip", "media", {"scorer": "image_text_matching"}, 0.3, after=("clip",), resource="gpu"),
        ]
    raise KeyError(name)


#: Curated pipelines: modalities, operators, and which of them want a GPU.
CATALOG: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "llava_quality": (("image", "text"), ("FixUnicode", "NormalizePunctuation", "LanguageQuality", "Perplexity", "ImageShape", "ImageSize", "ImageTextSimilarity", "ImageTextMatching"), ("ImageTextSimilarity", "ImageTextMatching")),
    "llava_safety": (("image", "text"), ("FixUnicode", "CharacterRepetition", "FlaggedWords", "SpecialCharacters", "ImageAspectRatio", "ImageSize", "ImageTextSimilarity", "ImageTextMatching"), ("ImageTextSimilarity", "ImageTextMatching")),
    "image_edit_generation": (("source_image", "target_image", "text"), ("SentenceAugmentation", "PromptToPrompt", "DifferenceArea", "DifferenceCaption"), ("PromptToPrompt", "DifferenceArea", "DifferenceCaption")),
    "video_sandbox": (("video", "text"), ("VideoNSFW", "VideoTextSimilarity"), ("VideoNSFW", "VideoTextSimilarity")),
    "video_self_evolution": (("video", "text"), ("VideoDuration", "VideoMotion", "VideoAesthetics", "VideoNSFW", "VideoTextSimilarity"), ("VideoAesthetics", "VideoNSFW", "VideoTextSimilarity")),
    "general_video_refine": (("video", "text"), ("LanguageIdentification", "Perplexity", "VideoAesthetics", "VideoTextSimilarity", "VideoMotion", "VideoNSFW", "VideoWatermark"), ("VideoAesthetics", "VideoTextSimilarity", "VideoNSFW", "VideoWatermark")),
    "video_caption_refine": (("video", "text"), ("ParseRecord", "ResolveVideoPath", "LanguageIdentification", "Perplexity", "VideoAesthetics", "VideoTextSimilarity", "VideoMotion", "VideoNSFW", "VideoWatermark", "VideoDuration"), ("VideoAesthetics", "VideoTextSimilarity", "VideoNSFW", "VideoWatermark")),
}


def _header(step: Step) -> Column:
    """Over shapes (array of width, height) and sizes (array of bytes) of a record's images."""
    test = {"image_aspect": (records.image_aspect, "shapes"), "image_shape": (records.image_shape, "shapes"), "image_bytes": (records.image_bytes, "sizes")}[step.tag]
    return test[0](F.col(test[1]), **step.args)


def lower_media(df: DataFrame, steps: Sequence[Step], loaders: Mapping[str, Callable[[], Scorer]], paths: str, annotate: bool = False, reduce_mode: str = "avg", any_or_all: str = "any") -> DataFrame:
    """df (text, the paths column, and for header steps shapes and sizes) through the steps in their order; loaders has load() by scorer.

    Similarity and matching look at the parts of a text between end marks and the images that each names; all others at each path.
    annotate: keeps all rows and adds ok_<tag> for each filter.
    """
    for s in steps:
        if s.op == "media":
            kind = s.args["scorer"]
            parts = records.image_chunks(F.col("text"), F.col(paths)) if kind.startswith("image_text") else one_part(F.col("text"), F.col(paths)) if kind == "video_text_similarity" else each_part(F.col("text"), F.col(paths))
            df = scored(df, parts, kind, loaders[kind], f"__{s.tag}", s.resource)
            ok = score_kept(F.col(f"__{s.tag}"), s.low, s.high, reduce_mode, any_or_all)
            df = df.withColumn(f"ok_{s.tag}", ok) if annotate else df.filter(ok)
            df = df.drop(f"__{s.tag}")
        elif s.op == "header":
            df = df.withColumn(f"ok_{s.tag}", _header(s)) if annotate else df.filter(_header(s))
        elif s.operator.kind == "map" or not annotate:
            df = lower(df, [s])
        else:
            df = lower(df, [s], annotate=True).withColumn(f"ok_{s.tag}", s.within(F.col(f"stat_{s.tag}"))).drop(f"stat_{s.tag}")
    return df
