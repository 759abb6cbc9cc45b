"""Sources: lines, JSON lines, files, images, detection annotations and web pages, each as a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from http.client import HTTPException
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import unused
from ..functions.text import rooted
from ..operators.rows import prefix, shard


def _limited(df: DataFrame, order: Sequence, rank_spec: tuple[int, int] | None, max_samples: int | None) -> DataFrame:
    """A prefix in source order, then the shard (world, rank) of it."""
    if max_samples is not None and max_samples <= 0:
        raise ValueError("max_samples must be positive")
    if rank_spec is not None:
        return shard(df, rank_spec[0], rank_spec[1], order, max_samples)
    if max_samples is not None:
        return prefix(df, max_samples, order)
    return df


def items(spark: SparkSession, rows: Iterable[Any], schema: str, rank_spec: tuple[int, int] | None = None) -> DataFrame:
    """Any Python values. Scalars become the one column of the schema."""
    rows = [r if isinstance(r, (tuple, dict, list)) else (r,) for r in rows]
    return _limited(spark.createDataFrame(rows, schema), (), rank_spec, None)


def lines(spark: SparkSession, path: str | list[str], rank_spec: tuple[int, int] | None = None, max_samples: int | None = None) -> DataFrame:
    """(value): one row a line of UTF-8 text, without line ends at either side. Blank lines are rows.

    Prefixes and shards are in source order: files by path, and lines as they stand there. Spark deals blocks to tasks by size, so the order
    is that of file and block, and of rows within a block.
    """
    df = spark.read.text(path).withColumn("value", F.regexp_replace("value", r"^[\r\n]+|[\r\n]+$", ""))
    if rank_spec is None and max_samples is None:
        return df
    df = df.withColumns({"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "row": F.monotonically_increasing_id()})
    return _limited(df, ["file", "block", "row"], rank_spec, max_samples).select("value")


def json_lines(spark: SparkSession, path: str | list[str], schema: str = "raw_content string, text string, meta string", max_samples: int | None = None) -> DataFrame:
    return parse_json(lines(spark, path, max_samples=max_samples), "value", schema)


def parse_json(df: DataFrame, column: str, schema: str = "raw_content string, text string, meta string") -> DataFrame:
    """The fields of a JSON object a row; raw_content falls back to text, then to empty. A row that is no JSON object is an error."""
    parsed = F.from_json(column, schema, {"mode": "FAILFAST"})
    j = unused("json", df)
    df = df.withColumn(j, parsed)
    fields = [f.strip().split()[0] for f in schema.split(",")]
    out = [F.coalesce(f"{j}.raw_content", f"{j}.text", F.lit("")).alias(f) if f == "raw_content" else F.col(f"{j}.{f}") for f in fields]
    return df.select(*[c for c in df.columns if c not in (column, j, *fields)], *out)


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """(value): one compact JSON line for each element of a file that holds one array."""
    return spark.read.option("multiLine", True).json(path).select(F.to_json(F.struct("*")).alias("value"))


def files(spark: SparkSession, path: str | list[str], recursive: bool = False, rank_spec: tuple[int, int] | None = None, max_samples: int | None = None) -> DataFrame:
    """(path, length) of each file, by path; contents are not read."""
    if not isinstance(path, (str, list, tuple)):
        raise TypeError("a path or a list of paths is needed")
    if max_samples is not None and max_samples <= 0:
        raise ValueError("max_samples must be positive")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length")
    return _limited(df, ["path"], rank_spec, max_samples)


def contents(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(path, length, content) of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length", "content")


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, line) of text files."""
    from ..operators.rows import lines_of

    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines_of(df, "value", ["path"])


PIXELS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("height", "width", "channels")] + [T.StructField("data", T.BinaryType())])


def mapped_bytes(df: DataFrame, column: str, out: str, kind: T.DataType, f: Callable[[bytes], Any]) -> DataFrame:
    """df with f of a binary column as another column, over Arrow batches. Null stays null."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    where = df.columns.index(column)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches):
        for b in batches:
            got = [None if x is None else f(x) for x in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, arrow)], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def images(df: DataFrame, content: str = "content", decode: Callable[[bytes], Any] | None = None) -> DataFrame:
    """df with image: height, width, channels and data of RGB pixels. Another decoder is a function from bytes to an array."""
    from ..functions.images import decode as usual

    f = decode or usual

    def pixels(raw: bytes) -> dict:
        x = f(raw)
        return {"height": x.shape[0], "width": x.shape[1], "channels": x.shape[2], "data": x.tobytes()}

    return mapped_bytes(df, content, "image", PIXELS, pixels)


def detection(images: DataFrame, annotations: DataFrame, empty: bool = True, relative: bool = False) -> DataFrame:
    """images (id, file_name, width, height) with boxes and labels of annotations (image_id, bbox, category_id), in the order of their ids if
    they have any.

    Boxes go from corner and size to two corners. empty: images without annotations stay, with empty arrays; else they go. relative: boxes
    are divided by width and height. An image's annotations are combined before they move.
    """
    box = F.array(F.get("bbox", F.lit(0)), F.get("bbox", F.lit(1)), F.get("bbox", F.lit(0)) + F.get("bbox", F.lit(2)), F.get("bbox", F.lit(1)) + F.get("bbox", F.lit(3)))
    order = F.col("id") if "id" in annotations.columns else F.monotonically_increasing_id()
    each = annotations.select("image_id", F.struct(order.alias("o"), F.transform(box, lambda v: v.cast("double")).alias("box"), F.col("category_id").alias("label")).alias("a"))
    each = each.groupBy("image_id").agg(F.sort_array(F.collect_list("a")).alias("a"))
    out = images.join(each, images["id"] == each["image_id"], "left" if empty else "inner").drop("image_id").withColumnRenamed("id", "image_id")
    boxes = F.coalesce(F.transform("a", lambda x: x["box"]), F.array().cast("array<array<double>>"))
    if relative:
        boxes = F.transform(boxes, lambda b: F.transform(b, lambda v, i: v / F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height"))))
    return out.withColumns({"boxes": boxes, "labels": F.coalesce(F.transform("a", lambda x: x["label"]), F.array().cast("array<bigint>"))}).drop("a")


def word_lists(spark: SparkSession, path: str, kind: str) -> dict[str, list[str]]:
    """The words of every language, from all JSON files of a folder whose name holds `kind`: an object of lists, merged key by key. Without a key
    `all` it is every list after the other. The lists are small assets, and come to the driver."""
    found = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    out: dict[str, list[str]] = {}
    for r in found.filter(F.col("name").endswith(".json") & F.contains("name", F.lit(kind))).orderBy("name").collect():
        for key, words in json.loads(r.value).items():
            out.setdefault(key, []).extend(words)
    if not out:
        raise ValueError(f"no word list of {kind!r}")
    out.setdefault("all", [w for words in out.values() for w in words])
    return out


MANIFEST = "id string, image string, conversations array<struct<`from`: string, value: string>>"


def caption_manifest(spark: SparkSession, path: str, image_root: str | None = None, rows: int | None = None) -> DataFrame:
    """(id, image, caption) from lines of conversations: the second turn, trimmed. Blank lines are passed over. A line without an image or a
    second turn is an error that names its number, and so is another number of rows than `rows`. An id defaults to the image."""
    lined = file_lines(spark, path).filter(F.trim("line") != "").withColumn("j", F.from_json("line", MANIFEST, {"mode": "PERMISSIVE"}))
    second = F.get("j.conversations", F.lit(1))["value"]
    ok = F.coalesce(F.col("j.image") != "", F.lit(False)) & second.isNotNull()
    bad = F.raise_error(F.concat(F.lit("no image and caption in line "), (F.col("line_no") + 1).cast("string"))).cast("string")
    image = F.when(~ok, bad).otherwise(F.col("j.image") if image_root is None else F.get(rooted(F.array("j.image"), image_root), F.lit(0)))
    out = lined.withColumn("image", image).select(F.coalesce("j.id", "image").alias("id"), "image", F.regexp_replace(second, r"^\s+|\s+$", "").alias("caption"))
    if rows is not None and (n := out.count()) != rows:
        raise ValueError(f"{n} rows, not {rows}")
    return out


def web(urls: DataFrame, url: str = "url", timeout: float = 10, fetch: Callable[[str, float], bytes] | None = None, pages: DataFrame | None = None, stored: str | None = None) -> DataFrame:
    """urls with content: the bytes of each page. From a table pages (url, html) if one is given; from a column `stored` of urls, which goes, if
    the page of each row is there; else fetched by the executors.

    A timeout below one second is an error. Pages that can't be had are null. Where pages has several rows for a url, the url has a row for each;
    only `stored` tells visits to one url apart.
    """
    if timeout < 1:
        raise RuntimeError("the timeout must be a second at least")
    if stored is not None:
        return urls.select(*[c for c in urls.columns if c != stored], F.encode(stored, "UTF-8").alias("content"))
    if pages is not None:
        u = unused("u", urls)
        found = pages.select(F.col("url").alias(u), F.encode("html", "UTF-8").alias("content"))
        return urls.join(found, urls[url] == F.col(u), "left").drop(u)

    def usual(address: str, seconds: float) -> bytes:
        from urllib.request import urlopen

        with urlopen(address, timeout=seconds) as r:
            return r.read()

    get = fetch or usual
    where = urls.columns.index(url)
    schema = T.StructType([*urls.schema.fields, T.StructField("content", T.BinaryType())])

    def run(batches):
        for b in batches:
            got = []
            for u in b.column(where).to_pylist():
                try:
                    got.append(get(u, timeout))
                except (OSError, ValueError, HTTPException):  # no answer, no address, or no page
                    got.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*b.schema.names, "content"])

    return urls.mapInArrow(run, schema)
