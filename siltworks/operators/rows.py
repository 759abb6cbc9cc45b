"""Dataflow operators on whole tables: ordinals, prefixes, shards, batches, flat maps and caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scratch import cut, unused

_PLACE = (1 << 33) - 1


def with_ordinal(df: DataFrame, order: Sequence[str | Column] = (), name: str = "ordinal") -> DataFrame:
    """df with consecutive numbers from 0 in the given order, or in the order of its rows if none is given.

    A range sort spreads the rows, each partition numbers its own, and what comes before is a small table with a row per partition: no task
    sees all rows. The numbered rows are kept, as a second evaluation could partition them anew.
    """
    at, part, before = unused("at", df), unused("part", df), unused("before", df)
    rows = df.orderBy(*order) if order else df
    rows = cut(rows.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    starts = sizes.select(part, F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    numbered = rows.join(F.broadcast(starts), part)  # as many rows as rows has partitions
    return numbered.withColumn(name, (F.col(before) + F.col(at).bitwiseAND(F.lit(_PLACE))).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)


def prefix(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first n rows in the given order; n must be positive."""
    if n <= 0:
        raise ValueError("a prefix has at least one row")
    place = unused("n", df)
    return with_ordinal(df, order, place).filter(F.col(place) < n).drop(place)


def shard(df: DataFrame, world: int, rank: int, order: Sequence[str | Column], max_samples: int | None = None) -> DataFrame:
    """Row i stays if (i - rank) is a multiple of world; a prefix limit comes first."""
    if not 0 <= rank < world:
        raise ValueError("the rank must lie below the number of shards")
    place = unused("n", df)
    rows = with_ordinal(df, order, place)
    if max_samples is not None:
        rows = rows.filter(F.col(place) < max_samples)
    return rows.filter(F.pmod(F.col(place) - rank, F.lit(world)) == 0).drop(place)


def batch(df: DataFrame, size: int, order: Sequence[str | Column], drop_last: bool = False) -> DataFrame:
    """(batch, items): consecutive groups as arrays of structs, in order; the tail stays unless drop_last. Batches of one are arrays of one."""
    place = unused("n", df)
    rows = with_ordinal(df, order, place)
    item = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    out = rows.groupBy((F.col(place) / size).cast("long").alias("batch")).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("n"), item.alias("item")))).alias("x"))
    out = out.select("batch", F.transform("x", lambda x: x["item"]).alias("items"))
    return out.filter(F.size("items") == size) if drop_last else out


def _sized(df: DataFrame, size: Column, order: Sequence[str | Column]) -> tuple[DataFrame, str, str]:
    """df with the place of each row and the sum of the sizes up to it, and their names. Sums are by bin, then over bins."""
    own, place, bin_, total = (unused(n, df) for n in ("own", "place", "bin", "total"))
    rows = with_ordinal(df.withColumn(own, size.cast("long")), order, place).withColumn(bin_, (F.col(place) / 4096).cast("long"))
    sums = rows.groupBy(bin_).agg(F.sum(own).alias("s"))
    before = sums.select(bin_, F.coalesce(F.sum("s").over(W.orderBy(bin_).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    within = F.sum(own).over(W.partitionBy(bin_).orderBy(place).rowsBetween(W.unboundedPreceding, 0))
    more = unused("s", rows)
    rows = rows.withColumn(total, within).join(before.withColumnRenamed("s", more), bin_)
    return rows.withColumn(total, F.col(total) + F.col(more)), place, total


def byte_prefix(df: DataFrame, most: int, size: Column, order: Sequence[str | Column], least_rows: int = 0) -> DataFrame:
    """The longest prefix whose sizes add up to at most `most`; the first row always stays. Fewer than least_rows rows are an error."""
    rows, place, total = _sized(df, size, order)
    out = rows.filter((F.col(total) <= most) | (F.col(place) == 0)).select(*[F.col(f"`{c}`") for c in df.columns])
    if least_rows and (n := out.count()) < least_rows:
        raise ValueError(f"{n} rows are within the limit, and {least_rows} are needed")
    return out


def exact_prefix(df: DataFrame, n: int, size: Column, most: int, order: Sequence[str | Column], done: int = 0) -> DataFrame:
    """The first n rows without the first `done`, which are there already. Fewer rows, or more than `most` bytes of the n, are errors."""
    rows, place, total = _sized(df, size, order)
    first = rows.filter(F.col(place) < n)
    got = first.agg(F.count("*").alias("rows"), F.coalesce(F.max(total), F.lit(0)).alias("bytes")).first()
    if got["rows"] < n:
        raise ValueError(f"the source ended after {got['rows']} rows of {n}")
    if got["bytes"] > most:
        raise ValueError(f"{n} rows have {got['bytes']} bytes, more than {most}")
    return first.filter(F.col(place) >= done).select(*[F.col(f"`{c}`") for c in df.columns])


def lines_of(df: DataFrame, content: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, line_no, line): each line of a text column without line ends at either side; blank lines stay, a last empty one doesn't."""
    text = F.regexp_replace(F.col(content), r"\n\z", "")
    return df.filter(F.col(content) != "").select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"^[\r\n]+|[\r\n]+$", ""))


def noop(df: DataFrame) -> DataFrame:
    return df.select("*")


def fused(df: DataFrame, parts: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Several operators one after the other; Spark runs what it can in one stage. One operator alone is not a fusion."""
    parts = list(parts)
    if len(parts) < 2:
        raise ValueError("a fusion has two operators or more")
    for part in parts:
        df = part(df)
    return df


def cached(df: DataFrame) -> DataFrame:
    """Filled by the first pass and read by later ones, on the executors' disks."""
    return df.persist(StorageLevel.DISK_ONLY)


def stored(df: DataFrame, path: str) -> DataFrame:
    """A durable cache: written once, and read by whoever finds it complete. Spark's committer leaves _SUCCESS only after a whole write."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def boundary(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later expressions read and don't compute anew: a generator of one row stands between."""
    others = [c for c in df.columns if c != name]
    out = df.select(*others, F.explode(F.array(value)).alias(name))
    return out.select(*[F.col(c) for c in dict.fromkeys([*df.columns, name])])
