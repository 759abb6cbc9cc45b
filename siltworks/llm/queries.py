"""The queries of this subpackage: thin, each through its operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, toxicity
from .chat_format import as_chains, chat_format, read_back
from .common import table
from .decontamination import decontamination
from .exact_dedup import exact_dedup
from .induced_sort import byte_dedup
from .mixing import mixed
from .near_dedup import near_dedup
from .oracles import oracle_sql as oracle_sql
from .pii import pii_surrogates
from .suffix_trees import substring_dedup

#: For tables that are public anyway; a corpus needs a secret of its own, in spark.siltworks.pii.key.
KEY = "not a secret"
#: In the mix, a text of sixteen times the words is taken twice as often: inclusion odds differ between documents.
SIZE_POWER = 0.25


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("x"))
    rows = rows.unionByName(more.select("conv_id", "x.turn", "x.role", F.lit(probe).alias("text")))
    out = read_back(chat_format(as_chains(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return out.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("conversation").cast("long").alias("formatted_chars"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get("spark.siltworks.pii.key", KEY))
    return out.select("doc_id", "pii_count", F.array_join("pii_kinds", ",").alias("pii_kinds"), "text")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), size_power=SIZE_POWER).select("doc_id", "size", "source_size", "target", "taken", "source", "expected")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extracted(pages, html_extract.train(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join(F.transform("items", lambda i: i.cast("string")), ","))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_pii_surrogates, op3_exact_dedup, op4_mixing, op5_suffix_array_dedup, op6_html_extraction, op7_substring_dedup, op8_toxicity, op9_ngram_jaccard_join, op10_decontamination)}
