"""Queries of the problems on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .leakage import leaked_items, searched_items
from .mixing import mixed
from .quality import text_quality
from .tokens import with_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of an evaluation item, with the extent of the passage."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaked_items(docs, _table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least twelve successive words of an evaluation item."""
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation item with its words, whether it is long enough to be searched, and the documents that hold it."""
    return searched_items(_table(spark, sf_dir, "eval_items"), p8_leaks(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("text_key"), "text")
    return mixed(with_tokens(docs, "text"), _table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training mix in which each source has its target share of all tokens, a row per copy, shuffled."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of all tokens that the mix reaches, and how often texts are repeated."""
    return _mix(spark, sf_dir)[1]


def p10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and kind of every document's text."""
    return text_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are a list, a table or junk by more than half."""
    return p10_quality(spark, sf_dir).where("text_kind in ('list', 'table', 'junk')").select("doc_id", "text_kind")


def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text that SQL can give too."""
    return p10_quality(spark, sf_dir).select("doc_id", "n_chars", "n_words", F.round("duplicate_lines", 9).alias("duplicate_lines"), F.round("common_words", 9).alias("common_words"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every source its distinct texts, whether it comes within 0.01 or one text of its share, and whether it keeps to its repeats."""
    targets = _table(spark, sf_dir, "mix_targets").select(F.col("source").alias("_s"), "max_repeats")
    shares = p9_shares(spark, sf_dir).join(F.broadcast(targets), F.col("source") == F.col("_s"))
    one = F.try_divide(F.col("largest_text"), F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))  # a row per target
    near = F.abs(F.col("actual_share") - F.col("target_share")) < F.greatest(F.lit(0.01), one)
    return shares.select("source", "n_texts", near.alias("share_kept"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))


QUERIES = {
    "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_items": p8_items, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_kept": p9_kept,
    "p10_found": p10_found, "p10_quality": p10_quality, "p10_counts": p10_counts,
}
