"""Builders of text pairs: pair_id, grp, seq, original, modified."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that a task has at most, about: pairs, their tokens and operations are many times that, and cross to Python by thousands of rows.
MOST_BYTES = 4 << 20


def balanced(df: DataFrame) -> DataFrame:
    """A table dealt over all cores, and over more tasks the larger it is, as pairs make much more work and memory than their bytes tell."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // MOST_BYTES)))


def successive(df: DataFrame, group: list[str], order: list[str], text: str) -> DataFrame:
    """Each text with the one before it in its group; rows of a group must fit a window's sort, which spills."""
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)  # one that is not merged again for being small
    before = F.lag(text).over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("original", before).where("original IS NOT NULL").withColumn("modified", F.col(text))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation with the turn before."""
    df = successive(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], "text")
    pair = F.concat_ws("-", "conv_id", "turn", "role")
    return df.select(pair.alias("pair_id"), F.col("conv_id").cast("string").alias("grp"), F.col("turn").alias("seq"), "role", "original", "modified")


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with their types: short and ASCII."""
    df = table(spark, sf_dir, "part")
    return df.select(F.col("p_partkey").cast("string").alias("pair_id"), F.col("p_brand").alias("grp"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("original"), F.col("p_type").alias("modified"))


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their first line, with the whole: structured texts of one paragraph less."""
    df = balanced(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    cut = F.regexp_replace(F.col("text"), r"^[^\n]*\n", "")
    return df.select(F.col("doc_id").cast("string").alias("pair_id"), F.col("lang").alias("grp"), F.col("doc_id").alias("seq"), F.col("text").alias("original"), cut.alias("modified"))


def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share their first sentence, with the one before: copies and near copies."""
    df = table(spark, sf_dir, "documents").withColumn("head", F.xxhash64(F.regexp_extract("text", r"^[^.!?]*[.!?]?", 0)))
    df = successive(df, ["head"], ["doc_id"], "text")
    return df.select(F.col("doc_id").cast("string").alias("pair_id"), F.col("lang").alias("grp"), F.col("doc_id").alias("seq"), "original", "modified")
