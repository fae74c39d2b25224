"""A training-data pipeline over ``documents``: five stages, each written and read again.

Stages keep the columns of documents, but for the last, which returns tokens.
Near copies here share at least 0.8 of their five-word shingles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textdelta.llm import decontaminate, jaccard_join, line_dedup, pieces, toxicity
from textdelta.llm.components import cut, few, removed, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE, NUM, DEN = 5, 80, 100
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as abuse go; the lexicon is learned from the labels of the table's own documents."""
    lexicon = toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.clean(docs.select(COLUMNS), lexicon)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in their first document only."""
    kept = line_dedup.drop_recurring(docs.select(COLUMNS))
    changed = F.col("n_dropped") > 0
    return kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays, and of rows that repeat id and text one.

    Rows without an id are compared under an id made of their text, which is larger than
    others. Texts without words are no copies of each other.
    """
    docs = docs.select(COLUMNS).withColumn("__text", F.xxhash64("text"))
    made = F.shiftrightunsigned("__text", 2) + F.lit(1 << 62)
    docs = docs.withColumn("__id", F.coalesce("doc_id", made))
    parts = jaccard_join.jaccard_components(docs, id_column="__id", k=SHINGLE, num=NUM, den=DEN)
    gone = cut(parts.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())
    is_few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    gone = F.broadcast(gone) if is_few else gone.hint("shuffle_hash")
    left = docs.join(gone, docs["__id"] == F.col("gone"), "left_anti")
    own = ["__id", "__text"]
    repeated = cut(docs.where(F.rlike("text", F.lit("[^\\x20\\x09-\\x0D]"))).groupBy(*own).agg(F.count("*").alias("n")).where("n > 1").select(*own))
    if not repeated.isEmpty():
        repeated = few(repeated)
        left = left.join(repeated, own, "left_anti").unionByName(left.join(repeated, own, "left_semi").dropDuplicates(own))
    return left.select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of ten words of a benchmark item occurs go."""
    return decontaminate.clean(docs.select(COLUMNS), _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, as a digest, and the digest of what they decode to."""
    return pieces.digest(docs.select(COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", tokens),
]

#: No stage but the second and the fourth has a form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written to the shared folder and read again.

    What a stage has written goes when the next but one has been; the last stays, as the result reads it.
    """
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i > 1:
            removed(spark, f"{folder}/{i - 2}")
    removed(spark, f"{folder}/{len(STAGES) - 2}")
    return docs
