"""Connected components of a table of links, joins that a hot key does not crowd, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most.
BROADCAST_ROWS = 500_000
#: A key of more rows than this, and than this share of all rows, is a hot one; so there are at most SHARE of them.
HOT, SHARE = 1000, 50_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; one of our own only where that is unset, on a single machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table in the shared folder, of which readers take the columns that they need."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ours in the shared folder, whatever file system that is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` (which is cut, or cheap) marked for broadcast if it has at most ``most`` rows (BROADCAST_ROWS)."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def answered(rows: DataFrame, answers: DataFrame, keys: list[str], spread: Column, limit: int | None = None) -> DataFrame:
    """``rows`` left-joined to ``answers`` (unique by ``keys``; their column n tells how many rows have the key).

    At most BROADCAST_ROWS answers are broadcast whole. Of more, keys of more than
    ``limit`` rows are, and what has them is dealt by ``spread``, so that no task
    gets a hot key's rows. The limit leaves at most SHARE keys above it; where it
    is given, answers are not counted first.
    """
    if limit is None:
        if answers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            return rows.join(F.broadcast(answers.drop("n")), keys, "left").select(*rows.columns, *(c for c in answers.columns if c not in keys and c != "n"))
        limit = max(HOT, (answers.agg(F.sum("n")).first()[0] or 0) // SHARE)
    rest = [c for c in answers.columns if c not in keys and c != "n"]
    hot = answers.where(F.col("n") > limit).select(*(F.col(c).alias(f"__hot_{c}") for c in keys + rest), F.lit(True).alias("__hot"))
    cold = answers.where(F.col("n") <= limit).select(*(F.col(c).alias(f"__cold_{c}") for c in keys + rest))
    every = lambda conditions: reduce(lambda a, b: a & b, conditions)
    met = rows.join(F.broadcast(hot), every(F.col(k) == F.col(f"__hot_{k}") for k in keys), "left")
    met = met.withColumn("__is_hot", F.col("__hot").isNotNull()).withColumn("__first", F.when(F.col("__is_hot"), spread).otherwise(F.col(keys[0])))
    cold = cold.withColumn("__cold", F.lit(False))
    same = [F.col("__first") == F.col(f"__cold_{keys[0]}"), F.col("__is_hot") == F.col("__cold"), *(F.col(k) == F.col(f"__cold_{k}") for k in keys[1:])]
    met = met.join(cold, every(same), "left")
    return met.select(*rows.columns, *(F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in rest))


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a, b).

    Alternates large-star and small-star steps until nothing changes: each hangs
    nodes under the smallest neighbour by an aggregate and a join in which hubs
    are hot keys, so a hub's neighbours are never gathered. The number of rounds grows with the logarithm
    of the longest chain. Null or self links are ignored; no links, no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = cut(edges), None
    limit = max(HOT, 2 * edges.count() // SHARE)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = answered(both.where("v > u"), least, ["u"], F.xxhash64("u", "v"), limit).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(least.where("m <> u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.count_distinct("u").alias("d")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
        limit = max(HOT, 2 * now.n // SHARE)
