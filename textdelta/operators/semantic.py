"""A trained similarity threshold: learned from a history of similarities, used to judge new ones."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Learned:
    """What training gives; the defaults are those of an untrained model."""

    threshold: float = 0.7
    mean: float = 0.7
    std_dev: float = 0.15
    median: float = 0.7
    min: float = 0.0
    max: float = 1.0
    sample_count: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Learned:
        return cls(**json.loads(text))


SCHEMA = "threshold double, mean double, std_dev double, median double, min double, max double, sample_count long"


def as_json(learned: DataFrame, column: str = "parameters") -> DataFrame:
    """Learned parameters, a row each, as JSON texts."""
    return learned.select(F.to_json(F.struct(*(c.split()[0] for c in SCHEMA.split(", ")))).alias(column))


def parsed(json_column: Column) -> Column:
    """The parameters in a JSON text; null for what is none."""
    return F.from_json(json_column, SCHEMA)


class TooFewSamples(ValueError):
    """Fewer samples than training needs."""


def learn(history: DataFrame, percentile: float = 0.5, most: int = 10_000) -> DataFrame:
    """One row of Learned's columns, from the last ``most`` of (seq, similarity); null columns of fewer than 10 samples.

    The history is bounded by ``most``, so its places are taken by one window.
    """
    recent = history.where("similarity IS NOT NULL").orderBy(F.desc("seq"), F.desc("similarity")).limit(most).select(F.col("similarity").cast("double").alias("s"))
    ordered = Window.orderBy("s")
    df = recent.withColumn("i", F.row_number().over(ordered) - 1)
    df = df.withColumn("bend", F.abs(F.lead("s").over(ordered) - 2 * F.col("s") + F.lag("s").over(ordered)))
    whole = df.agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std_dev"), F.min("s").alias("min"), F.max("s").alias("max"))
    df = df.crossJoin(F.broadcast(whole))  # one row
    n, mean, s = F.col("n"), F.col("mean"), F.col("s")
    p = min(max(percentile, 0.0), 1.0)
    at = lambda place: F.max(F.when(F.col("i") == place, s))
    low, high = F.when(s < mean, s), F.when(s >= mean, s)
    out = df.groupBy("n", "mean", "std_dev", "min", "max").agg(
        at(F.floor(n / 2)).alias("median"),
        at(F.least(F.floor(n * p), n - 1)).alias("by_percentile"),
        F.count(low).alias("n_low"),
        F.avg(low).alias("low_mean"),
        F.avg(high).alias("high_mean"),
        F.stddev_pop(low).alias("low_std"),
        F.stddev_pop(high).alias("high_std"),
        F.max_by("s", F.when(F.col("bend").isNotNull(), F.struct(F.col("bend"), -F.col("i")))).alias("elbow"),
    )
    weight = F.col("n_low") / n
    mixture = F.col("low_mean") * (1 - weight) + F.col("high_mean") * weight + 0.1 * (F.col("high_std") - F.col("low_std"))
    mixture = F.when((n >= 50) & (F.col("n_low") > 0) & (F.col("n_low") < n), F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixture)))
    elbow = F.when(n >= 30, F.coalesce("elbow", "median"))
    base = F.col("by_percentile")
    threshold = (
        F.when(mixture.isNotNull() & elbow.isNotNull(), 0.4 * mixture + 0.4 * elbow + 0.2 * base)
        .when(mixture.isNotNull(), 0.6 * mixture + 0.4 * base)
        .when(elbow.isNotNull(), 0.6 * elbow + 0.4 * base)
        .otherwise(base)
    )
    enough = lambda c: F.when(n >= 10, c)
    return out.select(enough(threshold).alias("threshold"), *(enough(F.col(c)).alias(c) for c in ("mean", "std_dev", "median", "min", "max")), n.alias("sample_count"))


def train(history: DataFrame, percentile: float = 0.5, most: int = 10_000) -> Learned:
    rows = learn(history, percentile, most).collect()
    if not rows or rows[0].threshold is None:
        raise TooFewSamples(f"{rows[0].sample_count if rows else 0} samples; 10 are needed")
    return Learned(**rows[0].asDict())


def judge(similarity: Column, learned: Learned = Learned(), z_limit: float = 2.5, drift: float = 2.0) -> Column:
    """A struct of similarity, distance, level, z, confidence, outlier, drifted, drift magnitude."""
    t, mean, sd = learned.threshold, learned.mean, learned.std_dev
    z = (similarity - mean) / sd if sd > 0 else F.lit(0.0)
    limit = mean - drift * sd
    level = F.when(similarity >= t + 0.15, "very_high").when(similarity >= t, "high").when(similarity >= t - 0.15, "moderate").when(similarity >= t - 0.30, "low").otherwise("very_low")
    drifted = similarity < limit
    return F.struct(
        similarity.alias("similarity"),
        (1 - similarity).alias("distance"),
        level.alias("level"),
        z.alias("z"),
        (1 / (1 + F.abs(z))).alias("confidence"),
        (F.abs(z) > z_limit).alias("outlier"),
        drifted.alias("drifted"),
        F.when(drifted, F.abs((limit - similarity) / sd) if sd > 0 else F.lit(0.0)).otherwise(0.0).alias("drift_magnitude"),
    )
