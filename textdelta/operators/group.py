"""Analyzers of many diffs: aggregates over groups of a diffs table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import kept
from .classify import CATEGORIES


def statistics(diffs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and averages of diffs; an empty input without groups gives a row of 0 diffs."""
    s = F.col("semantic_similarity")
    return diffs.groupBy(*by).agg(
        F.count("*").alias("diff_count"),
        F.avg("insertions").alias("avg_insertions"),
        F.avg("deletions").alias("avg_deletions"),
        F.avg("modifications").alias("avg_modifications"),
        F.sum("edit_distance").alias("total_changes"),
        F.avg(s).alias("avg_similarity"),
        F.max(s).alias("max_similarity"),
        F.min(s).alias("min_similarity"),
        (F.avg("change_percentage") * 100).alias("avg_change_percent"),
    )


def patterns(diffs: DataFrame, min_frequency: float = 0.3) -> DataFrame:
    """pattern, name, frequency: what at least ``min_frequency`` of the diffs show.

    The dominant edit type and category count operations a diff (so may exceed 1); ties go to the first by name.
    """
    s = F.col("semantic_similarity")
    share = lambda c: F.avg(c.cast("double"))
    shares = {"expansion": F.col("insertions") > F.col("deletions"), "reduction": F.col("deletions") > F.col("insertions"), "major_rewrite": s < 0.5, "minor_edit": s > 0.8}
    kinds = {"edit_type": ("Delete", "Insert", "Modify"), "category": CATEGORIES}
    count = lambda field, name: F.sum(F.size(F.filter("ops", lambda o: (o["edit_type"] != "Equal") & (o[field] == name))))
    whole = diffs.agg(
        F.count("*").alias("n"),
        *(share(c).alias(name) for name, c in shares.items()),
        *(count(field, name).alias(f"{field}_{name}") for field, names in kinds.items() for name in names),
    )

    def most(field: str) -> Column:
        """The commonest name, ties to the first by name."""
        counts = F.array(*(F.struct(F.col(f"{field}_{name}").alias("c"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, name in enumerate(sorted(kinds[field]))))
        best = F.array_max(counts)
        return F.struct(F.lit(field).alias("pattern"), best["name"].alias("name"), F.when(best["c"] > 0, best["c"] / F.col("n")).alias("frequency"))

    found = F.array(*(F.struct(F.lit("share").alias("pattern"), F.lit(k).alias("name"), F.col(k).alias("frequency")) for k in shares), *map(most, kinds))
    return whole.select(F.explode(found).alias("x")).select("x.*").where(F.col("frequency") >= min_frequency)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``i``, the place of each row in the whole order, from 0.

    Ranges of the order are numbered apart and shifted by what is before them, so no task has all rows.
    """
    ranges = kept(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a partition
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*order)
    placed = ranges.withColumn("i", F.row_number().over(within) - 1).join(F.broadcast(starts), "_range")
    return placed.withColumn("i", F.col("i") + F.col("_start")).drop("_range", "_start")


def trends(diffs: DataFrame, by: str | None = "grp", order: str = "seq", metrics: tuple[str, ...] = ("semantic_similarity", "change_percentage")) -> DataFrame:
    """grp, n, and for each metric the slope over the order, its trend and the last centred moving average.

    Groups of fewer than three diffs are insufficient_data. by: None takes all diffs as one group.
    """
    if by is None:
        df = numbered(diffs.select(F.lit("all").alias("grp"), order, "pair_id", *metrics), [order, "pair_id"])
        by = "grp"
    else:
        place = Window.partitionBy(by).orderBy(order, "pair_id")
        df = diffs.select(by, order, "pair_id", *metrics).withColumn("i", F.row_number().over(place) - 1)
    size = df.groupBy(by).agg(F.count("*").alias("n"), *(F.regr_slope(F.col(m), F.col("i").cast("double")).alias(f"{m}_slope") for m in metrics))
    df = df.join(size.select(by, "n"), by)
    width = F.greatest(F.floor(F.col("n") / 3), F.lit(3))
    last = F.col("n") - 1
    # the window around the last place, clipped: the places from last - width / 2 on
    tail = df.where(F.col("i") >= last - F.floor(width / 2)).groupBy(by).agg(*(F.avg(m).alias(f"{m}_moving") for m in metrics))
    out = size.join(tail, by)
    for m in metrics:
        trend = F.when(F.col("n") < 3, "insufficient_data").when(F.col(f"{m}_slope") > 0.05, "increasing").when(F.col(f"{m}_slope") < -0.05, "decreasing").otherwise("stable")
        out = out.withColumn(f"{m}_trend", trend)
    return out


FEATURES = ("semantic_similarity", "change_percentage", "insertions", "deletions", "modifications", "stylistic_change", "readability_change")


def behaviour(diffs: DataFrame) -> DataFrame:
    """pair_id and the seven features that diffs are clustered by."""
    size = F.greatest(F.col("o_char_count"), F.lit(1))
    per = lambda c: F.col(c) / size
    return diffs.select("pair_id", "seq", F.array("semantic_similarity", "change_percentage", per("insertions"), per("deletions"), per("modifications"), "stylistic_change", "readability_change").alias("features"))


def _nearest(features: Column, centres: list[list[float]]) -> Column:
    """The place of the nearest centre; ties: the first."""
    away = lambda c: F.aggregate(F.zip_with(features, F.array(*map(F.lit, c)), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return F.array_min(F.array(*(F.struct(away(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))["i"]


def clusters(diffs: DataFrame, k: int = 3, rounds: int = 100) -> DataFrame:
    """cluster, size, percent, avg_similarity, avg_change, label of k-means seeded with the first k rows by (seq, pair_id).

    A round is one aggregate; only the k centres come to the driver. Fewer diffs than k: no rows. An empty cluster keeps its centre.
    """
    df = kept(behaviour(diffs))
    first = [list(r.features) for r in df.orderBy("seq", "pair_id").limit(k).collect()]
    if len(first) < k:
        return df.sparkSession.createDataFrame([], "cluster int, size long, percent double, avg_similarity double, avg_change double, label string")
    centres, before = first, None
    for _ in range(rounds):
        found = df.groupBy(_nearest(F.col("features"), centres).alias("i")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("pair_id").cast("decimal(38,0)")).alias("who"), *(F.avg(F.col("features")[j]).alias(f"f{j}") for j in range(len(FEATURES)))).collect()
        now = sorted((r.i, r.n, r.who) for r in found)
        if now == before:  # the same assignments
            break
        before = now
        centres = list(centres)
        for r in found:
            centres[r.i] = [r[f"f{j}"] for j in range(len(FEATURES))]
    i = _nearest(F.col("features"), centres)
    sim, change = F.col("features")[0], F.col("features")[1]
    by = df.groupBy(i.alias("cluster")).agg(F.count("*").alias("size"), F.avg(sim).alias("avg_similarity"), F.avg(change).alias("avg_change"))
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    by = every.join(by, "cluster", "left").fillna(0, ["size"])
    s, c = F.col("avg_similarity"), F.col("avg_change")
    label = F.when(F.col("size") == 0, "Empty cluster").when((s > 0.8) & (c < 0.2), "Minor edits").when(s > 0.6, "Moderate revisions").when(s < 0.5, "Substantial rewrites").otherwise("Mixed changes")
    total = df.count()
    return by.select("cluster", "size", (F.col("size") * 100.0 / total).alias("percent"), "avg_similarity", "avg_change", label.alias("label"))
