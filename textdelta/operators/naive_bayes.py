"""Sixteen features of an edit operation, and Gaussian naive Bayes over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import pair_metrics

FEATURES = (
    "char_similarity", "word_overlap", "length_ratio", "orig_length", "mod_length", "length_diff", "is_insert", "is_delete",
    "is_modify", "case_only_change", "punct_diff", "readability_score_diff", "word_count_diff", "stopword_ratio", "whitespace_ratio_change", "negation_changed",
)
#: The least standard deviation and log-density.
FLOOR, LEAST = 1e-6, -100.0


def features(ops: DataFrame) -> DataFrame:
    """``ops`` (edit_type, original_text, modified_text and any columns) with ``features``, an array in the order of FEATURES."""
    kept = ops.columns
    df = ops.withColumns({"_o": F.coalesce("original_text", F.lit("")), "_m": F.coalesce("modified_text", F.lit(""))})
    df = pair_metrics(df, "_o", "_m")
    flag = lambda c: c.cast("double")
    o, m = F.col("o_char_count").cast("double"), F.col("m_char_count").cast("double")
    kind = lambda k: flag(F.col("edit_type") == k)
    case_only = flag((F.lower("_o") == F.lower("_m")) & (F.col("_o") != F.col("_m")))
    values = (
        F.col("char_similarity"), F.col("word_overlap"), F.col("length_ratio"), o, m, F.abs(m - o), kind("Insert"), kind("Delete"),
        kind("Modify"), case_only, flag(F.abs(F.col("m_punctuation_count") - F.col("o_punctuation_count"))), F.col("readability_diff"),
        flag(F.col("word_count_diff")), (F.col("o_stopword_ratio") + F.col("m_stopword_ratio")) / 2.0, F.col("whitespace_ratio_diff"), flag(F.col("negation_changed")),
    )
    return df.select(*kept, F.array(*values).alias("features"))


def train(samples: DataFrame, label: str = "label") -> DataFrame:
    """label, n, prior, means, stds: one row a class (samples with null labels are ignored)."""
    own = samples.where(F.col(label).isNotNull())
    each = lambda f: F.array(*(f(F.col("features")[i]) for i in range(len(FEATURES))))
    by = own.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"),
        each(F.avg).alias("means"),
        each(lambda c: F.greatest(F.stddev_pop(c), F.lit(FLOOR))).alias("stds"),
    )
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("prior"), "means", "stds")  # one row


def log_posterior(features: Column, prior: Column, means: Column, stds: Column) -> Column:
    def density(i: int) -> Column:
        x, mu, sd = features[i], means[i], stds[i]
        return F.greatest(-0.5 * F.ln(2 * F.pi() * sd * sd) - (x - mu) * (x - mu) / (2 * sd * sd), F.lit(LEAST))

    return F.ln(prior) + reduce(lambda a, b: a + b, [density(i) for i in range(len(FEATURES))])


def predict(samples: DataFrame, model: DataFrame) -> DataFrame:
    """``samples`` with predicted and confidence; Unknown at 0 without a model.

    The model has a row a class; it is collected to be part of the expression.
    """
    rows = model.orderBy("label").collect()
    if not rows:
        return samples.withColumns({"predicted": F.lit("Unknown"), "confidence": F.lit(0.0)})
    numbers = lambda xs: F.array(*map(F.lit, xs))
    scores = F.array(*(F.struct(log_posterior(F.col("features"), F.lit(r.prior), numbers(r.means), numbers(r.stds)).alias("s"), F.lit(r.label).alias("label")) for r in rows))
    df = samples.withColumn("_scores", scores)
    best = F.array_max(F.transform("_scores", lambda x: x["s"]))
    label = F.array_min(F.transform(F.filter("_scores", lambda x: x["s"] == F.col("_best")), lambda x: x["label"]))
    df = df.withColumn("_best", best).withColumn("predicted", label)
    return df.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(F.col("_best") / 10)))).drop("_scores", "_best")
