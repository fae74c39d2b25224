"""Classifiers of edit operations, as column expressions on operation structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.charclass import PUNCT, SPACE

CATEGORIES = ("Semantic", "Stylistic", "Formatting", "Syntactic", "Organizational", "Unknown")
RESULT = "struct<category:string,confidence:double,alternatives:array<struct<category:string,score:double>>,explanation:string>"


def _texts(op: Column) -> tuple[Column, Column]:
    return F.coalesce(op["original_text"], F.lit("")), F.coalesce(op["modified_text"], F.lit(""))


def change_category(o: Column, m: Column) -> Column:
    """The category of a changed text."""
    most = F.greatest(F.char_length(o), F.char_length(m))
    similarity = F.when(most > 0, 1.0 - F.levenshtein(F.lower(o), F.lower(m)).cast("double") / most).otherwise(1.0)
    return F.when((F.lower(o) == F.lower(m)) & (o != m), "Formatting").when(similarity > 0.8, "Syntactic").when(similarity > 0.5, "Stylistic").otherwise("Semantic")


def engine_category(op: Column) -> Column:
    """The engine's own category of an operation."""
    o, m = _texts(op)
    case_only = (F.lower(o) == F.lower(m)) & (o != m)
    return F.when(op["edit_type"] == "Equal", "Unknown").when(op["edit_type"] == "Modify", change_category(o, m)).otherwise(F.when(case_only, "Formatting").otherwise("Semantic"))


def result(category: str | Column, confidence: float | Column, explanation: str = "", alternatives: Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.array().cast("array<struct<category:string,score:double>>")
    return F.struct(as_column(category).alias("category"), as_column(confidence).cast("double").alias("confidence"), (none if alternatives is None else alternatives).alias("alternatives"), F.lit(explanation).alias("explanation"))


def rule_based(op: Column) -> Column:
    """The first rule that fits: a classification result."""
    o, m = _texts(op)
    stripped = lambda c, p: F.regexp_replace(c, p, "")
    chars, words = metrics.char_similarity(o, m), metrics.word_overlap(metrics.word_list(o), metrics.word_list(m))
    entry = lambda name, score: F.struct(F.lit(name).alias("category"), F.lit(score).alias("score"))
    close = F.when(chars > 0.7, entry("Syntactic", 0.3))
    near = F.when((words > 0.6) & (words < 0.9), entry("Stylistic", 0.25))
    others = F.filter(F.array(close, near), lambda x: x.isNotNull())
    differ = o != m
    # nothing against text that has more than spaces and punctuation: no rule between can fit
    apart = ((o == "") != (m == "")) & F.rlike(F.concat(o, m), F.lit(rf"[^\p{{Punct}}\p{{IsWhite_Space}}]"))
    return (
        F.when(op["category"] != "Unknown", result(op["category"], op["confidence"], "already categorized"))
        .when(op["edit_type"] == "Equal", result("Unknown", 1.0, "no change"))
        .when(apart, result("Semantic", 0.85, "different words"))
        .when(differ & (F.lower(o) == F.lower(m)), result("Formatting", 0.95, "only case differs"))
        .when(differ & (stripped(o, SPACE) == stripped(m, SPACE)), result("Formatting", 0.95, "only white space differs"))
        .when(differ & (F.lower(stripped(o, PUNCT)) == F.lower(stripped(m, PUNCT))), result("Syntactic", 0.85, "only punctuation differs", others))
        .when(chars >= 0.9, result("Syntactic", 0.8, "nearly the same characters", others))
        .when(words >= 0.8, result("Stylistic", 0.75, "mostly the same words", others))
        .when(words >= 0.5, result("Stylistic", 0.6, "many of the same words", others))
        .when(words >= 0.3, result("Semantic", 0.7, "few of the same words", others))
        .otherwise(result("Semantic", 0.85, "different words", others))
    )


def classify_diff(ops: DataFrame) -> DataFrame:
    """pair_id, category, confidence: the category of the most confidence over all operations (ties: the first by name)."""
    by = ops.groupBy("pair_id", "category").agg(F.sum("confidence").alias("s"))
    whole = by.groupBy("pair_id").agg(F.sum("s").alias("total"), F.max_by("category", F.struct(F.col("s"), F.lit(0))).alias("any"), F.max("s").alias("most"), F.collect_list(F.struct("category", "s")).alias("all"))
    best = F.array_min(F.transform(F.filter("all", lambda x: x["s"] == F.col("most")), lambda x: x["category"]))
    return whole.select("pair_id", best.alias("category"), F.when(F.col("total") > 0, F.col("most") / F.col("total")).otherwise(0.0).alias("confidence"))


def _distinct(results: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(results, lambda r: r["category"])))


def _pick(results: Column, score) -> Column:
    """The category of the highest score; ties: the first by name; no results: Unknown at 0."""
    start = F.struct(F.lit("Unknown").alias("category"), F.lit(-1.0).alias("s"))

    def better(acc: Column, c: Column) -> Column:
        s = score(F.filter(results, lambda r: r["category"] == c))
        return F.when(s > acc["s"], F.struct(c.alias("category"), s.alias("s"))).otherwise(acc)

    best = F.aggregate(_distinct(results), start, better)
    return F.struct(best["category"].alias("category"), F.greatest(best["s"], F.lit(0.0)).alias("confidence"))


def vote(results: Column) -> Column:
    """The category of most results, and their share."""
    return _pick(results, lambda own: F.size(own).cast("double") / F.size(results))


def average(results: Column) -> Column:
    """The category of the highest mean confidence, and that mean."""
    return _pick(results, lambda own: F.aggregate(own, F.lit(0.0), lambda s, r: s + r["confidence"]) / F.size(own))


def ensemble(results: Column, strategy: str = "vote") -> Column:
    if strategy in ("vote", "average"):
        return {"vote": vote, "average": average}[strategy](results)
    return F.struct(F.lit("Unknown").alias("category"), F.lit(0.0).alias("confidence"))


#: Classifiers of an operation by name, which a configuration may add; users may add their own.
CLASSIFIERS: dict[str, Callable[[Column], Column]] = {"rule_based": rule_based, "change_category": lambda op: result(change_category(*_texts(op)), 0.8)}
