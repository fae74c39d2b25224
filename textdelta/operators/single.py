"""Analyzers of one diff: columns of a diff to analysis results.

A result is a struct of analyzer, metrics (map), insights, confidence and
metadata (map); every analyzer is a function of a diffs table's columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.charclass import SPACE

Analyzer = Callable[[], Column]
RESULT = "struct<analyzer:string,metrics:map<string,double>,insights:array<string>,confidence:double,metadata:map<string,string>>"


def result(name: str, metrics: dict[str, Column], insights: list[tuple[Column, str]] = (), confidence: Column | float = 1.0, metadata: dict[str, Column] | None = None) -> Column:
    pairs = [x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))]
    notes = F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in insights)), lambda x: x.isNotNull()) if insights else F.array()
    said = [x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(name).alias("analyzer"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")).alias("metrics"),
        notes.cast("array<string>").alias("insights"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"),
        (F.create_map(*said) if said else F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def _three(name: str, o: Column, m: Column) -> dict[str, Column]:
    return {f"original_{name}": o, f"modified_{name}": m, f"{name}_change": m - o}


def _of_category(category: str) -> Column:
    return F.size(F.filter("ops", lambda o: o["category"] == category))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def ladder(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    out = F.lit(last)
    for least, name in reversed(steps):
        out = F.when(value >= least, name).otherwise(out)
    return out


def semantic_similarity(threshold: float = 0.7) -> Column:
    s = F.col("semantic_similarity")
    level = ladder(s, [(0.9, "very_high"), (threshold, "high"), (0.5, "moderate"), (0.3, "low")], "very_low")
    return result("semantic_similarity", {"semantic_similarity": s, "semantic_distance": 1 - s, "semantic_changes": _of_category("Semantic")}, [(s < threshold, "Meaning changed notably"), (s >= 0.9, "Meaning is preserved")], metadata={"similarity_level": level})


def word_overlap() -> Column:
    return result("word_overlap", {"word_overlap": F.col("word_overlap")})


def char_similarity() -> Column:
    return result("char_similarity", {"char_similarity": F.col("char_similarity")})


def word_count_diff() -> Column:
    return result("word_count_diff", {"word_count_diff": F.col("word_count_diff"), "original_word_count": F.col("o_word_count"), "modified_word_count": F.col("m_word_count")})


def negation_changed() -> Column:
    c = F.col("negation_changed")
    return result("negation_changed", {"negation_changed": c, "original_has_negation": F.col("o_has_negation"), "modified_has_negation": F.col("m_has_negation")}, [(c, "Negation was added or removed")])


def smog(prefix: str) -> Column:
    many = F.size(F.filter(F.col(f"{prefix}words"), lambda w: M.syllables(w) >= 3))
    return 1.0430 * F.sqrt(many / F.col(f"{prefix}sentence_count") * 30) + 3.1291


def ari(prefix: str, text: str) -> Column:
    n, s = F.col(f"{prefix}word_count"), F.col(f"{prefix}sentence_count")
    chars = M.count_of(F.col(text), f"[^{SPACE}]")
    return F.when(n > 0, 4.71 * chars / n + 0.5 * n / s - 21.43).otherwise(0.0)


def readability() -> Column:
    o, m = (lambda n: F.col(f"o_{n}")), (lambda n: F.col(f"m_{n}"))
    fre, fk = m("flesch_reading_ease") - o("flesch_reading_ease"), m("flesch_kincaid_grade") - o("flesch_kincaid_grade")
    found = {
        **_three("flesch_reading_ease", o("flesch_reading_ease"), m("flesch_reading_ease")),
        **_three("flesch_kincaid_grade", o("flesch_kincaid_grade"), m("flesch_kincaid_grade")),
        **_three("smog", smog("o_"), smog("m_")),
        **_three("ari", ari("o_", "original"), ari("m_", "modified")),
    }
    level = ladder(m("flesch_reading_ease"), [(80, "very_easy"), (60, "easy"), (50, "moderate"), (30, "difficult")], "very_difficult")
    return result("readability", found, [(fre > 5, "Easier to read"), (fre < -5, "Harder to read"), (fk > 1, "Grade level rose"), (fk < -1, "Grade level fell")], metadata={"readability_level": level})


def readability_diff() -> Column:
    return result("readability_diff", {"readability_diff": F.col("readability_diff"), "original_flesch": F.col("o_flesch_reading_ease"), "modified_flesch": F.col("m_flesch_reading_ease")})


def stylistic() -> Column:
    def of(p: str, text: str) -> tuple[Column, ...]:
        words, n = F.col(f"{p}words"), F.col(f"{p}word_count")
        sentence = n / (M.count_of(F.col(text), "[.!?]") + 1)
        density = _ratio(F.col(f"{p}punctuation_count"), F.col(f"{p}char_count"))
        diversity = _ratio(F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w)))), n)
        return F.col(f"{p}avg_word_length"), sentence, density, diversity

    names = ("avg_word_length", "avg_sentence_length", "punctuation_density", "lexical_diversity")
    pairs = dict(zip(names, zip(of("o_", "original"), of("m_", "modified"), strict=True), strict=True))
    found = {k: v for name, (o, m) in pairs.items() for k, v in _three(name, o, m).items()}
    change = lambda n: F.abs(pairs[n][1] - pairs[n][0])
    notes = [(change("avg_word_length") > 0.5, "Word length changed"), (change("avg_sentence_length") > 2, "Sentence length changed"), (change("lexical_diversity") > 0.1, "Variety of words changed")]
    return result("stylistic", {**found, "stylistic_changes": _of_category("Stylistic")}, notes)


def whitespace_ratio_diff() -> Column:
    return result("whitespace_ratio_diff", {"whitespace_ratio_diff": F.col("whitespace_ratio_diff"), "original_whitespace_ratio": F.col("o_whitespace_ratio"), "modified_whitespace_ratio": F.col("m_whitespace_ratio")})


def category_distribution() -> Column:
    """Counts and shares of categories among changes; ties of the dominant one go to the first by name."""
    names = ("Formatting", "Organizational", "Semantic", "Stylistic", "Syntactic", "Unknown")
    changed = F.filter("ops", lambda o: o["edit_type"] != "Equal")
    count_of = lambda name: F.size(F.filter(changed, lambda o: o["category"] == name))
    count = {n: count_of(n) for n in names}
    total = F.size(changed)
    share = {n: _ratio(c, total) for n, c in count.items()}
    dominant = F.when(total > 0, F.array_max(F.array(*(F.struct(c.alias("c"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(count.items()))))["n"])
    found = {f"{n.lower()}_{k}": v for n in names for k, v in (("count", count[n]), ("percentage", share[n]))}
    notes = [(share["Semantic"] > 0.5, "Mostly changes of meaning"), (share["Stylistic"] > 0.3, "Many changes of style"), (share["Formatting"] > 0.5, "Mostly changes of form")]
    return result("category_distribution", {**found, "total_changes": total}, notes, metadata={"dominant_category": F.coalesce(dominant, F.lit("none"))})


def intents() -> Column:
    """All intents that fit, in order."""
    ins, dels, mods, sim = F.col("insertions"), F.col("deletions"), F.col("modifications"), F.col("semantic_similarity")
    n = F.size("ops")
    rules = [
        ((mods > ins) & (sim > 0.8), "clarification"),
        (ins > dels * 2, "expansion"),
        (dels > ins * 2, "condensation"),
        (_of_category("Syntactic") > F.floor(n / 4), "correction"),
        (_of_category("Formatting") > F.floor(n / 2), "reformatting"),
        ((_of_category("Stylistic") > 0) & (sim > 0.7), "stylistic_refinement"),
        (sim < 0.5, "rewrite"),
    ]
    return F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in rules)), lambda x: x.isNotNull())


def edit_intent() -> Column:
    found = intents()
    return result("edit_intent", {"intent_count": F.size(found)}, metadata={"primary_intent": F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("unknown")), "intents": F.array_join(found, ",")})


ANALYZERS: dict[str, Analyzer] = {
    "semantic_similarity": semantic_similarity,
    "word_overlap": word_overlap,
    "char_similarity": char_similarity,
    "word_count_diff": word_count_diff,
    "negation_changed": negation_changed,
    "readability": readability,
    "readability_diff": readability_diff,
    "stylistic": stylistic,
    "whitespace_ratio_diff": whitespace_ratio_diff,
    "category_distribution": category_distribution,
    "edit_intent": edit_intent,
}


@dataclass(frozen=True)
class Report:
    """Results of several analyzers over a diffs table: a row an analyzer and pair."""

    diffs: DataFrame
    analyzers: tuple[str, ...] = field(default=tuple(ANALYZERS))

    def results(self) -> DataFrame:
        found = F.array(*(ANALYZERS[a]() for a in self.analyzers))
        return self.diffs.select("pair_id", F.explode(found).alias("r")).select("pair_id", "r.*")

    def by_analyzer(self, name: str) -> DataFrame:
        return self.results().where(F.col("analyzer") == name)

    def insights(self) -> DataFrame:
        return self.results().select("pair_id", "analyzer", F.explode("insights").alias("insight"))

    def summary(self) -> DataFrame:
        return summary(self.results())


def summary(results: DataFrame) -> DataFrame:
    """metric, average (over the results that have it), n."""
    rows = results.select(F.explode("metrics").alias("metric", "value"))
    return rows.groupBy("metric").agg(F.avg("value").alias("average"), F.count("*").alias("n"))
