"""Metrics of a text and of a pair of texts, as column expressions.

Lengths are UTF-8 bytes, counts of character classes are characters. The edit
distance is over code points. Null in, null out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .charclass import PUNCT, SPACE

#: Cells of a table of edit distances that are filled one by one at most.
LONG = 100_000_000
#: Fixed values.
STOPWORDS = "a an and are as at be been but by for from has have he in is it its of on or that the to was were will with".split()
NEGATIONS = "not no never neither none nobody nothing nowhere".split()
TEXT_METRICS = ("char_count", "word_count", "sentence_count", "syllable_count", "whitespace_count", "punctuation_count", "avg_word_length", "avg_sentence_length", "flesch_reading_ease", "flesch_kincaid_grade", "stopword_ratio", "whitespace_ratio", "has_negation")
PAIR_METRICS = ("levenshtein_distance", "char_similarity", "word_overlap", "length_ratio", "readability_diff", "word_count_diff", "whitespace_ratio_diff", "negation_changed")


def word_list(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def syllables(word: Column) -> Column:
    """Groups of vowels, less a final e, one at least."""
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.greatest(groups - F.when(w.endswith("e") & (groups > 1), 1).otherwise(0), F.lit(1)).cast("long")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda n, x: n + of(x).cast("long"))


def with_words(df: DataFrame, column: str, into: str) -> DataFrame:
    return df.withColumn(into, word_list(F.col(column)))


def has_negation(c: Column, words: Column) -> Column:
    low = F.transform(words, lambda w: F.lower(w))
    return F.arrays_overlap(low, F.array(*map(F.lit, NEGATIONS))) | F.contains(F.lower(c), F.lit("n't"))


def text_metrics(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """``df`` with the metrics of TEXT_METRICS as columns, each named with ``prefix``, and the words as ``{prefix}words``."""
    p = lambda name: f"{prefix}{name}"
    t = F.col(column)
    df = df.withColumn(p("words"), word_list(t))
    w = F.col(p("words"))
    df = df.withColumns(
        {
            p("char_count"): F.octet_length(t).cast("long"),
            p("word_count"): F.size(w).cast("long"),
            p("sentence_count"): F.greatest(count_of(t, "[.!?]"), F.lit(1)),
            p("syllable_count"): _total(w, syllables),
            p("whitespace_count"): count_of(t, SPACE),
            p("punctuation_count"): count_of(t, PUNCT),
            p("word_bytes"): _total(w, F.octet_length),
            p("stopwords"): F.size(F.filter(w, lambda x: F.lower(x).isin(STOPWORDS))).cast("long"),
            p("has_negation"): has_negation(t, w),
        }
    )
    n, s = F.col(p("word_count")), F.col(p("sentence_count"))
    df = df.withColumns({p("avg_word_length"): _ratio(F.col(p("word_bytes")), n), p("avg_sentence_length"): _ratio(n, s), p("_asw"): _ratio(F.col(p("syllable_count")), n)})
    asl, asw = F.col(p("avg_sentence_length")), F.col(p("_asw"))
    df = df.withColumns(
        {
            p("flesch_reading_ease"): F.when(n > 0, 206.835 - 1.015 * asl - 84.6 * asw).otherwise(0.0),
            p("flesch_kincaid_grade"): F.when(n > 0, 0.39 * asl + 11.8 * asw - 15.59).otherwise(0.0),
            p("stopword_ratio"): _ratio(F.col(p("stopwords")), n),
            p("whitespace_ratio"): _ratio(F.col(p("whitespace_count")), F.col(p("char_count"))),
        }
    )
    return df.drop(p("word_bytes"), p("stopwords"), p("_asw"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; both empty: 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)).cast("double") / union).otherwise(1.0)


def word_overlap(a: Column, b: Column) -> Column:
    low = lambda x: F.transform(x, lambda w: F.lower(w))
    return jaccard(low(a), low(b))


def char_similarity(a: Column, b: Column, distance: Column | None = None) -> Column:
    most = F.greatest(F.char_length(a), F.char_length(b))
    distance = F.levenshtein(a, b) if distance is None else distance
    return F.when(most > 0, 1.0 - distance.cast("double") / most).otherwise(1.0)


def length_ratio(a: Column, b: Column) -> Column:
    x, y = F.octet_length(a), F.octet_length(b)
    return F.when(F.greatest(x, y) > 0, F.least(x, y).cast("double") / F.greatest(x, y)).otherwise(1.0)


def pair_metrics(df: DataFrame, a: str = "original", b: str = "modified", only: set[str] | None = None, max_chars: int | None = None, long_distance: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``df`` with both texts' metrics (o_, m_) and the metrics of PAIR_METRICS.

    only: names to compute; Catalyst prunes the others' inputs. max_chars: pairs
    with a longer text have a null edit distance. long_distance: takes the edit distance of
    pairs whose lengths' product is over LONG.
    """
    want = set(PAIR_METRICS) if only is None else only
    df = text_metrics(text_metrics(df, a, "o_"), b, "m_")
    x, y = F.col(a), F.col(b)
    o, m = (lambda n: F.col(f"o_{n}")), (lambda n: F.col(f"m_{n}"))
    if want & {"levenshtein_distance", "char_similarity"}:
        distance = F.levenshtein(x, y).cast("long")
        if long_distance is not None:
            long = F.char_length(x).cast("long") * F.char_length(y) > LONG
            distance = F.when(~long, distance).otherwise(long_distance(F.when(long, x), F.when(long, y)))
        if max_chars:
            distance = F.when(F.greatest(F.char_length(x), F.char_length(y)) <= max_chars, distance)
        df = df.withColumn("levenshtein_distance", distance)
    made = {
        "char_similarity": lambda: char_similarity(x, y, F.col("levenshtein_distance")),
        "word_overlap": lambda: word_overlap(o("words"), m("words")),
        "length_ratio": lambda: length_ratio(x, y),
        "readability_diff": lambda: F.abs(m("flesch_reading_ease") - o("flesch_reading_ease")),
        "word_count_diff": lambda: F.abs(m("word_count") - o("word_count")),
        "whitespace_ratio_diff": lambda: F.abs(m("whitespace_ratio") - o("whitespace_ratio")),
        "negation_changed": lambda: o("has_negation") != m("has_negation"),
    }
    return df.withColumns({name: make() for name, make in made.items() if name in want})


def stylistic_change(df_o: str = "o_", df_m: str = "m_") -> Column:
    """Mean of the relative changes of length and of punctuation."""

    def change(name: str) -> Column:
        a, b = F.col(f"{df_o}{name}"), F.col(f"{df_m}{name}")
        return F.abs(b - a).cast("double") / F.greatest(a, b, F.lit(1))

    return (change("char_count") + change("punctuation_count")) / 2.0


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def change_magnitude(count: Column, kind: str) -> Column:
    """How many changes of a kind, in words."""
    n = count.cast("string")
    return (
        F.when(count == 0, f"No {kind} changes detected")
        .when(count <= 2, F.concat(F.lit(f"Minimal {kind} changes: "), n, F.lit(" changed")))
        .when(count <= 5, F.concat(F.lit(f"Moderate {kind} changes: "), n, F.lit(" changed")))
        .otherwise(F.concat(F.lit(f"Significant {kind} changes: "), n, F.lit(" changed")))
    )


MODALS = "can could may might must shall should will would".split()
BE = "am is are was were be been being".split()
EXTRA_METRICS = ("paragraph_count", "line_count", "letter_count", "digit_count", "unique_words", "vocabulary_richness", "gunning_fog", "smog", "lexical_density", "modal_count", "passive_count")


def extra_metrics(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """``df`` with the metrics of EXTRA_METRICS; words of three syllables or more are hard ones.

    Lexical density is the share of words that are no stopwords; a passive is a form of
    "be" right before a word that ends in "ed" or "en".
    """
    p = lambda name: F.col(f"_x_{name}")
    t = F.col(column)
    df = df.withColumn("_x_words", F.transform(word_list(t), lambda w: F.lower(w)))
    bare = F.transform("_x_words", lambda w: F.regexp_replace(w, f"^{PUNCT}+|{PUNCT}+$", ""))
    df = df.withColumns({"_x_bare": bare, "_x_n": F.size("_x_words").cast("long"), "_x_sentences": F.greatest(count_of(t, "[.!?]"), F.lit(1)), "_x_hard": F.size(F.filter("_x_words", lambda w: syllables(w) >= 3)).cast("long")})
    lines_ = F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, "\n$", ""), "\n")))
    blank = r"\n(?:[^\S\n]*\n)+"
    following = lambda i: F.coalesce(F.get("_x_bare", i + 1), F.lit(""))
    passive = F.size(F.filter(F.transform("_x_bare", lambda w, i: w.isin(BE) & F.rlike(following(i), F.lit("(ed|en)$"))), lambda x: x))
    made = {
        "paragraph_count": F.size(F.filter(F.split(t, blank), lambda x: ~F.rlike(x, F.lit(f"^{SPACE}*$")))).cast("long"),
        "line_count": lines_.cast("long"),
        "letter_count": count_of(t, r"\p{L}"),
        "digit_count": count_of(t, r"\p{Nd}"),
        "unique_words": F.size(F.array_distinct("_x_words")).cast("long"),
        "vocabulary_richness": _ratio(F.size(F.array_distinct("_x_words")), p("n")),
        "gunning_fog": F.when(p("n") > 0, 0.4 * (p("n") / p("sentences") + 100.0 * p("hard") / p("n"))).otherwise(0.0),
        "smog": 1.0430 * F.sqrt(p("hard") / p("sentences") * 30) + 3.1291,
        "lexical_density": _ratio(F.size(F.filter("_x_words", lambda w: ~w.isin(STOPWORDS))), p("n")),
        "modal_count": F.size(F.filter("_x_bare", lambda w: w.isin(MODALS))).cast("long"),
        "passive_count": passive.cast("long"),
    }
    return df.withColumns({f"{prefix}{k}": v for k, v in made.items()}).drop("_x_words", "_x_bare", "_x_n", "_x_sentences", "_x_hard")


def dice(a: Column, b: Column) -> Column:
    """Twice the common members of two arrays as sets, of all members; both empty: 1."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(x, y)) / total).otherwise(1.0)


def word_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of words by their counts; 0 if one is empty."""
    count = lambda items, w: F.size(F.filter(items, lambda x: x == w)).cast("double")
    dot = lambda x, y: F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda s, w: s + count(x, w) * count(y, w))
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
