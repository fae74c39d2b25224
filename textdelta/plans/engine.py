"""The plan of a diff: normalize, tokenize, align, measure, classify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mapping
from ..functions.metrics import PAIR_METRICS, pair_metrics, stylistic_change
from ..functions.tokens import GRAMS, TOKENIZERS
from ..operators import align
from ..operators.classify import CLASSIFIERS, engine_category
from .config import DiffConfig


def normalized(df: DataFrame, config: DiffConfig) -> DataFrame:
    pipeline = config.normalizers()
    return df.withColumns({c: pipeline(F.col(c)) for c in ("original", "modified")}) if len(pipeline) else df


def with_ops(df: DataFrame, config: DiffConfig) -> DataFrame:
    """``df`` with edit operations (or with their counts alone): the one crossing to Python."""
    tokenize, *gram = GRAMS.get(config.tokenizer, (TOKENIZERS[config.tokenizer], 1, ""))
    o, m = F.col("original"), F.col("modified")
    if not config.operations:
        return df.withColumn("_counts", align.edit_counts(config.algorithm, config.strict_script, *gram)(tokenize(o), tokenize(m)))
    run = align.edit_script(config.algorithm, config.strict_script, *gram)
    df = df.withColumn("ops", run(o, tokenize(o), m, tokenize(m)))
    category = engine_category if config.classify_edits else lambda o: F.lit("Unknown")
    confidence = F.lit(0.8 if config.classify_edits else 0.0)
    fields = ("edit_type", "original_text", "modified_text", "original_start", "original_end", "modified_start", "modified_end")
    df = df.withColumn("ops", F.transform("ops", lambda o: F.struct(*(o[f].alias(f) for f in fields), category(o).alias("category"), confidence.alias("confidence"))))
    for name in config.classifiers:
        df = df.withColumn("ops", F.transform("ops", lambda o: o.withField(name, CLASSIFIERS[name](o))))  # noqa: B023
    return df


def with_original_spans(df: DataFrame, config: DiffConfig) -> DataFrame:
    """Operations with ``original_spans`` and ``modified_spans``: where they are in the texts before normalization (_raw_original, _raw_modified)."""
    names = config.normalizers().names
    for side in ("original", "modified"):
        own = F.transform("ops", lambda o: F.struct(o[f"{side}_start"].alias("start"), o[f"{side}_end"].alias("end")))  # noqa: B023
        df = df.withColumn("_spans", mapping.spans_before(names)(F.col(f"_raw_{side}"), own))
        df = df.withColumn("ops", F.zip_with("ops", "_spans", lambda o, s: o.withField(f"{side}_spans", s)))  # noqa: B023
    return df.drop("_spans", "_raw_original", "_raw_modified")


def compute_diff(df: DataFrame, config: DiffConfig | None = None) -> DataFrame:
    """Pairs (any columns, with original and modified) to diffs: operations, statistics, metrics and analysis.

    Metrics and lengths are those of the normalized texts, which replace the given ones. Metrics
    that ``df`` has already, as columns of their names, are kept as they are.
    """
    config = config or DiffConfig()
    given = [m for m in PAIR_METRICS if m in df.columns]
    df = df.withColumnsRenamed({m: f"_given_{m}" for m in given})
    if config.original_spans and config.operations:
        df = df.withColumns({"_raw_original": F.col("original"), "_raw_modified": F.col("modified")})
    df = with_ops(normalized(df, config), config)
    if config.original_spans and config.operations:
        df = with_original_spans(df, config)
    wanted = config.computed() - set(given)
    df = pair_metrics(df, only=wanted, max_chars=config.max_chars, long_distance=align.edit_distance)
    df = df.withColumnsRenamed({f"_given_{m}": m for m in given})
    missing = [m for m in PAIR_METRICS if m not in wanted and m not in given]
    df = df.withColumns({m: F.lit(False) if m == "negation_changed" else F.lit(0).cast("long") if m in ("levenshtein_distance", "word_count_diff") else F.lit(0.0) for m in missing})
    return with_statistics(df, config)


def compute_distinct(df: DataFrame, config: DiffConfig | None = None) -> DataFrame:
    """``compute_diff`` of pairs of which many are equal: each pair of texts is compared once, by a hash of 128 bits, and joined back."""
    keyed = df.withColumns({"_key": F.xxhash64("original", "modified"), "_key2": F.xxhash64(F.lit("second"), "modified", "original")})
    once = keyed.select("_key", "_key2", "original", "modified").dropDuplicates(["_key", "_key2"])
    found = compute_diff(once, config)
    return keyed.drop("original", "modified").join(found, ["_key", "_key2"]).drop("_key", "_key2")


def with_statistics(df: DataFrame, config: DiffConfig) -> DataFrame:
    if config.operations:
        ops = F.col("ops")
        df = df.withColumns({f"{name}s": align.count_type(ops, kind) for name, kind in (("insertion", "Insert"), ("deletion", "Delete"), ("modification", "Modify"))})
    else:
        known = F.col("_counts").isNotNull()
        df = df.withColumns({"insertions": F.col("_counts.insertions"), "deletions": F.col("_counts.deletions"), "modifications": F.when(known, F.lit(0).cast("long"))}).drop("_counts")
    df = df.withColumn("edit_distance", F.col("insertions") + F.col("deletions") + F.col("modifications"))
    most = F.greatest("o_char_count", "m_char_count")
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "change_percentage": F.when(most > 0, F.col("edit_distance").cast("double") / most).otherwise(zero),
            "semantic_similarity": F.col("word_overlap") if config.compute_semantic_similarity else zero,
            "stylistic_change": stylistic_change() if config.analyze_style else zero,
            "readability_change": F.col("m_avg_word_length") - F.col("o_avg_word_length") if config.analyze_style else zero,
        }
    )


def ops_table(diffs: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """A row an operation, in order."""
    return diffs.select(*keys, F.posexplode("ops").alias("op_idx", "op")).select(*keys, "op_idx", "op.*")


def operations_by_category(diffs: DataFrame) -> DataFrame:
    return ops_table(diffs).groupBy("pair_id", "category").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("op_idx")).alias("op_idxs"))


def summary(df_column_prefix: str = "") -> Column:
    """A line of text about a diff; percentages are rounded half up."""
    c = lambda n: F.col(f"{df_column_prefix}{n}")
    percent = lambda x: F.format_string("%.1f", F.floor(x * 1000 + 0.5 + 1e-9) / 10)  # noqa: E731  (69 / 240 * 100 is less than 28.75 in doubles)
    return F.concat(F.lit("Changes: "), c("insertions"), F.lit(" insertions, "), c("deletions"), F.lit(" deletions, "), c("modifications"), F.lit(" modifications ("), percent(c("change_percentage")), F.lit("% changed, "), percent(c("semantic_similarity")), F.lit("% similar)"))
