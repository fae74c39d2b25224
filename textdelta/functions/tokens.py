"""Tokenizers: string columns to arrays of token texts, and the long table with byte spans."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .charclass import NUMBER, PUNCT, SPACE, WORD

Tokenizer = Callable[[Column], Column]
_ALL = f"{SPACE}+|{PUNCT}+|{NUMBER}+|{WORD}+"


def _extract(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def characters(c: Column) -> Column:
    return _extract(c, "(?s).")


def words(punctuation: bool = False, space: bool = False) -> Tokenizer:
    """Maximal runs of one class; words and numbers always, punctuation and white space on demand."""
    pattern = "|".join([f"{NUMBER}+", f"{WORD}+", *([f"{PUNCT}+"] if punctuation else []), *([f"{SPACE}+"] if space else [])])
    return lambda c: _extract(c, pattern)


def char_ngrams(n: int) -> Tokenizer:
    """The n characters from each place on; fewer characters give none."""
    return lambda c: F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def word_ngrams(n: int) -> Tokenizer:
    def run(c: Column) -> Column:
        def windows(items: Column) -> Column:
            grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(items, i, n), " "))
            return F.when(F.size(items) >= n, grams).otherwise(F.array().cast("array<string>"))

        return F.element_at(F.transform(F.array(words()(c)), windows), 1)  # so that the words are found once

    return run


def sentences(c: Column) -> Column:
    """Cut after each . ! ? and the white space that follows; every token trimmed."""
    cut = _extract(c, rf"[^.!?]*[.!?]{SPACE}*|[^.!?]+$")
    return F.transform(cut, lambda s: F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", ""))


def lines(c: Column) -> Column:
    """Lines without their ends; a last one that is empty is none."""
    return F.split(F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\n$", ""), "\n")


def paragraphs(c: Column) -> Column:
    """What blank lines part, trimmed; nothing empty."""
    parts = F.split(F.regexp_replace(c, "\r\n?", "\n"), rf"\n(?:[^\S\n]*\n)+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")), lambda s: s != "")


def symbols(c: Column) -> Column:
    """Single characters that are symbols (currency, mathematics, modifiers, others)."""
    return _extract(c, r"\p{S}")


def at_least(tokenizer: Tokenizer, n: int) -> Tokenizer:
    """Only tokens of n characters or more."""
    return lambda c: F.filter(tokenizer(c), lambda t: F.char_length(t) >= n)


TOKENIZERS: dict[str, Tokenizer] = {
    "character": characters,
    "word": words(),
    "word_punctuation": words(punctuation=True),
    "word_all": words(True, True),
    "char_bigram": char_ngrams(2),
    "word_bigram": word_ngrams(2),
    "sentence": sentences,
    "line": lines,
    "paragraph": paragraphs,
    "symbol": symbols,
}
#: For n-grams: the tokenizer of their tokens, how many these are, and what joins them.
GRAMS: dict[str, tuple[Tokenizer, int, str]] = {"char_bigram": (characters, 2, ""), "word_bigram": (words(), 2, " ")}


def token_type(token: Column) -> Column:
    return F.when(F.rlike(token, F.lit(f"^{SPACE}")), "whitespace").when(F.rlike(token, F.lit(f"^{PUNCT}")), "punctuation").when(F.rlike(token, F.lit(f"^{NUMBER}")), "number").otherwise("word")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def running_sums(sizes: pa.Array) -> pa.Array:
    """Of each array of sizes, what they add up to so far."""
    sizes = pc.fill_null(sizes, pa.scalar([], sizes.type)) if sizes.null_count else sizes
    lengths = pc.list_value_length(sizes).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.append(0, np.cumsum(lengths))
    total = np.append(0, np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
    sums = total[1:] - np.repeat(total[offsets[:-1]], lengths)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sums, pa.int32()))


def token_table(df: DataFrame, id_column: str, text_column: str, punctuation: bool = False, space: bool = False) -> DataFrame:
    """id, index, text, type, start, end (UTF-8 bytes) of each token of the word tokenizer; all within a row, without an exchange."""
    kept = ["word", "number", *(["punctuation"] if punctuation else []), *(["whitespace"] if space else [])]
    rows = df.select(F.col(id_column).alias("id"), _extract(F.col(text_column), _ALL).alias("all_"))
    rows = rows.withColumn("ends", running_sums(F.transform("all_", lambda t: F.octet_length(t))))
    placed = F.zip_with("all_", "ends", lambda t, e: F.struct(t.alias("text"), token_type(t).alias("type"), (e - F.octet_length(t)).alias("start"), e.alias("end")))
    rows = rows.select("id", F.posexplode(F.filter(placed, lambda t: t["type"].isin(kept))).alias("index", "t"))
    return rows.select("id", "index", "t.text", "t.type", "t.start", "t.end")
