"""Text normalizers: string columns to string columns, and pipelines of them.

Null in, null out. Position maps are in ``mapping``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .charclass import COMBINING_BLOCKS, NUMBER, PUNCT, SPACE

Normalizer = Callable[[Column], Column]


def lowercase(c: Column) -> Column:
    return F.lower(c)


def uppercase(c: Column) -> Column:
    return F.upper(c)


def whitespace(collapse: bool = True, trim: bool = False) -> Normalizer:
    """Collapse runs of white space to a space, or (not collapsing) make each of its bytes one and drop a trailing run."""

    def run(c: Column) -> Column:
        if not collapse:
            c = F.regexp_replace(c, f"{SPACE}+$", "")
            for size, chars in ((3, r"[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"), (2, r"[\x{85}\x{A0}]"), (1, r"[\x09-\x0D\x20]")):
                c = F.regexp_replace(c, chars, " " * size)
        if trim:
            c = F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
        return F.regexp_replace(c, f"{SPACE}+", " ") if collapse else c

    return run


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCT, "")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBER, "")


def strip_accents_text(text: str) -> str:
    """Each character's base, without ASCII punctuation and combining marks."""
    out = []
    for c in text:
        base = unicodedata.normalize("NFD", c)[0]
        if not (base.isascii() and not base.isalnum() and base.isprintable() and base != " ") and not any(a <= ord(base) <= b for a, b in COMBINING_BLOCKS):
            out.append(base)
    return "".join(out)


@F.arrow_udf(T.StringType())
def remove_accents(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else strip_accents_text(t) for t in text.to_pylist()], pa.string())


#: Latin letters with marks, and their bases.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_BASES = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def remove_latin_accents(c: Column) -> Column:
    """The same for texts of Latin-1 letters, without leaving the JVM."""
    return F.regexp_replace(F.translate(c, _MARKED, _BASES), PUNCT, "")


NORMALIZERS: dict[str, Normalizer] = {
    "lowercase": lowercase,
    "uppercase": uppercase,
    "whitespace": whitespace(),
    "whitespace_trim": whitespace(trim=True),
    "whitespace_each": whitespace(collapse=False),
    "remove_punctuation": remove_punctuation,
    "remove_accents": remove_accents,
    "remove_latin_accents": remove_latin_accents,
    "remove_numbers": remove_numbers,
}


@dataclass(frozen=True)
class Pipeline:
    """An ordered list of named normalizers; custom ones are any function of columns."""

    steps: tuple[tuple[str, Normalizer], ...] = ()

    def add(self, name: str, normalizer: Normalizer | None = None) -> Pipeline:
        return Pipeline((*self.steps, (name, normalizer or NORMALIZERS[name])))

    @classmethod
    def of(cls, names: Sequence[str]) -> Pipeline:
        return cls(tuple((n, NORMALIZERS[n]) for n in names))

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def __len__(self) -> int:
        return len(self.steps)

    def __call__(self, c: Column) -> Column:
        for _, normalizer in self.steps:
            c = normalizer(c)
        return c

    def layers(self, c: Column) -> Column:
        """array<struct<name, text>>: the original and what each step makes of it."""
        out = [F.struct(F.lit("original").alias("name"), c.alias("text"))]
        for name, normalizer in self.steps:
            c = normalizer(c)
            out.append(F.struct(F.lit(name).alias("name"), c.alias("text")))
        return F.array(*out)


def newlines(c: Column) -> Column:
    """Every line end as a line feed."""
    return F.regexp_replace(c, "\r\n?|[\u0085  ]", "\n")


def without(characters: str) -> Normalizer:
    """A normalizer that removes a set of characters of the caller's."""
    return lambda c: F.translate(c, characters, "") if characters else c


def unicode_form(form: str) -> Normalizer:
    """NFC, NFD, NFKC or NFKD; texts of ASCII do not change, and take no time."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown form {form!r}")

    @F.arrow_udf(T.StringType())
    def run(text: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in text.to_pylist()], pa.string())

    return run


NORMALIZERS |= {"newlines": newlines, **{form.lower(): unicode_form(form) for form in ("NFC", "NFD", "NFKC", "NFKD")}}
