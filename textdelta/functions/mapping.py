"""Character maps: which original bytes each normalized byte comes from.

A map is an array of (norm, kind, orig) by normalized offset; offsets are bytes
everywhere. Kinds: direct (one original position), collapsed (several),
expanded (one original position gives several bytes), inserted (none).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .normalize import Pipeline, strip_accents_text
from .once import once

MAP = "array<struct<norm:int,kind:string,orig:array<int>>>"
_ARROW = pa.list_(pa.struct([("norm", pa.int32()), ("kind", pa.string()), ("orig", pa.list_(pa.int32()))]))


def _per_character(text: str, make) -> list[dict]:
    """Each character's own output."""
    out, at, here = [], 0, 0
    for c in text:
        size, new = len(c.encode()), make(c).encode()
        kind = "direct" if len(new) == 1 else "expanded"
        out.extend({"norm": here + k, "kind": kind, "orig": [at]} for k in range(len(new)))
        at, here = at + size, here + len(new)
    return out


def _collapse_spaces(text: str) -> list[dict]:
    out, at, run = [], 0, []
    for c in [*text, ""]:
        size = len(c.encode())
        if c and (c.isspace() and not "\x1c" <= c <= "\x1f"):
            run.extend(range(at, at + size))
        else:
            if run:
                out.append({"norm": len(out), "kind": "direct" if len(run) == 1 else "collapsed", "orig": run})
                run = []
            for k in range(size):
                out.append({"norm": len(out), "kind": "direct", "orig": [at + k]})
        at += size
    return out


#: The White_Space property.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
MAKERS = {
    "lowercase": lambda t: _per_character(t, str.lower),
    "uppercase": lambda t: _per_character(t, str.upper),
    "whitespace": _collapse_spaces,
    "remove_punctuation": lambda t: _per_character(t, lambda c: "" if c in _PUNCTUATION else c),
    "remove_accents": lambda t: _per_character(t, strip_accents_text),
}


def _each_space(text: str) -> list[dict]:
    """Every byte of white space its own, without a run at the end."""
    end = len(text.rstrip(_SPACES).encode())
    return [{"norm": k, "kind": "direct", "orig": [k]} for k in range(end)]


def _trimmed(text: str) -> list[dict]:
    """Collapsed runs, without those at the ends."""
    inner = text.strip(_SPACES)
    lead = len(text[: len(text) - len(text.lstrip(_SPACES))].encode()) if inner else 0
    return [e | {"orig": [p + lead for p in e["orig"]]} for e in _collapse_spaces(inner)]


MAKERS |= {
    "whitespace_each": _each_space,
    "whitespace_trim": _trimmed,
    "remove_numbers": lambda t: _per_character(t, lambda c: "" if unicodedata.category(c)[0] == "N" else c),
    "remove_latin_accents": lambda t: _per_character(t, strip_accents_text),
}


def place_by_place(length: int, new_length: int) -> list[dict]:
    """The map of a normalizer of which only texts are known: byte by byte, and what is longer is inserted."""
    return [{"norm": k, "kind": "direct", "orig": [k]} if k < length else {"norm": k, "kind": "inserted", "orig": []} for k in range(new_length)]


@F.arrow_udf(from_arrow_type(_ARROW))
def custom_map(text: pa.Array, made: pa.Array) -> pa.Array:
    """The map of a custom normalizer from its input and output."""
    pairs = zip(text.to_pylist(), made.to_pylist(), strict=True)
    return pa.array([None if a is None or b is None else place_by_place(len(a.encode()), len(b.encode())) for a, b in pairs], _ARROW)


_STEPS: dict[str, Callable[[str], str]] = {
    "lowercase": str.lower,
    "uppercase": str.upper,
    "whitespace": lambda t: re.sub(f"[{_SPACES}]+", " ", t),
    "whitespace_trim": lambda t: re.sub(f"[{_SPACES}]+", " ", t.strip(_SPACES)),
    "whitespace_each": lambda t: re.sub(f"[{_SPACES}]", lambda m: " " * len(m[0].encode()), t.rstrip(_SPACES)),
    "remove_punctuation": lambda t: "".join(c for c in t if c not in _PUNCTUATION),
    "remove_numbers": lambda t: "".join(c for c in t if unicodedata.category(c)[0] != "N"),
    "remove_accents": strip_accents_text,
    "remove_latin_accents": strip_accents_text,
}


def origins(text: str, names: list[str]) -> list[list[int]]:
    """For each byte of the text that the named steps give: the bytes of ``text`` that it comes from."""
    out: list[list[int]] = [[k] for k in range(len(text.encode()))]
    for name in names:
        out = [sorted({p for q in e["orig"] for p in out[q]}) for e in MAKERS[name](text)]
        text = _STEPS[name](text)
    return out


def _runs(positions: set[int]) -> list[dict]:
    out: list[dict] = []
    for p in sorted(positions):
        if out and out[-1]["end"] == p:
            out[-1]["end"] = p + 1
        else:
            out.append({"start": p, "end": p + 1})
    return out


_SPANS = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def spans_before(names: list[str]):
    """An Arrow UDF (text before normalization, spans after it) -> for each span, those it comes from."""
    unknown = [n for n in names if n not in MAKERS]
    if unknown:
        raise ValueError(f"no map of {unknown[0]!r}")

    @F.arrow_udf(from_arrow_type(_SPANS))
    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            if t is None or own is None:
                out.append(None)
                continue
            back = origins(t, names)
            out.append([None if s["start"] is None else _runs({p for q in back[s["start"] : s["end"]] for p in q}) for s in own])
        return pa.array(out, _SPANS)

    return run


def character_map(name: str):
    """An Arrow UDF from texts to the map of a normalizer."""
    make = MAKERS[name]

    @F.arrow_udf(from_arrow_type(_ARROW))
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else make(t) for t in text.to_pylist()], _ARROW)

    return run


def identity(length: Column) -> Column:
    entry = lambda i: F.struct(i.cast("int").alias("norm"), F.lit("direct").alias("kind"), F.array(i.cast("int")).alias("orig"))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), entry)).otherwise(F.array().cast(MAP))


def positions(mapping: Column, norm: Column) -> Column:
    """The original positions of a normalized one."""
    return F.coalesce(F.get(mapping, norm)["orig"], F.array().cast("array<int>"))  # entries are by normalized position


def primary(mapping: Column, norm: Column) -> Column:
    return F.try_element_at(positions(mapping, norm), F.lit(1))


def normalized(mapping: Column, orig: Column) -> Column:
    """The normalized positions of an original one."""
    return F.transform(F.filter(mapping, lambda e: F.array_contains(e["orig"], orig)), lambda e: e["norm"])


def spans(mapping: Column, start: Column, end: Column) -> Column:
    """The original spans of a normalized span: runs of consecutive positions, in the order they are met."""
    met = F.flatten(F.transform(F.filter(mapping, lambda e: (e["norm"] >= start) & (e["norm"] < end)), lambda e: e["orig"]))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        one = F.array(F.struct(p.alias("start"), (p + 1).alias("end")))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), (p + 1).alias("end"))))
        return F.when((F.size(acc) > 0) & (last["end"] == p), longer).otherwise(F.concat(acc, one))

    return F.aggregate(met, empty, add)


def compose(first: Column, second: Column) -> Column:
    """The map through two steps: none is inserted, one direct, several collapsed to their whole span."""

    def through(e: Column) -> Column:
        back = F.flatten(F.transform(e["orig"], lambda p: positions(first, p)))
        whole = F.sequence(F.array_min(back), F.array_max(back))
        kind = F.when(F.size(back) == 0, "inserted").when(F.size(back) == 1, "direct").otherwise("collapsed")
        return F.struct(e["norm"].alias("norm"), kind.alias("kind"), F.when(F.size(back) > 1, whole).otherwise(back).alias("orig"))

    return F.transform(second, through)


class LayerSet:
    """A text and what each step of a pipeline makes of it, with the maps between, as columns.

    Layer 0 is the original; positions without an origin vanish on the way back.
    """

    def __init__(self, pipeline: Pipeline, text: Column):
        self.names = pipeline.names
        self.texts, self.maps = [text], []
        for name, step in pipeline.steps:
            made = step(self.texts[-1])
            self.maps.append(character_map(name)(self.texts[-1]) if name in MAKERS else custom_map(self.texts[-1], made))
            self.texts.append(made)

    def layer(self, index: int) -> Column:
        return self.texts[index] if 0 <= index < len(self.texts) else F.lit(None).cast("string")

    def final_layer(self) -> Column:
        return self.texts[-1]

    def num_layers(self) -> int:
        return len(self.texts)

    def all_texts(self) -> Column:
        return F.array(*self.texts)

    def map_to_original(self, index: int, position: Column) -> Column:
        """The original positions of a position in a layer; none for a layer that is not."""
        if index > len(self.maps):
            return F.array().cast("array<int>")
        out = F.array(position.cast("int"))
        for mapping in self.maps[:index][::-1]:
            both = F.struct(mapping.alias("map"), out.alias("at"))
            out = once(both, lambda b: F.flatten(F.transform(b["at"], lambda p: positions(b["map"], p))))
        return out

    def final_to_original(self) -> Column:
        """The composed map."""
        if not self.maps:
            return identity(F.octet_length(self.texts[0]))
        out = self.maps[0]
        for mapping in self.maps[1:]:
            out = once(F.struct(out.alias("first"), mapping.alias("second")), lambda b: compose(b["first"], b["second"]))
        return out
