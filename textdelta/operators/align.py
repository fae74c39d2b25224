"""Alignment of two token sequences: an edit script by one of three algorithms.

Sequences are lists of hashable tokens; a script is a list of (kind, i, j) with
kind ``=`` (or ``#``, an anchor), ``-`` or ``+``; i and j are token places (one is None for - and +).
``myers`` is the longest common subsequence with ties resolved towards the
modified side; ``patience`` and ``histogram`` split at anchors first. Both
reproduce scripts whose anchors may cross, unless ``strict``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.once import once

Script = list[tuple[str, int | None, int | None]]
#: Algorithms by name that a user adds: functions of two token lists.
CUSTOM_ALGORITHMS: dict[str, Callable[[list, list], Script]] = {}
#: An equal pair that is an anchor.
ANCHOR = "#"
#: The most anchors that the histogram algorithm takes, and the least rows of a table that are kept at once.
ANCHORS, ROWS = 10, 512


def _rows(a: list, where: dict, full: int, flat: int) -> list[int]:
    """The rows of a part of the table, after the row before it."""
    rows = []
    for token in a:
        hits = flat & where.get(token, 0)
        flat = ((flat + hits) | (flat - hits)) & full
        rows.append(flat)
    return rows


def lcs(a: list, b: list) -> list[tuple[int, int]]:
    """Matches of a longest common subsequence, by bit-parallel rows.

    Row i lacks a bit for each j where the table grows from j - 1 to j. Walking
    back from the end, equal tokens are taken (so an equal end needs no table),
    a missing bit goes up, else left. Of many rows only each some hundredth is
    kept, and the rows between are made again on the way back, so that memory
    grows with the root of the number of rows.
    """
    i, j, out = len(a), len(b), []
    while i and j and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
        out.append((i, j))
    if not i or not j:
        return out[::-1]
    where: dict = {}
    for place, token in enumerate(b[:j]):
        where[token] = where.get(token, 0) | 1 << place
    full = (1 << j) - 1
    step = max(ROWS, isqrt(i))
    starts, kept = [full], []
    for lo in range(0, i, step):
        kept = _rows(a[lo : min(lo + step, i)], where, full, starts[-1])
        starts.append(kept[-1])
    low = (i - 1) // step * step
    while i and j:
        if i <= low:
            low -= step
            kept = _rows(a[low : low + step], where, full, starts[low // step])
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif not kept[i - 1 - low] >> (j - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def myers(a: list, b: list, at: int = 0, to: int = 0) -> Script:
    """The script of a longest common subsequence; at and to are added to the places."""
    out: Script = []
    i = j = 0
    for x, y in [*(lcs(a, b) if a and b else []), (len(a), len(b))]:
        out += [("-", at + k, None) for k in range(i, x)]
        out += [("+", None, to + k) for k in range(j, y)]
        if x < len(a) and y < len(b):
            out.append(("=", at + x, to + y))
        i, j = x + 1, y + 1
    return out


def unique_anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Tokens that are once on both sides, in original order, each kept if it goes forward from the last kept."""
    left, right = Counter(a), Counter(b)
    place = {t: j for j, t in enumerate(b)}
    out: list[tuple[int, int]] = []
    for i, t in enumerate(a):
        if left[t] == 1 and right[t] == 1 and (not out or place[t] > out[-1][1]):
            out.append((i, place[t]))
    return out


def rare_anchors(a: list, b: list, most: int = ANCHORS) -> list[tuple[int, int]]:
    """The equal pairs of the rarest tokens, by rarity, then place; ``most`` at most."""
    left, right = Counter(a), Counter(b)
    places: dict = {}
    for j, t in enumerate(b):
        places.setdefault(t, []).append(j)
    by_rarity: dict[int, list[tuple[int, int]]] = {}
    for i, t in enumerate(a):
        if t in places:
            own = by_rarity.setdefault(min(left[t], right[t]), [])
            if len(own) < most:
                own += [(i, j) for j in places[t][: most - len(own)]]
    return [pair for rarity in sorted(by_rarity) for pair in by_rarity[rarity]][:most]


def split_at(a: list, b: list, anchors: list[tuple[int, int]], from_a: int, from_b: int, to_a: int, to_b: int) -> Script:
    """The script of a region by the anchors in it: what is before each, in the anchors' order, and what is after the last."""
    if from_a > to_a or from_b > to_b:
        return []
    if not anchors:
        return myers(a[from_a:to_a], b[from_b:to_b], from_a, from_b)
    forward = all(x[0] < y[0] and x[1] < y[1] for x, y in pairwise(anchors))  # then none is in a gap
    out: Script = []
    i, j = from_a, from_b
    for x, y in [*anchors, (to_a, to_b)]:
        if i < x or j < y:
            inside = [] if forward else [(p, q) for p, q in anchors if i <= p < x and j <= q < y]
            out += split_at(a, b, inside, i, j, x, y)
        out.append((ANCHOR, x, y))
        i, j = x + 1, y + 1
    return out[:-1]


def forward_only(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Anchors in original order without those that cross an earlier one or share a place."""
    out: list[tuple[int, int]] = []
    for i, j in sorted(anchors):
        if not out or (i > out[-1][0] and j > out[-1][1]):
            out.append((i, j))
    return out


def script(a: list, b: list, algorithm: str | Callable = "histogram", strict: bool = False) -> Script:
    """The edit script of two token lists."""
    if callable(algorithm):
        return algorithm(a, b)
    if algorithm in ("myers", "lcs") or not a or not b:
        return myers(a, b)
    anchors = {"patience": unique_anchors, "histogram": rare_anchors}[algorithm](a, b)
    anchors = forward_only(anchors) if strict else anchors
    return split_at(a, b, anchors, 0, 0, len(a), len(b)) if anchors else myers(a, b)


def byte_spans(text: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Where the tokens, in order, are in a text, in UTF-8 bytes."""
    out, at, done, plain = [], 0, 0, text.isascii()
    for token in tokens:
        start = text.index(token, at)
        size = len(token) if plain else len(token.encode())
        done += start - at if plain else len(text[at:start].encode())
        out.append((done, done + size))
        at, done = start + len(token), done + size
    return out


def grams(tokens: list[str], n: int, between: str) -> list[str]:
    """The n-grams of tokens."""
    return tokens if n == 1 else [between.join(tokens[k : k + n]) for k in range(len(tokens) - n + 1)]


def token_spans(text: str, tokens: list[str], gram: int = 1) -> list[tuple[int, int]]:
    """The spans of the n-grams of tokens in a text."""
    own = byte_spans(text, tokens)
    return own if gram == 1 else [(own[k][0], own[k + gram - 1][1]) for k in range(len(own) - gram + 1)]


def distance(a: str, b: str) -> int:
    """The edit distance of two strings, by bit-parallel columns."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, out = full, 0, len(a)
    for c in b:
        hits = where.get(c, 0)
        wide = (((hits & up) + up) ^ up) | hits
        more, less = down | ~(wide | up) & full, up & wide
        out += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | ~(hits | down | more) & full, more & (hits | down)
    return out


@F.arrow_udf(T.LongType())
def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """The edit distance over code points; for long texts, where a table of all cells takes too long."""
    return pa.array([None if x is None or y is None else distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())


_FIELDS = [("edit_type", pa.string()), ("original_text", pa.string()), ("modified_text", pa.string()), ("original_start", pa.int32()), ("original_end", pa.int32()), ("modified_start", pa.int32()), ("modified_end", pa.int32())]
_OPS = pa.list_(pa.struct(_FIELDS))
_KINDS = {"=": 0, ANCHOR: 1, "-": 2, "+": 3}
_NAMES = pa.array(["Equal", "Equal", "Delete", "Insert"])
#: Tokens of both sides that are Python objects at once, about; a pair with more is alone.
TOKENS = 100_000


def _pieces(*columns: pa.Array) -> Iterator[list[pa.Array]]:
    """Runs of the rows of columns, of which the lists have about TOKENS members together."""
    lists = [c for c in columns if pa.types.is_list(c.type)]
    sizes = sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in lists)
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // TOKENS)) + 1
    for lo, hi in pairwise([0, *starts.tolist(), len(sizes)]):
        yield [c.slice(lo, hi - lo) for c in columns]


def _operations(columns: list[pa.Array], algorithm: str | Callable, strict: bool, gram: int, between: str) -> pa.Array:
    """The edit operations of some pairs; texts and spans are taken by place from those of all tokens."""
    original, o_tokens, modified, m_tokens = columns
    kinds, lefts, rights, offsets, valid = [], [], [], [0], []
    spans, members, sides = ([], []), ([], []), (lefts, rights)
    for x, a, y, b in zip(original.to_pylist(), o_tokens.to_pylist(), modified.to_pylist(), m_tokens.to_pylist(), strict=True):
        valid.append(not (x is None or y is None))
        if valid[-1]:
            starts = len(spans[0]), len(spans[1])
            spans[0].extend(token_spans(x, a, gram))
            spans[1].extend(token_spans(y, b, gram))
            a, b = grams(a, gram, between), grams(b, gram, between)
            members[0].extend(a)
            members[1].extend(b)
            done = script(a, b, algorithm, strict)
            kinds += [_KINDS[kind] for kind, _, _ in done]
            for k, (side, start) in enumerate(zip(sides, starts, strict=True), 1):
                side += [-1 if op[k] is None else start + op[k] for op in done]
        offsets.append(len(kinds))
    kinds, lefts, rights = np.array(kinds, np.int8), np.array(lefts, np.int64), np.array(rights, np.int64)
    out = [_NAMES.take(pa.array(kinds))]
    out += [pa.array(own, pa.string()).take(pa.array(at, mask=at < 0)) for own, at in zip(members, (lefts, rights), strict=True)]
    left, right = (np.array([*own, (0, 0)], np.int32)[at] for own, at in zip(spans, (lefts, rights), strict=True))
    if not strict:  # an anchor's span is the original's
        right = np.where((kinds == _KINDS[ANCHOR])[:, None], left, right)
    out += [pa.array(span[:, k], pa.int32(), mask=at < 0) for span, at in ((left, lefts), (right, rights)) for k in (0, 1)]
    values = pa.StructArray.from_arrays(out, fields=[pa.field(*f) for f in _FIELDS])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array([not v for v in valid], pa.bool_()))


def edit_script(algorithm: str = "histogram", strict: bool = False, gram: int = 1, between: str = ""):
    """An Arrow UDF (original text and tokens, modified text and tokens) -> edit operations on the tokens' n-grams.

    A batch of rows is answered in pieces, as its operations are many times its texts.
    """
    algorithm = CUSTOM_ALGORITHMS.get(algorithm, algorithm)  # the function itself goes to the workers

    @F.arrow_udf(from_arrow_type(_OPS))
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for piece in _pieces(*columns):
                yield _operations(piece, algorithm, strict, gram, between)

    return run.asNondeterministic()  # so that it is evaluated once


_COUNTS = pa.struct([("insertions", pa.int64()), ("deletions", pa.int64())])


def edit_counts(algorithm: str = "histogram", strict: bool = False, gram: int = 1, between: str = ""):
    """An Arrow UDF (tokens of both sides) -> how many operations insert and delete, without the operations."""
    algorithm = CUSTOM_ALGORITHMS.get(algorithm, algorithm)  # the function itself goes to the workers

    @F.arrow_udf(from_arrow_type(_COUNTS))
    def run(o_tokens: pa.Array, m_tokens: pa.Array) -> pa.Array:
        out: list[dict | None] = []
        for piece in _pieces(o_tokens, m_tokens):
            for a, b in zip(*(side.to_pylist() for side in piece), strict=True):
                kinds = None if a is None or b is None else Counter(kind for kind, _, _ in script(grams(a, gram, between), grams(b, gram, between), algorithm, strict))
                out.append(None if kinds is None else {"insertions": kinds["+"], "deletions": kinds["-"]})
        return pa.array(out, _COUNTS)

    return run.asNondeterministic()  # so that it is evaluated once


def count_type(ops: Column, kind: str) -> Column:
    return F.size(F.filter(ops, lambda o: o["edit_type"] == kind)).cast("long")


def changed(ops: Column) -> Column:
    return F.filter(ops, lambda o: o["edit_type"] != "Equal")


def is_empty(ops: Column) -> Column:
    return F.forall(ops, lambda o: o["edit_type"] == "Equal")


def replaced(ops: Column) -> Column:
    """Operations in which a run of deletions and the insertions right after it are one ``Modify``, of the texts joined by spaces."""
    kind = "struct<edit_type:string,original_text:string,modified_text:string,original_start:int,original_end:int,modified_start:int,modified_end:int>"
    empty = F.array().cast(f"array<{kind}>")
    names = ("original_text", "modified_text", "original_start", "original_end", "modified_start", "modified_end")

    def add(acc: Column, o: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        own = F.struct(o["edit_type"].alias("edit_type"), *(o[n].alias(n) for n in names))
        gone, come = last["edit_type"].isin("Delete", "Modify"), o["edit_type"] == "Insert"
        joined = lambda n: F.concat_ws(" ", last[n], o[n])
        more = F.struct(
            F.when(come, "Modify").otherwise("Delete").alias("edit_type"),
            F.when(come, last["original_text"]).otherwise(joined("original_text")).alias("original_text"),
            F.when(come, joined("modified_text")).alias("modified_text"),
            last["original_start"].alias("original_start"),
            F.coalesce(o["original_end"], last["original_end"]).alias("original_end"),
            F.coalesce(last["modified_start"], o["modified_start"]).alias("modified_start"),
            F.coalesce(o["modified_end"], last["modified_end"]).alias("modified_end"),
        )
        joins = (gone & come) | ((last["edit_type"] == "Delete") & (o["edit_type"] == "Delete"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, F.array(own)))

    # runs of changes between equal operations are folded one by one, so that an array is as long as its run
    runs = F.filter(F.transform(ops, lambda o, i: F.when((o["edit_type"] == "Equal") | (i == 0) | (F.get(ops, i - 1)["edit_type"] == "Equal"), i)), lambda i: i.isNotNull())
    folded = lambda all_: lambda at, k: F.aggregate(F.slice(ops, at + 1, F.coalesce(F.get(all_, k + 1), F.size(ops)) - at), empty, add)
    return once(runs, lambda all_: F.flatten(F.transform(all_, folded(all_))))
