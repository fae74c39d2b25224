"""Texts about diffs: operation descriptions and the unified format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import once

HUNK = "struct<original_start:int,original_count:int,modified_start:int,modified_count:int,lines:array<string>>"


def describe(op: Column) -> Column:
    """One operation in words."""
    quoted = lambda c: F.concat(F.lit("'"), F.coalesce(c, F.lit("")), F.lit("'"))
    o, m = quoted(op["original_text"]), quoted(op["modified_text"])
    return (
        F.when(op["edit_type"] == "Insert", F.concat(F.lit("Insert "), m))
        .when(op["edit_type"] == "Delete", F.concat(F.lit("Delete "), o))
        .when(op["edit_type"] == "Modify", F.concat(F.lit("Change "), o, F.lit(" to "), m))
        .otherwise(F.concat(F.lit("Keep "), o))
    )


def unified(original_name: Column, modified_name: Column, hunks: Column) -> Column:
    """The unified diff text of an array of hunks, whose lines have their prefixes."""

    def one(h: Column) -> Column:
        place = lambda a, b: F.concat_ws(",", h[a].cast("string"), h[b].cast("string"))
        head = F.concat(F.lit("@@ -"), place("original_start", "original_count"), F.lit(" +"), place("modified_start", "modified_count"), F.lit(" @@\n"))
        return F.concat(head, F.array_join(F.transform(h["lines"], lambda x: F.concat(x, F.lit("\n"))), ""))

    return F.concat(F.lit("--- "), original_name, F.lit("\n+++ "), modified_name, F.lit("\n"), F.array_join(F.transform(hunks, one), ""))


def token_hunk(ops: Column) -> Column:
    """One hunk of all operations, a token a line."""
    sign = lambda o: F.when(o["edit_type"] == "Insert", "+").when(o["edit_type"] == "Delete", "-").otherwise(" ")
    lines = F.transform(ops, lambda o: F.concat(sign(o), F.coalesce(o["original_text"], o["modified_text"])))
    count = lambda other: F.size(F.filter(ops, lambda o: o["edit_type"] != other))
    return F.struct(F.lit(1).alias("original_start"), count("Insert").alias("original_count"), F.lit(1).alias("modified_start"), count("Delete").alias("modified_count"), lines.alias("lines"))


def hunks(ops: Column, context: int = 3) -> Column:
    """The changes of a diff, each with ``context`` unchanged tokens (or lines) around it; changes nearer than twice that share a hunk."""
    sign = lambda o: F.when(o["edit_type"] == "Insert", "+").when(o["edit_type"] == "Delete", "-").otherwise(" ")
    changed = F.filter(F.transform(ops, lambda o, i: F.when(o["edit_type"] != "Equal", i)), lambda i: i.isNotNull())

    def of(all_: Column) -> Column:
        at = all_["changed"]
        far = lambda k: (k == 0) | (F.get(at, k) - F.get(at, k - 1) > 2 * context + 1)
        heads = F.filter(F.transform(at, lambda i, k: F.when(far(k), k)), lambda k: k.isNotNull())

        def one(heads: Column) -> Callable[[Column, Column], Column]:
            def hunk(head: Column, h: Column) -> Column:
                first = F.greatest(F.get(at, head) - context, F.lit(0))
                last = F.get(at, F.coalesce(F.get(heads, h + 1), F.size(at)) - 1)
                end = F.least(last + context + 1, F.size(all_["ops"]))
                before, own = F.slice(all_["ops"], F.lit(1), first), F.slice(all_["ops"], first + 1, end - first)
                count = lambda part, other: F.size(F.filter(part, lambda o: o["edit_type"] != other))
                lines = F.transform(own, lambda o: F.concat(sign(o), F.coalesce(o["original_text"], o["modified_text"])))
                start = lambda other: count(before, other) + F.when(count(own, other) > 0, 1).otherwise(0)
                return F.struct(start("Insert").alias("original_start"), count(own, "Insert").alias("original_count"), start("Delete").alias("modified_start"), count(own, "Delete").alias("modified_count"), lines.alias("lines"))

            return hunk

        return once(heads, lambda found: F.transform(found, one(found)))

    return once(F.struct(ops.alias("ops"), changed.alias("changed")), of)
