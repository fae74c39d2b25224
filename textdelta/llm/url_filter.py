"""URL filter: rules, and a character language-model ratio for what no rule fits.

URLs that a rule accepts or rejects train two smoothed variable-order Markov
models of characters: the probability of a character interpolates the counts
after the longest context seen down to the shortest. The score of a URL is the
difference of its log-likelihoods, divided by its length. Its threshold is
calibrated on a held-out part of the labelled URLs, as the one of the best
balanced accuracy.

Counts are kept by the hash of context and character in ``KEYS`` cells for each
order, so that different n-grams do not share counts; they are counted over all
labelled URLs by partial aggregates. The models hold a row of 16 bytes for each
distinct n-gram, and grow with them. Up to ``MODEL_ROWS`` rows they are broadcast
whole. Larger ones stay a table: groups of distinct texts ask for their own
n-grams, each once a group, and get the counts by a join. Both ways give
the same scores. Labelled URLs of which there is no accepted or no rejected one train nothing; then all
that has no rule is allowed.

Edge cases: a null URL or one without ``://`` has empty host and path, and is
scored as an empty text (0, so it is allowed unless the threshold is above);
repeated rows are each judged and each counted; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import spread
from .components import answered, written
from .textcore import U64, arrow_text, mix, of_batches, of_group, of_groups

#: The longest context; cells of a dense table of counts, and of the keys of a sparse one.
ORDER, CELLS, KEYS = 5, 1 << 16, 1 << 58
#: How much a shorter context counts, in observations; and one in HELD_OUT of the labelled URLs calibrates.
WEIGHT, HELD_OUT = 2.0, 5
#: Rows of models that are broadcast at most (64 MB); bytes of the texts that ask a larger model together.
MODEL_ROWS, GROUP_BYTES = 4_000_000, 512 << 10
#: Units of a log-likelihood ratio; whole numbers add up alike however texts are batched.
FIXED = 1 << 32
#: Calibration bins of the score: width and range.
BIN, RANGE = 1 / 64, 8.0
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    part = lambda k: F.coalesce(F.regexp_extract(url, whole, k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as a string, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, said in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _contexts(buf: np.ndarray, off: np.ndarray, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the cells of the contexts and of the contexts with their characters, for all bytes of a batch."""
    lo, hi = int(off[0]), int(off[-1])
    data = buf[lo:hi].astype(U64) + U64(1)
    start = np.repeat(off[:-1] - lo, np.diff(off))
    place = np.arange(hi - lo) - start
    context = np.zeros(hi - lo, dtype=U64)
    for order in range(ORDER + 1):
        if order:
            before = np.zeros(hi - lo, dtype=U64)
            before[order:] = data[:-order] if order < hi - lo else 0
            before[place < order] = 0  # before the text
            context = mix(context + before * U64(0x9E3779B97F4A7C15) + U64(order))
        cell = (context % U64(cells)).astype(np.int64)
        yield cell, (mix(context + data) % U64(cells)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], cells: int = CELLS) -> Iterator[pa.RecordBatch]:
    """Counts by place in a table (label, order, kind, cell); a place comes once a batch."""
    for batch in batches:
        accepted = batch["accepted"].to_numpy(zero_copy_only=False).astype(bool)
        places = [np.zeros(0, np.int64)]
        for label in (0, 1):
            buf, off = arrow_text(batch["text"].filter(pa.array(accepted == bool(label))))
            for order, found in enumerate(_contexts(buf, off, cells)):
                places += [((label * (ORDER + 1) + order) * 2 + kind) * cells + found[kind] for kind in (0, 1)]
        used, n = np.unique(np.concatenate(places), return_counts=True)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(used, pa.int64()), "n": pa.array(n, pa.int64())})


@dataclass(frozen=True)
class Sparse:
    """A table of counts by label, order, kind and cell, as its sorted places that are not 0."""

    places: np.ndarray
    n: np.ndarray
    cells: int = KEYS

    def of(self, label: int, order: int, kind: int, cell: np.ndarray) -> np.ndarray:
        place = cell + ((label * (ORDER + 1) + order) * 2 + kind) * self.cells
        at = np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)
        return np.where(self.places[at] == place, self.n[at], 0)


@dataclass(frozen=True)
class Model:
    """Counts by label, order, kind (context; context with character) and cell, dense or sparse."""

    counts: np.ndarray | Sparse

    def _seen(self, label: int, order: int, kind: int, cell: np.ndarray) -> np.ndarray:
        return self.counts.of(label, order, kind, cell) if isinstance(self.counts, Sparse) else self.counts[label, order, kind][cell]

    def scores(self, column) -> np.ndarray:
        """Log-likelihood ratio a byte of each text, accepted against rejected; 0 for an empty text."""
        buf, off = arrow_text(column)
        n = int(off[-1] - off[0])
        p = [np.full(n, 1 / 256), np.full(n, 1 / 256)]
        cells = self.counts.cells if isinstance(self.counts, Sparse) else self.counts.shape[-1]
        for order, (context, pair) in enumerate(_contexts(buf, off, cells)):
            for label in (0, 1):
                p[label] = (self._seen(label, order, 1, pair) + WEIGHT * p[label]) / (self._seen(label, order, 0, context) + WEIGHT)
        ratio = np.rint((np.log(p[1]) - np.log(p[0])) * FIXED).astype(np.int64)
        sums = np.diff(np.append(0, np.cumsum(ratio))[off - off[0]]) / FIXED
        lengths = np.diff(off)
        return np.where(lengths > 0, sums / np.maximum(lengths, 1), 0.0)


def _asked(table: pa.Table) -> pa.Table:
    """The distinct places (order, kind, cell) of a group's texts."""
    buf, off = arrow_text(table["text"])
    places = [(order * 2 + kind) * KEYS + cell for order, found in enumerate(_contexts(buf, off, KEYS)) for kind, cell in enumerate(found)]
    distinct = np.unique(np.concatenate(places))
    return pa.table({"part": np.full(len(distinct), table["part"][0].as_py(), np.int64), "place": distinct})


def _answer(texts: pa.Table, found: pa.Table) -> pa.Table:
    """Scores of a group's texts by the counts that it has asked for."""
    place, rejected, accepted = (found[c].to_numpy() for c in ("place", "rejected", "accepted"))
    order = np.argsort(place)
    place, both = place[order], np.concatenate([rejected[order], accepted[order]])
    counts = Sparse(np.concatenate([place, place + 2 * (ORDER + 1) * KEYS]), both)
    scores = Model(counts).scores(texts["text"]) if len(place) else np.zeros(len(texts))
    return pa.table({**{c: texts[c] for c in ("__h", "__digest", "n")}, "score": pa.array(scores, pa.float64())})


def _scored_by_join(df: DataFrame, model: DataFrame, columns: list[str]) -> DataFrame:
    """The same scores from a model that stays a table (place, rejected, accepted).

    Equal texts are scored once and joined to their rows by two hashes, a hot text by
    broadcast. A place is asked for once a group, so the most common one has a row a group.
    """
    text = F.coalesce("text", F.lit(""))
    rows = df.select(*columns, F.xxhash64(text).alias("__h"), F.unhex(F.sha2(text, 256)).alias("__digest"))
    texts = written(df.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("n")))
    size = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    groups = F.lit(size // GROUP_BYTES + 1).cast("long")
    keyed = texts.select(F.xxhash64("text").alias("__h"), F.unhex(F.sha2("text", 256)).alias("__digest"), "text", "n")
    keyed = spread(keyed.withColumn("part", F.pmod("__h", groups)), "part", size)
    asks = 2 * (ORDER + 1) * 16 * size  # bytes at most
    asked = spread(keyed.groupBy("part").applyInArrow(of_group(_asked), "part long, place long"), "place", asks)
    found = spread(asked.join(spread(model, "place", asks), "place").select("part", "place", "rejected", "accepted"), "part", asks)
    met = spread(keyed, "part", asks).groupBy("part").cogroup(found.groupBy("part"))
    scores = written(met.applyInArrow(of_groups(_answer), "__h long, __digest binary, n long, score double"))
    return answered(rows, scores, ["__h", "__digest"], F.monotonically_increasing_id()).select(*columns, "score")


def _scored(df: DataFrame, model: Model | DataFrame | None, schema: str, columns: list[str]) -> DataFrame:
    if isinstance(model, DataFrame):
        return _scored_by_join(df, model, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch["text"]
            scores = model.scores(text) if model else np.zeros(len(text))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(scores, pa.float64())], names=[*columns, "score"])

    return df.mapInArrow(of_batches(run), schema)


def fit(labelled: DataFrame) -> tuple[Model | DataFrame | None, float]:
    """The models (a table where they are large) and the threshold from (text, accepted)."""
    part = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT))
    counts = labelled.where(part != 0).mapInArrow(of_batches(lambda batches: _count(batches, KEYS)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = written(counts)
    label = KEYS * 2 * (ORDER + 1)
    known = counts.agg(F.min("cell").alias("least"), F.max("cell").alias("most"), F.count("*").alias("n")).first()
    if not known.n or known.least >= label or known.most < label:
        return None, 0.0
    if known.n <= MODEL_ROWS:
        rows = counts.toArrow()
        places, n = (rows[c].to_numpy() for c in ("cell", "n"))
        order = np.argsort(places)
        model = Model(Sparse(places[order], n[order]))
    else:
        of = lambda accepted: F.sum(F.when((F.col("cell") >= label) == accepted, F.col("n")).otherwise(0))
        model = counts.groupBy(F.pmod("cell", F.lit(label)).alias("place")).agg(of(False).alias("rejected"), of(True).alias("accepted"))
        model = written(model)
    held = _scored(labelled.where(part == 0).select("text", "accepted"), model, "accepted boolean, score double", ["accepted"])
    bins = held.select("accepted", F.floor(F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), "score")) / BIN).alias("bin"))
    seen = {(r.accepted, r.bin): r.n for r in bins.groupBy("accepted", "bin").agg(F.count("*").alias("n")).collect()}
    good, bad = (sum(n for (label, _), n in seen.items() if label is want) for want in (True, False))
    if not good or not bad:
        return model, 0.0
    edges = range(int(-RANGE / BIN), int(RANGE / BIN) + 1)
    below = {label: 0 for label in (True, False)}
    found = []
    for edge in edges:  # everything in a bin below the edge is rejected
        found.append((-(below[False] / bad + 1 - below[True] / good), abs(edge), edge))
        for label in below:
            below[label] += seen.get((label, edge), 0)
    return model, min(found)[2] * BIN


def judge(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each page."""
    host, path = parsed(F.col(url_column))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"), F.concat("host", "path").alias("text"))
    model, threshold = fit(rows.where("rule IS NOT NULL").select("text", (F.col("said") == "allow").alias("accepted")))
    kept = ["page_id", "host", "path", "rule", "said"]
    kind = dict(rows.dtypes)
    scored = _scored(rows, model, ", ".join(f"{c} {kind[c]}" for c in kept) + ", score double", kept)
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block") if model else F.lit("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", by_model).alias("verdict"), "score")
