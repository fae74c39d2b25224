"""Benchmark decontamination with suffix arrays of the training text.

Each shard (a MB of documents, or one that is longer) has the suffix array of its
text, as word numbers, sorted by prefix doubling to their whole length. Every
test suffix that begins a window (of ``n`` words of an item; a shorter item is one
window) is binary-searched in it by the window's words: the range is where the
window occurs. Each occurrence is extended to the longest verbatim match. Words
that no item has, and ends of documents, are different from all others and so end
a suffix; windows with a word that the shard hasn't are not searched in it.

The test set goes to the executors in blocks of at most about ``BLOCK_BYTES`` of
text. One block, which most test sets are, is matched in one map pass. Of more,
the driver holds one at a time; each leaves its hits in the shared folder, and
they are joined to the documents by hashes of the text.

Edge cases: null text has no words; an item without words has no window; items
with a null id mark words but are not listed; rows that repeat an item id are
one item; repeated documents are each judged; columns but those named are kept
by ``clean`` and ignored by ``matches``; an empty test set leaves every document
clean; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import Members
from .components import answered, shared_folder, written
from .textcore import ALNUM_WORDS, Words, arrow_text, of_batches, ranges, release, slices

#: Test text that is held at once, and documents' text that makes a shard.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 1_000_000
SPANS = "array<struct<start:int,end:int>>"
RESULT = f"doc_id long, n_words long, n_hit long, n_items long, items array<string>, longest long, spans {SPANS}"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def suffix_array(first: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a sequence of numbers whose last is unique."""
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]  # of each place's group of equals
    rank = np.empty(len(first), dtype=np.int64)
    rank[order] = start
    length = 1
    while True:
        tied = np.zeros(len(order), dtype=bool)
        tied[1:] = start[1:] == start[:-1]
        tied[:-1] |= tied[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        own = order[places]
        key = rank[own] << 32 | rank[np.minimum(own + length, len(rank) - 1)]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[places] = own
        new = np.append(True, key[1:] != key[:-1])
        start[places] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank[own] = start[places]
        length *= 2


class TestSet:
    """A block of the test set as word numbers; its windows by their places, and whose they are."""

    def __init__(self, ids: list, texts: list, n: int):
        buf, off = arrow_text(pa.array(texts, pa.large_string()))
        w = Words(buf, off, ALNUM_WORDS, lower=True)
        self.vocabulary = np.unique(w.hash)
        self.members = Members(w.hash)
        self.words = np.searchsorted(self.vocabulary, w.hash)
        length = np.diff(w.first)
        size = np.minimum(length, n)
        self.at = ranges(w.first[:-1], np.where(size > 0, length - size + 1, 0))
        item = np.searchsorted(w.first, self.at, side="right") - 1
        self.item, self.size, self.end = item, size[item], w.first[1:][item]
        self.ids = [None if x is None else str(x) for x in ids]

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word place, window and words of the longest match from there of each occurrence in a shard."""
        none = np.zeros(0, dtype=np.int64)
        known = self.members.has(w.hash) if len(self.at) else np.zeros(len(w.hash), bool)
        number = np.searchsorted(self.vocabulary, w.hash[known])
        here = np.zeros(len(self.vocabulary), dtype=bool)
        here[number] = True
        lacks = np.append(0, np.cumsum(~here[self.words]))
        asked = np.flatnonzero(lacks[self.at + self.size] == lacks[self.at])
        if not len(asked):
            return none, none, none
        # the text, an end after each row
        at = np.arange(len(w.hash)) + w.rows()
        text = np.full(len(w.hash) + len(w.first) - 1, -1, dtype=np.int64)
        text[at[known]] = number
        ends = np.flatnonzero(text < 0)
        text[ends] = len(self.vocabulary) + np.arange(len(ends))
        array = suffix_array(text)
        lo, hi = (self._bound(array, text, asked, after) for after in (False, True))
        count = hi - lo
        place, window = array[ranges(lo, count)], np.repeat(asked, count)
        longest = self.size[window].copy()
        going = np.arange(len(place))
        while len(going):
            k = longest[going]
            p = self.at[window[going]] + k
            more = p < self.end[window[going]]
            more[more] = text[place[going[more]] + k[more]] == self.words[p[more]]
            going = going[more]
            longest[going] += 1
        word = np.full(len(text), -1, dtype=np.int64)
        word[at] = np.arange(len(at))
        return word[place], window, longest

    def _bound(self, array: np.ndarray, text: np.ndarray, asked: np.ndarray, after: bool) -> np.ndarray:
        """The place in the array of the first suffix that isn't before (or is after) each window."""
        lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), len(array), np.int64)
        while len(open_ := np.flatnonzero(lo < hi)):
            middle = (lo[open_] + hi[open_]) // 2
            sign = np.zeros(len(open_), dtype=np.int64)
            same, depth = np.arange(len(open_)), 0
            while len(same):
                window = asked[open_[same]]
                sign[same] = np.sign(text[array[middle[same]] + depth] - self.words[self.at[window] + depth])
                depth += 1
                same = same[(sign[same] == 0) & (depth < self.size[window])]
            right = sign <= 0 if after else sign < 0
            lo[open_[right]], hi[open_[~right]] = middle[right] + 1, middle[~right]
        return lo


def _found(test: TestSet, text) -> Iterator[tuple[int, np.ndarray, list[str], int]]:
    """n_words, covered flags, items and longest match of each row of a text column."""
    buf, off = arrow_text(text)
    for lo, hi in slices(off, SHARD_BYTES):
        w = Words(buf, off[lo : hi + 1], ALNUM_WORDS, lower=True)
        place, window, longest = test.find(w)
        step = np.bincount(place, minlength=len(w.hash) + 1) - np.bincount(place + test.size[window], minlength=len(w.hash) + 1) if len(place) else np.zeros(len(w.hash) + 1, np.int64)
        covered = np.cumsum(step)[: len(w.hash)] > 0
        row = np.searchsorted(w.first, place, side="right") - 1
        order = np.argsort(row, kind="stable")
        item, longest = test.item[window[order]], longest[order]
        cut = np.searchsorted(row[order], np.arange(hi - lo + 1))
        for r in range(hi - lo):
            x, y = int(cut[r]), int(cut[r + 1])
            items = sorted({test.ids[k] for k in np.unique(item[x:y]).tolist()} - {None}) if y > x else []
            yield int(w.first[r + 1] - w.first[r]), covered[w.first[r] : w.first[r + 1]], items, int(longest[x:y].max()) if y > x else 0


def _spans(covered: np.ndarray) -> list[dict]:
    turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).tolist()
    return [{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]


def _blocks(items: DataFrame, id_column: str, text_column: str, n: int) -> tuple[int, Iterator[TestSet]]:
    """How many blocks the test set has, and the blocks, each made when it is asked for."""
    items = items.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // (BLOCK_BYTES // 2)) or 1

    def made() -> Iterator[TestSet]:
        for k in range(count):
            rows = items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k).collect()
            yield TestSet([r.id for r in rows], [r.text for r in rows], n)

    return count, made()


def _row(count: int, covered: np.ndarray, items: list[str], longest: int) -> dict:
    return {"n_words": count, "n_hit": int(covered.sum()), "n_items": len(items), "items": items, "longest": longest, "spans": _spans(covered) if covered.any() else []}


_FINAL = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("spans", _SPAN)])


def _match(test: TestSet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            rows = [_row(*found) for found in _found(test, batch["text"])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], **{f.name: pa.array([r[f.name] for r in rows], f.type) for f in _FINAL if f.name != "doc_id"}}, schema=_FINAL)

    return run


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with 128 bits that tell texts apart."""
    return docs.withColumns({"__key1": F.xxhash64(F.col(text)), "__key2": F.xxhash64(F.lit("second"), F.col(text))})


def _hits(docs: DataFrame, text: str, blocks: Iterator[TestSet]) -> DataFrame:
    """__key1, __key2, items, longest, spans of the texts with hits, a row for each block and copy; one block after the other."""
    folder = f"{shared_folder(docs.sparkSession)}/hits-{uuid.uuid4().hex}"
    schema = f"__key1 long, __key2 long, items array<string>, longest long, spans {SPANS}"
    rows = _keyed(docs.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL"), "text")
    for k, test in enumerate(blocks):

        def run(batches: Iterator[pa.RecordBatch], test=test) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                release()
                found = [(i, items, most, _spans(covered)) for i, (_, covered, items, most) in enumerate(_found(test, batch["text"])) if covered.any()]
                at = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_pydict({"__key1": batch["__key1"].take(at), "__key2": batch["__key2"].take(at), "items": pa.array([x[1] for x in found], pa.list_(pa.string())), "longest": pa.array([x[2] for x in found], pa.int64()), "spans": pa.array([x[3] for x in found], _SPAN)})

        rows.mapInArrow(of_batches(run), schema).write.parquet(f"{folder}/block={k}")
    return docs.sparkSession.read.schema(schema).parquet(*(f"{folder}/block={i}" for i in range(k + 1)))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from texts and the hits of all blocks."""
    for batch in batches:
        buf, off = arrow_text(batch["text"])
        rows = []
        for lo, hi in slices(off):
            first = Words(buf, off[lo : hi + 1], ALNUM_WORDS, lower=True).first
            for r in range(lo, hi):
                n = int(first[r - lo + 1] - first[r - lo])
                covered = np.zeros(n, dtype=bool)
                for s in batch["spans"][r].as_py() or ():
                    covered[s["start"] : s["end"]] = True
                rows.append(_row(n, covered, sorted(set(batch["items"][r].as_py() or ())), batch["longest"][r].as_py() or 0))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], **{f.name: pa.array([r[f.name] for r in rows], f.type) for f in _FINAL if f.name != "doc_id"}}, schema=_FINAL)


def matches(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, longest (words of the longest verbatim match) and spans (hit words) of each document."""
    count, blocks = _blocks(items, item_id, item_text, n)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    if count == 1:
        return rows.mapInArrow(of_batches(_match(next(blocks))), RESULT)
    all_ = lambda c: F.flatten(F.collect_set(c)).alias(c)  # of one text
    hits = written(_hits(rows, "text", blocks).groupBy("__key1", "__key2").agg(all_("items"), F.max("longest").alias("longest"), all_("spans"), F.count("*").alias("n")))
    met = answered(_keyed(rows, "text"), hits, ["__key1", "__key2"], F.xxhash64("doc_id"))
    return met.select("doc_id", "text", "items", "longest", "spans").mapInArrow(of_batches(_joined), RESULT)


def clean(docs: DataFrame, items: DataFrame, text_column: str = "text", item_text: str = "text", n: int = 10) -> DataFrame:
    """The documents, with all their columns, in which no window of any item occurs."""
    count, blocks = _blocks(items, item_text, item_text, n)
    if count > 1:
        hits = written(_hits(docs, text_column, blocks).groupBy("__key1", "__key2").agg(F.lit(True).alias("__hit"), F.count("*").alias("n")))
        met = answered(_keyed(docs, text_column), hits, ["__key1", "__key2"], F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind)))
        return met.where("__hit IS NULL").select(docs.columns)
    test = next(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            hit = [bool(covered.any()) for _, covered, _, _ in _found(test, batch.column(text_column).cast(pa.string()))]
            yield batch.filter(pa.array([not x for x in hit], pa.bool_()))

    return docs.mapInArrow(of_batches(run), docs.schema)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = matches(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The digest's rows in DuckDB SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw), gs AS (SELECT DISTINCT k, g FROM bw),
dw AS (
  SELECT rid, i, k, list_slice(w, i, i + k - 1) AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), hits AS (
  SELECT rid, i, dw.k, dw.g FROM dw JOIN gs ON dw.k = gs.k AND dw.g = gs.g
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, i + unnest(range(0, k)) AS p FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits JOIN bw ON hits.k = bw.k AND hits.g = bw.g) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
