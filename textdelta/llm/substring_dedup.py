"""Substring dedup with fixed-block anchors.

A run of ``window`` words that repeats an earlier document covers at least one
whole block of ``(window + 1) // 2`` words wherever the earlier document's
non-overlapping blocks lie. So the blocks of every document are indexed as
anchors, and every rolling window of a block's length probes them. Hits are
then extended: all windows around a hit are compared exactly (64-bit hashes in
buckets of a second hash), which leaves the maximal exact repeats.

Plan: (1) the texts are exchanged once, by groups of some MB, which all steps
reuse; each group's distinct probes and anchors go to hash buckets, packed; (2) a
bucket answers the hashes that an anchor and another document's probe share; (3)
groups send the windows around hits, each once with the smallest id that the
group knows; (4) a bucket answers those whose smallest document is in another
group; (5) with these, and with what documents of the group hold before others,
covered words go. So a passage that all documents hold is one hash a group, not
one a document, in its bucket; nothing pairs documents.

Edge cases: null text is a text without words; a text shorter than ``window``
loses nothing; a row with a null id loses nothing and takes nothing from others;
rows that share an id are each returned, and take nothing from each other;
columns but the two named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import ARROW, PACKED, Members, grouped, packed, place_key, runs, spread, together, unpack
from .textcore import NO_ID, SPACE_WORDS, U64, Words, arrow_ids, arrow_text, bucket_count, input_bytes, of_group, of_groups, release, slices, window_hash, window_starts

#: What a group says of a hash, added up: more than one of its documents has it; it is an anchor of one.
SEVERAL, ANCHOR = 1, 2
_BLOCK_SEED, _WINDOW_SEED, _PLACE_SEED = 11, 12, 13
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())])


def _bits(n: int) -> U64:
    return U64(64 - (n.bit_length() - 1))


def _windows(docs: pa.Table, size: int, seed: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, and place in its row of each window in the rows that have an id and ``least`` words."""
    ids = arrow_ids(docs["id"])
    buf, off = arrow_text(docs["text"])
    none = np.zeros(0, np.int64)
    found = [(none.view(U64), none, none)]
    for lo, hi in slices(off):
        w = Words(buf, off[lo : hi + 1], SPACE_WORDS)
        at = window_starts(w.first, size)
        row = w.rows()[at]
        good = (np.diff(w.first)[row] >= least) & (ids[lo:hi][row] != NO_ID)
        at, row = at[good], row[good]
        if len(at):
            found.append((window_hash(w.hash, size, seed)[at], row + lo, at - w.first[row]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _lowest(ids: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(ids[order], heads) if len(heads) else ids[:0]


def _probe(window: int, buckets: int):
    block = (window + 1) // 2

    def run(docs: pa.Table) -> pa.Table:
        release()
        h, row, place = _windows(docs, block, _BLOCK_SEED, window)
        ids = arrow_ids(docs["id"])[row]
        order, heads, _ = runs(h)
        if not len(heads):
            return ARROW.empty_table()
        low, high = _lowest(ids, order, heads), np.maximum.reduceat(ids[order], heads)
        anchor = np.logical_or.reduceat((place % block == 0)[order], heads)
        kind = SEVERAL * (low != high) + ANCHOR * anchor
        h = h[order[heads]]
        part, low = (h >> _bits(buckets)).astype(np.int64), h.astype(np.uint32)
        group = docs["part"][0].as_py()
        return together(x for k in range(4) for x in packed(k, group, part[kind == k], low[kind == k]))

    return run


def _match(table: pa.Table) -> pa.Table:
    release()
    hashes, kind, group, _, _ = unpack(table)
    order, heads, number = runs(hashes)
    if not len(heads):
        return ARROW.empty_table()
    said = np.bitwise_or.reduceat(kind[order], heads)
    size = np.diff(np.append(heads, len(order)))
    shared = ((said & ANCHOR) > 0) & ((size > 1) | ((said & SEVERAL) > 0))
    hit = shared[number]
    return together(packed(0, table["part"][0].as_py(), group[hit], hashes[hit]))


def _extend(window: int, buckets: int):
    block = (window + 1) // 2

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        hits, _, origins, _, _ = unpack(answers)
        if not len(hits) or not len(docs):
            return ARROW.empty_table()
        hit_keys = Members(place_key(origins, hits))
        ids = arrow_ids(docs["id"])
        buf, off = arrow_text(docs["text"])
        found: list[tuple[np.ndarray, ...]] = []
        for lo, hi in slices(off):
            w = Words(buf, off[lo : hi + 1], SPACE_WORDS)
            at = window_starts(w.first, block)
            if not len(at):
                continue
            h = window_hash(w.hash, block, _BLOCK_SEED)[at]
            hit = np.zeros(len(w.hash) + 1, dtype=np.int32)
            hit[at + 1] = hit_keys.has(place_key(h >> _bits(buckets), h.astype(np.uint32)))
            before = np.cumsum(hit)
            at = window_starts(w.first, window)
            at = at[(before[at + window - block + 1] > before[at]) & (ids[lo:hi][w.rows()[at]] != NO_ID)]
            if len(at):
                place = window_hash(w.hash, window, _PLACE_SEED)[at] >> _bits(buckets)
                found.append((window_hash(w.hash, window, _WINDOW_SEED)[at], place.astype(np.int64), ids[lo:hi][w.rows()[at]]))
        if not found:
            return ARROW.empty_table()
        h, place, own = (np.concatenate(x) for x in zip(*found, strict=True))
        order, heads, _ = runs(h)
        own, first = _lowest(own, order, heads), order[heads]
        by_id = np.argsort(own, kind="stable")
        return together(packed(0, docs["part"][0].as_py(), place[first][by_id], h[first][by_id], own[by_id]))

    return run


def _repeats(table: pa.Table) -> pa.Table:
    release()
    hashes, _, group, ids, _ = unpack(table, np.uint64)
    order, heads, number = runs(hashes)
    later = _lowest(ids, order, heads)[number] < ids
    return together(packed(0, 0, group[later], hashes[later]))


def _remove(window: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        repeats = Members(unpack(answers, np.uint64)[0])
        ids = arrow_ids(docs["id"])
        h, row, place = _windows(docs, window, _WINDOW_SEED, window)
        order, heads, number = runs(h)
        gone = repeats.has(h) | (_lowest(ids[row], order, heads)[number] < ids[row])
        row, place = row[gone], place[gone]
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        buf, off = arrow_text(docs["text"])
        out: dict[str, list] = {name: [] for name in _RESULT.names}
        for r in range(len(ids)):
            words = buf[off[r] : off[r + 1]].tobytes().split()
            n, spans, own = len(words), [], place[cut[r] : cut[r + 1]]
            if len(own):
                step = np.bincount(own, minlength=n + 1) - np.bincount(own + window, minlength=n + 1)
                covered = np.cumsum(step)[:n] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).tolist()
                spans = [{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                words = list(compress(words, (~covered).tolist()))
            out["doc_id"].append(int(ids[r]) if ids[r] != NO_ID else None)
            out["n_words"].append(n)
            out["n_removed"].append(n - len(words))
            out["removed"].append(spans)
            out["kept_text"].append(b" ".join(words).decode())
        return pa.Table.from_pydict(out, schema=_RESULT)

    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 13) -> DataFrame:
    """Each document without the words that a window of ``window`` words starting in a document of smaller id covers.

    Returns doc_id, n_words, n_removed, removed (half-open spans of word places in the input) and kept_text.
    """
    size = input_bytes(docs.select(text_column), text_column)
    buckets, groups = bucket_count(size), bucket_count(size, each=8 << 20, least=16)
    texts = grouped(docs, id_column, text_column, groups, size)
    asked = spread(texts.groupBy("part").applyInArrow(of_group(_probe(window, buckets)), PACKED), "part", size)
    answers = spread(asked.groupBy("part").applyInArrow(of_group(_match), PACKED), "part", size)
    asked = spread(texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(of_groups(_extend(window, buckets)), PACKED), "part", size)
    answers = spread(asked.groupBy("part").applyInArrow(of_group(_repeats), PACKED), "part", size)
    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(of_groups(_remove(window)), RESULT)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept text."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The digest's rows in DuckDB SQL.
ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT rid, doc_id, i, hash(list_slice(w, i, i + 12)) AS h
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), least AS (
  SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h
), hits AS (
  SELECT DISTINCT rid, i + unnest(range(0, 13)) AS p
  FROM windows JOIN least USING (h) WHERE first_doc < doc_id
), gone AS (
  SELECT rid, list(p) AS ps FROM hits GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w
              ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (rid)
"""
