"""Exchange of hashes between groups of documents and hash buckets, as packed arrays.

Rolling windows give about as many hashes as a corpus has words. As rows they
would shuffle some 30 bytes each; here a group of documents (some MB of text,
dealt by a hash of id and text) packs its distinct hashes into one row for each
bucket, so that a hash costs a few bytes. A hash that all documents have comes
once for each group, whoever has it, and so does its answer: what the documents
of a group say together is worked out in the group, before and after. Buckets
are a share of the hash space whose number follows the input's size, so one
bucket's arrays stay bounded; so does the number of partitions (``spread``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import U64

#: part: bucket or group. kind: what the hashes are. origin: the group that asks, or the bucket that answers.
PACKED = "part long, kind int, origin int, hashes binary, ids binary, counts binary, extra binary"
ARROW = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("origin", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("extra", pa.binary())])


def grouped(docs: DataFrame, id_column: str, text_column: str, groups: int, size: int) -> DataFrame:
    """Ids, texts and their group; the same plan each time, so its exchange is reused."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return spread(rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(groups).cast("long"))), "part", size)


def spread(df: DataFrame, key: str, size: int, each: int = 128 << 20) -> DataFrame:
    """``df`` dealt by ``key`` over partitions of about ``each`` of ``size`` bytes, where the session's number of partitions is too small for that."""
    n = -(-size // each)
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def packed(kind: int, origin: int, part: np.ndarray, hashes: np.ndarray, ids: np.ndarray | None = None, extra: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row a part of the hashes, with an id each (stored once for hashes in a row) and something more, if given."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.uint16) if int(part.max()) < 1 << 16 else part, kind="stable")  # a radix sort if of 16 bits
    part, hashes = part[order], hashes[order]
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    out: dict[str, list] = {name: [] for name in ARROW.names}
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True):
        out["part"].append(int(part[a]))
        out["hashes"].append(hashes[a:b].tobytes())
        own = ids[order[a:b]] if ids is not None else np.zeros(0, np.int64)
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        out["ids"].append(own[heads].tobytes())
        out["counts"].append(np.diff(np.append(heads, len(own))).astype(np.uint32).tobytes())
        out["extra"].append(extra[order[a:b]].tobytes() if extra is not None else None)
    n = len(out["part"])
    yield pa.RecordBatch.from_pydict(out | {"kind": [kind] * n, "origin": [origin] * n}, schema=ARROW)


def together(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema=ARROW)


def unpack(table: pa.Table, dtype=np.uint32, extra_dtype=None) -> tuple[np.ndarray, ...]:
    """Hashes, and for each: its kind, its origin, its id (or none), what more there is (or none)."""

    def joined(name: str, of) -> np.ndarray:
        return np.frombuffer(b"".join(x for x in table[name].to_pylist() if x), dtype=of)

    each = np.array([len(x) // np.dtype(dtype).itemsize for x in table["hashes"].to_pylist()], dtype=np.int64)
    of_row = lambda name: np.repeat(np.array(table[name].to_pylist(), dtype=np.int32), each)
    ids = np.repeat(joined("ids", np.int64), joined("counts", np.uint32))
    return joined("hashes", dtype), of_row("kind"), of_row("origin"), ids, joined("extra", extra_dtype) if extra_dtype else None


def place_key(origins: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One key for a bucket and a hash of 32 bits in it."""
    return origins.astype(U64) << U64(32) | hashes.astype(U64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts, where each distinct value starts in it, and the number of its value for each place of the input."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(values) else np.zeros(0, bool)
    number = np.empty(len(values), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


class Members:
    """A set of 64-bit keys; most of what isn't in it is told by a table of bits, before the binary search."""

    def __init__(self, keys: np.ndarray):
        keys = np.sort(keys)
        self.keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        self.mask = U64((1 << max(10, (8 * len(self.keys)).bit_length())) - 1)
        self.table = np.zeros(int(self.mask) + 1, dtype=bool)
        self.table[self.keys & self.mask] = True

    def __contains__(self, key) -> bool:
        return bool(self.has(np.array([key], dtype=self.keys.dtype))[0])

    def has(self, asked: np.ndarray) -> np.ndarray:
        out = self.table[asked & self.mask]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, asked[maybe]), len(self.keys) - 1)
            out[maybe] = self.keys[at] == asked[maybe]
        return out
