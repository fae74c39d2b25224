"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its nearest pivots: its rank at each
pivot. The ranks are posted by pivot (a file of ranks for each pivot, over the
vectors of a block), a query adds up |its rank - theirs| file by file, which is
Spearman's footrule, and the vectors of the smallest footrule are reranked by
the exact cosine in double precision.

The pivots are ``PIVOTS`` vectors (those of the smallest hash of their id), the
only sample; every vector is indexed, under all pivots: files of each vector's
nearest few only were measured at recalls of 0.2 to 0.8 on vectors without
clusters. Vectors and queries are dealt by hash into blocks of about ``BLOCK`` and
``QUERIES`` rows; each pair of blocks is a group of its own, so that nothing goes
through the driver, no task grows with the data, and results do not depend on how
rows lie in files. A query reranks the best ``SHARE`` of each block, so the work
follows the data; nothing is capped. A block answers with its k best, merged by
window. Identical vectors have one footrule and are ordered by id, so a crowd of
them costs no more than others.

Edge cases: vectors that are null, empty, zero, of another length than most
(ties: the shorter), or hold null or non-finite components take no part, and
neither does a null id; a query alone has no neighbours and no row; rows that
repeat an id are different candidates and queries, each with k answers, but one
query's own id is never its neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textcore import release

PIVOTS, SHARE, BLOCK, QUERIES = 128, 0.12, 8192, 2048
RESULT = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("copies", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def ranks(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The rank of each pivot in each vector's order of pivots by cosine (ties: the earlier pivot)."""
    order = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return out


def footrule(queries: np.ndarray, files: np.ndarray) -> np.ndarray:
    """Distances of queries (rows of ranks) to the vectors of a batch, whose ranks come by pivot."""
    total = np.zeros((len(queries), files.shape[1]), dtype=np.int32)
    step = np.empty(files.shape[1], dtype=np.int16)
    for q, own in enumerate(queries):
        row = total[q]
        for pivot, rank in enumerate(own):
            np.subtract(files[pivot], rank, out=step)
            np.abs(step, out=step)
            row += step
    return total


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact cosines, each by the same sum of products in double precision."""
    dots = np.add.reduce(vectors * query, axis=1)
    return dots / (np.sqrt(np.add.reduce(vectors * vectors, axis=1)) * np.sqrt(np.add.reduce(query * query)))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _search(pivots: np.ndarray, k: int, share: float):
    """The best k of a block of vectors for each of a block of queries."""
    pivots = _unit(pivots)

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        release()
        out: dict[str, list] = {name: [] for name in RESULT.names}
        if len(block) and len(asked):
            ids, vectors = block["id"].to_numpy(), _matrix(block["v"])
            order = np.lexsort((block["key"].to_numpy(), ids))
            ids, vectors = ids[order], vectors[order]
            query_ids, keys, copies, queries = (*(asked[c].to_numpy() for c in ("id", "key", "copies")), _matrix(asked["v"]))
            files = np.ascontiguousarray(ranks(_unit(vectors), pivots).T)
            query_ranks = ranks(_unit(queries), pivots)
            take = min(len(ids), max(4 * k, int(np.ceil(share * len(ids)))) + 1)  # one more: the query itself may be among them
            for lo in range(0, len(query_ids), 256):
                for q, row in enumerate(footrule(query_ranks[lo : lo + 256], files), lo):
                    place = row.astype(np.int64) * len(ids) + np.arange(len(ids))  # ties: the smaller id
                    near = np.argpartition(place, take - 1)[:take] if take < len(ids) else np.arange(len(ids))
                    near = near[ids[near] != query_ids[q]]
                    scores = cosines(queries[q], vectors[near])
                    top = best(ids[near], scores, k)
                    if len(top):
                        for name, x in zip(RESULT.names, (int(query_ids[q]), int(keys[q]), int(copies[q]), ids[near][top], scores[top]), strict=True):
                            out[name].append(x)
        return pa.Table.from_pydict(out, schema=RESULT)

    return run


def nearest(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, every: int = 50, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("asked")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes or not sizes[0].asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes[0].d).withColumn("key", F.xxhash64("v"))
    pivots = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id", "key").limit(PIVOTS).select("v").collect()])
    parts = lambda n, each: F.lit(-(-n // each))
    every_part = lambda n, each: F.explode(F.sequence(F.lit(0).cast("long"), (parts(n, each) - 1).cast("long")))
    blocks, groups = (sizes[0].n, BLOCK), (sizes[0].asked, QUERIES)
    asked = rows.where(F.col("id") % every == 0).groupBy("id", "key", "v").agg(F.count("*").alias("copies"))
    asked = asked.select("id", "key", "copies", "v", F.pmod(F.xxhash64("id", "key"), parts(*groups)).alias("group"), every_part(*blocks).alias("block"))
    rows = rows.select("id", "key", "v", F.pmod(F.xxhash64("key", "id"), parts(*blocks)).alias("block"), every_part(*groups).alias("group"))
    found = rows.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(_search(pivots, k, share), "query_id long, key long, copies long, vec_ids array<long>, scores array<double>")
    flat = found.select("query_id", "key", "copies", F.explode(F.arrays_zip("vec_ids", "scores")).alias("x")).select("query_id", "key", "copies", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    best_ = flat.withColumn("rank", rank).where(F.col("rank") <= k)
    return best_.select("query_id", "rank", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("col")
