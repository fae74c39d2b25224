"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles. All sets are ordered alike,
rare shingles first. If sets x and y (x not the larger) have similarity t or
more, they share at least m tokens of x's first ``|x| - ceil(2t/(1+t) |x|) + m``
(its index prefix) and y's first ``|y| - ceil(t |y|) + m`` (its probe prefix).
Each document chooses its own m: longer prefixes are posted where the estimated
cost of candidates (from the shingles' frequencies) is high, and then a pair
must share min(m, m') of them before it is verified.

Plan: (1) the texts are exchanged once, by groups of some MB; each group's distinct
shingle hashes go to hash buckets, packed, with the number of its documents that
have them; (2) buckets answer each group with the frequencies above 1, so that
order, prefixes and m are known; documents whose prefix is all of single shingles
cannot have a partner and post nothing; equal sets are one class from here on;
(3) documents are dealt into blocks by their smallest shared token (a min-hash),
so near copies mostly meet in one block; a crowded token's documents are salted
over several; (4) posting lists of index prefixes tell which documents of other
blocks must probe a block too, and they come in parts of bounded size; prefix
matches are counted and candidates verified there by sparse counting, pair by
pair but not as rows; a block returns links that span what it found linked, or
all of them on demand; (5) connected components.

Where tokens are crowded and only components are asked for, (4) comes in two
rounds: crowded blocks are verified by themselves, then one document of each
component found there meets those of the other blocks in blocks of their own;
and a document then probes a block at a token only if not all that the block has
there is of its own component. So a large group of near copies makes rows in
proportion to its members, exactly: what is skipped is connected already.

No task holds more than a block and a part. Sets are verified by 64-bit hashes
of their shingles.

Edge cases: null or wordless text is an empty set, linked with nothing; with
fewer words than ``k`` the whole sequence is the one shingle; rows that share an
id count as one document whose links are theirs together; a row with a null id
is returned with a null component; columns but the two named are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import PACKED, Members, grouped, packed, place_key, runs, spread, together, unpack
from .components import answered, components, cut, few
from .textcore import NO_ID, SPACE_WORDS, U64, Words, arrow_ids, arrow_text, bucket_count, input_bytes, mix, of_group, of_groups, ranges, release, slices, window_hash

_SEED = 21
#: The longest m, and what verifying a candidate costs against reading a posting.
MOST_MATCHES, VERIFY_COST = 4, 10.0
#: Shingles of the documents in a block, of those of other blocks that probe it at once, and pairs of equal tokens counted at once.
BLOCK_TOKENS, PART_TOKENS, MEETINGS = 600_000, 2_000_000, 2_000_000
#: A token that more than so many documents of one component are posted under is told by broadcast where these are few.
HOT_TOKEN = 1000
SETS = "doc_id long, n_shingles long, f1 long, f2 long, m int, n_index int, home long, prefix array<long>, tokens binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("m", pa.int32()), ("n_index", pa.int32()), ("home", pa.int64()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])


def _sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h = window_hash(w.hash, k, _SEED)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        yield np.unique(h[a : b - k + 1]) if b - a >= k else window_hash(w.hash[a:b], b - a, _SEED) if b > a else h[:0]


def _shift(buckets: int) -> U64:
    return U64(64 - (buckets.bit_length() - 1))


def _post(k: int, buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        release()
        ids = arrow_ids(docs["id"])
        buf, off = arrow_text(docs["text"])
        h = [np.zeros(0, U64)]
        for lo, hi in slices(off):
            h += [s for s, me in zip(_sets(Words(buf, off[lo : hi + 1], SPACE_WORDS, lower=True), k), ids[lo:hi], strict=True) if me != NO_ID]
        h, count = np.unique(np.concatenate(h), return_counts=True)
        return together(packed(0, docs["part"][0].as_py(), (h >> _shift(buckets)).astype(np.int64), h.astype(np.uint32), extra=np.minimum(count, 65535).astype(np.uint16)))

    return run


def _count(table: pa.Table) -> pa.Table:
    release()
    h, _, group, _, count = unpack(table, extra_dtype=np.uint16)
    order, heads, number = runs(h)
    total = np.add.reduceat(count[order].astype(np.int64), heads)[number] if len(h) else np.zeros(0, np.int64)
    shared = total > 1
    return together(packed(0, table["part"][0].as_py(), group[shared], h[shared], extra=np.minimum(total, 65535)[shared].astype(np.uint16)))


def _unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a column, and the n + 1 offsets."""
    each = [x or b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(each), dtype=U64), np.append(0, np.cumsum([len(x) // 8 for x in each])).astype(np.int64)


def choose_m(frequency: np.ndarray, base: int, most: int) -> int:
    """How many prefix tokens to ask for: the m with the least estimated cost.

    frequency: of the document's tokens, rare first. A list of f documents costs
    f - 1 readings; at most a share 1 / m of the readings can be of documents
    that are met m times, and each of those is verified.
    """
    readings = np.cumsum(frequency[: base + most - 1] - 1.0)
    costs = [(readings[min(base + m - 1, len(readings)) - 1] * (1 + VERIFY_COST / m), m) for m in range(1, most + 1)]
    return min(costs)[1]


def _prefixes(k: int, num: int, den: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        h_, _, origins, _, counts = unpack(answers, extra_dtype=np.uint16)
        keys = place_key(origins, h_)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.int64)
        ids = arrow_ids(docs["id"])
        order = np.argsort(ids, kind="stable")  # the smallest id of equal sets comes first
        docs, ids = docs.take(order), ids[order]
        buf, off = arrow_text(docs["text"])
        out: dict[str, list] = {name: [] for name in _SETS.names}
        seen: set[tuple[int, int, int]] = set()
        for lo, hi in slices(off):
            for r, s in zip(range(lo, hi), _sets(Words(buf, off[lo : hi + 1], SPACE_WORDS, lower=True), k), strict=True):
                n, me = len(s), int(ids[r])
                print_ = (n, int(mix(s ^ U64(0x51ED270B)).sum().view(np.int64)), int(mix(s + U64(0x2545F4914F6CDD1D)).sum().view(np.int64)))
                m, n_index, home, prefix, tokens = None, None, None, None, None
                if n and me != NO_ID and print_ not in seen and len(keys):
                    seen.add(print_)
                    asked = place_key(s >> _shift(buckets), s.astype(np.uint32))
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    frequency = np.where(keys[at] == asked, counts[at], 1)
                    least = -(-num * n // den)
                    base, short = n - least + 1, n - (-(-2 * num * n // (num + den))) + 1
                    if (frequency > 1).sum() > n - base:
                        order = np.lexsort((s, frequency))
                        m = choose_m(frequency[order], base, min(MOST_MATCHES, least))
                        first = order[: base + m - 1]
                        shared = frequency[first] > 1
                        n_index = int(shared[: short + m - 1].sum())
                        prefix = s[first[shared]].view(np.int64)
                        shared = s[frequency > 1]
                        home, tokens = int(shared[0].view(np.int64)), shared.tobytes()
                for name, x in zip(_SETS.names, (me if me != NO_ID else None, *print_, m, n_index, home, prefix, tokens), strict=True):
                    out[name].append(x)
        return pa.Table.from_pydict(out, schema=_SETS)

    return run


class _Forest:
    """Union-find over whatever is asked."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column as unsigned, and the n + 1 offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array([0, *pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)], dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64), np.cumsum(lengths)


class _Lists:
    """Which of up to BLOCK classes have a token."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, upto: np.ndarray | None = None):
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        if upto is not None:
            keep = np.arange(len(values)) - offsets[owner] < upto[owner]
            values, owner = values[keep], owner[keep]
        order = np.argsort(values, kind="stable")
        values, self.owner = values[order], owner[order]
        heads = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        self.keys, self.first = values[heads], np.append(heads, len(values))
        self.members = Members(self.keys)

    def counts(self, values: np.ndarray, row: np.ndarray, n_rows: int, n_classes: int) -> np.ndarray:
        """How many of each row's tokens each class has."""
        at = np.flatnonzero(self.members.has(values))
        key = np.searchsorted(self.keys, values[at])
        size = self.first[key + 1] - self.first[key]
        before = np.cumsum(size) - size
        out = np.zeros(n_rows * n_classes, dtype=np.int64)
        lo = 0
        while lo < len(at):  # MEETINGS at once
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + MEETINGS)))
            met = np.repeat(row[at[lo:hi]], size[lo:hi]) * n_classes + self.owner[ranges(self.first[key[lo:hi]], size[lo:hi])]
            out += np.bincount(met, minlength=n_rows * n_classes)
            lo = hi
        return out.reshape(n_rows, n_classes)


def _verify(num: int, den: int, every: bool):
    """Links within a block (in its part 0, unless done), and with the documents of other blocks that probe it.

    What has one component already is linked; unless all links are wanted, only those that connect more are returned.
    """

    def run(block: pa.Table, part: pa.Table) -> pa.Table:
        release()
        out: list[tuple[int, int]] = []
        forest = _Forest()
        for side in (block, part):
            for x, y in zip(side["doc_id"].to_pylist(), side["component"].to_pylist(), strict=True):
                forest.join(x, y)
        if len(block):
            block = block.sort_by("doc_id")
            kept: dict[tuple, int] = {}
            for i, x in enumerate(zip(*(block[k].to_pylist() for k in ("f1", "f2", "n_shingles")), strict=True)):
                kept.setdefault(x, i)  # one of equal sets
            block = block.take(list(kept.values()))
            nodes, sizes, ms = (block[k].to_numpy() for k in ("doc_id", "n_shingles", "m"))
            index = _Lists(*_flat(block["prefix"]), block["n_index"].to_numpy())
            whole = _Lists(*_unpacked(block["tokens"]))
            sides = [part] if block["part"][0].as_py() or block["done"][0].as_py() else [block, part]
        for side in sides if len(block) else []:
            y_nodes, y_sizes, y_ms = (side[k].to_numpy() for k in ("doc_id", "n_shingles", "m"))
            (prefix, at), (tokens, to) = _flat(side["prefix"]), _unpacked(side["tokens"])
            step = max(1, (1 << 18) // len(nodes))
            for lo in range(0, len(y_nodes), step):
                hi = min(lo + step, len(y_nodes))
                row = lambda o: np.repeat(np.arange(hi - lo), np.diff(o[lo : hi + 1]))  # noqa: B023, E731
                matches = index.counts(prefix[at[lo] : at[hi]], row(at), hi - lo, len(nodes))
                yn, yk, ym = (x[lo:hi, None] for x in (y_sizes, y_nodes, y_ms))
                maybe = (matches >= np.minimum(ms, ym)) & ((sizes < yn) | ((sizes == yn) & (nodes < yk))) & (sizes * den >= yn * num)
                if not maybe.any():
                    continue
                both = whole.counts(tokens[to[lo] : to[hi]], row(to), hi - lo, len(nodes))
                linked = maybe & (both * den >= (sizes + yn - both) * num)
                for y, x in zip(*np.nonzero(linked), strict=True):
                    a, b = int(nodes[x]), int(y_nodes[lo + y])
                    if every or forest.join(a, b):
                        out.append((min(a, b), max(a, b)))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


class JaccardJoin:
    """``sets`` (a row a document), ``classes`` of equal sets, ``posting`` (documents that may have partners) and what follows."""

    def __init__(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 4, num: int = 85, den: int = 100):
        self.num, self.den = num, den
        self.size = size = input_bytes(docs.select(text_column), text_column)
        buckets, groups = bucket_count(size), bucket_count(size, each=8 << 20, least=16)
        texts = grouped(docs, id_column, text_column, groups, size)
        asked = spread(texts.groupBy("part").applyInArrow(of_group(_post(k, buckets)), PACKED), "part", size)
        answers = spread(asked.groupBy("part").applyInArrow(of_group(_count), PACKED), "part", size)
        self.sets = cut(texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(of_groups(_prefixes(k, num, den, buckets)), SETS))
        full = self.sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
        self.classes = cut(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
        self.posting = self.sets.where("prefix IS NOT NULL")

    def _dealt(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``rows`` with the block of each and whether its home is crowded, and the crowded homes."""
        weights = rows.groupBy("home").agg(F.sum("n_shingles").alias("w"))
        total = weights.agg(F.sum("w")).first()[0] or 0
        crowded = cut(weights.where(F.col("w") > BLOCK_TOKENS).select(F.col("home").alias("crowd"), F.ceil(F.col("w") / BLOCK_TOKENS).alias("salts")))
        salt = F.pmod(F.xxhash64("f1", "f2"), F.col("salts"))  # equal sets stay together
        light = F.pmod(F.xxhash64("home"), F.lit(-(-total // BLOCK_TOKENS) or 1))
        dealt = rows.join(few(crowded), F.col("home") == F.col("crowd"), "left").withColumn("is_crowded", F.col("crowd").isNotNull())
        block = F.when(F.col("is_crowded"), F.xxhash64("crowd", salt)).otherwise(light)
        return dealt.withColumn("block", block).drop("crowd", "salts"), crowded

    def _verified(self, left: DataFrame, right: DataFrame, every: bool) -> DataFrame:
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # names of their own on either side
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(of_groups(_verify(self.num, self.den, every)), "a long, b long")

    def _alone(self, rows: DataFrame) -> DataFrame:
        """Links within blocks that no one probes."""
        whole = rows.select("doc_id", "block", F.lit(0).alias("part"), "n_shingles", "f1", "f2", "m", "n_index", "prefix", "tokens", F.col("doc_id").alias("component"), F.lit(False).alias("done"))
        return self._verified(whole, whole.where("false"), False)

    def _settled(self, dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
        """node, component of documents of crowded homes, by what is linked within their blocks and among one of each component; and those links."""
        crowd = dealt.where("is_crowded")
        within = cut(self._alone(crowd))
        first = crowd.join(components(within), F.col("doc_id") == F.col("node"), "left").where("component IS NULL OR component = doc_id")
        firsts, _ = self._dealt(cut(first.select(self.posting.columns)))
        links = cut(within.union(self._alone(firsts)))
        return cut(components(links)), links

    def links(self, every: bool = True) -> DataFrame:
        """a, b: pairs of documents that are similar; of equal sets the smallest id stands for all.

        All pairs (of a block's and a probing document's sets), or enough to connect what is connected.
        """
        dealt, crowded = self._dealt(self.posting)
        settle = not every and not crowded.isEmpty()
        early = None
        if settle:
            parts, early = self._settled(dealt)
            dealt = dealt.join(parts, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).withColumn("done", F.col("is_crowded")).drop("node")
            dealt = cut(dealt)
        else:
            dealt = dealt.withColumn("component", F.col("doc_id")).withColumn("done", F.lit(False))
        narrow = dealt.select("doc_id", "component", "block", "n_shingles", "n_index", "prefix")
        index = narrow.select("block", "component", F.explode(F.slice("prefix", 1, F.col("n_index"))).alias("token"))
        probes = narrow.select("doc_id", "component", F.col("block").alias("own"), F.col("n_shingles").alias("weight"), F.explode("prefix").alias("token"))
        if settle:
            index = index.groupBy("block", "token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
            alike = index.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low = high").select(F.col("token").alias("settled"), F.col("low").alias("by"), "n")
            same = (F.col("token") == F.col("settled")) & (F.col("component") == F.col("by"))
            hot = few(cut(alike.where(F.col("n") > HOT_TOKEN)))
            probes = probes.join(hot, same, "left_anti").join(alike, same, "left_anti")
            met = index.join(probes, "token").where("block <> own AND NOT (low = high AND low = component)")
        else:
            met = index.select("block", "token").distinct().join(probes, "token").where("block <> own")
        met = cut(met.select("block", "doc_id", "weight").distinct())
        parts = met.groupBy("block").agg(F.ceil(F.sum("weight") / PART_TOKENS).cast("int").alias("parts"))
        left = dealt.join(parts, "block", "left").where("NOT done OR parts IS NOT NULL")
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
        left = left.select("doc_id", "block", "part", "n_shingles", "f1", "f2", "m", "n_index", "prefix", "tokens", "component", "done")
        met = met.join(parts, "block").select("block", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "doc_id")
        right = met.join(dealt.select("doc_id", "n_shingles", "m", "prefix", "tokens", "component"), "doc_id")
        found = self._verified(left, right, every)
        found = found.union(early) if early is not None else found
        # to the smallest ids of equal sets
        own = answered(self.posting.select("doc_id", "f1", "f2", "n_shingles"), self.classes, ["f1", "f2", "n_shingles"], F.xxhash64("doc_id")).where("doc_id <> node").select("doc_id", "node")
        for side in ("a", "b"):
            found = found.join(own.toDF(side, "node"), side, "left").withColumn(side, F.coalesce("node", side)).drop("node")
        return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def components(self) -> DataFrame:
        """node, component of every class of equal sets (by its smallest id) that has links."""
        return components(self.links(every=False))

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, component_id: a row a document."""
        parts = self.components().withColumnRenamed("node", "root")
        classes = self.classes.join(parts, F.col("node") == F.col("root"), "left").select("f1", "f2", "n_shingles", F.coalesce("component", "node").alias("component"), "n")
        own = answered(self.sets.select("doc_id", "n_shingles", "f1", "f2"), cut(classes), ["f1", "f2", "n_shingles"], F.xxhash64("doc_id"))
        own = own.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
        return own.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id: documents of shingle-set similarity num / den or more are linked."""
    return JaccardJoin(docs, id_column, text_column, k, num, den).documents()


#: The rows of ``jaccard_components`` with its default parameters in DuckDB SQL.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, hash(list_slice(w, i, i + 3)) AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0))
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id AS root, doc_id AS met FROM n UNION SELECT reach.root, links.b FROM reach JOIN links ON reach.met = links.a
), parts AS (
  SELECT root, min(met) AS component_id FROM reach GROUP BY root
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN parts ON parts.root = w.doc_id
"""
