"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut where no piece can reach across (before a run of
word marks, and at characters that only occur alone), and the different parts
are concatenated. Their suffix array (to the depth of the longest piece) is
binary-searched for every piece of the vocabulary at once, character by
character, which gives each piece's range of occurrences. The occurrences are
edges over the text; sorted by position they are relaxed: for a unigram model
along positions to the best path, for a BPE model by rank, an edge joining two
neighbouring symbols that exactly fill it, best rank first and leftmost first.
Characters in no piece fall back to bytes, or to the unknown piece.

The vocabulary comes from a model file read on the driver, and goes to the
executors as it is (its size is the vocabulary's, not the data's). Encoded parts
are kept from batch to batch up to ``KEPT`` parts. There is no shuffle.

Edge cases: null text gives null tokens, empty text none; a text that holds the
word mark itself decodes to a space there, as in the library; what the model
cannot represent without byte fallback decodes to its unknown surface;
normalisation other than identity is refused; columns but the two named are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import arrow_text, of_batches, ranges, release, slices, span_hash

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of different parts indexed at once, and encoded parts that a worker keeps.
INDEX_CHARS, KEPT = 200_000, 300_000
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


class Vocabulary:
    """What a model file says: pieces, scores, and how texts are prepared."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.kind = model.trainer_spec.model_type
        self.byte_fallback = model.trainer_spec.byte_fallback
        norm = model.normalizer_spec
        if self.kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise NotImplementedError("only unigram and BPE models with identity normalisation")
        self.prefix = norm.add_dummy_prefix
        self.surface = model.trainer_spec.unk_surface.encode()
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = [0] * 256
        self.out: list[bytes] = []
        for i, p in enumerate(model.pieces):
            self.out.append(b"")
            if p.type in (_NORMAL, _USER):
                self.pieces[p.piece] = (i, p.score)
                self.out[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == _BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.out[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == _UNKNOWN:
                self.unknown = i
                self.out[i] = self.surface


class Codec:
    """Encodes parts of texts and keeps what it has encoded."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        known = sorted(vocabulary.pieces)
        self.known = known
        self.ids = np.array([vocabulary.pieces[p][0] for p in known], dtype=np.int64)
        self.scores = np.array([vocabulary.pieces[p][1] for p in known])
        self.ranks = np.unique(-self.scores, return_inverse=True)[1]  # equal scores have equal ranks
        self.sizes = np.array([len(p) for p in known], dtype=np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.codes = np.zeros((len(known), self.longest), dtype=np.uint32)
        for i, p in enumerate(known):
            self.codes[i, : len(p)] = [ord(c) for c in p]
        long_pieces = [p for p in known if len(p) > 1]
        reach = any(MARK in p.lstrip(MARK) for p in long_pieces)  # a piece that goes on over a word mark
        within = {c for p in long_pieces for c in p}
        self.whole = reach
        self.lone = np.zeros(256, dtype=bool)
        self.lone[[ord(c) for c in "\n\t\r\0" if c not in within]] = True
        self.ids_of: dict[int, bytes] = {}
        self.out_size = np.array([len(x) for x in vocabulary.out], dtype=np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(vocabulary.out), dtype=np.uint8)

    # the index ----------------------------------------------------------------

    def suffix_array(self, text: np.ndarray) -> np.ndarray:
        """The order of the suffixes of a text of code points, by their first ``longest`` characters."""
        n = len(text)
        wide = np.append(text, np.zeros(2, np.uint32)).astype(np.uint64)
        key = wide[:n] << np.uint64(42) | wide[1 : n + 1] << np.uint64(21) | wide[2:]
        reached = 3
        while True:
            order = np.argsort(key)
            if reached >= self.longest:
                return order
            s = key[order]
            rank = np.empty(n, dtype=np.uint64)
            rank[order] = np.cumsum(np.append(True, s[1:] != s[:-1]))
            after = np.zeros(n, dtype=np.uint64)
            after[: n - reached] = rank[reached:] if reached < n else 0
            key = rank << np.uint64(32) | after
            reached *= 2

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of every occurrence of every piece, by place."""
        array = self.suffix_array(text)
        padded = np.append(text, np.zeros(self.longest, np.uint32))
        lo, hi = np.zeros(len(self.known), np.int64), np.full(len(self.known), len(text), np.int64)
        for j in range(self.longest):
            live = np.flatnonzero((self.sizes > j) & (lo < hi))
            want = self.codes[live, j]
            for bound, wanted in ((lo, want), (hi, want + 1)):
                a, b = lo[live].copy() if bound is lo else start, hi[live].copy()
                if bound is lo:
                    start = a.copy()
                while True:
                    open_ = np.flatnonzero(a < b)
                    if not len(open_):
                        break
                    mid = (a[open_] + b[open_]) >> 1
                    less = padded[array[mid] + j] < wanted[open_]
                    a[open_[less]] = mid[less] + 1
                    b[open_[~less]] = mid[~less]
                if bound is lo:
                    first = a
                else:
                    last = a
            lo[live], hi[live] = first, last
        count = np.maximum(hi - lo, 0)
        place, piece = array[ranges(lo, count)], np.repeat(np.arange(len(self.known)), count)
        order = np.argsort(place)
        return place[order], piece[order]

    # relaxing -----------------------------------------------------------------

    def _merge_one(self, size: int, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Boundaries of one part, from its edges, by a heap."""
        pairs = dict(zip(zip(start.tolist(), end.tolist(), strict=True), rank.tolist(), strict=True))
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(a: int) -> None:
            if a >= 0 and (b := after[a]) < size and (x := pairs.get((a, after[b]))) is not None:
                heapq.heappush(heap, (x, a, b, after[b]))

        for a in range(size):
            push(a)
        alive = [True] * size
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if not alive[a] or b >= size or not alive[b] or after[a] != b or after[b] != e:
                continue
            alive[b] = False
            after[a] = e
            if e < size:
                before[e] = a
            push(before[a])
            push(a)
        return np.array(alive, dtype=bool)

    def _merge(self, first: np.ndarray, n: int, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which places begin a symbol, after BPE's merges. first: where parts begin (parts + 1 entries)."""
        use = self.sizes[piece] > 1
        start, end, rank = place[use], place[use] + self.sizes[piece[use]], self.ranks[piece[use]]
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        part = owner[start]
        # by part, rank and place
        if n < 1 << 22 and len(first) < 1 << 20 and len(self.sizes) < 1 << 22:  # that fit one number of 20 + 22 + 22 bits
            order = np.argsort(part.astype(np.uint64) << np.uint64(44) | rank.astype(np.uint64) << np.uint64(22) | start.astype(np.uint64))
        else:
            order = np.lexsort((start, rank, part))
        start, end, rank, part = start[order], end[order], rank[order], part[order]
        bound = np.ones(n + 1, dtype=bool)
        while len(start):
            parts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            if len(parts) < 400:
                for a, b in zip(parts, np.append(parts[1:], len(part)), strict=True):
                    lo, hi = int(first[part[a]]), int(first[part[a] + 1])
                    here = np.flatnonzero(bound[lo:hi])  # the symbols so far
                    s, e = np.searchsorted(here, start[a:b] - lo), np.searchsorted(here, end[a:b] - lo)
                    fits = bound[start[a:b]] & (bound[end[a:b]] | (end[a:b] == hi))
                    keep = self._merge_one(len(here), s[fits], e[fits], rank[a:b][fits])
                    bound[lo + here[~keep]] = False
                break
            symbols = np.cumsum(bound)  # symbols that begin up to each place
            inside = symbols[end - 1] - symbols[start]  # boundaries strictly inside
            alive = bound[start] & bound[end] & (inside > 0)
            ready = alive & (inside == 1)
            index = np.where(ready, np.arange(len(start)), len(start))
            best = np.minimum.reduceat(index, parts)
            done = best == len(start)
            best = best[~done]
            places = np.flatnonzero(bound)
            bound[places[symbols[start[best]]]] = False  # the next boundary after the edge's start
            alive &= ~np.repeat(done, np.diff(np.append(parts, len(part))))
            start, end, rank, part = start[alive], end[alive], rank[alive], part[alive]
        return bound[:n]

    def _best_path(self, n: int, edges: list[tuple[int, int, float]], penalty: float) -> np.ndarray:
        """Boundaries of one part of a unigram model: edges (start, end, score) by start, relaxed in order."""
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        at = 0
        for i in range(n):
            one = False
            while at < len(edges) and edges[at][0] == i:
                _, e, x = edges[at]
                one |= e == i + 1
                if best[i] + x > best[e]:
                    best[e], back[e] = best[i] + x, i
                at += 1
            if not one and best[i] + penalty > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + penalty, i
        out, i = np.zeros(n, dtype=bool), n
        while i:
            i = back[i]
            out[i] = True
        return out

    def _index(self, parts: list[str]) -> list[bytes]:
        """Encodes parts, all at once: the ids of each as 32-bit integers."""
        joined = "\0".join(parts)
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + 1
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        first = np.append(0, np.cumsum(sizes + 1))
        text = text.copy()
        text[first[1:-1] - 1] = 0  # between parts
        self.codes += 1
        try:
            place, piece = self.occurrences(text)
        finally:
            self.codes -= 1
        if self.v.kind == BPE:
            begins = self._merge(first, len(text), place, piece)
        else:
            begins = np.zeros(len(text), dtype=bool)
            cut = np.searchsorted(place, first)
            penalty = float(self.scores.min(initial=0.0)) - 10.0
            for k, size in enumerate(sizes.tolist()):
                a, b = cut[k], cut[k + 1]
                edges = [(int(p - first[k]), int(p - first[k] + self.sizes[q]), float(self.scores[q])) for p, q in zip(place[a:b], piece[a:b], strict=True)]
                begins[first[k] : first[k] + size] = self._best_path(size, edges, penalty)
        # the piece of each symbol is the edge that begins and ends with it
        ends = np.append(begins[1:], True)
        ends[first[1:-1] - 2] = True
        begin_at = np.flatnonzero(begins & (text != 0))
        stop = np.flatnonzero(ends & (text != 0)) + 1
        size_at = np.zeros(len(text), dtype=np.int64)
        size_at[begin_at] = stop - begin_at
        exact = np.flatnonzero(self.sizes[piece] == size_at[place])
        id_at = np.full(len(text), -1, dtype=np.int64)
        id_at[place[exact]] = self.ids[piece[exact]]
        ids = id_at[begin_at]
        cut = np.searchsorted(begin_at, first)
        unknown = np.flatnonzero(ids < 0)
        missing = np.add.reduceat(np.append(ids < 0, False).astype(np.int64), np.minimum(cut[:-1], len(ids))) if len(unknown) else None
        packed, cut = ids.astype("<i4").tobytes(), cut.tolist()
        found = []
        for k, part in enumerate(parts):
            a, b = cut[k], cut[k + 1]
            if missing is None or not missing[k]:
                found.append(packed[4 * a : 4 * b])
                continue
            own = [j for i, p in zip(ids[a:b].tolist(), begin_at[a:b].tolist(), strict=True) for j in ([i] if i >= 0 else self._fallback(part[p - int(first[k])]))]
            if not self.v.byte_fallback:  # neighbouring unknowns are one
                own = [i for at, i in enumerate(own) if i != self.v.unknown or not at or own[at - 1] != i]
            found.append(np.array(own, dtype="<i4").tobytes())
        return found

    def _fallback(self, c: str) -> list[int]:
        return [self.v.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.v.byte_fallback else [self.v.unknown]

    def _parts(self, buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where parts begin and end: at rows' ends, before runs of marks, and around characters that are always alone."""
        n = len(buf)
        begins = np.zeros(n + 1, dtype=bool)
        begins[rows] = True
        if not self.whole:
            mark, lone = buf == 32, self.lone[buf]
            begins[1:n] |= mark[1:] & ~mark[:-1] | lone[1:] | lone[:-1]
        at = np.flatnonzero(begins[:n])
        return at, np.append(at[1:], n)

    def _new(self, hashes: list[int], parts: list[bytes]) -> None:
        held: list[str] = []
        size = done = 0
        for k, part in enumerate(parts):
            held.append(part.decode("utf-8", "surrogatepass").replace(" ", MARK))
            size += len(held[-1])
            if size > INDEX_CHARS or k == len(parts) - 1:
                self.ids_of.update(zip(hashes[done : k + 1], self._index(held), strict=True))
                held, size, done = [], 0, k + 1

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes] | None]:
        """(token ids as 32-bit integers, the text that they decode to) of each text."""
        prefix = b" " if self.v.prefix else b""
        raw = [prefix + t.replace(MARK, " ").encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        rows = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
        data = b"".join(raw)
        buf = np.frombuffer(data, dtype=np.uint8)
        start, end = self._parts(buf, rows)
        hashes, first, of = np.unique(span_hash(buf, start, end), return_index=True, return_inverse=True)
        listed = hashes.tolist()
        unknown = [k for k, h in enumerate(listed) if h not in self.ids_of]
        if unknown:
            spans = zip(start[first[unknown]].tolist(), end[first[unknown]].tolist(), strict=True)
            self._new([listed[k] for k in unknown], [data[a:b] for a, b in spans])
        found = [self.ids_of[h] for h in listed]
        size = np.array([len(x) // 4 for x in found], dtype=np.int64)
        flat = np.frombuffer(b"".join(found), dtype="<i4")
        ids = flat[ranges((np.cumsum(size) - size)[of], size[of])]
        cut = np.append(0, np.cumsum(size[of]))[np.searchsorted(start, rows)].tolist()
        plain = self.out_bytes[ranges(self.out_at[ids], self.out_size[ids])].tobytes()
        places = np.append(0, np.cumsum(self.out_size[ids]))[cut].tolist()
        skip, packed = len(prefix), ids.tobytes()
        for k, text in enumerate(texts):
            if text is None:
                yield None
            elif plain[places[k] : places[k + 1]] == raw[k]:
                yield packed[4 * cut[k] : 4 * cut[k + 1]], raw[k][skip:]
            else:  # characters without a piece; or parts of one hash
                yield self._verified(raw[k], skip)
        if len(self.ids_of) > KEPT:
            self.ids_of.clear()


    def _verified(self, raw: bytes, skip: int) -> tuple[bytes, bytes]:
        """(token ids, decoded text) of one text, its parts told apart by their bytes."""
        start, end = self._parts(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        parts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        ids_of = {p: self._index([p.decode("utf-8", "surrogatepass").replace(" ", MARK)])[0] for p in set(parts)}
        packed = b"".join(ids_of[p] for p in parts)
        return packed, b"".join(self.v.out[i] for i in np.frombuffer(packed, dtype="<i4").tolist())[skip:]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of token ids."""
    out = b"".join([vocabulary.out[i] for i in ids])
    return (out[1:] if vocabulary.prefix and out.startswith(b" ") else out).decode("utf-8", "replace")


def _groups(column) -> Iterator[list]:
    """The texts of a column, about a million bytes at a time."""
    off = arrow_text(column)[1]
    for lo, hi in slices(off, 1_000_000):
        yield column.slice(lo, hi - lo).to_pylist()


def _run(vocabulary: Vocabulary, row, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            release()
            at = 0
            for texts in _groups(batch["text"]):
                ids = batch["doc_id"].slice(at, len(texts))
                at += len(texts)
                rows = [row(x, t) for x, t in zip(codec.encode(texts), texts, strict=True)]
                columns = [ids, *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate(zip(*rows, strict=True)))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, tokens (array of ids) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int32()))])
    row = lambda x, _: (None if x is None else np.frombuffer(x[0], dtype="<i4"),)
    return _rows(docs, id_column, text_column).mapInArrow(of_batches(_run(Vocabulary(model), row, schema)), "doc_id long, tokens array<int>")


def decoded(tokens: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, text of each row of ``encode``."""
    vocabulary = Vocabulary(model)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            text = [None if ids is None else decode(vocabulary, ids) for ids in batch["tokens"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(text, pa.string())], schema=schema)

    return tokens.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model: str = DEFAULT_MODEL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, tokens_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256 of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("tokens_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(x, _):
        return (None, None, None) if x is None else (len(x[0]) // 4, hashlib.sha256(x[0]).hexdigest(), hashlib.sha256(x[1]).hexdigest())

    return _rows(docs, id_column, text_column).mapInArrow(of_batches(_run(Vocabulary(model), row, schema)), "doc_id long, n_tokens long, tokens_sha256 string, decoded_sha256 string")
