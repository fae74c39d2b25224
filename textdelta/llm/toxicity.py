"""Toxicity by a learned lexicon, matched with Levenshtein automata over its trie.

Labelled documents give the lexicon: words, and stems (beginnings that several
words share), that toxic documents have far more often than others by a
likelihood ratio. The lexicon is a trie; a word of a text is matched by walking
the trie together with the word's Levenshtein automaton (its rows of edit
distances), so terms of ``FUZZY`` letters or more and a weight of ``SURE`` also match with one
edit, unless the misspelt form is itself at home in clean training documents. Stems
match as they are. Each match weighs what its term's labels say, less for an
edit, and less where the words around it make it a quotation: quotation marks
that are open before it in its line and closed after it, or a word of reporting
shortly before. The
score is the probability that at least one match is abuse.

A word is a run of letters, digits, marks and symbols that are not ASCII: white
space, controls and punctuation of any script end it, and invisible format characters (as U+200B) are
taken out of it, in training as in scoring.

Only words that share the first or the last two characters of a term, and nearly
its length, can be within one edit of it; that is told in bulk from the bytes
before any automaton runs. Words that are not ASCII there, whose case and
invisible characters change their bytes, all pass.

Labels are learned from at most ``SAMPLE`` documents of each label (those of the
smallest hash of their id), which is the one sample; of near copies in it (those
that share a min-hash) one counts, so that a copied document's words are no
evidence by themselves. Every text is scored whole.

Edge cases: null and empty texts score the floor; null labels are ignored; of
labels that disagree on an id the toxic one counts; without toxic or without
clean training documents the lexicon is empty and all score the floor; a null
id is not held out; other columns are kept by ``clean`` and ignored by
``scores``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import cut
from .textcore import U64, Words, arrow_text, mix, of_batches, release, slices, window_hash, word_table

SAMPLE = 5000
#: A term's least log-likelihood ratio and share of toxic documents, and the words that a stem stands for at least.
EVIDENCE, PRECISION, STEM_WORDS = 14.0, 0.6, 4
STEMS = (4, 5, 6)
FUZZY, SURE, EDIT_WEIGHT, QUOTED_WEIGHT, FLOOR, LIMIT = 5, 0.98, 0.7, 0.25, 0.02, 0.3
#: Words whose matches are held at once.
KNOWN = 50_000
#: Words looked at before a match, bytes looked at for them, and what marks reporting.
BEFORE, AROUND = 4, 120
REPORTING = frozenset("said says saying wrote writes called calls quoted quote quoting quotes word words term terms slur insult insults sagte schrieb nannte zitat wort dijo escribió llamó cita palabra dit écrit appelé citation mot".split())
_LETTERS = re.compile(r"[^\W\d_]+")
_ASCII_ENDS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = word_table(_ASCII_ENDS)
_SPACED = bytes.maketrans(_ASCII_ENDS, b" " * len(_ASCII_ENDS))
_OPEN, _CLOSE = "“«„‹", "”»“›"
_MARKS = re.compile("|".join(f"{c}" for c in sorted({*_OPEN, *_CLOSE, '"', "\n"})).encode())


@cache
def _ends() -> tuple[np.ndarray, np.ndarray]:
    """Which code points above ASCII end a word, and which are invisible; those of higher planes do neither."""
    kinds = [unicodedata.category(chr(c)) for c in range(0x20000)]
    return np.array([k[0] in "PZ" or k == "Cc" for k in kinds]), np.array([k == "Cf" for k in kinds])


def spaced(buf: np.ndarray) -> np.ndarray:
    """UTF-8 with the characters above ASCII that end a word as spaces, byte by byte."""
    lead = np.flatnonzero(buf >= 0xC2)
    if not len(lead):
        return buf
    size = 2 + (buf[lead] >= 0xE0) + (buf[lead] >= 0xF0)
    padded = np.append(buf, np.zeros(3, np.uint8)).astype(np.int32)
    code = padded[lead] & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    for k in (1, 2, 3):
        code = np.where(size > k, code << 6 | padded[lead + k] & 0x3F, code)
    ends = np.zeros(len(lead), dtype=bool)
    low = code < 0x20000
    ends[low] = _ends()[0][code[low]]
    out = buf.copy()
    for k in range(4):
        out[lead[ends & (size > k)] + k] = 0x20
    return out


def visible(word: str) -> str:
    """A word in lower case without invisible characters."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in word if unicodedata.category(c) != "Cf").lower()


def words_of(text: str) -> set[str]:
    """The distinct words of a text."""
    raw = spaced(np.frombuffer(text.encode("utf-8", "replace"), np.uint8)).tobytes().translate(_SPACED)
    return {visible(w) for w in raw.decode("utf-8", "replace").split(" ")} - {""}


class Trie:
    """The lexicon; a node has its children by character, and the term that ends there."""

    def __init__(self):
        self.children: dict[str, Trie] = {}
        self.term: str | None = None
        self.stem = self.sure = False

    def add(self, term: str, stem: bool = False, sure: bool = True) -> None:
        node = self
        for c in term:
            node = node.children.setdefault(c, Trie())
        node.term, node.stem, node.sure = term, stem, sure

    def match(self, word: str) -> tuple[str, int] | None:
        """The term of the fewest edits (at most one), ties by the term; (term, edits).

        The word's Levenshtein automaton as its states (place in the word, edits):
        each state of a node goes on by the next character, and from no edits also
        by a substitution, an insertion or a deletion.
        """
        found: list[tuple[int, str]] = []
        n = len(word)
        todo = [(self, 0, 0)]
        while todo:
            node, i, edits = todo.pop()
            if node.term is not None:
                if node.stem:
                    if not edits and i < n:
                        found.append((0, node.term))
                elif i == n and (not edits or node.sure):
                    found.append((edits, node.term))
            if i < n and (child := node.children.get(word[i])) is not None:
                todo.append((child, i + 1, edits))
            if not edits:
                if i < n:
                    todo.append((node, i + 1, 1))
                    after = word[i + 1] if i + 1 < n else ""
                    for c, child in node.children.items():
                        if c != word[i]:
                            if not after or after in child.children:
                                todo.append((child, i + 1, 1))
                            if word[i] in child.children:
                                todo.append((child, i, 1))
                else:
                    todo.extend((child, i, 1) for child in node.children.values() if child.term is not None)
        return min(found)[::-1] if found else None


@dataclass
class Lexicon:
    """Terms with their weights, which of them are stems, and misspelt forms that are known as clean."""

    weights: dict[str, float]
    stems: set[str]
    clean: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.trie = Trie()
        for term in sorted(self.weights):
            self.trie.add(term, term in self.stems, len(term) >= FUZZY and self.weights[term] >= SURE)
        self.known: dict[bytes, tuple[str, float] | None] = {}
        # the first and the last two bytes of terms, each with the lengths that a match can have, or (as 0) of any length
        self.begin, self.end = np.zeros(1 << 22, bool), np.zeros(1 << 22, bool)
        self.heads = np.array(sorted({int.from_bytes(t.encode()[:4], "little") for t in self.stems}), dtype=np.uint32)
        for term in set(self.weights) - self.stems:
            raw = term.encode()
            more = 0 if not (len(term) >= FUZZY and self.weights[term] >= SURE) else 1 if term.isascii() else 4
            for n in {0, *range(max(len(raw) - more, 2), len(raw) + (4 if more else 0) + 1)}:  # an edit adds four bytes at most
                self.begin[raw[0] | raw[1] << 8 | min(n, 63) << 16] = True
                self.end[raw[-2] | raw[-1] << 8 | min(n, 63) << 16] = True

    def of(self, raw: bytes) -> tuple[str, float] | None:
        """The term that a word matches and the weight of the match."""
        if raw in self.known:
            return self.known[raw]
        word = visible(raw.decode("utf-8", "replace"))
        found = self.trie.match(word)
        out = None
        if found and (not found[1] or word not in self.clean):
            out = (found[0], self.weights[found[0]] * (EDIT_WEIGHT if found[1] else 1.0))
        if len(self.known) > KNOWN:
            self.known.clear()
        self.known[raw] = out
        return out

    def candidates(self, w: Words) -> np.ndarray:
        """The places of the words that may match."""
        size = w.end - w.start
        at = np.flatnonzero(size >= 2)
        s, e = w.start[at], w.end[at]
        buf = np.append(w.buf, np.zeros(4, np.uint8)).astype(np.uint32)
        first, last = buf[s] | buf[s + 1] << 8, buf[e - 2] | buf[e - 1] << 8
        above = np.append(0, np.cumsum(w.buf >= 0x80))
        plain = above[e] == above[s]
        long = np.where(plain, np.minimum(size[at], 63), 0).astype(np.uint32) << 16
        ok = self.begin[first | long] | self.end[last | long]
        if len(self.heads):
            four = first | buf[s + 2] << 16 | buf[s + 3] << 24
            ok |= (size[at] >= 4) & (self.heads[np.minimum(np.searchsorted(self.heads, four), len(self.heads) - 1)] == four)
        odd = np.flatnonzero(~plain)
        ok[odd] |= (above[np.minimum(s[odd] + 4, e[odd])] > above[s[odd]]) | (above[e[odd]] > above[e[odd] - 2])
        return at[ok]


class Quotes:
    """Where quotation marks and line ends are in UTF-8 text."""

    def __init__(self, data: bytes):
        self.places: dict[str, list[int]] = {c: [] for c in {*_OPEN, *_CLOSE, '"', "\n"}}
        for m in _MARKS.finditer(data):
            self.places[m[0].decode()].append(m.start())

    def around(self, lo: int, s: int, e: int, hi: int) -> bool:
        """Whether marks that are open at s close after e, in the line of [s, e) within the text [lo, hi)."""
        lines = self.places["\n"]
        k = bisect_left(lines, s)
        lo = max(lo, lines[k - 1] + 1) if k else lo
        hi = min(hi, lines[k]) if k < len(lines) else hi

        def last(c: str) -> int:
            k = bisect_left(self.places[c], s)
            return self.places[c][k - 1] if k and self.places[c][k - 1] >= lo else -1

        def follows(c: str) -> bool:
            k = bisect_left(self.places[c], e)
            return k < len(self.places[c]) and self.places[c][k] < hi

        plain = self.places['"']
        if (bisect_left(plain, s) - bisect_left(plain, lo)) % 2 and follows('"'):
            return True
        return any(last(a) > last(b) and follows(b) for a, b in zip(_OPEN, _CLOSE, strict=True))


def reported(before: str) -> bool:
    """Whether one of the last words is of reporting."""
    return any(x in REPORTING for x in _LETTERS.findall(before.lower())[-BEFORE:])


def _matches(lexicon: Lexicon, column) -> Iterator[list[dict]]:
    """The matches of each text."""
    buf, off = arrow_text(column)
    for lo, hi in slices(off):
        base = off[lo : hi + 1] - off[lo]
        w = Words(spaced(buf[off[lo] : off[hi]]), base, _TABLE, lower=True)
        at = lexicon.candidates(w) if lexicon.weights else np.zeros(0, np.int64)
        row = np.searchsorted(w.first, at, side="right") - 1
        out: list[list[dict]] = [[] for _ in range(hi - lo)]
        words, data, quotes = w.buf.tobytes(), b"", None
        for i, r in zip(at.tolist(), row.tolist(), strict=True):
            s, e = int(w.start[i]), int(w.end[i])
            if found := lexicon.of(words[s:e]):
                if quotes is None:
                    data = buf[off[lo] : off[hi]].tobytes()
                    quotes = Quotes(data)
                a, b = int(base[r]), int(base[r + 1])
                quoted = quotes.around(a, s, e, b) or reported(data[max(s - AROUND, a) : s].decode("utf-8", "ignore"))
                out[r].append({"term": found[0], "weight": found[1], "quoted": quoted, "start": s - a, "end": e - a})
        yield from out


def score(matches: list[dict]) -> float:
    clean = 1.0 - FLOOR
    for m in matches:
        clean *= 1.0 - m["weight"] * (QUOTED_WEIGHT if m["quoted"] else 1.0)
    return min(1.0, 1.0 - clean)


def _terms(text: str) -> set[tuple[str, str]]:
    """The words, and the stems with the word they are of, of a text."""
    words = {w for w in words_of(text) if not w.isnumeric()}
    return {(w, "") for w in words if len(w) > 2} | {(w[:k] + "*", w) for w in words for k in STEMS if len(w) > k}


_COUNTS = pa.schema([("term", pa.string()), ("n0", pa.int64()), ("n1", pa.int64()), ("words", pa.list_(pa.string()))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo, hi in slices(arrow_text(whole["text"])[1]):  # some texts' terms at once
            release()
            batch = whole.slice(lo, hi - lo)
            counts: dict[str, list] = {}
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                seen: dict[str, set] = {}
                for term, word in _terms(text or ""):
                    seen.setdefault(term, set()).add(word)
                for term, words in seen.items():
                    own = counts.setdefault(term, [0, 0, set()])
                    own[toxic] += 1
                    if toxic and len(own[2]) < STEM_WORDS:
                        own[2] |= words
            found = counts.values()
            columns = {"term": list(counts), "n0": [x[0] for x in found], "n1": [x[1] for x in found], "words": [sorted(x[2])[: 2 * STEM_WORDS] for x in found]}
            yield pa.RecordBatch.from_pydict(columns, schema=_COUNTS)


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four min-hashes of the five-word shingles of each text."""
    for batch in batches:
        release()
        buf, off = arrow_text(batch["text"])
        signs: list[list[int]] = []
        for lo, hi in slices(off):
            w = Words(buf, off[lo : hi + 1], _TABLE, lower=True)
            h = window_hash(w.hash, 5, 61)
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                own = h[a : max(b - 4, a)]
                signs.append([int(mix(own + U64(k)).min().view(np.int64)) for k in range(4)] if len(own) else [])
        yield pa.RecordBatch.from_arrays([batch["__id"], batch["toxic"], pa.array(signs, pa.list_(pa.int64()))], names=["id", "toxic", "signs"])


def evidence(n1: float, n0: float, all1: float, all0: float) -> tuple[float, float]:
    """Log-likelihood ratio of a term against the base rate, and its share of toxic documents with both labels made equally many."""
    base, own = all1 / (all1 + all0), n1 / (n1 + n0)
    ratio = n1 * math.log(own / base) + (n0 * math.log((1 - own) / (1 - base)) if n0 else 0.0)
    rate1, rate0 = (n1 + 0.5) / (all1 + 1), (n0 + 0.5) / (all0 + 1)
    return ratio, rate1 / (rate1 + rate0)


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Lexicon:
    """The lexicon from the labelled documents that are not held out."""
    known = labels.select(F.col(id_column).cast("long").alias("__id"), F.col(label_column).cast("int").alias("toxic")).where("__id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE) for y in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most 2 SAMPLE rows of two numbers
    rows = docs.select(F.col(id_column).cast("long").alias("__id"), F.col(text_column).cast("string").alias("text")).join(sample, "__id")
    rows = cut(rows.groupBy("__id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    signs = rows.mapInArrow(of_batches(_signs), "id long, toxic int, signs array<long>").collect()  # a row for each of the sample
    seen: set[int] = set()
    alike = []
    for r in sorted(signs, key=lambda r: (-r.toxic, r.id)):
        if r.signs and not seen.isdisjoint(r.signs):
            alike.append((r.id,))
        seen.update(r.signs)
    if alike:
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(alike, "__id long")), "__id", "left_anti")
    rows = rows.select("text", "toxic")
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return Lexicon({}, set())
    counts = rows.mapInArrow(of_batches(_count), "term string, n0 long, n1 long, words array<string>").groupBy("term")
    counts = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("kinds"))
    least = EVIDENCE / math.log((totals[0] + totals[1]) / totals[1])  # fewer toxic documents can't be evidence enough
    weights: dict[str, float] = {}
    for r in counts.where((F.col("n1") >= least) & (F.col("n1") * totals[0] > F.col("n0") * totals[1])).collect():
        ratio, share = evidence(r.n1, r.n0, totals[1], totals[0])
        if ratio >= EVIDENCE and share >= PRECISION and (not r.term.endswith("*") or r.kinds >= STEM_WORDS and share >= 0.9):
            weights[r.term] = share
    stems = {t[:-1] for t in weights if t.endswith("*")}
    stems = {s for s in stems if not any(s != x and s.startswith(x) for x in stems)}
    plain = {t: x for t, x in weights.items() if not t.endswith("*")}
    for s in sorted(stems):  # a stem that one word alone accounts for is that word
        if any(t.startswith(s) and weights[s + "*"] <= x for t, x in plain.items() if len(t) >= FUZZY) and sum(t.startswith(s) for t in plain) == 1:
            stems.discard(s)
    plain = {t: x for t, x in plain.items() if not any(t.startswith(s) and t != s for s in stems)}
    lexicon = Lexicon(plain | {s: weights[s + "*"] for s in stems}, stems)
    lexicon.clean = {r.word for r in rows.where("toxic = 0").mapInArrow(of_batches(_near(lexicon)), "word string").distinct().collect()}
    lexicon.known.clear()
    return lexicon


def _near(lexicon: Lexicon):
    """Misspelt forms of terms in clean documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            buf, off = arrow_text(batch["text"])
            found: set[str] = set()
            for lo, hi in slices(off):
                w = Words(spaced(buf[off[lo] : off[hi]]), off[lo : hi + 1] - off[lo], _TABLE, lower=True)
                data = w.buf.tobytes()
                for i in lexicon.candidates(w).tolist():
                    word = visible(data[w.start[i] : w.end[i]].decode("utf-8", "replace"))
                    if (m := lexicon.trie.match(word)) and m[1]:
                        found.add(word)
            yield pa.RecordBatch.from_pydict({"word": pa.array(sorted(found), pa.string())})

    return run


def scores(docs: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score and matches (term, weight, quoted, start and end in bytes) of each document."""
    match = pa.struct([("term", pa.string()), ("weight", pa.float64()), ("quoted", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            found = list(_matches(lexicon, batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([score(x) for x in found], pa.float64()), pa.array(found, pa.list_(match))], names=["doc_id", "score", "matches"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(of_batches(run), "doc_id long, score double, matches array<struct<term:string,weight:double,quoted:boolean,start:long,end:long>>")


def clean(docs: DataFrame, lexicon: Lexicon, text_column: str = "text") -> DataFrame:
    """The documents, with all their columns, that score below ``LIMIT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            yield batch.filter(pa.array([score(x) < LIMIT for x in _matches(lexicon, batch.column(text_column).cast(pa.string()))], pa.bool_()))

    return docs.mapInArrow(of_batches(run), docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = scores(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
