"""Syntax of two annotated texts: alignment of their tokens, and what differs.

Annotations are columns: arrays of (text, lemma, pos, tag, dep, head, is_stop,
is_punct). A null annotation gives a result of confidence 0 with a status.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.metrics import change_magnitude
from .single import _ratio, result

TOKEN = "struct<text:string,lemma:string,pos:string,tag:string,dep:string,head:int,is_stop:boolean,is_punct:boolean>"
ALIGNMENT = "array<struct<kind:string,orig_idx:int,mod_idx:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("orig_idx", pa.int32()), ("mod_idx", pa.int32())]))


def _fold(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def align_tokens(original: list[dict], modified: list[dict]) -> list[dict]:
    """Pairs of equal tokens, then of similar ones, each nearest the diagonal first and none crossing a taken token.

    Equal: the same text whatever its ASCII case, or the same lemma (not empty)
    and tag. Similar: the same lemma. A pair of equal tokens is a Reorder if
    another one crosses it.
    """
    n, m = len(original), len(modified)
    texts = [_fold(t["text"]) for t in modified]
    exact, alike = [], []
    for i, a in enumerate(original):
        text, lemma, tag = _fold(a["text"]), a["lemma"], a["tag"]
        for j, b in enumerate(modified):
            same = bool(lemma) and lemma == b["lemma"]
            if text == texts[j] or same and tag == b["tag"]:
                exact.append((i, j))
            elif same:
                alike.append((i, j))
    away = lambda p: int(1000 * abs(p[0] / n - p[1] / m))
    left: dict[int, tuple[str, int]] = {}
    right: set[int] = set()
    taken = []
    for pairs, kind in ((sorted(exact, key=away), "Match"), (sorted(alike, key=away), "Replacement")):
        for i, j in pairs:
            if i not in left and j not in right:
                left[i] = (kind, j)
                right.add(j)
                if kind == "Match":
                    taken.append((i, j))
    for i, j in taken:
        if any((i - x) * (j - y) < 0 for x, y in taken):
            left[i] = ("Reorder", j)
    out = [{"kind": left[i][0], "orig_idx": i, "mod_idx": left[i][1]} if i in left else {"kind": "Deletion", "orig_idx": i, "mod_idx": None} for i in range(n)]
    return out + [{"kind": "Insertion", "orig_idx": None, "mod_idx": j} for j in range(m) if j not in right]


@F.arrow_udf(from_arrow_type(_ARROW))
def alignment(original: pa.Array, modified: pa.Array) -> pa.Array:
    pairs = zip(original.to_pylist(), modified.to_pylist(), strict=True)
    return pa.array([None if a is None or b is None else align_tokens(a, b) for a, b in pairs], _ARROW)


def _pair(al: Column, o: Column, m: Column) -> tuple[Column, Column]:
    return F.try_element_at(o, al["orig_idx"] + 1), F.try_element_at(m, al["mod_idx"] + 1)


def _count(al: Column, condition) -> Column:
    return F.size(F.filter(al, condition))


def kinds(al: Column, *names: str) -> Column:
    return _count(al, lambda a: a["kind"].isin(*names))


def pos_changes(al: Column, o: Column, m: Column) -> Column:
    def differ(a: Column) -> Column:
        x, y = _pair(a, o, m)
        return a["kind"].isin("Deletion", "Insertion") | (x["pos"] != y["pos"])

    return _count(al, differ)


def dep_changes(al: Column, o: Column, m: Column) -> Column:
    """A changed role, a reordering, an insertion or a deletion count one each."""

    def differ(a: Column) -> Column:
        x, y = _pair(a, o, m)
        return a["kind"].isin("Match", "Reorder", "Replacement") & (x["dep"] != y["dep"])

    return _count(al, differ) + kinds(al, "Reorder", "Deletion", "Insertion")


def structural_similarity(al: Column, o: Column, m: Column) -> Column:
    def same(a: Column) -> Column:
        x, y = _pair(a, o, m)
        return (a["kind"] == "Match") & (x["pos"] == y["pos"]) & (x["dep"] == y["dep"])

    most = F.greatest(F.size(o), F.size(m))
    return F.when(most > 0, _count(al, same) / most).otherwise(1.0)


def grammar_fixes(al: Column, o: Column, m: Column) -> Column:
    """Messages about pairs of the same lemma."""

    def of(a: Column) -> Column:
        x, y = _pair(a, o, m)
        both = lambda p: (x["pos"] == p) & (y["pos"] == p)
        low = lambda t: F.lower(t["text"])
        said = lambda name: F.concat(F.lit(f"{name} correction: '"), x["text"], F.lit("' → '"), y["text"], F.lit("'"))
        swap = (low(x) == "a") & (low(y) == "an") | (low(x) == "an") & (low(y) == "a")
        replaced = a["kind"] == "Replacement"
        rules = [
            (x["dep"].isin("nsubj", "ROOT") & both("VERB") & (x["tag"] != y["tag"]), "Verb form"),
            (both("AUX") & (low(x) != low(y)), "Auxiliary verb"),
            (both("VERB") & (x["tag"] != y["tag"]), "Tense"),
            (replaced & both("DET") & swap, "Article"),
            (replaced & both("PRON"), "Pronoun"),
        ]
        found = F.array(*(F.when(c, said(name)) for c, name in rules))
        return F.when(a["kind"].isin("Match", "Reorder", "Replacement") & (x["lemma"] == y["lemma"]), F.filter(found, lambda s: s.isNotNull())).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(al, of))


def categorize_fixes(fixes: Column) -> dict[str, Column]:
    holds = lambda *names: _count(fixes, lambda s: F.exists(F.array(*map(F.lit, names)), lambda n: F.startswith(s, n)))
    return {"verb_corrections": holds("Verb", "Auxiliary"), "article_corrections": holds("Article"), "tense_corrections": holds("Tense")}


def tag_counts(tokens: Column, field: str, punctuation: bool = True) -> Column:
    """map<tag, count>."""
    tags = F.transform(F.filter(tokens, lambda t: F.lit(punctuation) | ~t["is_punct"]), lambda t: t[field])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(tags)), lambda g: F.struct(g, F.size(F.filter(tags, lambda x: x == g)))))


def tag_divergence(o: Column, m: Column, field: str) -> Column:
    """Half the sum of the differences of shares; both empty 0, one empty 1."""
    a, b = F.transform(o, lambda t: t[field]), F.transform(m, lambda t: t[field])
    share = lambda tags, g: F.size(F.filter(tags, lambda x: x == g)) / F.size(tags)
    total = F.aggregate(F.array_union(a, b), F.lit(0.0), lambda s, g: s + F.abs(share(a, g) - share(b, g)))
    return F.when((F.size(o) == 0) & (F.size(m) == 0), 0.0).when((F.size(o) == 0) | (F.size(m) == 0), 1.0).otherwise(total / 2)


def unchanged_ratio(o: Column, m: Column, field: str) -> Column:
    """Equal tags at equal places, of the shorter text; 1 without any."""
    n = F.least(F.size(o), F.size(m))
    same = F.zip_with(F.slice(o, F.lit(1), n), F.slice(m, F.lit(1), n), lambda x, y: x[field] == y[field])
    return F.when(n > 0, F.size(F.filter(same, lambda x: x)) / n).otherwise(1.0)


def root_changes(o: Column, m: Column) -> Column:
    roots = lambda t: F.filter(t, lambda x: x["dep"] == "ROOT")
    a, b = roots(o), roots(m)
    return F.when(F.size(a) != F.size(b), F.greatest(F.size(a), F.size(b))).otherwise(F.size(F.filter(F.zip_with(a, b, lambda x, y: x["lemma"] != y["lemma"]), lambda x: x)))


def role_changes(o: Column, m: Column) -> Column:
    """Places whose role differs, as text."""
    n = F.least(F.size(o), F.size(m))
    pairs = F.zip_with(F.slice(o, F.lit(1), n), F.slice(m, F.lit(1), n), lambda x, y: F.when(x["dep"] != y["dep"], F.concat(F.lit("'"), x["text"], F.lit("': "), x["dep"], F.lit(" → "), y["dep"])))
    return F.filter(pairs, lambda x: x.isNotNull())


def clauses(tokens: Column) -> Column:
    """Each root with its subject."""

    def of(root: Column) -> Column:
        place = F.array_position(F.transform(tokens, lambda t: t["text"]), root["text"]) - 1
        subject = F.try_element_at(F.filter(tokens, lambda t: (t["dep"] == "nsubj") & (t["head"] == place)), F.lit(1))
        return F.concat(F.when(subject.isNotNull(), F.concat(subject["text"], F.lit(" "))).otherwise(""), F.lit("["), root["text"], F.lit("]"))

    return F.transform(F.filter(tokens, lambda t: t["dep"] == "ROOT"), of)


def _guarded(name: str, o: Column, m: Column, made: Column) -> Column:
    missing = result(name, {}, confidence=0.0, metadata={"status": F.lit("no annotation")})
    return F.when(o.isNull() | m.isNull(), missing).otherwise(made)


def syntactic(al: Column, o: Column, m: Column) -> Column:
    s, d, fixes = structural_similarity(al, o, m), tag_divergence(o, m, "pos"), grammar_fixes(al, o, m)
    found = {"pos_changes": pos_changes(al, o, m), "dep_changes": dep_changes(al, o, m), "structural_similarity": s, "grammar_fixes": F.size(fixes), "pos_divergence": d}
    notes = [(s > 0.9, "Structure is kept"), (s < 0.7, "Structure changed much"), (d > 0.3, "Parts of speech are dealt otherwise"), (F.size(fixes) > 0, "Grammar was corrected")]
    return _guarded("spacy_syntactic", o, m, result("spacy_syntactic", found, notes))


def part_of_speech(al: Column, o: Column, m: Column) -> Column:
    n = pos_changes(al, o, m)
    found = {"pos_changes": n, "pos_divergence": tag_divergence(o, m, "pos"), "pos_unchanged_ratio": unchanged_ratio(o, m, "pos")}
    return _guarded("spacy_pos", o, m, result("spacy_pos", found, metadata={"change_summary": change_magnitude(n, "POS")}))


def dependency(al: Column, o: Column, m: Column) -> Column:
    n, ratio = dep_changes(al, o, m), unchanged_ratio(o, m, "dep")
    details = role_changes(o, m)
    found = {"dep_changes": n, "root_changes": root_changes(o, m), "dep_unchanged_ratio": ratio}
    said = {"change_summary": change_magnitude(n, "dependency"), "details": F.when(F.size(details).between(1, 10), F.array_join(details, "; "))}
    return _guarded("spacy_dependency", o, m, result("spacy_dependency", found, metadata=said))


def grammar(al: Column, o: Column, m: Column) -> Column:
    fixes = grammar_fixes(al, o, m)
    return _guarded("spacy_grammar", o, m, result("spacy_grammar", {"total_fixes": F.size(fixes), **categorize_fixes(fixes)}, metadata={"fixes": F.array_join(fixes, "; ")}))


def structural(al: Column, o: Column, m: Column) -> Column:
    def same(a: Column) -> Column:
        x, y = _pair(a, o, m)
        return (x["pos"] == y["pos"]) & (x["dep"] == y["dep"])

    s = structural_similarity(al, o, m)
    ratio = F.when((F.size(o) == 0) | (F.size(m) == 0), 0.0).otherwise(_ratio(_count(al, same), F.size(al)))
    said = {"original_clauses": F.array_join(clauses(o), "; "), "modified_clauses": F.array_join(clauses(m), "; ")}
    return _guarded("spacy_structural", o, m, result("spacy_structural", {"structural_similarity": s, "pos_dep_match_ratio": ratio, "structure_changed": s < 0.7}, metadata=said))


def alignment_counts(al: Column, o: Column, m: Column) -> Column:
    names = ("Match", "Deletion", "Insertion", "Replacement", "Reorder")
    found = {f"{n.lower()}_count": kinds(al, n) for n in names}
    return _guarded("spacy_alignment", o, m, result("spacy_alignment", {**found, "alignment_ratio": _ratio(kinds(al, "Match", "Reorder", "Replacement"), F.size(al))}))


ANALYZERS = {"spacy_syntactic": syntactic, "spacy_pos": part_of_speech, "spacy_dependency": dependency, "spacy_grammar": grammar, "spacy_structural": structural, "spacy_alignment": alignment_counts}
