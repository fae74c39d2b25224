"""Configuration of a diff, and which metrics it needs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from graphlib import CycleError, TopologicalSorter

from ..functions.metrics import PAIR_METRICS
from ..functions.normalize import Pipeline
from ..functions.tokens import TOKENIZERS
from ..operators.align import CUSTOM_ALGORITHMS

ALGORITHMS = ("histogram", "myers", "patience", "lcs")


class CyclicDependency(ValueError):
    """Metrics depend on each other in a circle."""


class InvalidDependency(ValueError):
    """A metric depends on one that is not known."""


#: What a metric is made from.
METRIC_DEPENDENCIES: dict[str, tuple[str, ...]] = {
    "char_similarity": ("levenshtein_distance",),
    "levenshtein_distance": (),
    "word_overlap": (),
    "semantic_similarity": ("word_overlap",),
    "readability_diff": ("flesch_reading_ease",),
    "flesch_reading_ease": (),
    "length_ratio": (),
    "word_count_diff": (),
    "whitespace_ratio_diff": ("whitespace_ratio",),
    "whitespace_ratio": (),
    "negation_changed": ("has_negation",),
    "has_negation": (),
}
#: What flags and analyzers ask for.
NEEDS: dict[str, tuple[str, ...]] = {
    "compute_semantic_similarity": ("semantic_similarity",),
    "analyze_style": ("readability_diff",),
    "classify_edits": ("char_similarity", "word_overlap"),
    "char_similarity": ("char_similarity",),
    "word_count_diff": ("word_count_diff",),
    "negation_changed": ("negation_changed",),
    "word_overlap": ("word_overlap",),
    "readability_diff": ("readability_diff",),
    "whitespace_ratio_diff": ("whitespace_ratio_diff",),
    "naive_bayes": ("char_similarity", "word_overlap", "readability_diff", "word_count_diff", "whitespace_ratio_diff", "negation_changed"),
}


def execution_order(wanted: set[str], dependencies: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """The wanted metrics and what they depend on, dependencies first."""
    known = METRIC_DEPENDENCIES if dependencies is None else dependencies
    graph: dict[str, tuple[str, ...]] = {}
    todo = sorted(wanted)
    while todo:
        name = todo.pop()
        if name not in known:
            raise InvalidDependency(name)
        if name not in graph:
            graph[name] = known[name]
            todo.extend(known[name])
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise CyclicDependency(str(e.args[1])) from e


@dataclass(frozen=True)
class DiffConfig:
    """How pairs are compared. A given pipeline takes precedence over the ignore flags.

    operations: whether operations are wanted, or their counts only. original_spans: whether they
    also have spans in the texts before normalization. classifiers: names of CLASSIFIERS, each of
    which adds its result to every operation, under its name.
    """

    algorithm: str = "histogram"
    compute_semantic_similarity: bool = True
    classify_edits: bool = True
    analyze_style: bool = True
    ignore_case: bool = False
    ignore_whitespace: bool = False
    context_lines: int = 3
    pipeline: Pipeline | None = None
    tokenizer: str = "word"
    analyzers: tuple[str, ...] = field(default=())
    strict_script: bool = False
    compat_pruned_metrics: bool = False
    max_chars: int | None = None
    operations: bool = True
    original_spans: bool = False
    classifiers: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS and self.algorithm not in CUSTOM_ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        if self.tokenizer not in TOKENIZERS:
            raise ValueError(f"unknown tokenizer {self.tokenizer!r}")
        if self.context_lines < 0:
            raise ValueError("context_lines is negative")

    @classmethod
    def minimal(cls) -> DiffConfig:
        return cls("myers", False, False, False, context_lines=0)

    @classmethod
    def comprehensive(cls) -> DiffConfig:
        return cls(context_lines=5)

    @classmethod
    def fast(cls) -> DiffConfig:
        """Counts by the longest common subsequence, and what they need."""
        return cls.minimal().with_(operations=False, compat_pruned_metrics=True)

    def with_(self, **changes) -> DiffConfig:
        return replace(self, **changes)

    def add_analyzer(self, name: str) -> DiffConfig:
        return self.with_(analyzers=(*self.analyzers, name))

    def add_classifier(self, name: str) -> DiffConfig:
        return self.with_(classifiers=(*self.classifiers, name))

    def normalizers(self) -> Pipeline:
        if self.pipeline is not None:
            return self.pipeline
        out = Pipeline()
        if self.ignore_case:
            out = out.add("lowercase")
        return out.add("whitespace_trim") if self.ignore_whitespace else out

    def metrics(self) -> list[str]:
        """The metrics that flags and analyzers need, in an order that works."""
        wanted = {m for flag in ("compute_semantic_similarity", "analyze_style", "classify_edits") if getattr(self, flag) for m in NEEDS[flag]}
        wanted |= {m for a in self.analyzers for m in NEEDS.get(a, ())}
        return execution_order(wanted)

    def computed(self) -> set[str]:
        """The pair metrics to compute: those needed if pruned, else all."""
        return set(self.metrics()) & set(PAIR_METRICS) if self.compat_pruned_metrics else set(PAIR_METRICS)
