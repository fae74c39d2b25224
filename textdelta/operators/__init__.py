"""Operators on diffs: alignment, selection, classification, analysis."""
