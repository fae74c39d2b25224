"""The same stages on streams."""
