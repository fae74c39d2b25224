"""Configuration, metric dependencies, and the diff plan."""
