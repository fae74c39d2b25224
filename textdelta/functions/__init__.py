"""Column functions: string, token, metric and vector expressions."""
