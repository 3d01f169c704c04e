"""Column expressions and ordered-window helpers."""
