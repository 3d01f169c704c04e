"""Plan patterns: dense grids, blocked recurrences, halo buckets for long series."""
