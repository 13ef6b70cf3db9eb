"""Helpers of the tests; a module of its own, as several folders have a conftest."""


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all when none)."""
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
