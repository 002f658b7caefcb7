"""Where the small driver tables lie, and a helper to read small results."""

SF_SMALL = "/root/testdata/sf0.001"


def rows(df, *cols):
    """Collect a small test result as a list of tuples (tests only)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
