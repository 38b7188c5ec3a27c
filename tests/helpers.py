"""What several test modules share."""


def rows_of(found, columns):
    """Rows as sorted tuples, floats to six digits."""
    clean = lambda x: None if x is None or x != x else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(clean(r[c]) for c in columns) for r in found), key=repr)
