"""Test tables and comparisons."""

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    import decimal
    import math

    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if isinstance(value, decimal.Decimal) else value


def same_rows(df, relation):
    """Whether a DataFrame and a DuckDB relation have the same columns and rows, in any order."""
    names = sorted(df.columns)
    assert sorted(relation.columns) == names
    place = [relation.columns.index(n) for n in names]
    ours = sorted(str(tuple(plain(r[n]) for n in names)) for r in df.collect())
    theirs = sorted(str(tuple(plain(r[i]) for i in place)) for r in relation.fetchall())
    assert ours == theirs
