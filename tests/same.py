"""Comparing a query's rows with those of its SQL."""


def rows_of(df, columns):
    return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))


def assert_same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    assert rows_of(df, columns) == sorted(tuple(str(r[i]) for i in at) for r in relation.fetchall())
