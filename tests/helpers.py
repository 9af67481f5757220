"""Compares a query with its SQL: columns by name, rows as a multiset, numbers to six places."""

import math


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str([value(x) for x in v]) if isinstance(v, list | tuple) else v


def same(df, con, sql):
    rows, columns = df.collect(), sorted(df.columns)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    mine = sorted((tuple(value(r[c]) for c in columns) for r in rows), key=repr)
    theirs = sorted((tuple(value(r[i]) for i in order) for r in got.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    assert mine == theirs
    return len(mine)
