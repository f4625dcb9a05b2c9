"""Rows of either engine in one comparable form."""


def plain(v):
    if isinstance(v, float):
        return None if v != v else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([str(plain(r[i])) for i in order] for r in rows)


def agree(df, con, sql):
    r = con.execute(sql)
    theirs = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(theirs)
    assert canonical(df.columns, [tuple(x) for x in df.collect()]) == canonical(theirs, r.fetchall())
