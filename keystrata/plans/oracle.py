"""Parts of the DuckDB SQL that queries are compared with."""

from __future__ import annotations

import math

HISTOGRAM = "STRUCT(x {}, n BIGINT)[]"


def merge_once(h: str, size: int, whole: bool) -> str:
    """DuckDB: the closest neighbours of a sorted list made one, if it is over size."""
    gaps = "list_transform(range(2, len(s) + 1), lambda j: s[j].x - s[j - 1].x)"
    total = "(s[i].x * s[i].n + s[i + 1].x * s[i + 1].n)"
    mean = f"{total} // (s[i].n + s[i + 1].n)" if whole else f"{total} / (s[i].n + s[i + 1].n)"
    fewer = f"list_concat(s[1:i - 1], [{{'x': {mean}, 'n': s[i].n + s[i + 1].n}}], s[i + 2:])"
    return f"list_transform([{h}], lambda s: CASE WHEN len(s) > {size} THEN list_transform([list_position({gaps}, list_min({gaps}))], lambda i: {fewer})[1] ELSE s END)[1]"


def bounded_sql(rows: str, by: str, size: int, parts: int = 16, whole: bool = False) -> str:
    """DuckDB: by, h from rows (by, x): values counted, inserted in rising order in each part, parts merged in order."""
    kind = "BIGINT" if whole else "DOUBLE"
    group = f"{by}, " if by else ""
    add = merge_once("list_concat(a, e)", size, whole)
    shrink = f"list_reduce(list_concat([list_sort(list_concat(a, h))], list_transform(range({size}), lambda _: CAST([] AS {HISTOGRAM.format(kind)}))), lambda b, _: {merge_once('b', size, whole)})"
    return f"""SELECT {group}list_reduce(list(h ORDER BY part), lambda a, h: {shrink}) AS h FROM
    (SELECT {group}part, list_reduce(list([{{'x': x, 'n': n}}] ORDER BY x), lambda a, e: {add}) AS h FROM
    (SELECT {group}x, CAST(count(*) AS BIGINT) AS n, (CAST(floor(x) AS BIGINT) % {parts} + {parts}) % {parts} AS part FROM (SELECT {group}CAST(x AS {kind}) AS x FROM ({rows})) GROUP BY ALL) GROUP BY ALL){f' GROUP BY {by}' if by else ''}"""


def hex_part(x: str, i: int) -> str:
    """DuckDB: eight hexadecimal digits of a value's md5 as a number."""
    return f"CAST('0x' || substr(md5(CAST({x} AS VARCHAR)), {8 * i + 1}, 8) AS BIGINT)"


def bloom_sql(members: str, asked: str, rate: float) -> str:
    """DuckDB: x, hit for asked (x) against a blocked filter of members (x) by md5."""
    k = max(1, round(-math.log2(rate)))
    places = lambda rows: f"SELECT x, {hex_part('x', 0)} % b * 512 + ({hex_part('x', 1)} + i * ({hex_part('x', 2)} % 511 + 1)) % 512 AS p FROM ({rows}), size, (SELECT unnest(range({k})) AS i)"
    return f"""WITH size AS (SELECT greatest(1, CAST(ceil(greatest(64, ceil(-greatest(count(*), 1) * ln({rate}) / (ln(2) * ln(2)))) / 512) AS BIGINT)) AS b FROM ({members})),
    held AS (SELECT DISTINCT p FROM ({places(members)})) SELECT x, bool_and(held.p IS NOT NULL) AS hit FROM ({places(asked)}) a LEFT JOIN held USING (p) GROUP BY x"""
