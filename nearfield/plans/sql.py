"""Building blocks of the queries' SQL."""

from __future__ import annotations

VECTORS = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"


def knn(dist: str, k: int, base: str = "e", out: str = "round(dist, 6) + 0.0 AS dist") -> str:
    """The k nearest of ``base`` for every vector of ``e``."""
    return f"""d AS (SELECT a.vec_id AS qid, b.vec_id, {dist} AS dist FROM e a CROSS JOIN {base} b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rn FROM d)
SELECT qid, vec_id, CAST(rn AS INTEGER) AS rn, {out} FROM r WHERE rn <= {k}"""


def lloyd(k: int, steps: int, source: str = "e") -> str:
    """``c0 .. c{steps}(cell, c)`` and ``a0 .. a{steps}(vec_id, label, v, cell, d)`` from the k smallest ids."""
    parts = [f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cell, v AS c FROM (SELECT * FROM {source} ORDER BY vec_id LIMIT {k}))"]
    for t in range(steps + 1):
        parts.append(
            f"a{t} AS (SELECT vec_id, label, v, cell, d FROM (SELECT x.vec_id, x.label, x.v, y.cell, list_distance(x.v, y.c) AS d, "
            f"row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.v, y.c), y.cell) AS r FROM {source} x CROSS JOIN c{t} y) WHERE r = 1)"
        )
        if t < steps:
            parts.append(
                f"c{t + 1} AS (SELECT cell, list(m ORDER BY pos) AS c FROM (SELECT cell, pos, avg(x) AS m FROM "
                f"(SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{t}) GROUP BY cell, pos) GROUP BY cell)"
            )
    return ",\n".join(parts)


def probes(centers: str, cells: int, metric: str = "list_distance") -> str:
    return (
        f"p AS (SELECT qid, q, cell, rn FROM (SELECT a.vec_id AS qid, a.v AS q, c.cell, row_number() OVER (PARTITION BY a.vec_id ORDER BY {metric}(a.v, c.c), c.cell) AS rn "
        f"FROM e a CROSS JOIN {centers} c) WHERE rn <= {cells})"
    )


def best(source: str, k: int, out: str = "round(dist, 6) + 0.0 AS dist") -> str:
    return f"""SELECT qid, vec_id, CAST(rn AS INTEGER) AS rn, {out} FROM
(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rn FROM {source}) WHERE rn <= {k}"""


def books(source: str, bounds: list[tuple[int, int]], ksub: int, steps: int) -> str:
    """``book(sub, code, c)`` and ``coded(vec_id, sub, code)`` of a product quantizer over ``source(vec_id, v)``."""
    parts = []
    for s, (lo, hi) in enumerate(bounds):
        parts.append(f"s{s} AS (SELECT vec_id, v[{lo + 1}:{hi}] AS v FROM {source})")
        parts.append(f"b{s}_0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS code, v AS c FROM (SELECT min(vec_id) AS vec_id, v FROM s{s} GROUP BY v ORDER BY 1 LIMIT {ksub}))")
        for t in range(steps + 1):
            parts.append(
                f"n{s}_{t} AS (SELECT vec_id, v, code FROM (SELECT x.vec_id, x.v, y.code, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.v, y.c), y.code) AS r "
                f"FROM s{s} x CROSS JOIN b{s}_{t} y) WHERE r = 1)"
            )
            if t < steps:
                parts.append(
                    f"b{s}_{t + 1} AS (SELECT code, list(m ORDER BY pos) AS c FROM (SELECT code, pos, avg(x) AS m FROM "
                    f"(SELECT code, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM n{s}_{t}) GROUP BY code, pos) GROUP BY code)"
                )
    last = range(len(bounds))
    parts.append("book AS (" + " UNION ALL ".join(f"SELECT {s} AS sub, code, c FROM b{s}_{steps}" for s in last) + ")")
    parts.append("coded AS (" + " UNION ALL ".join(f"SELECT vec_id, {s} AS sub, code FROM n{s}_{steps}" for s in last) + ")")
    parts.append("decoded AS (SELECT vec_id, flatten(list(c ORDER BY sub)) AS v FROM coded JOIN book USING (sub, code) GROUP BY vec_id)")
    return ",\n".join(parts)
