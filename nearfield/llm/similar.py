"""The most similar vectors of every vector, by learned partitions."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.arrays import binary, matrix
from nearfield.llm.collapse import members, vector_groups
from nearfield.llm.routing import LearnedPartitions
from nearfield.operators.blocks import nearest
from nearfield.sources.tables import materialise, table

#: The router's upper levels are fitted on at most so many distinct vectors, its lower ones on as many of
#: each part at most; every vector is indexed.
SAMPLE = 16_384
#: Distinct vectors a partition is meant to hold, and vectors of a sample that a partition needs.
PART_ROWS, PART_SAMPLE = 600, 16
#: Levels fitted at once, and at all: beyond 6e8 distinct vectors partitions grow and are shared among tasks.
LEVELS, MOST_LEVELS = 9, 20
#: Partitions that travel together, so that a vector is sent once for all it probes of them; and the least number of such blocks' levels.
BLOCK_LEVELS, LEAST_BLOCK_LEVELS = 7, 4
#: Vectors of a block, and ``QUERY_SHARE`` times as many queries, that meet in one task; larger ones are cut into shares.
TASK_ROWS = 60_000
QUERY_SHARE, QUERY_ROWS = 8, 4_096
BLOCK = 1 << 22
#: Partitions probed unless stated: a tenth of all, between these; with a radius, which rules out most, not so many.
LEAST_PROBES, MOST_PROBES, RADIUS_PROBES = 12, 64, 24
#: Neighbours of a record that ``p3_found`` and ``p3_nearest`` give.
K_FOUND, K_NEAREST = 5, 10

# The nine audio features and the divisors that bring them to one range.
FEATURES = ["danceability", "energy", "loudness", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo"]
DIVISORS = {"loudness": 60.0, "tempo": 250.0}


def fit_router(groups: DataFrame, n: int, dim: int, kind: str, sample: int = SAMPLE, part_rows: int | None = None) -> LearnedPartitions:
    """A router fitted on samples of the distinct vectors that are the same in every run.

    Up to ``LEVELS`` levels are fitted on one sample. Of more, the upper half is, and
    every part gets a router of its own below, fitted in a task on a sample of its own
    vectors. All gates together are bounded by ``MOST_LEVELS``.
    """
    order = F.xxhash64("v", F.lit(5))
    share = min(1.0, 1.2 * sample / max(n, 1) + 64 / max(n, 1))
    some = groups.select("v", order.alias("o")).where(F.pmod("o", F.lit(1 << 20)) <= int(share * (1 << 20)))
    rows = some.orderBy("o").limit(sample).toArrow()  # bounded by ``sample``
    x = matrix(rows.column("v"), dim, kind)
    part_rows = part_rows or PART_ROWS
    depth = min(math.ceil(math.log2(n / part_rows)), MOST_LEVELS) if n > part_rows else 0
    top = min(depth if depth <= LEVELS else depth // 2, int(math.log2(max(1, len(x) // PART_SAMPLE))))
    router = LearnedPartitions(top).fit(x)
    if top == depth:
        return router
    levels, most = depth - top, min(sample, 2 * PART_SAMPLE << (depth - top))
    upper = groups.sparkSession.sparkContext.broadcast(router)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = upper.value.route(matrix(batch.column(0), dim, kind), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], ["part", "v", "o"])

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("o").slice(0, 2 * most)
        lower = LearnedPartitions(levels).fit(matrix(rows.column("v"), dim, kind))
        return pa.table({"part": rows.column("part").slice(0, 1), "router": pa.array([pickle.dumps(lower)], pa.binary())})

    share = int(min(1.0, most * 2**top / n) * (1 << 20))
    some = groups.select("v", F.xxhash64("v", F.lit(6)).alias("o")).where(F.pmod("o", F.lit(1 << 20)) <= share)
    lower = some.mapInArrow(own, "part int, v binary, o long").groupBy("part").applyInArrow(fit, "part int, router binary").collect()  # one row a part
    return router.grown({r["part"]: pickle.loads(r["router"]) for r in lower}, levels)


def _near(x: np.ndarray, base: np.ndarray, k: int, most: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places ``(query, base, distance)`` of candidates: those within ``most``, else all that can be among the k nearest, equal ones too."""
    center = base.mean(0)
    b, out = base - center, []
    norms = (b**2).sum(1)
    step = max(1, BLOCK // max(1, len(base)))
    for at in range(0, len(x), step):
        q = x[at : at + step] - center
        own = (q**2).sum(1)[:, None]
        d = own + norms - 2 * (q @ b.T)
        if most is not None:
            i, j = np.nonzero(d <= (most + 1e-6) ** 2 + 1e-9)
        elif k >= len(base):
            i, j = np.divmod(np.arange(d.size), len(base))
        else:
            bound = np.sqrt(np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1 : k], 0)) + 1.1e-6
            i, j = np.nonzero(d <= bound * bound + 1e-12 * (own + norms.max()))
        exact = np.sqrt(((x[at + i] - base[j]) ** 2).sum(1))
        out.append((at + i, j, np.round(exact, 6)))
    i, j, d = (np.concatenate(c) for c in zip(*out))
    return i, j, d


def default_probes(partitions: int, most: float | None) -> int:
    return min(partitions, MOST_PROBES if most is None else RADIUS_PROBES, max(LEAST_PROBES, partitions // 10))


def neighbours(
    spark: SparkSession,
    groups: DataFrame,
    dim: int,
    kind: str,
    k: int,
    probes: int | None = None,
    most: float | None = None,
    queries: Column | None = None,
    n: int | None = None,
    router: LearnedPartitions | None = None,
) -> DataFrame:
    """``a, b, d``: for each distinct vector its ``k`` nearest others among the partitions probed.

    Every vector is stored in the partition that every gate finds more probable and
    sought in the ``probes`` most probable ones (see ``default_probes``); within these
    distances are exact, in double precision, rounded to 6 decimals, ties to the smaller
    id. ``most`` leaves out what lies farther, and of the partitions probed those that
    lie farther behind a gate; ``queries`` (a condition on ``groups``) limits what is sought, not what is found.

    Neighbouring partitions form blocks, and a vector is sent once to each block in which
    it has a place or probes; with it go the partitions it probes there. A block with
    many vectors or queries is cut into shares of both, each pair of which meets in a
    task of its own.
    """
    n = groups.count() if n is None else n
    router = fit_router(groups, n, dim, kind) if router is None else router
    depth, shared = router.depth, spark.sparkContext.broadcast(router)
    probes = default_probes(2**depth, most) if probes is None else min(probes, 2**depth)
    low = max(0, min(BLOCK_LEVELS, depth - LEAST_BLOCK_LEVELS))

    def places(v: pa.Array, sought: np.ndarray) -> tuple[np.ndarray, ...]:
        """``row, block, partition, own`` of what every vector is sent for, by row and block."""
        x = matrix(v, dim, kind)
        home = shared.value.route(x, 1)
        parts = shared.value.route(x, probes, most)
        lost = ~(parts == home).any(1)
        parts[lost, -1] = home[lost, 0]
        own = parts == home
        row, rank = np.nonzero((parts >= 0) & (own | sought[:, None]))
        part = parts[row, rank]
        order = np.lexsort((part, row))
        row, part, own = row[order], part[order], own[row, rank][order]
        return row, part >> low, part & (2**low - 1), own

    def heads(row: np.ndarray, block: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]) if len(row) else np.zeros(0, np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sought = batch.column(2).to_numpy(zero_copy_only=False)
            row, block, leaf, own = places(batch.column(1), sought)
            first = heads(row, block)
            x = matrix(batch.column(1), dim, kind)
            home = np.maximum.reduceat(np.where(own, leaf, -1), first) if len(first) else first
            bounds = np.r_[first, len(row)].astype(np.int32)
            leaves = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(leaf.astype(np.uint8).tobytes())])
            at = row[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[first].astype(np.int32)), batch.column(0).take(pa.array(at)), binary(x[at]), pa.array(home.astype(np.int16)), leaves, pa.array(sought[at])], ["block", "gid", "v", "home", "leaves", "sought"]
            )

    wanted = F.lit(True) if queries is None else queries
    asked = groups.select("gid", "v", wanted.alias("sought"))
    routed = asked.mapInArrow(route, "block int, gid long, v binary, home smallint, leaves binary, sought boolean")

    def occupy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many vectors and queries each block gets; routing again is cheaper than writing every vector several times."""
        total = np.zeros((2, 2 ** (depth - low)), np.int64)
        for batch in batches:
            sought = batch.column(1).to_numpy(zero_copy_only=False)
            row, block, _, own = places(batch.column(0), sought)
            first = heads(row, block)
            total[0] += np.bincount(block[own], minlength=total.shape[1])
            total[1] += np.bincount(block[first][sought[row[first]]], minlength=total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), *map(pa.array, total)], ["block", "vectors", "queries"])

    sizes = asked.select("v", "sought").mapInArrow(occupy, "block int, vectors long, queries long").groupBy("block").agg(F.sum("vectors").alias("vectors"), F.sum("queries").alias("queries"))
    shares = lambda column, rows: F.greatest(F.ceil(F.col(column) / rows), F.lit(1)).cast("int")
    large = sizes.select("block", shares("vectors", TASK_ROWS).alias("bs"), shares("queries", QUERY_SHARE * TASK_ROWS).alias("qs")).where("bs * qs > 1").collect()  # at most one row a block
    if large:
        cut = routed.join(F.broadcast(spark.createDataFrame(large, "block int, bs int, qs int")), "block", "left").withColumns({"bs": F.coalesce("bs", F.lit(1)), "qs": F.coalesce("qs", F.lit(1))})
        mine_b, mine_q = F.pmod(F.xxhash64("gid"), F.col("bs")), F.pmod(F.xxhash64("gid", F.lit(2)), F.col("qs"))
        is_base = lambda c: (F.col("home") >= 0) & (F.floor(c / F.col("qs")) == mine_b)
        is_query = lambda c: F.col("sought") & (F.pmod(c, F.col("qs")) == mine_q)
        pairs = F.filter(F.sequence(F.lit(0), F.col("bs") * F.col("qs") - 1), lambda c: is_base(c) | is_query(c))
        cut = cut.withColumn("share", F.explode(pairs))
        routed = cut.select("block", "share", "gid", "v", "leaves", F.when(is_base(F.col("share")), F.col("home")).otherwise(F.lit(-1)).cast("smallint").alias("home"), is_query(F.col("share")).alias("sought"))
    else:
        routed = routed.withColumn("share", F.lit(0))

    def search(rows: pa.Table) -> pa.Table:
        home, ids = rows.column("home").to_numpy(), rows.column("gid").to_numpy()
        x = matrix(rows.column("v"), dim, kind).astype(np.float64)
        base, asking = np.flatnonzero(home >= 0), np.flatnonzero(rows.column("sought").to_numpy())
        base = base[np.argsort(home[base], kind="stable")]
        starts = np.searchsorted(home[base], np.arange(2**low + 1))
        leaves = rows.column("leaves").take(pa.array(asking)).to_pylist()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(asking), QUERY_ROWS):
            some = asking[at : at + QUERY_ROWS]
            listed = leaves[at : at + QUERY_ROWS]
            leaf = np.frombuffer(b"".join(listed), np.uint8)
            query = np.repeat(np.arange(len(some)), [len(t) for t in listed])
            query, leaf = query[np.argsort(leaf, kind="stable")], np.sort(leaf)
            found = [(query[:0], query[:0], np.zeros(0))]
            for part in np.unique(leaf):
                there = base[starts[part] : starts[part + 1]]
                if len(there):
                    who = query[np.searchsorted(leaf, part) : np.searchsorted(leaf, part, side="right")]
                    i, j, d = _near(x[some[who]], x[there], k + 1, most)
                    found.append((who[i], there[j], d))
            i, j, d = (np.concatenate(c) for c in zip(*found))
            a, b = ids[some[i]], ids[j]
            keep = a != b
            if most is not None:
                keep &= d <= most
            a, b, d = a[keep], b[keep], d[keep]
            order = np.lexsort((b, d, a))
            a, b, d = a[order], b[order], d[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            out.append((a[rank < k], b[rank < k], d[rank < k]))
        return pa.table(dict(zip("abd", map(np.concatenate, zip(*out)))))

    found = routed.groupBy("block", "share").applyInArrow(search, "a long, b long, d double")
    by = Window.partitionBy("a").orderBy("d", "b")
    return found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).select("a", "b", "d")


def similar_records(
    spark: SparkSession, df: DataFrame, id_column: str, vector: Column, dim: int, kind: str, k: int, probes: int | None = None, most: float | None = None
) -> DataFrame:
    """``id, rank, neighbour, d``: the ``k`` nearest other records of every record.

    Exact copies are one vector while searching: a record's copies are its neighbours at
    distance 0, those of smallest id first, and a neighbour's copies follow it, so each
    vector carries only its ``k + 1`` smallest ids and a group of copies is never
    paired out. See ``neighbours`` for the search and ``vector_groups`` for which rows
    count. A table with fewer than ``k + 1`` records gives all; an empty one none.
    """
    rows, groups = vector_groups(spark, df, id_column, vector, dim, kind, k + 1)
    return _records(rows, groups, neighbours(spark, groups, dim, kind, k, probes, most), k)


def _records(rows: DataFrame, groups: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """``id, rank, neighbour, d`` of records from ``near(a, b, d)`` of their distinct vectors."""
    ids = groups.select(F.col("gid").alias("b"), "ids")
    other = near.join(ids, "b").select(F.col("a").alias("gid"), "d", F.explode("ids").alias("id"))
    same = groups.where("n > 1").select("gid", F.lit(0.0).alias("d"), F.explode("ids").alias("id"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k + 1)
    listed = other.unionByName(same).groupBy("gid").agg(first.alias("near"))
    own = members(rows, groups.select("gid", "reps").join(listed, "gid"))
    left = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return own.select("id", F.posexplode(left).alias("rank", "x")).select("id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("neighbour"), F.col("x.d").alias("d"))


def track_vector() -> Column:
    return F.array(*(F.col(f).cast("double") / DIVISORS[f] if f in DIVISORS else F.col(f).cast("double") for f in FEATURES))


SOURCES = {
    "dataset_vectors": ("vec_id", lambda: F.col("embedding"), 32, "f4", 0.5),
    "spotify_tracks": ("row_id", track_vector, len(FEATURES), "f8", 0.0025),
}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, (key, vector, dim, kind, most) in SOURCES.items():
        near = similar_records(spark, table(spark, sf_dir, name), key, vector(), dim, kind, K_FOUND, most=most)
        pairs = near.select(F.lit(name).alias("src"), F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, every record's ten nearest others at any distance."""
    out = None
    for name, (key, vector, dim, kind, _) in SOURCES.items():
        near = similar_records(spark, table(spark, sf_dir, name), key, vector(), dim, kind, K_NEAREST).select(F.lit(name).alias("src"), "*")
        out = near if out is None else out.unionByName(near)
    return out


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, the share of the true neighbours found, for every id divisible by 50 against all.

    ``within`` is null for the ten nearest at any distance, as ``p3_nearest`` seeks them,
    and R for the five nearest within R, as ``p3_found`` does; ``partitions`` and
    ``probes`` are those of these queries. Neighbours are records, copies among them, and
    ``n_queries`` counts the ids with any; without one, ``recall`` is null.
    """
    out = None
    for name, (key, vector, dim, kind, most) in SOURCES.items():
        row = recall(spark, table(spark, sf_dir, name), key, vector(), dim, kind, most, 50).select(F.lit(name).alias("src"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def recall(spark: SparkSession, df: DataFrame, id_column: str, vector: Column, dim: int, kind: str, most: float, every: int) -> DataFrame:
    """``within, partitions, probes, n_queries, recall`` of both searches as they are by default, for the ids divisible by ``every``."""
    rows, groups = vector_groups(spark, df, id_column, vector, dim, kind, K_NEAREST + 1)
    wanted = rows.where(F.col("id") % every == 0)
    held = members(wanted, groups.select("gid", "reps")).select("gid", F.lit(True).alias("asked")).distinct()
    groups = materialise(spark, groups.join(held, "gid", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "asked")
    router = fit_router(groups, groups.count(), dim, kind)
    found = neighbours(spark, groups, dim, kind, K_NEAREST, queries=F.col("asked"), router=router)
    close = neighbours(spark, groups, dim, kind, K_FOUND, most=most, queries=F.col("asked"), router=router)
    true = materialise(spark, _records(wanted, groups, exact_neighbours(spark, groups, dim, kind, K_NEAREST, F.col("asked")), K_NEAREST), "exact")
    true_close = true.where((F.col("d") <= most) & (F.col("rank") <= K_FOUND))
    out = None
    for within, every_one, near, k in ((None, true, found, K_NEAREST), (most, true_close, close, K_FOUND)):
        got = _records(wanted, groups, near, k).select("id", "neighbour", F.lit(1).alias("hit"))
        hit = every_one.join(got, ["id", "neighbour"], "left")
        row = hit.agg(F.countDistinct("id").alias("n_queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))
        row = row.select(F.lit(within).cast("double").alias("within"), F.lit(2**router.depth).alias("partitions"), F.lit(default_probes(2**router.depth, within)).alias("probes"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def exact_neighbours(spark: SparkSession, groups: DataFrame, dim: int, kind: str, k: int, queries: Column, spare: int = 8) -> DataFrame:
    """The same by brute force: the stated query set, in blocks, against all vectors.

    Queries of a checked size go to all tasks, more meet the vectors in shares (see the
    core's exact search). A few spare ones are ranked again, since equal rounded
    distances go by id.
    """

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), binary(matrix(batch.column(1), dim, kind).astype(np.float64))], ["gid", "v"])

    asked = groups.where(queries).select("gid", "v").mapInArrow(wide, "qid long, v binary") if kind != "f8" else groups.where(queries).select(F.col("gid").alias("qid"), "v")
    base = groups.select("gid", "v").mapInArrow(wide, "vec_id long, v binary") if kind != "f8" else groups.select(F.col("gid").alias("vec_id"), "v")
    found = nearest(spark, asked, base, dim, k + 1 + spare, "l2").where("qid <> vec_id").select(F.col("qid").alias("a"), F.col("vec_id").alias("b"), F.round("dist", 6).alias("d"))
    return found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= k).select("a", "b", "d")


QUERIES = {"p3_found": p3_found, "p3_nearest": p3_nearest, "p3_recall": p3_recall}


def _sql(name: str, rows: str, near: str, most: float) -> str:
    return f"""SELECT DISTINCT '{name}' AS src, least(id, other) AS id_a, greatest(id, other) AS id_b FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rn FROM (
    SELECT a.id, b.id AS other, round(list_distance(a.x, b.x), 6) AS d FROM ({rows}) a JOIN ({rows}) b ON {near} WHERE a.id <> b.id) WHERE d <= {most})
WHERE rn <= 5"""


_X = ", ".join(f"{f} / {DIVISORS[f]}" if f in DIVISORS else f for f in FEATURES)
_FULL = " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
# no two within the distance differ by more in one feature, which keeps the join small
_CLOSE = "b.x[{0}] BETWEEN a.x[{0}] - {1} AND a.x[{0}] + {1}"
SQL = {
    "p3_found": _sql("dataset_vectors", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM dataset_vectors WHERE len(embedding) = 32 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y))) = 0", _CLOSE.format(1, 0.51), 0.5)
    + "\nUNION ALL\n"
    + _sql("spotify_tracks", f"SELECT row_id AS id, CAST([{_X}] AS DOUBLE[]) AS x FROM spotify_tracks WHERE {_FULL}", _CLOSE.format(1, 0.0026) + " AND " + _CLOSE.format(9, 0.0026), 0.0025),
}
