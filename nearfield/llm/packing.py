"""Filling containers of fixed capacity, by best fit over the histogram of sizes."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.tokens import token_counts
from nearfield.sources.tables import materialise, table

#: Permitted lengths of containers; none is longer than the last.
CAPACITIES = (2048, 4096, 8192)
#: The histogram of sizes reaches the driver, at most so many entries; with larger
#: capacities sizes count in units, rounded up.
MAX_SIZES = 1 << 20
#: Items of one size that one task numbers.
NUMBERED_ROWS = 100_000


@dataclass
class Pattern:
    """``bins`` containers with the same contents: ``items`` holds (size, copies)."""

    capacity: int
    bins: int
    room: int
    items: list[tuple[int, int]] = field(default_factory=list)


def best_fit(histogram: dict[int, int], capacities: tuple[int, ...]) -> list[Pattern]:
    """Best-fit decreasing for all items at once, containers of equal contents together.

    Sizes go in descending order. All items of a size enter the open containers with the
    least sufficient room, as many copies as fit; when none has room, containers open
    whose capacity has the least cost a token, judged by filling one with the sizes
    that are left. At last each container shrinks to the least capacity that holds its
    contents. The work follows the number of sizes, not of items.
    """
    capacities = tuple(sorted(capacities))
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(p: Pattern) -> None:
        if p.room not in open_:
            open_[p.room] = []
            insort(rooms, p.room)
        open_[p.room].append(p)

    def take(room: int) -> Pattern:
        p = open_[room].pop()
        if not open_[room]:
            del open_[room]
            del rooms[bisect_left(rooms, room)]
        return p

    sizes = sorted((s for s, c in histogram.items() if c > 0 and s > 0), reverse=True)
    ascending = sizes[::-1]

    def cost(capacity: int, size: int, left: int) -> float:
        room = capacity - min(left, capacity // size) * size
        at = bisect_left(ascending, min(room + 1, size)) - 1
        while at >= 0 and room >= ascending[0]:
            if ascending[at] <= room:
                room -= ascending[at] * min(histogram[ascending[at]], room // ascending[at])
            at = min(at - 1, bisect_left(ascending, room + 1) - 1)
        return capacity / (capacity - room)

    for size in sizes:
        left = histogram[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                capacity = min((c for c in capacities if c >= size), key=lambda c: (cost(c, size, left), -c))
                put(Pattern(capacity, -(-left // (capacity // size)), capacity))
                continue
            p = take(rooms[at])
            copies = p.room // size
            full = min(p.bins, left // copies)
            if full:
                put(Pattern(p.capacity, full, p.room - copies * size, [*p.items, (size, copies)]))
                left -= full * copies
            rest = p.bins - full
            if rest and 0 < left < copies:
                put(Pattern(p.capacity, 1, p.room - left * size, [*p.items, (size, left)]))
                left, rest = 0, rest - 1
            if rest:
                put(Pattern(p.capacity, rest, p.room, p.items))
    packed = [p for group in open_.values() for p in group if p.items]
    for p in packed:
        used = p.capacity - p.room
        p.capacity = next(c for c in capacities if c >= used)
        p.room = p.capacity - used
    return sorted(packed, key=lambda p: (-p.capacity, p.room, p.items))


def pack(spark: SparkSession, items: DataFrame, key: str, size: str, capacities: tuple[int, ...] = CAPACITIES, max_sizes: int = MAX_SIZES) -> DataFrame:
    """``key, piece, size, bin_id, bin_start, capacity``: every item's place.

    An item larger than the largest capacity is cut into pieces of it and a rest, no
    other is. Containers are planned on the histogram of sizes, with all ``capacities``
    at once (see ``best_fit``); items then take the places of their size by their number
    among the items of that size, numbered in salted shares, so neither many items nor
    many of one size meet in one task. If the largest capacity exceeds ``max_sizes``,
    sizes are rounded up to a unit that leaves as many, for planning only: no container
    is overfilled, and up to a unit an item stays unused.

    An item of size 0 or null takes no room: one row, ``bin_id`` null. A repeated key is
    another item; a null key is kept; an empty table gives no rows; further columns are
    not read.
    """
    largest = max(capacities)
    if min(capacities) < 1:
        raise ValueError("capacities must be at least 1")
    unit = -(-largest // max_sizes)
    whole = {c // unit: c for c in sorted(capacities) if c >= unit}
    rows = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("total"))
    last = F.greatest(F.ceil(F.col("total") / largest) - 1, F.lit(0)).cast("int")
    pieces = rows.select("key", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("key", "piece", F.least(F.lit(largest), F.col("total") - F.col("piece") * largest).cast("long").alias("size"))
    # what is larger than all whole units fills a container by itself
    pieces = pieces.withColumn("units", F.least(F.ceil(F.col("size") / unit), F.lit(largest // unit)).cast("int"))
    pieces = materialise(spark, pieces, "pieces")
    histogram = {r["units"]: r["count"] for r in pieces.where("size > 0").groupBy("units").count().collect()}  # at most ``max_sizes``
    patterns = best_fit(histogram, tuple(whole))
    taken: dict[int, int] = {}
    slots, first = [], 0
    for p in patterns:
        start = 0
        for s, copies in p.items:
            at = taken.get(s, 0)
            slots.append((s, at, first, copies, start * unit, whole[p.capacity]))
            taken[s] = at + p.bins * copies
            start += s * copies
        first += p.bins
    plan = np.array(sorted(slots), dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(plan)  # at most a few entries a size
    shares = max(16, max(histogram.values(), default=0) // NUMBERED_ROWS)
    salted = pieces.where("size > 0").withColumn("share", F.pmod(F.xxhash64("key", "piece"), F.lit(shares)))
    offsets = salted.groupBy("units", "share").count().withColumn("below", F.sum("count").over(Window.partitionBy("units").orderBy("share")) - F.col("count")).select("units", "share", "below")
    number = F.row_number().over(Window.partitionBy("units", "share").orderBy("key", "piece")) - 1
    numbered = salted.withColumn("n", number).join(offsets, ["units", "share"]).select("key", "piece", "size", "units", (F.col("n") + F.col("below")).alias("n"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = shared.value
        keys = (slot[:, 0] << 40) + slot[:, 1]
        for batch in batches:
            s, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("units", "n"))
            at = slot[np.searchsorted(keys, (s << 40) + n, side="right") - 1]
            bin_, copy = np.divmod(n - at[:, 1], at[:, 3])
            new = [at[:, 2] + bin_, at[:, 4] + copy * s * unit, at[:, 5]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("piece"), batch.column("size"), *(pa.array(x) for x in new)], ["key", "piece", "size", "bin_id", "bin_start", "capacity"]
            )

    kind = dict(rows.dtypes)["key"]
    placed = numbered.mapInArrow(place, f"key {kind}, piece int, size long, bin_id long, bin_start long, capacity long")
    none = F.lit(None).cast("long")
    weightless = pieces.where("size = 0").select("key", "piece", "size", none.alias("bin_id"), none.alias("bin_start"), none.alias("capacity"))
    return placed.unionByName(weightless).withColumnsRenamed({"key": key, "size": size})


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were cut."""
    return pack(spark, _sizes(spark, sf_dir), "doc_id", "n_tokens").where("piece = 1").select("doc_id")


def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's containers of 2,048, 4,096 or 8,192 tokens."""
    return pack(spark, _sizes(spark, sf_dir), "doc_id", "n_tokens")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, room and tokens with 8,192 tokens alone and with 2,048, 4,096 and 8,192."""
    sizes, out = materialise(spark, _sizes(spark, sf_dir), "sizes"), None
    for name, capacities in (("fixed", CAPACITIES[-1:]), ("mixed", CAPACITIES)):
        bins = pack(spark, sizes, "doc_id", "n_tokens", capacities).where("bin_id IS NOT NULL").groupBy("bin_id", "capacity").agg(F.sum("n_tokens").alias("used"))
        row = bins.agg(F.count("*").alias("containers"), F.sum("capacity").alias("room"), F.sum("used").alias("tokens")).select(F.lit(name).alias("capacities"), "*")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("filled", F.round(F.col("tokens") / F.col("room"), 4))


QUERIES = {"p8_found": p8_found, "p8_bins": p8_bins, "p8_report": p8_report}
# A token has about four characters, and texts are either far shorter or far longer than a container.
SQL = {"p8_found": f"SELECT doc_id FROM documents WHERE length(text) > 4 * {CAPACITIES[-1]}"}
