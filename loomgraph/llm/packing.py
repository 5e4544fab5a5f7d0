"""Filling containers of fixed capacity with items of varying length.

Method: *variable-capacity best-fit*. Several container sizes may be permitted; an item goes into the open container
that it fills best, and where none has room, the size with the least cost for what still waits is opened. At the end
each container is downsized to the least permitted size that holds its contents.

Items of equal size are interchangeable, so the plan is made over the histogram of sizes, which has at most one row per
size up to the largest capacity, whatever the number of items. The plan is a short list of runs: ``count`` containers
alike, each with so many items of each size. Items then find their container by their rank among the items of their
size. Ranks are made per salt of the item's key, with prefix sums over the salts, so no size is ever sorted in one task.

Defined results: items larger than the largest capacity are cut into full containers and a rest that is packed like any
other item; items of size 0 (empty and null texts) take no room and are spread over the containers; repeated rows are
each packed; an empty table gives no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: About so many items of one size are ranked by one sort.
RANKED_TOGETHER = 50_000


def plan(histogram: dict[int, int], sizes: Sequence[int]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Runs of equal containers, ``(count, capacity, [(size, how many in each), ...])``, for items by size.

    Sizes are taken in falling order. ``opened`` has the open containers by free room; containers with the same free
    room and contents are one group, so the steps depend on the number of different sizes only.
    """
    sizes = sorted(sizes)
    rooms: list[int] = []  # sorted
    opened: dict[int, list[list]] = {}  # free room -> [[count, capacity, contents], ...]

    def put(room: int, count: int, capacity: int, contents: tuple) -> None:
        if room not in opened:
            opened[room] = []
            insort(rooms, room)
        opened[room].append([count, capacity, contents])

    for size in sorted((s for s in histogram if s > 0), reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                group = opened[room][-1]
                each = min(room // size, left)
                used = min(group[0], left // each)
                group[0] -= used
                if not group[0]:
                    opened[room].pop()
                    if not opened[room]:
                        del opened[room]
                        rooms.pop(at)
                put(room - each * size, used, group[1], (group[2], size, each))
                left -= used * each
                continue
            # the size with the least room lost for each item that waits; the larger one if they are equal
            capacity = min((c for c in sizes if c >= size), key=lambda c: (c / min(c // size, left), -c))
            each = min(capacity // size, left)
            used = left // each
            put(capacity - each * size, used, capacity, ((), size, each))
            left -= used * each
    out = []
    for room in rooms:
        for count, capacity, contents in opened[room]:
            held, chain = {}, contents
            while chain:
                chain, size, each = chain
                held[size] = held.get(size, 0) + each
            out.append((count, capacity, sorted(held.items(), reverse=True)))
    return out


def pack(
    items: DataFrame,
    key: str,
    size: str,
    sizes: Sequence[int] = (2048,),
    fitted: Sequence[int] = (),
) -> DataFrame:
    """One row for each piece of an item: ``key``, piece, size, container, capacity, used, fitted_capacity.

    ``sizes`` are the permitted capacities of containers while they are filled, ``fitted`` those that they are
    downsized to at the end (the capacity itself is always one of them). Pieces are numbered from 0; only items larger
    than the largest capacity have more than one. ``key`` need not be unique.
    """
    spark = items.sparkSession
    most = max(sizes)
    steps = sorted({*fitted, *sizes})
    whole = F.coalesce(F.col(size), F.lit(0)).cast("long")
    base = items.select(F.col(key).alias("_key"), whole.alias("_n")).withColumn("_h", F.xxhash64("_key"))
    base = cut(base)  # sizes are dear (tokenizing) and needed twice
    pieces = base.select(
        "_key",
        "_h",
        F.posexplode(F.when(F.col("_n") > most, F.concat(F.array_repeat(F.lit(most).cast("long"), (F.floor(F.col("_n") / most)).cast("int")), F.when(F.col("_n") % most > 0, F.array(F.col("_n") % most)).otherwise(F.array().cast("array<bigint>")))).otherwise(F.array("_n"))).alias("piece", "_size"),
    )
    # at most one row per size up to the largest capacity
    histogram = {r["_size"]: r["n"] for r in pieces.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    runs = plan(histogram, sizes)
    total = sum(count for count, _, _ in runs)
    salts = max(1, -(-max(histogram.values(), default=0) // RANKED_TOGETHER))

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_h", "piece"), F.lit(salts)))
    offsets = salted.groupBy("_size", "_salt").agg(F.count("*").alias("_c"))
    offsets = offsets.withColumn("_before", F.sum("_c").over(Window.partitionBy("_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("_size", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("_size", "_salt").orderBy("_key", "piece")) - 1)
    ranked = ranked.join(offsets, ["_size", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    rows, taken, first = [], {}, 0
    for count, capacity, held in runs:
        used = sum(s * each for s, each in held)
        least = next(c for c in steps if c >= used)
        for s, each in held:
            start = taken.get(s, 0)
            taken[s] = start + count * each
            rows.append((s, start, taken[s], each, first, capacity, used, min(least, capacity)))
        first += count
    schema = "_size long, _from long, _to long, _each long, _first long, capacity int, used int, fitted_capacity int"
    # bounded by the number of sizes and runs, not by the items
    where = F.broadcast(spark.createDataFrame(rows, schema))
    full = ranked.filter("_size > 0").join(where, "_size").filter("_rank >= _from and _rank < _to")
    full = full.withColumn("container", F.col("_first") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each")))
    empty = ranked.filter("_size = 0").withColumn("container", F.when(F.lit(total) > 0, F.pmod(F.col("_rank"), F.lit(max(1, total)))))
    out = [F.col("_key").alias(key), "piece", F.col("_size").alias("size"), "container"]
    full = full.select(*out, "capacity", "used", "fitted_capacity")
    none = [F.lit(None).cast("int").alias(c) for c in ("capacity", "used", "fitted_capacity")]
    return full.unionByName(empty.select(*out, *none))
