"""Filling fixed-capacity containers: best-fit planned over a length histogram.

The plan is made over counts of lengths, not over documents, so its size is bounded by the capacity. The
documents of a length then take that length's planned slots by their rank among documents of the length.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.session import cut

RUN_SCHEMA = "size int, first_rank long, last_rank long, first_container long, per_container int"


def plan_runs(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over (length, count): runs of slots, and the number of containers.

    A run (size, first_rank, last_rank, first_container, per_container) gives the documents of ``size`` ranked
    first..last to containers in order, ``per_container`` to each. Equal containers are kept as one group
    (room left, first container, count), so the work follows the lengths, not the documents.
    """
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    runs, made = [], 0

    def add(room: int, first: int, count: int) -> None:
        if count and room:
            if not groups[room]:
                bisect.insort(rooms, room)
            groups[room].append((first, count))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, first, count = capacity, made, -(-left // (capacity // size))
                made += count
            each = room // size
            full = min(count, left // each)
            if full:
                runs.append((size, rank, rank + full * each - 1, first, each))
                add(room - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            rest = count - full
            if rest and left and left < each:
                runs.append((size, rank, rank + left - 1, first + full, left))
                add(room - left * size, first + full, 1)
                full, rest, left = full + 1, rest - 1, 0
            add(room, first + full, rest)
    return runs, made


#: Rows that one task of a ranking sorts, about.
TASK_ROWS = 250_000


def ranked(items: DataFrame, group: list[str], order: list[str], salts: int) -> DataFrame:
    """``items`` with ``rank`` 0.. within ``group``, without ever sorting a hot group in one task.

    Rows are spread over ``salts`` parts by a hash of ``order``, ranked within a part, and moved by the sizes
    of the parts before; the parts' sizes are a small table.
    """
    salted = items.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = Window.partitionBy(*group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(*group, "__salt").count().withColumn("__off", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy(*group, "__salt").orderBy(*order)
    return (
        salted.withColumn("__r", F.row_number().over(within) - 1)
        .join(offsets, [*group, "__salt"])
        .withColumn("rank", F.col("__off") + F.col("__r"))
        .drop("__salt", "__r", "__off")
    )


def pack(sizes: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(``item``, piece_no, n_tokens, container_id): every row of ``sizes`` in containers of ``capacity``.

    An item over the capacity is divided into pieces of the whole capacity, each a container of its own, and
    a rest that is packed like any other; no other item is divided.

    Defined cases: null or non-positive sizes need no container and are no result; equal sizes take slots
    in a fixed pseudo-random order of their items; repeated rows are packed once per row; an empty input has
    no containers; other columns are ignored, whatever their names.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = sizes.sparkSession
    base = sizes.filter(F.col(size) > 0).select(F.col(item).alias("__item"), F.col(size).cast("long").alias("__size"))
    rest = base.select("__item", (F.col("__size") / capacity).cast("long").alias("__whole"), F.pmod("__size", F.lit(capacity)).cast("int").alias("size"))
    # At most ``capacity`` rows: the only thing the driver sees of the data.
    counted = rest.groupBy("size").agg(F.count("*").alias("n"), F.sum("__whole").alias("w")).collect()
    histogram = {r["size"]: r["n"] for r in counted if r["size"] > 0}
    runs, made = plan_runs(histogram, capacity)
    slots = _runs_table(spark, runs)
    # Parts and series grow with the commonest size and the whole pieces, so that none is sorted in one task.
    small = ranked(rest.filter("size > 0"), ["size"], ["__item"], -(-max(histogram.values(), default=1) // TASK_ROWS))
    series = max(1, -(-sum(r["w"] for r in counted) // TASK_ROWS))
    packed = small.join(slots, (small["size"] == slots["size"]) & F.col("rank").between(F.col("first_rank"), F.col("last_rank"))).select(
        "__item",
        (F.col("__whole") + 1).alias("piece_no"),
        small["size"].cast("long").alias("n_tokens"),
        (F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per_container"))).cast("long").alias("container_id"),
    )
    large = rest.filter("__whole > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__whole"))))
    whole = ranked(large.withColumn("__all", F.pmod(F.xxhash64("__item"), F.lit(series))), ["__all"], ["__item", "piece_no"], 1)
    # Containers of whole pieces are numbered after the planned ones, in interleaved series.
    whole = whole.select("__item", "piece_no", F.lit(capacity).cast("long").alias("n_tokens"), (F.lit(made) + F.col("rank") * series + F.col("__all")).cast("long").alias("container_id"))
    return packed.unionByName(whole).withColumnRenamed("__item", item)


def _runs_table(spark: SparkSession, runs: list[tuple]) -> DataFrame:
    """The runs as a DataFrame; Spark broadcasts it only within its own size threshold."""
    import pandas as pd

    frame = pd.DataFrame(runs, columns=[c.split()[0] for c in RUN_SCHEMA.split(", ")])
    return spark.createDataFrame(frame, RUN_SCHEMA) if len(frame) else spark.createDataFrame([], RUN_SCHEMA)


def pack_all(sizes: DataFrame, item: str, size: str, capacities: dict[str, int]) -> DataFrame:
    """``pack`` for each kind of container: (container_type, container_id, ``item``, piece_no, n_tokens).

    ``sizes`` is written once, so that texts are not measured again for each kind.
    """
    sizes = cut(sizes.select(item, size))
    out = None
    for kind in sorted(capacities):
        one = pack(sizes, item, size, capacities[kind]).select(F.lit(kind).alias("container_type"), "container_id", item, "piece_no", "n_tokens")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no kind of container")
    return out


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per kind: containers, pieces, tokens, fill (share of the capacity used) and the least number of containers possible by volume."""
    capacity = F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair])[F.col("container_type")]
    return (
        packed.groupBy("container_type", "container_id")
        .agg(F.sum("n_tokens").alias("t"), F.count("*").alias("p"))
        .groupBy("container_type")
        .agg(F.count("*").alias("containers"), F.sum("p").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
        .withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))
        .withColumn("least_containers", F.ceil(F.col("tokens") / capacity))
    )
