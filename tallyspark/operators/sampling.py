"""Matchup sampling (Q1), chunking with a shuffled run order (Q2), dense ids.

Randomness is a seeded hash of (seed, key) (see ``functions.uniform``), so a
draw does not depend on partitioning, retries or lost executors, and an SQL
oracle can reproduce it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uniform import hash_uniform

# Fixed value: added to the smallest rating gap so that weights stay finite.
GAP_EPS = 1e-6


# Bytes up to which the seats' tables are broadcast: M * M entries of a position and a running sum.
BROADCAST_BYTES = 64 << 20
ENTRY_BYTES = 16


def seat_tables(ratings: DataFrame) -> DataFrame:
    """Per seat A, what its opponents are drawn by: ``a``, ``table`` (array of ``j, cum``).

    ``ratings``: ``idx`` (0 to M - 1), ``rating``. The weight of opponent j is ``1 / (1 + d / dmin)``, ``d = |r_a - r_b|``, ``dmin = min(d) +
    1e-6``; ``cum`` is the running sum of the weights by ``idx``. Made once for all items.
    """
    one = ratings.agg(F.array_sort(F.collect_list(F.struct("idx", "rating"))).alias("all"))  # M entries, a run-config size
    pairs = (one.select(F.explode("all").alias("x"), "all").repartition(F.col("x.idx"))
             .select("x", F.explode("all").alias("y")).filter(F.col("x.idx") != F.col("y.idx"))
             .select(F.col("x.idx").alias("a"), F.col("y.idx").alias("j"), F.abs(F.col("x.rating") - F.col("y.rating")).alias("gap")))
    seat = Window.partitionBy("a")
    weighted = pairs.withColumn("w", F.lit(1.0) / (F.lit(1.0) + F.col("gap") / (F.min("gap").over(seat) + F.lit(GAP_EPS))))
    summed = weighted.withColumn("cum", F.sum("w").over(seat.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)))
    return summed.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("j", "cum"))).alias("table"))


def draw_matchups(items: DataFrame, ratings: DataFrame, key: str = "item_id", seed: str = "arena") -> DataFrame:
    """Q1: draw (model_a, model_b) per item with ratings frozen for the chunk.

    ``ratings``: ``idx`` (0 to M - 1), ``system``, ``rating``, one row per system. A is uniform; B is drawn among the others with the weights of
    :func:`seat_tables`; then seats swap with probability 1/2. An item meets the table of its seat A by a join (broadcast
    while the tables are within ``BROADCAST_BYTES``; else dealt by the seat, of which all are equally likely) and does one
    lookup by halving.
    """
    m = ratings.count()
    if m < 2:
        raise ValueError("two systems are needed")
    tables = seat_tables(ratings)
    names = ratings.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "system"))), lambda x: x["system"]).alias("n")).scalar()
    if m * m * ENTRY_BYTES <= BROADCAST_BYTES:
        tables = F.broadcast(tables)
    k = F.col(key)
    d = (items.withColumn("_a", F.floor(hash_uniform(f"{seed}:a", k) * m).cast("int")).withColumn("_u2", hash_uniform(f"{seed}:b", k))
         .withColumn("_u3", hash_uniform(f"{seed}:s", k)))
    d = d.join(tables.withColumnsRenamed({"a": "_a", "table": "_table"}), "_a")
    # the first opponent whose running sum exceeds the draw
    start = F.struct(F.lit(0).alias("lo"), F.lit(m - 2).alias("hi"))

    def half(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get("_table", mid)["cum"] <= F.col("_draw")
        return F.struct(F.when(s["lo"] >= s["hi"], s["lo"]).when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when((s["lo"] >= s["hi"]) | below, s["hi"]).otherwise(mid).alias("hi"))

    d = d.withColumn("_draw", F.col("_u2") * F.element_at("_table", -1)["cum"])
    at = F.aggregate(F.sequence(F.lit(0), F.lit(m.bit_length())), start, half, lambda s: s["lo"])
    d = d.withColumn("_b", F.get("_table", at)["j"]).withColumn("_names", names)
    swap = F.col("_u3") < 0.5
    return (d.withColumn("model_a", F.get("_names", F.when(swap, F.col("_b")).otherwise(F.col("_a"))))
            .withColumn("model_b", F.get("_names", F.when(swap, F.col("_a")).otherwise(F.col("_b"))))
            .select(*items.columns, "model_a", "model_b"))


def matchups(items: DataFrame, systems: Sequence[str], ratings: Sequence[float], key: str = "item_id",
             seed: str = "arena") -> DataFrame:
    """Q1 with the ratings given as lists; see :func:`draw_matchups`."""
    rows = [(k, s, float(r)) for k, (s, r) in enumerate(zip(systems, ratings, strict=True))]
    return draw_matchups(items, items.sparkSession.createDataFrame(rows, "idx int, system string, rating double"), key, seed)


def eligible_pair(out_a: Column, out_b: Column) -> Column:
    """Both outputs non-empty and not the literal ``none``."""
    def ok(c):
        return c.isNotNull() & (c != "") & (c != "none")
    return ok(out_a) & ok(out_b)


def dense_index(df: DataFrame, order: Sequence[str], out: str = "seq", partitions: int | None = None) -> DataFrame:
    """0-based dense row number by ``order`` without a single-partition window.

    Range-partition + sort, materialise once (reliable checkpoint in the shared
    folder so both passes see the same partitions), count rows per partition
    (one row per partition reaches the driver), then number each row as its
    partition's offset plus its position inside the partition - read from
    ``monotonically_increasing_id`` (partition index << 33 | row), all in the JVM.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    counts = dict(ranged.groupBy(F.spark_partition_id().alias("p")).count().collect())
    n_parts = ranged.rdd.getNumPartitions()
    offsets, acc = [], 0
    for p in range(n_parts):
        offsets.append(acc)
        acc += counts.get(p, 0)
    pid = F.spark_partition_id()
    within = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    offset = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), pid + 1)
    return ranged.withColumn(out, offset + within)


def chunk_order(df: DataFrame, key: str = "task_id", size: int = 100, seed: str = "chunks") -> DataFrame:
    """Q2: ``(chunk_id, chunk_seq)`` for consecutive ``size``-row chunks of a dense key,
    numbered in a seeded shuffled run order (``md5(seed|chunk_id)``).

    One row per chunk (N / size rows), numbered without a single-partition window.
    """
    ch = df.select(F.floor(F.col(key) / size).cast("bigint").alias("chunk_id")).distinct()
    ch = ch.withColumn("run_key", F.md5(F.concat(F.lit(f"{seed}|"), F.col("chunk_id").cast("string"))))
    return dense_index(ch, ["run_key", "chunk_id"], "chunk_seq").select("chunk_id", "chunk_seq")


def chunk_runs(df: DataFrame, key: str = "task_id", size: int = 100, seed: str = "chunks") -> DataFrame:
    """Q2: every row with its ``chunk_id`` and ``chunk_seq`` (see :func:`chunk_order`)."""
    d = df.withColumn("chunk_id", F.floor(F.col(key) / size).cast("bigint"))
    return d.join(chunk_order(df, key, size, seed), "chunk_id")
