"""Window-style operators: running weights, per-group head, first/last rows,
chunks and segments of a numbered row set.

A window without ``partitionBy`` runs in a single task, so nothing here uses
one on a big table. The global row number needed for chunks and segments is
computed the distributed way: a range-partitioned sort, a position inside each
sorted partition, and a prefix sum over the per-partition counts (one row per
partition -- bounded by the partition count, so broadcasting it is safe).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.keys import div
from shoal.session import cut_lineage


# --------------------------------------------------------------------------- E1
def cumulative_weights(dist: DataFrame, group: str = "dist", order: str = "pos",
                       weight: str = "weight") -> DataFrame:
    """Running weight per distribution (E1): ``cum = sum(weight) over rows <= pos``.

    Partitioned by distribution; a distribution is a short value list, so each
    window partition is small.
    """
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dist.withColumn("cum", F.sum(weight).over(w))


def value_distribution(df: DataFrame, column: str, name: str) -> DataFrame:
    """A weighted list (dist, pos, text, weight) from the value counts of a column.

    Intended for low-cardinality columns (priorities, flags, modes, segments).
    """
    counts = df.groupBy(F.col(column).alias("text")).agg(F.count(F.lit(1)).alias("weight"))
    w = Window.partitionBy("dist").orderBy("text")
    return (counts.withColumn("dist", F.lit(name))
            .withColumn("pos", F.row_number().over(w))
            .select("dist", "pos", "text", "weight"))


# --------------------------------------------------------------------------- E2 / E3 / F3 / F4
def head_per_group(df: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """First ``n`` rows of every group (E2): ``row_number() <= n``.

    Spark plans a WindowGroupLimit before the shuffle, so each map task sends
    at most ``n`` rows per group -- a group holding a third of the table still
    moves only ``n`` rows per task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def last_row(df: DataFrame, order: list[str]) -> DataFrame:
    """The row that sorts last by ``order`` (then by every other column).

    A global ``max`` over a struct: partial max per task, one final row.
    """
    rest = [c for c in df.columns if c not in order]
    best = df.agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """``ORDER BY order LIMIT n`` (F3, F4): a per-task top-n then one merge."""
    return df.orderBy(*order).limit(n)


# --------------------------------------------------------------------------- global numbering
def global_row_number(df: DataFrame, order: list[str], name: str = "rn",
                      checkpoint: bool = True) -> DataFrame:
    """1-based row number over a total order, without a single-task window.

    1. ``orderBy`` range-partitions and sorts (sampling picks the bounds);
    2. each row gets its partition id and its position inside the partition
       (``monotonically_increasing_id`` is ``partition << 33 | position``);
    3. the result is checkpointed so every later use sees the same partitions;
    4. per-partition counts (one row per partition) give start offsets by a
       prefix sum; the offsets are joined back by broadcast.

    ``order`` must be unique (a total order): equal keys cannot be split across
    range partitions.
    """
    numbered = (df.orderBy(*order)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_pos", F.monotonically_increasing_id()
                            - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    if checkpoint:
        numbered = cut_lineage(numbered)
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    prefix = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(prefix), F.lit(0)).alias("_off"))
    return (numbered.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_pos") + 1)
            .drop("_pid", "_pos", "_off"))


def group_row_number(df: DataFrame, group: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """1-based row number inside each group, safe when one group holds a third of the rows.

    ``partitionBy(group)`` would put a whole group in one task. Instead the
    rows are numbered globally over (group, order) -- a range-partitioned sort
    that splits a large group across tasks -- and each group's first global
    number (one row per group, from a partial+final aggregate) is subtracted.
    ``group + order`` must be unique.
    """
    numbered = global_row_number(df, group + order, "_grn")
    starts = numbered.groupBy(*group).agg(F.min("_grn").alias("_start"))
    return (numbered.join(starts, group)
            .withColumn(name, F.col("_grn") - F.col("_start") + 1)
            .drop("_grn", "_start"))


def block_row_number(df: DataFrame, group: list[str], key: str, block: int, name: str = "rn") -> DataFrame:
    """1-based position of an integer ``key`` inside its group, with every window bounded.

    ``group + key`` must be unique and ``key`` an integer (a second, a day).
    Keys are cut into blocks of ``block`` consecutive values: a rank inside a
    block (a window of at most ``block`` rows) plus the number of rows in the
    group's earlier blocks (a running sum over one row per block). A group
    holding a third of the table is spread over many small windows, with no
    global sort and no checkpoint.
    """
    b = F.floor(F.col(key) / block)
    tagged = df.withColumn("_blk", b)
    per_block = tagged.groupBy(*group, "_blk").agg(F.count(F.lit(1)).alias("_bn"))
    before = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*group, "_blk", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"))
    in_block = Window.partitionBy(*group, "_blk").orderBy(key)
    ranked = tagged.withColumn("_r", F.row_number().over(in_block))
    return (ranked.join(offsets, [*group, "_blk"])
            .withColumn(name, F.col("_off") + F.col("_r"))
            .drop("_blk", "_r", "_off"))


def global_running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` over a total order, without a single-task window.

    Range-partitioned sort, running sums inside each partition, and the totals of
    the partitions before it (one row per partition) as offsets.
    """
    cut = cut_lineage(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy("_pid").agg(F.sum(value).alias("_t"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offsets = totals.select("_pid", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    return (cut.withColumn("_in", F.sum(value).over(inside)).join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_in") + F.col("_off")).drop("_pid", "_in", "_off"))


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: list[float],
                    names: list[str] | None = None) -> DataFrame:
    """Exact continuous quantiles per group without holding a group in one task.

    Same definition as ``percentile`` (linear interpolation between the values at
    0-based positions floor/ceil of ``(n - 1) * p``). Equal values are counted
    first (map-side combined), so a row moves only as part of a count; running
    counts over (group, value) then tell which values hold the wanted positions.
    NULLs are left out.
    """
    names = names or [f"p{int(round(p * 100))}" for p in probs]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    running = global_running_sum(counts, [*group, value], "_c", "_cum")
    ends = running.groupBy(*group).agg(F.max("_cum").alias("_end"), F.sum("_c").alias("n"))
    r = running.join(ends, group)
    last = F.col("_cum") - F.col("_end") + F.col("n") - 1            # 0-based position of the value's last row
    first = last - F.col("_c") + 1
    aggs = [F.first("n").alias("n")]
    wanted = F.lit(False)
    for p, name in zip(probs, names):
        pos = (F.col("n") - 1) * F.lit(p)
        at = [F.floor(pos).between(first, last), F.ceil(pos).between(first, last)]
        wanted = wanted | at[0] | at[1]
        lo, hi = (F.max(F.when(x, F.col(value))) for x in at)
        aggs.append((lo + (hi - lo) * F.first(pos - F.floor(pos))).alias(name))
    return r.filter(wanted).groupBy(*group).agg(*aggs)


def _total(df: DataFrame) -> Column:
    return df.select(F.count(F.lit(1))).scalar()


def _numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Rows with their global number ``rn``, and the number of rows of the written copy (one number)."""
    numbered = global_row_number(df, order)
    return numbered, numbered.agg(F.coalesce(F.max("rn"), F.lit(0))).first()[0]


def chunk_of(rn: Column, total: Column, chunks: int) -> Column:
    """Chunk s of C with ``total div C`` rows each, the remainder in the last."""
    per = div(total, chunks)
    return F.least(div(rn - 1, F.greatest(per, F.lit(1))) + 1, F.lit(chunks)).cast("int")


def ntile_of(rn: Column, total: int, n: int) -> Column:
    """``ntile(n)``: quotient rows per segment, one extra in the first ``total mod n`` (E5)."""
    q, r = divmod(total, n)
    big = r * (q + 1)
    return F.when(rn <= big, div(rn - 1, q + 1) + 1).otherwise(div(rn - 1 - big, max(q, 1)) + r + 1).cast("int")


def delete_segment_of(rn: Column, total: int, n: int) -> Column:
    """Delete-file segment: ``(rn - 1) div (total div n + 1) + 1`` (E5, deletes)."""
    return (div(rn - 1, total // n + 1) + 1).cast("int")


def assign_chunks(df: DataFrame, order: list[str], chunks: int, dense_key: str | None = None) -> DataFrame:
    """Add ``chunk`` (E6). With a dense 0-based ``dense_key`` the row number is
    the key + 1 and no sort is needed (the generator's case)."""
    if dense_key:
        return df.withColumn("chunk", chunk_of(F.col(dense_key) + 1, _total(df), chunks))
    numbered, total = _numbered(df, order)
    return numbered.withColumn("chunk", chunk_of(F.col("rn"), total, chunks)).drop("rn")


def assign_segments(df: DataFrame, order: list[str], n: int, kind: str = "insert") -> DataFrame:
    """Add ``segment`` for an insert (ntile) or delete set split into ``n`` files (E5)."""
    numbered, total = _numbered(df, order)
    seg = ntile_of(F.col("rn"), total, n) if kind == "insert" else delete_segment_of(F.col("rn"), total, n)
    return numbered.withColumn("segment", seg).drop("rn")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
