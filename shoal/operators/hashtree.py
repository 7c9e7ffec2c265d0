"""Where two copies of a table differ: a hash tree over key ranges.

A leaf covers ``width`` keys and holds the number of its rows and three sums of row
hashes, each modulo a prime; a node holds the sums of its ``fanout`` children. Sums
don't depend on the order of rows or on how Spark splits them, and are combined map-side,
so building a tree is one pass with one row per leaf and task in the shuffle. Each copy's
tree is stored beside it and built once.

A comparison starts at the roots and goes down level by level: of each level only
the children of differing nodes are joined. Rows are read for differing leaves alone, by a
semi join; where at most ``LISTED`` leaves differ, they also reach the scan as a filter,
which prunes partitions (copies stored by ``refresh.write_ranges``) or, as at most
``SPANS`` spans of keys that hold them, row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.keys import div
from shoal.session import cut_lineage

PRIME = (1 << 31) - 1
LANES = ("h1", "h2", "h3")
WIDTH = 64
FANOUT = 16
LISTED = 512
SPANS = 32


def _lanes(columns: list[str]) -> list[Column]:
    """A row's hashes, below the prime: lengths and nulls count, so no two columns run together."""
    parts = [c for n in columns for c in (F.col(f"`{n}`").isNull(), F.col(f"`{n}`"))]
    return [F.pmod(F.xxhash64(F.lit(lane), *parts), F.lit(PRIME)) for lane in LANES]


def _summed(rows: DataFrame, by: list, n: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(n).alias("n"), *((F.sum(lane) % PRIME).alias(lane) for lane in LANES))


def leaves(df: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(node, n, h1, h2, h3) of each range of ``width`` keys."""
    columns = sorted(df.columns)
    rows = df.select(div(F.col(key), width).alias("node"), *(h.alias(x) for h, x in zip(_lanes(columns), LANES, strict=True)))
    return _summed(rows, ["node"], F.lit(1))


def build_tree(df: DataFrame, key: str, path: str, width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """Write the tree of ``df`` below ``path``, a folder per level, and return it: (level, node, n, h1, h2, h3)."""
    spark = df.sparkSession
    leaves(df, key, width).write.mode("overwrite").parquet(f"{path}/level=0")
    level, top = 0, None
    while True:
        below = spark.read.parquet(f"{path}/level={level}")
        if top is None:
            top = below.agg(F.max("node")).first()[0] or 0
        if top == 0:
            break
        level, top = level + 1, top // fanout
        _summed(below.withColumn("node", div(F.col("node"), fanout)), ["node"], F.col("n")).write.mode("overwrite").parquet(f"{path}/level={level}")
    return spark.read.parquet(path)


def _height(tree: DataFrame) -> int:
    return tree.agg(F.max("level")).first()[0] or 0


def differing_leaves(one: DataFrame, two: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, list[int]]:
    """Leaves whose digests differ, and how many nodes were compared on each level from the root down.

    Copies of unequal height meet at the lower root's level: nodes that only one
    tree has differ.
    """
    height = max(_height(one), _height(two))
    found, compared = None, []
    for level in range(height, -1, -1):
        sides = []
        for tree in (one, two):
            nodes = tree.filter(F.col("level") == level).drop("level")
            if found is not None:
                nodes = nodes.withColumn("up", div(F.col("node"), fanout)).join(found.withColumnRenamed("node", "up"), "up", "left_semi").drop("up")
            sides.append(nodes)
        same = F.lit(True)
        for c in ("n", *LANES):
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        pairs = sides[0].alias("a").join(sides[1].alias("b"), F.col("a.node") == F.col("b.node"), "full_outer")
        met = cut_lineage(pairs.select(F.coalesce("a.node", "b.node").alias("node"), (~same).alias("differs")))
        # a lower tree has no node here yet, so all below it is open
        short = level > min(_height(one), _height(two))
        found = met.filter(F.col("differs") | F.lit(short)).select("node")
        compared.append(met.count())
        if found.isEmpty():
            return found, compared
    return found, compared


def _spans(nodes: list[int], most: int = SPANS) -> list[tuple[int, int]]:
    """At most ``most`` spans (first, last) that hold all ``nodes``, apart at the widest gaps."""
    at = sorted(nodes)
    widest = sorted(range(1, len(at)), key=lambda i: at[i] - at[i - 1], reverse=True)[:most - 1]
    cuts = sorted(i for i in widest if at[i] - at[i - 1] > 1)
    return [(at[a], at[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True) if a < b]


def copy_diff(one: DataFrame, two: DataFrame, key: str, nodes: DataFrame, width: int = WIDTH, range_col: str | None = None) -> DataFrame:
    """(key, status) of keys whose rows differ between the copies, looked for in the leaves ``nodes`` only: missing or extra in ``two``, or changed.

    ``range_col``: the copies' partition column that holds the leaf number.
    """
    columns = sorted(c for c in one.columns if c != range_col)
    some = [r[0] for r in nodes.limit(LISTED + 1).collect()]
    inside = F.lit(True)
    if len(some) <= LISTED and range_col:
        inside = F.col(range_col).isin(some)
    elif len(some) <= LISTED:
        # for the scan only, so the spans may hold equal leaves too; a node of 0 or less begins below its multiple
        inside = F.lit(False)
        for a, b in _spans([x for x in some if x is not None]):
            inside = inside | F.col(key).between(a * width - (width - 1 if a <= 0 else 0), b * width + (width - 1 if b >= 0 else 0))

    def digests(df: DataFrame, side: str) -> DataFrame:
        leaf = F.col(range_col) if range_col else div(F.col(key), width)
        rows = df.filter(inside).withColumn("_leaf", leaf).join(nodes.select(F.col("node").alias("_leaf")), "_leaf", "left_semi")
        rows = rows.select(F.col(key).alias("key"), *(h.alias(x) for h, x in zip(_lanes(columns), LANES, strict=True)))
        return _summed(rows, ["key"], F.lit(1)).select("key", F.struct("n", *LANES).alias(side))

    both = digests(one, "a").join(digests(two, "b"), "key", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return both.select(F.col("key").alias(key), status.alias("status"))
