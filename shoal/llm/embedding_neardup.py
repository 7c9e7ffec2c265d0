"""Embedding near-duplicates (operator 5): cross-polytope hashing after fast Hadamard rotations.

A hash turns a vector by three rounds of random signs and a fast Hadamard
transform and names its largest coordinate with its sign. ``K`` of them, chosen
by the number of vectors, are one table's code; ``2 K`` tables are kept. Multiprobe:
a vector also visits the buckets of the codes that differ in one hash whose
second or third coordinate was nearly the largest.

Equal vectors (with equal labels) are one class with a count. Vectors that share
a bucket meet in tiles of at most two blocks of ``BLOCK`` classes, so a hot bucket
is many bounded tasks. A tile verifies its pairs by cosine in double precision and
counts a pair only in the first table in which the two meet; it returns sums and a
spanning forest, not pairs, so a large group of near copies gives as many rows as
it has members. No cap on buckets or partners.

Only vectors with equal labels are compared. Defined results: a null label, and a
vector that is null, empty, zero or holds null, NaN or infinite components, links
with nothing (its component is its own id); vectors of unequal length don't link;
rows with equal ids are separate vectors; null ids stay null and are no component;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import components, small_batches, write_table

COSINE = 0.98
PROBES = 2
ROUNDS = 3
BLOCK = 512
PER_BUCKET = 1 / 64
SEED = 20240611


def hashes_per_table(n: int, dim: int) -> int:
    """K with about ``PER_BUCKET`` vectors for each of the (2 D)^K codes, 2 at least and 6 at most."""
    size = 2 * (1 << max(1, (dim - 1).bit_length()))
    return min(6, max(2, math.ceil(math.log(max(n, 2) / PER_BUCKET) / math.log(size))))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def codes(v: np.ndarray, k: int, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(vectors, 2 k tables, 1 + probes) codes: the vector's own and its probes', likeliest first."""
    n, dim = v.shape
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :dim] = v / np.linalg.norm(v, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, dim])
    out = np.zeros((n, 2 * k, 1 + probes), np.int64)
    at = np.arange(n)
    ranks = min(3, d)
    for table in range(2 * k):
        best, gaps = np.zeros((n, k, ranks), np.int64), np.zeros((n, k, ranks - 1))
        for j in range(k):
            y = x
            for _ in range(ROUNDS):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :ranks]
            best[:, j] = 2 * top + (np.take_along_axis(y, top, 1) > 0)
            tops = np.take_along_axis(size, top, 1)
            gaps[:, j] = tops[:, :1] - tops[:, 1:]
        weight = (2 * d) ** np.arange(k)
        own = best[:, :, 0] @ weight
        out[:, table, 0] = own
        order = np.argsort(gaps.reshape(n, -1), axis=1, kind="stable")
        for p in range(probes):
            j, r = np.divmod(order[:, p], ranks - 1)
            out[:, table, 1 + p] = own + (best[at, j, r + 1] - best[at, j, 0]) * weight[j]
    return out


def _valid(label: str, v: str) -> str:
    return (f"{label} IS NOT NULL AND {v} IS NOT NULL AND size({v}) > 0 AND exists({v}, x -> coalesce(x <> 0, false)) "
            f"AND forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")


def coded(classes: DataFrame, n: int) -> DataFrame:
    """Classes with their codes, table by table (own code, then probes)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            dims = np.asarray(v.value_lengths())
            found: list = [None] * b.num_rows
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                m = np.asarray(v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), dim)
                m = m / np.abs(m).max(axis=1, keepdims=True)
                for r, c in zip(rows, codes(m, hashes_per_table(n, int(dim))).reshape(len(rows), -1)):
                    found[r] = c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], [*b.schema.names, "codes"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(add, f"{kind}, codes array<long>")


def _union_rows(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Root (smallest row) of each of n rows under the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def tile_links(tab: int, block: np.ndarray, node: np.ndarray, label: np.ndarray, v: np.ndarray, c: np.ndarray,
               cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of a tile that meet first in table ``tab``: rows of one label and length.

    c: (rows, tables, 1 + probes) codes. With two blocks only pairs across them count here.
    """
    norm = np.linalg.norm(v, axis=1)
    cos = (v @ v.T) / np.outer(norm, norm)
    i, j = np.nonzero(np.triu(cos >= cosine, 1))
    ok = (label[i] == label[j]) & (node[i] != node[j])
    if block.min() != block.max():
        ok &= block[i] != block[j]
    i, j = i[ok], j[ok]
    if not len(i):
        return i, j
    a, z = c[i], c[j]                                     # (pairs, tables, 1 + probes)
    meet = (a[:, :tab, :1] == z[:, :tab]).any((1, 2)) | (z[:, :tab, :1] == a[:, :tab]).any((1, 2))
    return i[~meet], j[~meet]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    # a class is known by two hashes, 128 bits; its number is given when the classes are written
    rows = rows.withColumns({h: F.when(F.expr(_valid("label", "v")), F.xxhash64(*salt, "label", "v")) for h, salt in (("h1", []), ("h2", [F.lit("lane")]))})
    classes, _ = write_table(rows.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.count("*").alias("m"), F.min("vec_id").alias("least_id"), F.first("label").cast("string").alias("label"), F.first("v").alias("v"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    table, _ = write_table(coded(classes.select("node", "m", "label", "v"), n), "coded")

    wide = 1 + PROBES
    entries = (table.select("node", "label", F.size("v").alias("dim"), F.posexplode("codes").alias("pos", "code"))
               .select("node", F.expr(f"pos div {wide}").cast("int").alias("tab"), (F.col("pos") % wide == 0).alias("own"),
                       F.xxhash64("label", "dim", F.expr(f"pos div {wide}"), "code").alias("bucket")))
    # counted map-side and written, then joined back: Spark can split a hot bucket's rows in the join
    shared, _ = write_table(entries.groupBy("bucket").agg(F.count("*").alias("c"), F.min("node").alias("first"), F.max("node").alias("last"), F.max("own").alias("owns"))
                            .filter("first <> last and owns").select("bucket", "c"), "buckets")
    entries = entries.join(shared, "bucket")
    blocks = F.ceil(F.col("c") / block).cast("int")
    tiles = (entries.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("tile", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))
             .select("tile", "tab", "block", "own", "node").join(table.select("node", "m", "label", "v", "codes"), "node"))
    tiles = tiles.repartition("tile").sortWithinPartitions("tile")
    names = ["tile", "tab", "block", "own", "node", "m", "label", "v", "codes"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(t: pa.Table) -> pa.RecordBatch:
            node, weight, other = [], [], []
            tile = t.column("tile").to_numpy()
            cuts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])
            cols = {k: t.column(k).to_numpy() for k in ("tab", "block", "own", "node", "m")}
            vs, cs = t.column("v").combine_chunks(), t.column("codes").combine_chunks()
            labels = t.column("label").to_pylist()
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo < 2:
                    continue
                part, own, nodes = cols["block"][lo:hi], cols["own"][lo:hi], cols["node"][lo:hi]
                v = [vs[k].values.to_numpy(zero_copy_only=False) for k in range(lo, hi)]
                names_ = np.unique([f"{len(x)} {y}" for x, y in zip(v, labels[lo:hi])], return_inverse=True)[1]
                for group in np.unique(names_):             # one, but for equal bucket hashes
                    at = np.flatnonzero(names_ == group)
                    if len(at) < 2:
                        continue
                    m = np.stack([np.asarray(v[k], np.float64) for k in at])
                    m = m / np.abs(m).max(axis=1, keepdims=True)
                    c = np.stack([cs[lo + k].values.to_numpy() for k in at]).reshape(len(at), -1, wide)
                    tab = int(cols["tab"][lo])
                    i, j = tile_links(tab, part[at], nodes[at], np.zeros(len(at)), m, c, cosine)
                    if not len(i):
                        continue
                    # in this table: both at home here, or one at home and the other probing; each pair once
                    a, z, ci, cj = own[at][i], own[at][j], c[i, tab], c[j, tab]
                    home = ci[:, 0] == cj[:, 0]
                    i_in_j, j_in_i = (ci[:, :1] == cj[:, 1:]).any(1), (cj[:, :1] == ci[:, 1:]).any(1)
                    first_i = nodes[at][i] < nodes[at][j]
                    both = i_in_j & j_in_i
                    ok = np.where(home, a & z, np.where(both, np.where(first_i, a & ~z, ~a & z), (a & ~z & i_in_j) | (~a & z & j_in_i)))
                    i, j = i[ok], j[ok]
                    if not len(i):
                        continue
                    w = cols["m"][lo:hi][at]
                    total = np.bincount(i, w[j], len(at)) + np.bincount(j, w[i], len(at))
                    root = _union_rows(len(at), i, j)
                    some = np.flatnonzero(total)
                    node.append(nodes[at][some])
                    weight.append(total[some].astype(np.int64))
                    other.append(nodes[at][root[some]])
            cat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (node, weight, other)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cat], ["node", "weight", "other"])

        for b in batches:
            t = pa.Table.from_batches([b]).select(names)
            t = pa.concat_tables([held, t]) if held is not None else t
            tile = t.column("tile").to_numpy()
            if not len(tile):
                continue
            last = int(np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])[-1])   # the last tile may go on in the next batch
            held = t.slice(last)
            if last:
                yield links(t.slice(0, last))
        if held is not None and held.num_rows:
            yield links(held)

    found, _ = write_table(tiles.select(*names).mapInArrow(work, "node long, weight long, other long"), "links")
    sums = found.groupBy("node").agg(F.sum("weight").alias("weight"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = (classes.select("node", "m", "least_id").join(sums, "node", "left").join(roots, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select("node", (F.col("m") - 1 + F.coalesce("weight", F.lit(0))).alias("links"), "component_id")
    out = rows.select("vec_id", "h1", "h2").join(classes.select("h1", "h2", "node"), ["h1", "h2"], "left").join(named, "node", "left")
    comp = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                      F.col("vec_id").eqNullSafe(comp).alias("kept"))
