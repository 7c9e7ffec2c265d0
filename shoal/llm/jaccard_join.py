"""N-gram Jaccard join (operator 8): size-banded tiles with hashed bitmap signatures.

Documents are sets of hashed 5-word shingles. Two sets link when their Jaccard
similarity is at least ``NUM/DEN`` (exact, in integers).

1. One pass gives each document its set's size, 64-bit identity and bitmap
   signature, whose length follows the size band. Equal sets are one class.
2. Tiles: a set sends its smallest shingles in a global order, a quarter of them
   and one, as tile keys; by pigeonhole two linked sets meet in a tile. The
   order puts the shingles last that are most frequent in a sample (at most
   ``FREQUENT`` of them), so a passage of a third of all documents is no tile; any
   order gives the same links.
   A task sends a class once, so copies don't repeat their rows.
3. Contraction, which only finds links early: each class of a tile above ``BIG``
   is compared in numpy within its block of that tile and with the tile's first
   block, signatures first; each class is compared with the smallest class of
   its tiles that it meets most. Linked classes become components, so a group
   of thousands of near copies collapses in linear work.
4. Pairs of different components that share a tile are counted. Sizes and the
   number of keys that linked sets must share bound them. Tiles up to ``SMALL``
   join their pairs. Larger ones are worked on in numpy, in blocks of
   ``TILE_ROWS``: what lies outside the tile's main component against all of it,
   and only pairs that could share enough keys in large tiles alone. Bit counts
   of the signatures (a bit set in one and not in the other is at least one
   shingle missing there) bound the overlap from above, and a tile returns what
   remains of the pairs that share no earlier tile. Sorted arrays decide.
5. Components over all links.

No link between two different components can be missed: every such pair is
enumerated in each tile it shares, and each bound is from above. Pairs inside a
component are not all enumerated; the result is the components.

Defined results: without words or text a set is empty and links with nothing
(component_id is the own id); rows with equal ids are separate documents; the
component of documents without any id is null; very long texts are shingled
whole; an empty table gives no rows; other columns are ignored.
Shingle and set identity are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import (WORD_NONBLANK, components, drop_path, hash_grams, hash_words, mix64, row_chunks,
                              small_batches, text_buffer, whole_groups, write_table)

WORDS = 5
NUM, DEN = 75, 100
SMALL = 8
BIG = 64
BLOCK_SHINGLES = 1 << 18
BLOCK_ROWS = 1024
TILE_ROWS = 4096
FIRST_KEYS = 16
SAMPLE_SHARE = 8
FREQUENT = 1 << 18
BROADCAST_IDS = 200_000


def sets_of(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    data, offsets = text_buffer(column)
    for i, j in row_chunks(offsets):
        h, first, _, _ = hash_words(data, offsets, i, j, WORD_NONBLANK)
        for k in range(j - i):
            w = h[first[k]:first[k + 1]]
            yield i + k, np.unique(hash_grams(w, min(n, len(w)))) if len(w) else w


def identity(s: np.ndarray) -> int:
    """Order-free 64-bit identity of a set of hashes, as a signed number."""
    return int(mix64(np.array([mix64(s).sum(dtype=np.uint64)], np.uint64) + np.uint64(len(s)))[0].view(np.int64))


def signature(s: np.ndarray) -> np.ndarray:
    """Bitmap of 64 * 2^k bits, about one bit for each two shingles, as longs."""
    words = max(1, 1 << max(0, (len(s) - 1).bit_length() - 7))
    at = s % np.uint64(64 * words)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64)


def described(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, th (text hash), n_shingles, node (class; null for an empty set), sig."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, node, sig = [], [], []
            for _, s in sets_of(b.column("text"), n):
                size.append(len(s))
                node.append(identity(s) if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.list_(pa.int64()))],
                ["doc_id", "th", "n_shingles", "node", "sig"])

    return (docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
            .mapInArrow(describe, f"doc_id {kind}, th long, n_shingles long, node long, sig array<long>"))


def frequent_shingles(docs: DataFrame, n: int = WORDS) -> np.ndarray:
    """Shingles of three or more documents in one of ``SAMPLE_SHARE``, the ``FREQUENT`` most frequent at most."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [s for _, s in sets_of(b.column("text"), n)]
            if got:
                h, c = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    top = (docs.select("text").filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(SAMPLE_SHARE)) == 0)
           .mapInArrow(spell, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 2")
           .orderBy(F.desc("c"), "h").limit(FREQUENT).select("h").toArrow())
    return np.sort(top.column("h").to_numpy().astype(np.int64).view(np.uint64))


def tile_keys(docs: DataFrame, frequent: np.ndarray, n: int = WORDS) -> DataFrame:
    """(h, node, n): each class's first shingles in the global order, once for each task that meets the class."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            hs, nodes, sizes, held = [], [], [], 0

            def out():
                count = [len(x) for x in hs]
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.repeat(nodes, count).astype(np.int64)),
                     pa.array(np.repeat(sizes, count).astype(np.int64))], ["h", "node", "n"])

            for _, s in sets_of(b.column("text"), n):
                if not len(s) or (me := identity(s)) in seen:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(me)
                if len(frequent):
                    k = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    late = frequent[k] == s
                    s = np.concatenate([s[~late], s[late]])
                hs.append(s[:len(s) * (DEN - NUM) // DEN + 1])
                nodes.append(me)
                sizes.append(len(s))
                held += len(hs[-1])
                if held > 1 << 17:
                    yield out()
                    hs, nodes, sizes, held = [], [], [], 0
            if hs:
                yield out()

    return docs.select("text").mapInArrow(keys, "h long, node long, n long")


def fits() -> str:
    return f"{DEN} * least(na, nb) >= {NUM} * greatest(na, nb)"


#: Least overlap of linked sets: ceil(NUM (na + nb) / (NUM + DEN)); a set's keys are floor(n (DEN - NUM) / DEN) + 1 of its n.
NEED = f"ceil({NUM} * (na + nb) / ({NUM} + {DEN}))"
BEYOND = f"(greatest(na, nb) - floor(greatest(na, nb) * ({DEN} - {NUM}) / {DEN}) - 1)"


def bit_bound(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drop pairs whose signatures show too small an overlap. Signatures of neighbouring bands are folded to one length."""
    sig = nodes.select("node", "sig")
    both = (pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"))
    fold = "IF(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p | q), {x})"
    both = both.withColumns({"fa": F.expr(fold.format(x="sa", y="sb")), "fb": F.expr(fold.format(x="sb", y="sa"))})
    missing = "aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p & ~q)), 0, (n, c) -> n + c)"
    return (both.filter(f"least(na - {missing.format(x='fa', y='fb')}, nb - {missing.format(x='fb', y='fa')}) >= {NEED}")
            .select("a", "b", "na", "nb"))


def arrays_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, n: int = WORDS) -> tuple[DataFrame, str]:
    """(node, s): the sorted arrays of the wanted classes, read again from one document of each."""
    ids, path = write_table(nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("rep", "th"), "wanted")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = (docs.withColumn("wanted_th", F.xxhash64("text"))
             .join(side, docs["doc_id"].eqNullSafe(F.col("rep")) & (F.col("wanted_th") == F.col("th")), "left_semi").select("text"))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [s for _, s in sets_of(b.column("text"), n)]
            yield pa.RecordBatch.from_arrays([pa.array([identity(s) for s in got], pa.int64()), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))],
                                             ["node", "s"])

    sets = write_table(texts.mapInArrow(arrays, "node long, s array<long>"), "sets")
    drop_path(docs.sparkSession, path)
    return sets


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Exact: DEN * |x & y| >= NUM * |x | y| of two sorted arrays."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by intersecting their sorted arrays."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("sa"), b.column("sb")
            ok = pa.array([alike(*(np.asarray(c[k].values.to_numpy(zero_copy_only=False)).view(np.uint64) for c in (x, y)))
                           for k in range(b.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    links = (pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
             .join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
             .select("a", "b", "sa", "sb").mapInArrow(meet, "a long, b long"))
    return write_table(links.distinct(), "links")[0]


def tile_forest(tile: pa.Table) -> pa.Table:
    """Links (a, b) that join the classes of one block tile: bit bounds on all its pairs, then arrays, strongest first."""
    node = tile.column("node").to_numpy()
    node, at = np.unique(node, return_index=True)
    arrays = tile.column("s").combine_chunks()
    s = [np.asarray(arrays[int(k)].values.to_numpy(zero_copy_only=False)).view(np.uint64) for k in at]
    size = np.array([len(x) for x in s])
    words = max(1, 1 << max(0, int(np.median(size)).bit_length() - 6))
    sig = np.zeros((len(s), words), np.uint64)
    for k, x in enumerate(s):
        bit = x % np.uint64(64 * words)
        np.bitwise_or.at(sig[k], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    root = list(range(len(s)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(s) - 1):
        missing = np.bitwise_count(sig[i] & ~sig[i + 1:]).sum(axis=1, dtype=np.int64)
        extra = np.bitwise_count(sig[i + 1:] & ~sig[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(size[i] - missing, size[i + 1:] - extra)
        ok = np.flatnonzero((NUM + DEN) * most >= NUM * (size[i] + size[i + 1:]))
        for j in ok[np.argsort(-most[ok], kind="stable")] + i + 1:
            if find(i) != find(int(j)) and alike(s[i], s[j]):
                root[find(int(j))] = find(i)
                out.append((node[i], node[j]))
    return pa.table([pa.array([int(x[q]) for x in out], pa.int64()) for q in (0, 1)], ["a", "b"])


def could_share(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many keys linked sets of these sizes share at least: NEED - BEYOND in numpy."""
    most = np.maximum(na, nb)
    return -(-NUM * (na + nb) // (NUM + DEN)) - (most - most * (DEN - NUM) // DEN - 1)


def overlap_bound(size_a: np.ndarray, size_b: np.ndarray, a: list, b: list) -> np.ndarray:
    """Upper bounds of the overlaps of pairs by their signatures, the longer folded to the shorter."""
    out = np.minimum(size_a, size_b)
    wa, wb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for p, q in {*zip(wa.tolist(), wb.tolist())}:
        at = np.flatnonzero((wa == p) & (wb == q))
        x, y = np.stack([a[k] for k in at]), np.stack([b[k] for k in at])
        w = min(p, q)
        x, y = (np.bitwise_or.reduce(z.reshape(len(at), -1, w), axis=1) for z in (x, y))
        out[at] = np.minimum(size_a[at] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64),
                             size_b[at] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
    return out


def large_tile_pairs(t: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, na, nb) of different components that may link, from tiles (h, node, n, root, l), by bit counts."""
    size = t.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("rows"))
    # written before it is joined, so that the join can split a hot tile's rows
    size, _ = write_table(size.select("h", F.col("m.root").alias("main"), "rows", (F.col("rows") - F.col("m.c")).alias("outer")), "size")
    first = t.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("h")), 1, FIRST_KEYS).alias("keys"))      # a set's own keys
    side, _ = write_table(first.join(nodes.select("node", "sig"), "node"), "side")
    rows = t.join(size, "h").withColumns({
        "out": F.col("root") != F.col("main"),
        "ja": F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / TILE_ROWS)), "ia": F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("outer") / TILE_ROWS))})
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / TILE_ROWS) - 1)
    cols = ["h", "node", "n", "root", "l", "out"]
    member = rows.select(*cols, F.lit(False).alias("asks"), F.explode(every("outer")).alias("i"), F.col("ja").alias("j"))
    asks = rows.filter("out").select(*cols, F.lit(True).alias("asks"), F.col("ia").alias("i"), F.explode(every("rows")).alias("j"))
    tiles = (member.unionByName(asks).withColumn("tile", F.xxhash64("h", "i", "j")).drop("i", "j")
             .join(side, "node").repartition("tile").sortWithinPartitions("tile"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, "tile"):
            got: list[list] = [[], [], [], []]
            c = {k: table.column(k).to_numpy() for k in ("h", "node", "n", "root", "l", "out", "asks")}
            sig, keys = (table.column(k).combine_chunks() for k in ("sig", "keys"))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                ask, all_ = lo + np.flatnonzero(c["asks"][lo:hi]), lo + np.flatnonzero(~c["asks"][lo:hi])
                step = max(1, (1 << 18) // max(1, len(all_)))
                for s in range(0, len(ask), step):
                    i, j = ask[s:s + step, None], all_[None, :]
                    na, nb = c["n"][i], c["n"][j]
                    ok = ((c["root"][i] != c["root"][j]) & (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb))
                          & (~c["out"][j] | (c["node"][i] < c["node"][j])) & (could_share(na, nb) <= np.minimum(c["l"][i], c["l"][j])))
                    x, y = np.nonzero(ok)
                    x, y = ask[s:s + step][x], all_[y]
                    if not len(x):
                        continue
                    rows_ = np.unique(np.r_[x, y])
                    at = {int(k): np.asarray(sig[int(k)].values.to_numpy()).view(np.uint64) for k in rows_}
                    na, nb = c["n"][x], c["n"][y]
                    most = overlap_bound(na, nb, [at[int(k)] for k in x], [at[int(k)] for k in y])
                    near = np.flatnonzero((NUM + DEN) * most >= NUM * (na + nb))
                    mine = {int(k): set(keys[int(k)].as_py()) for k in np.unique(np.r_[x[near], y[near]])}
                    for k in near:
                        p, q = int(x[k]), int(y[k])
                        h = int(c["h"][p])
                        if any(e < h for e in mine[p] & mine[q]):          # they meet in an earlier tile too
                            continue
                        p, q = (p, q) if c["node"][p] < c["node"][q] else (q, p)
                        for col, v in zip(got, (c["node"][p], c["node"][q], c["n"][p], c["n"][q])):
                            col.append(int(v))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["a", "b", "na", "nb"])

    return tiles.select("tile", "h", "node", "n", "root", "l", "out", "asks", "sig", "keys").mapInArrow(work, "a long, b long, na long, nb long")


def groups(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, th (xxhash64 of its text), n_shingles, root (its group; null for an empty set), component_id."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base, _ = write_table(described(slim, n), "described")
    nodes, _ = write_table(base.filter("node is not null").groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("least_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r"))
        .select("node", "n", "sig", "least_id", F.col("r.doc_id").alias("rep"), F.col("r.th").alias("th")), "nodes")
    frequent = frequent_shingles(slim, n)
    # counted map-side and written, then joined back: Spark can split a hot shingle's rows in the join
    met, met_path = write_table(tile_keys(slim, frequent, n), "met")
    shared, _ = write_table(met.groupBy("h").agg(F.count("*").alias("cnt"), F.min("node").alias("hub"), F.max("node").alias("top"))
                            .filter("hub <> top").select("h", "hub", "cnt"), "shared", release=True)
    tiles, _ = write_table(met.join(shared, "h").select("h", "node", "n", "hub", "cnt").distinct(), "tiles", release=True)
    drop_path(spark, met_path)

    # contraction: classes of large tiles in blocks; for each class the hub that it shares most tiles with
    own = tiles.filter(f"cnt > {BIG}").groupBy("node").agg(F.max(F.struct("cnt", "h")).alias("t"), F.first("n").alias("n")).select("node", "n", "t.h")
    blocks = own.groupBy("h").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks"))
    blocks, _ = write_table(blocks, "blocks")
    dense, _ = write_table(own.join(blocks, "h").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "dense")
    size = nodes.select(F.col("node").alias("hub"), F.col("n").alias("nb"))
    hubs = (tiles.filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("c"), F.first("n").alias("na"))
            .join(size, "hub").filter(fits()).groupBy("node").agg(F.max(F.struct("c", "hub", "na", "nb")).alias("m"))
            .select(F.col("node").alias("a"), F.col("m.hub").alias("b"), "m.na", "m.nb"))
    hubs, _ = write_table(bit_bound(hubs, nodes), "hubs")
    sets, sets_path = arrays_of(hubs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(dense.select("node")), slim, nodes, n)
    # the first block goes to each block's tile, so a tile holds two blocks at most
    other = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    near = (dense.select("h", "node", F.explode(other).alias("tile")).join(sets, "node")
            .groupBy("h", "tile").applyInArrow(tile_forest, "a long, b long"))
    links, _ = write_table(near.unionByName(exact(hubs, sets)), "links")
    drop_path(spark, sets_path)
    comp, _ = write_table(components(links), "comp")

    # tiles' pairs between different components
    t = tiles.join(comp, "node", "left").select("h", "node", "n", "cnt", F.coalesce("root", "node").alias("root"))
    spread, _ = write_table(t.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("h"), "spread")
    t, _ = write_table(t.join(spread, "h"), "spread")
    large = t.filter(f"cnt > {SMALL}").groupBy("node").agg(F.count("*").alias("l"))     # keys that lie in large tiles
    t, _ = write_table(t.join(large, "node", "left").fillna(0, "l"), "spread")
    cols = {"node": "{}node", "root": "{}root", "n": "n{}", "l": "l{}"}
    a, b = (t.filter(f"cnt <= {SMALL}").select("h", *(F.col(c).alias(to.format(x)) for c, to in cols.items())) for x in "ab")
    pairs = (a.join(b, "h").filter(f"anode < bnode and aroot <> broot and {fits()}")
             .groupBy(F.col("anode").alias("a"), F.col("bnode").alias("b"), "na", "nb", "la", "lb").agg(F.count("*").alias("c"))
             # what the two share besides is at most the keys of either in larger tiles
             .filter(f"c + least(la, lb) >= {NEED} - {BEYOND}").select("a", "b", "na", "nb"))
    pairs = pairs.unionByName(large_tile_pairs(t.filter(f"cnt > {SMALL}"), nodes)).distinct()
    pairs, _ = write_table(bit_bound(pairs, nodes), "pairs")
    sets, sets_path = arrays_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), slim, nodes, n)
    more = exact(pairs, sets)
    drop_path(spark, sets_path)
    root, _ = write_table(components(links.unionByName(more)), "root")
    named = (nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least_id"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select("node", "root", "component_id")
    return (base.join(named, "node", "left")
            .select("doc_id", "th", "n_shingles", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
