"""Source divergence audit (operator 13): count-level bitmaps over the terms of a language.

Which sources of a language write alike, and which terms set a source apart. A
term is a run of letters or non-ASCII characters, A-Z lower-cased; a language keeps
the terms that at least ``MIN_DOCS`` of its documents hold. With integer shares
p = 1 + floor(10^9 (count + 2) / (N + 2 V)) of a term in a group (N occurrences of
kept terms there, V kept terms), two groups differ by the sum over all kept terms of
f = floor((p - q)^2 / (p + q)).

f depends on a term only through its two counts. So the terms get ids by falling
frequency, 64 of them make a block, and for each (group, count) a block stores one
bitset: the ids of the terms with that count. For two groups, AND and popcount of
their bitsets give the number of terms in every joint cell (count, count'), which
multiplies f of that cell; count 0 is the complement of a group's bitsets. Terms of
similar frequency share a block, so that a block of rare terms has few levels.

Spark does: counting (summed in Arrow batches, then map-side, then shuffled by
group and term), the ids (a range sort and numbering per partition), the bitsets,
and the deal of work units. A unit is one block and two tiles of ``TILE`` groups: at
most 2 * 32 * 65 bitsets, whatever the sizes of groups and languages. Sums over blocks
are added up per task before they are shuffled. Nothing is collected.

Defined results: null text, lang and source read as ''; documents without terms still
make their group occur; repeated rows are documents of their own; ties rank by the
UTF-8 bytes of the item; a language with one source has no pairs; without kept
terms each pair has value 0 and there are no term rows; an empty table gives no rows;
long texts are counted whole; other columns are ignored, whatever their names.
All arithmetic is on integers (shares by DECIMAL(38), sums by 64 bits: a sum of f is
at most the sum of both shares, about 2 * 10^9).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.common import LOWER, drop_path, small_batches, text_buffer, whole_groups, write_table

MIN_DOCS = 10
TOP_TERMS = 10
TILE = 32
BLOCK = 64
TALLY_BYTES = 16 << 20

TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


# -- counting ------------------------------------------------------------------


def tally(table: pa.Table) -> pa.RecordBatch:
    """Occurrences and documents of each (lang, source, term) of some rows."""
    data, offsets = text_buffer(table.column("text"))
    base = int(offsets[0])
    buf, rel = LOWER[data[base:int(offsets[-1])]], offsets - base
    inside = TERM[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = rel[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]              # a term never crosses rows
    begin[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    at = np.cumsum(inside, dtype=np.int64)[starts] - 1
    letters = buf[inside]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(at, len(letters))), pa.py_buffer(letters)).dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    langs, sources = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    row = np.searchsorted(rel, starts, "right") - 1
    per_doc, n = np.unique(row << 32 | code, return_counts=True)
    key = group[per_doc >> 32] << 32 | (per_doc & 0xFFFFFFFF)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    docs = np.diff(np.append(first, len(key)))
    total = np.add.reduceat(n[order], first) if len(first) else first
    g = key[first] >> 32
    return pa.RecordBatch.from_arrays(
        [langs.dictionary.take(pa.array(g // max(1, len(sources.dictionary)))).cast(pa.string()),
         sources.dictionary.take(pa.array(g % max(1, len(sources.dictionary)))).cast(pa.string()),
         words.dictionary.take(pa.array(key[first] & 0xFFFFFFFF)).cast(pa.string()),
         pa.array(total.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])


def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TALLY_BYTES:
            yield tally(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield tally(pa.Table.from_batches(held))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact for 64-bit counts."""
    big = "decimal(20,0)"
    return F.call_function("div", (n.cast(big) + 2) * F.lit(1000000000).cast("decimal(10,0)"),
                           F.greatest(total.cast(big) + 2 * kept.cast(big), F.lit(1).cast("decimal(22,0)"))) + 1


# -- pairs of groups -----------------------------------------------------------


def _levels(rows: pa.Table, groups: list, zeros: list, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares, bitsets, first level of each group), level 0 of a group last: the complement of its others."""
    owner, p = rows.column("gid").to_numpy(), rows.column("p").to_numpy()
    bits = rows.column("bits").to_numpy().view(np.uint64)
    full = np.uint64((1 << size) - 1)
    ps, bs, first, k = [], [], [], 0
    for g, zero in zip(groups, zeros, strict=True):
        own = np.flatnonzero(owner == g)
        first.append(k)
        ps.append(np.append(p[own], zero))
        bs.append(np.append(bits[own], full ^ np.bitwise_or.reduce(bits[own]) if len(own) else full))
        k += len(own) + 1
    return np.concatenate(ps).astype(np.int64), np.concatenate(bs), np.array(first)


def unit_values(rows: pa.Table) -> tuple[tuple, list, list, np.ndarray]:
    """One block, two tiles: ((lang, i, j), groups of i, groups of j, their partial values)."""
    head = rows.filter(pc.is_valid(rows.column("left"))).slice(0, 1).to_pylist()[0]
    rows = rows.filter(pc.is_valid(rows.column("bits")))
    left, right = ([x["gid"] for x in head[s]] for s in ("left", "right"))
    pa_, a, ra = _levels(rows, left, [x["p0"] for x in head["left"]], head["size"])
    pb_, b, rb = _levels(rows, right, [x["p0"] for x in head["right"]], head["size"])
    cells = np.bitwise_count(a[:, None] & b[None, :]).astype(np.int64)
    d = pa_[:, None] - pb_[None, :]
    cells *= d * d // (pa_[:, None] + pb_[None, :])
    return (head["lang"], head["i"], head["j"]), left, right, np.add.reduceat(np.add.reduceat(cells, ra, axis=0), rb, axis=1)


def unit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of the pairs of groups, summed over the units of a task that share their tiles."""

    def out(left, right, total):
        keep = [(x, y, int(total[k, m])) for k, x in enumerate(left) for m, y in enumerate(right) if x < y]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in keep], pa.int64()) for k in range(3)], names=["a", "b", "value"])

    held = None
    for table, bounds in whole_groups(batches, "unit"):
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            key, left, right, part = unit_values(table.slice(s, e - s))
            if held and held[0] == key:
                held[3] += part
            else:
                if held:
                    yield out(*held[1:])
                held = [key, left, right, part]
    if held:
        yield out(*held[1:])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by distance, and the terms that mark a source."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                         for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    counts, counts_path = write_table(
        slim.mapInArrow(tallies, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts", release=True)

    # kept terms, numbered by falling frequency: range sort, then numbers per partition
    terms = (counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
             .filter(F.col("docs") >= min_docs).select("lang", "term", "all_n"))
    terms, _ = write_table(terms.repartitionByRange("lang", F.desc("all_n"), "term").sortWithinPartitions("lang", F.desc("all_n"), "term")
                           .withColumn("id", F.monotonically_increasing_id()), "terms", release=True)
    cells, _ = write_table(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "cells", release=True)
    drop_path(spark, counts_path)

    kept = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    inside = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (slim.select("lang", "source").distinct().join(inside, ["lang", "source"], "left").join(kept, "lang", "left")
              .select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_n"))))
    groups, _ = write_table(groups.repartitionByRange("lang", "source").sortWithinPartitions("lang", "source")
                            .withColumn("gid", F.monotonically_increasing_id())
                            .withColumn("tile", F.expr(f"gid div {tile}")), "groups", release=True)

    block = F.expr(f"id div {BLOCK}")
    bitmaps, _ = write_table(cells.groupBy("lang", block.alias("block"), "source", "n")
                             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.expr(f"cast(id % {BLOCK} AS int)"))).alias("bits")),
                             "bitmaps", release=True)
    # a language's ids are consecutive within a partition only, so a block's terms are numbered 0.. by their place in it
    sizes = terms.groupBy("lang", block.alias("block")).agg(F.count("*").alias("size"), F.min(F.expr(f"cast(id % {BLOCK} AS int)")).alias("low"))
    none = groups.select("lang").distinct().select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("low"))

    tiles = groups.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct(
        "gid", share(F.lit(0), F.col("total"), F.col("v")).alias("p0")))).alias("members"))
    i, j = (tiles.select("lang", F.col("tile").alias(t), F.col("members").alias(m)) for t, m in (("i", "left"), ("j", "right")))
    deals, _ = write_table(i.join(j, "lang").filter("i <= j"), "deals", release=True)
    heads = sizes.unionByName(none).join(deals, "lang").select("lang", "block", "i", "j", "size", "left", "right")
    where = deals.select("lang", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    levels = (bitmaps.join(sizes.select("lang", "block", "low"), ["lang", "block"]).join(groups, ["lang", "source"])
              .select("lang", "block", "tile", "gid", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
                      F.call_function("shiftrightunsigned", "bits", "low").alias("bits"))
              .join(where, ["lang", "tile"]))
    empty = F.lit(None).cast(deals.schema["left"].dataType)
    units = levels.select("lang", "block", "i", "j", F.lit(None).cast("long").alias("size"), empty.alias("left"), empty.alias("right"), "gid", "p", "bits")
    null = F.lit(None).cast("long")
    units = units.unionByName(heads.select("*", null.alias("gid"), null.alias("p"), null.alias("bits")))
    units = units.withColumn("unit", F.concat_ws("/", "block", "i", "j", "lang"))
    values = (units.repartition("lang", "block", "i", "j").sortWithinPartitions("lang", "i", "j", "block")
              .mapInArrow(unit_sums, "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("value")))
    values, _ = write_table(values, "values", release=True)
    both = values.unionByName(values.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = groups.select("lang", "source", "gid")
    pairs = (both.join(name.withColumnRenamed("gid", "a"), "a")
             .join(name.select(F.col("source").alias("item"), F.col("gid").alias("b")), "b")
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("all_n"), F.col("lang_n"), F.col("v"))
    marks = (cells.join(groups.select("lang", "source", "total", "v", "lang_n"), ["lang", "source"])
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
             .select("lang", "source", "part", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
             .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms))
    return pairs.unionByName(marks)
