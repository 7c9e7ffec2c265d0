"""Personal data by bootstrapped contextual extraction (operator 11).

Seeds are the identifiers that fixed forms find: e-mail addresses, IPv4 addresses, card
numbers (Luhn), phone numbers. Every seed, and every other token that looks like an
identifier (it holds '@', '_' or a digit, and is no seed), is an occurrence of an instance, the
normalised token. The words around an occurrence are its lexical patterns: the word
before, the two words before, the two words after.

Patterns and instances make a bipartite graph that Spark scores in rounds. A pattern's
confidence for a kind is the belief in what stands in it, over all places where its
words stand in the corpus: ordinary words and other kinds count against it in full, unknown
identifiers by ``UNKNOWN``. It counts only where the beliefs of its distinct instances
add up to ``SUPPORT``. Seeds are believed in; the belief in another
instance is the mean over its occurrences of the best high-confidence pattern there. So
the seeds induce patterns, these find unseen identifiers, and those support further
patterns. An occurrence is added to the result where it stands in a high-confidence
pattern or where the belief in its instance is ``BELIEVED`` or more; its kind is the pattern's.

Two passes read whole texts, with NumPy over Arrow batches: one finds occurrences, one
counts how often each pattern's words stand anywhere. The second pass looks words up
in a bit filter of fixed size (``FILTER_BITS``, the only thing sent to all tasks) and
shuffles only what hits; the exact join drops what hit by chance. Everything else is
a join or a sum on the occurrences, summed map-side, so a pattern or an instance in a third
of all documents is one row per task. Nothing grows on the driver.

The forms are found without backtracking over long runs: digits by chains of digit
runs, addresses from their '@', phone numbers from their '+'; each is the leftmost,
longest match, and what fails its check is dropped with its characters spent.

Defined results: null and empty texts have no spans; rows equal in all columns are
documents of their own; positions are code points of the whole text, the end exclusive; an
empty table gives no rows; other columns pass by, whatever their names; word identity
is by 64-bit hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import SPACE, WORD_ALNUM, hash_grams, hash_words, mix64, row_chunks, small_batches, text_buffer, write_table

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
CONFIDENT = 0.8
UNKNOWN = 0.25
BELIEVED = 0.4                  # half of the occurrences, in patterns of the least confidence
ROUNDS = 4
FILTER_BITS = 1 << 25
HELD = 1 << 20                  # counts that a task holds before it passes them on

LOCAL = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-":
    LOCAL[_c] = True
#: context words: A-Z lower-cased, every digit read as 0
CONTEXT = np.arange(256, dtype=np.uint8)
CONTEXT[65:91] += 32
CONTEXT[48:58] = 48
DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
#: pieces of a token that may be an identifier
PIECE = re.compile(rb"[0-9A-Za-z@_][0-9A-Za-z@_.%+/#-]*")


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(buf: np.ndarray, rel: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, as byte positions, in rows that begin at ``rel``."""
    raw, found = buf.tobytes(), []
    row_of = lambda at: np.searchsorted(rel, at, "right") - 1

    at = np.flatnonzero(buf == 0x40)
    spent = 0
    for k, r in zip(at.tolist(), row_of(at).tolist(), strict=True):
        low = max(spent, int(rel[r]))
        s = k
        while s > low and LOCAL[raw[s - 1]]:
            s -= 1
        m = DOMAIN.match(raw, k, int(rel[r + 1])) if s < k else None
        if m:
            found.append((0, s, m.end()))
            spent = m.end()

    digit = (buf >= 48) & (buf <= 57)
    if digit.any():
        begin, finish = digit.copy(), digit.copy()
        begin[1:] &= ~digit[:-1]
        finish[:-1] &= ~digit[1:]
        edge = rel[1:-1]
        edge = edge[(edge > 0) & (edge < len(buf))]
        begin[edge] = digit[edge]
        finish[edge - 1] = digit[edge - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        near = (s[1:] == e[:-1] + 1) & (row_of(s[1:]) == row_of(s[:-1]))
        gap = np.where(near, buf[np.minimum(e[:-1], len(buf) - 1)], 0)
        for kind, linked in ((1, gap == 0x2E), (2, (gap == 0x20) | (gap == 0x2D))):
            head = np.flatnonzero(np.r_[True, ~linked])          # first runs of the chains
            size = np.diff(np.append(head, len(s)))
            if kind == 1:
                for h, n in zip(head[size >= 4].tolist(), size[size >= 4].tolist(), strict=True):
                    for k in range(h, h + n - 3, 4):
                        parts = [raw[s[x]:e[x]].lstrip(b"0") for x in range(k, k + 4)]
                        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
                            found.append((1, int(s[k]), int(e[k + 3])))
            else:
                total = np.add.reduceat(e - s, head)
                for h, n in zip(head[(total >= 13) & (total <= 19)].tolist(), size[(total >= 13) & (total <= 19)].tolist(), strict=True):
                    if luhn(b"".join(raw[s[x]:e[x]] for x in range(h, h + n))):
                        found.append((2, int(s[h]), int(e[h + n - 1])))

    at = np.flatnonzero(buf == 0x2B)
    for k, r in zip(at.tolist(), row_of(at).tolist(), strict=True):
        m = PHONE.match(raw, k, int(rel[r + 1]))
        if m and 9 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
            found.append((3, k, m.end()))
    return found


def other_identifiers(buf: np.ndarray, rel: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of pieces of tokens that look like identifiers and overlap no fixed form."""
    inside = ~SPACE[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = rel[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    begin[edge] = inside[edge]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    finish[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    marks = np.concatenate(([0], np.cumsum(((buf >= 48) & (buf <= 57)) | (buf == 0x40) | (buf == 0x5F))))
    some = np.flatnonzero(marks[e] > marks[s])
    busy = np.array(sorted((a, b) for _, a, b in taken), np.int64).reshape(-1, 2)
    low, high = busy[:, 0], np.maximum.accumulate(busy[:, 1]) if len(busy) else busy[:, 1]
    raw, found = buf.tobytes(), []
    for a, b in zip(s[some].tolist(), e[some].tolist(), strict=True):
        for m in PIECE.finditer(raw, a, b):
            p = m[0].rstrip(b".%+/#-@")
            x, y = m.start(), m.start() + len(p)
            k = int(np.searchsorted(low, y)) - 1                 # the last taken span that begins before the piece ends
            if k >= 0 and high[k] > x:
                continue
            if b"@" in p or b"_" in p.strip(b"_") or (len(p) >= 4 and any(48 <= c <= 57 for c in p)):
                found.append((x, y))
    return found


def _left1(h: np.ndarray) -> np.ndarray:
    return mix64(h ^ np.uint64(0x4C31)).view(np.int64)


def _pair(h: np.ndarray, side: int) -> np.ndarray:
    return mix64(hash_grams(h, 2) ^ np.uint64(side)).view(np.int64)


LEFT2, RIGHT2 = 0x4C32, 0x5232


def scan_chunk(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> list[tuple]:
    """Occurrences (row, kind or -1, start, end in code points, instance, patterns) of rows i..j-1."""
    base = int(offsets[i])
    buf, rel = data[base:int(offsets[j])], offsets[i:j + 1] - base
    if not len(buf):
        return []
    spans = base_spans(buf, rel)
    spans += [(-1, s, e) for s, e in other_identifiers(buf, rel, spans)]
    if not spans:
        return []
    words = CONTEXT[buf]
    h, first, ws, we = hash_words(words, rel, 0, j - i, WORD_ALNUM, lower=False)
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    raw, out = buf.tobytes(), []
    for kind, s, e in spans:
        r = int(np.searchsorted(rel, s, "right")) - 1
        left, right = int(np.searchsorted(we, s, "right")), int(np.searchsorted(ws, e))
        patterns = []
        if left > first[r]:
            patterns.append(int(_left1(h[left - 1:left])[0]))
        if left - 1 > first[r]:
            patterns.append(int(_pair(h[left - 2:left], LEFT2)[0]))
        if right + 1 < first[r + 1]:
            patterns.append(int(_pair(h[right:right + 2], RIGHT2)[0]))
        low = int(points[rel[r]])
        instance = bytes(c for c in raw[s:e] if 48 <= c <= 57) if kind > 1 else raw[s:e].lower()
        out.append((i + r, kind, int(points[s]) - low, int(points[e]) - low, instance, patterns))
    return out


_OCCURRENCE = pa.struct([("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64()), ("instance", pa.binary()), ("patterns", pa.list_(pa.int64()))])
OCCURRENCE = "struct<kind int, s long, e long, instance binary, patterns array<long>>"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's occurrences and drops its text."""
    for b in batches:
        data, offsets = text_buffer(b.column("text"))
        found: list[list] = [[] for _ in range(b.num_rows)]
        for i, j in row_chunks(offsets):
            for r, kind, s, e, instance, patterns in scan_chunk(data, offsets, i, j):
                found[r].append({"kind": kind, "s": s, "e": e, "instance": instance, "patterns": patterns})
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(_OCCURRENCE))], names=["doc_id", "found"])


def count_patterns(bits: np.ndarray):
    """Pattern counts over whole texts, of the patterns that hit the filter."""
    mask = np.uint64(len(bits) * 8 - 1)

    def hit(p: np.ndarray) -> np.ndarray:
        at = p.view(np.uint64) & mask
        return p[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        p, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return p, np.bincount(at, np.concatenate([n for _, n in held]), len(p)).astype(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0                      # counts of the task so far, in chunks
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in row_chunks(offsets):
                base = int(offsets[i])
                h, first, _, _ = hash_words(CONTEXT[data[base:int(offsets[j])]], offsets[i:j + 1] - base, 0, j - i, WORD_ALNUM, lower=False)
                if not len(h):
                    continue
                inner = np.ones(max(0, len(h) - 1), bool)
                ends = first[1:-1]
                inner[ends[(ends > 0) & (ends < len(h))] - 1] = False       # pairs within a row only
                seen = np.concatenate([hit(_left1(h)), *(hit(_pair(h, side)[inner]) for side in (LEFT2, RIGHT2))])
                held.append(np.unique(seen, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["pattern", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], names=["pattern", "n"])
    return work


def filter_bits(patterns: DataFrame, size: int) -> np.ndarray:
    """A bit per pattern, by its low bits; what comes to the driver is at most size / 64 numbers."""
    at = F.expr(f"pattern & {size - 1}L")
    words = (patterns.select(at.alias("at")).groupBy(F.expr("at div 64").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("v")))
    bits = np.zeros(size // 64, np.int64)
    got = words.toArrow()
    bits[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return bits.view(np.uint8)


def score_graph(occ: DataFrame, totals: DataFrame, rounds: int, support: float, confident: float) -> tuple[DataFrame, DataFrame]:
    """(high-confidence patterns: pattern, kind, conf), (believed instances: instance, kind, belief) of occurrences (rid, s, kind, instance, patterns)."""
    edges, _ = write_table(occ.select("rid", "s", "kind", "instance", F.explode("patterns").alias("pattern")).join(totals, "pattern"), "edges", release=True)
    graph = edges.groupBy("pattern", "kind", "instance", "total").agg(F.count("*").alias("n"))
    graph, _ = write_table(graph, "graph", release=True)
    seen = occ.filter("kind < 0").groupBy("instance").agg(F.count("*").alias("n"))
    seen, _ = write_table(seen, "seen", release=True)
    unseen = edges.filter("kind < 0").select("rid", "s", "instance", "pattern")
    open_, _ = write_table(graph.groupBy("pattern", "total").agg(F.sum(F.expr("IF(kind < 0, n, 0)")).alias("open")), "open", release=True)
    believed, before, confs = None, -1, None
    for _ in range(rounds):
        held = graph.filter("kind >= 0").select("pattern", "kind", "n", F.lit(1.0).alias("belief"), F.lit(0).alias("found"))
        if believed is not None:
            held = held.unionByName(graph.filter("kind < 0").drop("kind").join(believed, "instance")
                                    .select("pattern", "kind", "n", "belief", F.lit(1).alias("found")))
        mass = held.groupBy("pattern", "kind").agg(F.sum("belief").alias("support"), F.sum(F.expr("belief * n")).alias("mass"), F.sum(F.expr("belief * n * found")).alias("found"))
        against = F.expr(f"total - open + found + {UNKNOWN} * (open - found)")
        confs = (mass.filter(F.col("support") >= support).join(open_, "pattern").withColumn("conf", F.least(F.col("mass") / against, F.lit(1.0)))
                 .filter(F.col("conf") >= confident).select("pattern", "kind", "conf"))
        confs, _ = write_table(confs, "patterns", release=True)
        best = unseen.join(confs, "pattern").groupBy("rid", "s", "instance").agg(F.max(F.struct("conf", (-F.col("kind")).alias("k"))).alias("b"))
        believed = (best.groupBy("instance", (-F.col("b.k")).alias("kind")).agg(F.sum("b.conf").alias("w")).join(seen, "instance")
                    .select("instance", "kind", F.least(F.col("w") / F.col("n"), F.lit(1.0)).alias("belief")))
        believed, _ = write_table(believed, "beliefs", release=True)
        now = tuple(confs.agg(F.count("*"), F.sum(F.round("conf", 6))).first()) + tuple(believed.agg(F.count("*"), F.sum(F.round("belief", 6))).first())
        if now == before or not now[0]:
            break
        before = now
    return confs, believed


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, support: float = SUPPORT,
         confident: float = CONFIDENT, filter_size: int = FILTER_BITS) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``added``, arrays of (kind number, s, e) in code points."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    found, _ = write_table(slim.mapInArrow(scan, f"doc_id {kind}, found array<{OCCURRENCE}>").withColumn("rid", F.monotonically_increasing_id()), "found")
    occ = found.select("rid", F.inline("found"))
    # patterns of fewer distinct instances than the support can never count
    could = (occ.select("instance", F.explode("patterns").alias("pattern")).distinct().groupBy("pattern").agg(F.count("*").alias("d"))
             .filter(F.col("d") >= support).select("pattern"))
    could, _ = write_table(could, "could", release=True)
    bits = filter_bits(could, filter_size)
    totals = slim.select("text").mapInArrow(count_patterns(bits), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    # written before it is joined: Spark would move a semi join below the sum, to every task's counts
    totals, _ = write_table(totals, "totals", release=True)
    totals = totals.join(could, "pattern", "left_semi")
    confs, believed = score_graph(occ, totals, rounds, support, confident)

    other = occ.filter("kind < 0").select("rid", "s", "e", "instance", "patterns")
    stands = (other.select("rid", "s", "e", F.explode("patterns").alias("pattern")).join(confs, "pattern")
              .select("rid", "s", "e", "kind", "conf"))
    known = other.join(believed.filter(F.col("belief") >= BELIEVED), "instance").select("rid", "s", "e", "kind", F.col("belief").alias("conf"))
    added = (stands.unionByName(known).groupBy("rid", "s", "e").agg(F.max(F.struct("conf", (-F.col("kind")).alias("k"))).alias("b"))
             .select("rid", F.struct((-F.col("b.k")).alias("kind"), "s", "e").alias("span")).groupBy("rid").agg(F.collect_list("span").alias("added")))
    base = F.expr("transform(filter(found, x -> x.kind >= 0), x -> struct(x.kind AS kind, x.s AS s, x.e AS e))")
    none = F.expr("cast(array() AS array<struct<kind:int,s:bigint,e:bigint>>)")
    return (found.select("rid", "doc_id", F.sort_array(base).alias("base")).join(added, "rid", "left")
            .select("doc_id", "base", F.sort_array(F.coalesce("added", none)).alias("added")))


def as_text(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(sort_array({spans}), x -> concat({names}[x.kind], ':', x.s, ':', x.e)), ',')"


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of the fixed forms, SHA-256 of their list, and the list of all spans."""
    found = find(docs, **options)
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) AS long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.expr(f"sha2({as_text('base')}, 256)").alias("base_sha256"), F.expr(as_text("concat(base, added)")).alias("spans"))
