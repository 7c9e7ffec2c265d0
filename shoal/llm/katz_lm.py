"""Language-model scoring by Katz backoff (operator 10).

Words are runs of non-blanks, A-Z lower-cased; each text ends with an end token,
and its first word follows a start mark. The model is learned from the texts of
``train``. With c(v, w) and c(w) the training counts, d Good-Turing discounts
(r <= ``GT_MAX``, from the counts of counts) and u the unseen word::

    p1(w) = d1(c) c / N                   p1(u) = 1 - sum of p1 over seen words
    p(w | v) = d2(c) c / c(v)             if c(v, w) > 0
             = a(v) p1(w)                 else; a(v) makes the sum over all words and u exactly 1
    p(w | v) = p1(w)                      if v was never seen as a context

A context whose counts are all undiscounted leaves no mass; it divides by
c(v) + 1. Where the counts of counts give no discount between 0 and 1 (small
data), r - D over r is used with D = n1 / (n1 + 2 n2).

Nothing but the words with c >= N / ``KNOWN`` and the pairs with c >= N / ``HEAVY``
(at most that many, whatever the corpus) is sent to all tasks. Everything else
lies in tables partitioned by context: pairs (v, w, c, c(w)) by v, where a
context above half a partition's share is split by w; words by hash. Counting
combines a chunk's pairs, then sums by partition. Scoring sends each document's
distinct pairs to the pairs' partition, adds up per document there, and only
unseen pairs of rare words go on, to the words' table. Blocks of sorted columns
travel as compressed rows, several bytes a pair.

Word identity is a 63-bit hash. Defined results: null text is the empty text
(one end token); rows with equal ids are separate documents; a null id's
remainder is that of the empty text; an empty training set scores 0 (everything
is the unseen word); very long texts are counted and scored whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from shoal.llm.common import (WORD_NONBLANK, drop_path, hash_words, mix64, row_chunks, small_batches, text_buffer,
                              write_table)

KNOWN = 1 << 20
HEAVY = 1 << 16
GT_MAX = 5
PART_TOKENS = 1 << 19
CHUNK = 4 << 20
TOP = np.uint64(1 << 63)
START, END = (mix64(np.array([k], np.uint64))[0] for k in (0x5747, 0x454E))
BLOB = "p int, kind int, blob binary"


# -- packed columns ------------------------------------------------------------

def pack(*cols: np.ndarray) -> bytes:
    """Equal-length columns as one compressed block: their widths, then byte planes apart."""
    planes = (np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in cols)
    return zstandard.ZstdCompressor(level=1).compress(bytes(c.dtype.itemsize for c in cols) + b"".join(planes))


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    """The columns of a block; a column has the kind asked for and the width that it was packed with."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    types = [np.dtype(f"{np.dtype(t).kind}{width}") for t, width in zip(types, raw[:len(types)], strict=True)]
    n, at, out = (len(raw) - len(types)) // sum(t.itemsize for t in types), len(types), []
    for t in types:
        out.append(raw[at:at + n * t.itemsize].reshape(t.itemsize, n).T.copy().view(t).ravel())
        at += n * t.itemsize
    return out


def narrow(c: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all of them fit, else in 64."""
    return c.astype(np.uint32 if not len(c) or int(c.max()) < 1 << 32 else np.uint64)


PAIR = ("u8", "u8", "u4")                 # v, w, c
ENTRY = ("u8", "u8", "u4", "u4", "u4")    # v, w, c, c(w) (0 for a known word), unused by requests


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, in sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def summed(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, v))
    v, w, c = v[order], w[order], c[order]
    at = runs(v, w)
    return v[at], w[at], narrow(np.add.reduceat(c.astype(np.int64), at) if len(at) else c)


def tally(v: np.ndarray, w: np.ndarray, doc: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (v, w, doc) and how often each occurs, in order of v's and w's codes.

    The codes of a chunk's rare words get numbers after the ``known`` ranks, so a row
    is one 64-bit number and one sort does; what does not fit is sorted by columns.
    """
    rare = np.unique(np.concatenate([v[v >= TOP], w[w >= TOP]]))
    b = int(known + len(rare)).bit_length()
    d = int(doc.max()).bit_length() if len(doc) else 0
    if 2 * b + d > 64:
        order = np.lexsort((doc, w, v))
        v, w, doc = v[order], w[order], doc[order]
        at = runs(v, w, doc)
        return v[at], w[at], doc[at], np.diff(np.r_[at, len(v)])
    vi, wi = (np.where(x < TOP, x, np.uint64(known) + np.searchsorted(rare, x).astype(np.uint64)) for x in (v, w))
    key = (vi << np.uint64(b + d)) | (wi << np.uint64(d)) | doc.astype(np.uint64)
    key.sort()
    at = runs(key)
    n = np.diff(np.r_[at, len(key)])
    key = key[at]
    out = []
    for x in (key >> np.uint64(b + d), (key >> np.uint64(d)) & np.uint64((1 << b) - 1)):
        late = x >= np.uint64(known)
        x[late] = rare[(x[late] - np.uint64(known)).astype(np.int64)]
        out.append(x)
    return out[0], out[1], (key & np.uint64((1 << d) - 1)).astype(np.int64), n


# -- the part of the model that every task knows --------------------------------

def discounts(n: np.ndarray) -> np.ndarray:
    """d_1..d_GT_MAX from the counts of counts n_1..n_(GT_MAX + 1)."""
    r = np.arange(1, GT_MAX + 1)
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = (GT_MAX + 1) * n[GT_MAX] / n[0]
        d = ((r + 1) * n[1:GT_MAX + 1] / (r * n[:GT_MAX]) - tail) / (1 - tail)
    if np.isfinite(d).all() and (d > 0).all() and (d < 1).all():
        return d
    flat = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 else 0.5
    return (r - min(0.9, max(0.1, flat))) / r


class Known:
    """Frequent words (hash, count), the totals, and the unigram model."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, docs: int, total: int, types: int, n: np.ndarray):
        order = np.lexsort((hashes, -counts))
        hashes, counts = hashes[order], counts[order]
        self.count = np.r_[counts, 0].astype(np.int64)              # by rank; the last is the start mark
        self.hash = np.r_[hashes, START].astype(np.uint64)
        by = np.argsort(self.hash)
        self.sorted, self.rank = self.hash[by], by.astype(np.uint64)
        self.context = np.where(self.hash == END, 0, self.count)
        self.context[-1] = docs
        self.total, self.types, self.docs = total, types, docs
        self.parts = max(8, -(-total // PART_TOKENS))
        self.splits = np.minimum(1 + 2 * self.parts * self.context // max(1, total), self.parts).astype(np.uint64)
        self.d1 = discounts(n)
        r = np.arange(1, GT_MAX + 1)
        left = float(((1 - self.d1) * r * np.asarray(n[:GT_MAX], float)).sum()) if total else 1.0
        self.over = total if left > 0 else total + 1                # no discounted mass: one more for the unseen word
        self.unseen = (left if left > 0 else 1.0) / max(1, self.over)

    def code(self, h: np.ndarray) -> np.ndarray:
        """Rank of a known word, else its hash with the top bit set."""
        k = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[k] == h, self.rank[k], h | TOP)

    def p1(self, c: np.ndarray) -> np.ndarray:
        """Unigram probability by count (0: the unseen word)."""
        c = np.asarray(c, np.int64)
        d = np.r_[0.0, self.d1, 1.0][np.minimum(c, GT_MAX + 1)]
        return np.where(c > 0, d * c / max(1, self.over), self.unseen)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((np.asarray(c) + 0.5) / (self.total + 0.5 * (self.types + 1)))

    def route(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Partition of a pair: by its context, and by its word where the context is split."""
        s = np.ones(len(v), np.uint64)
        known = v < TOP
        s[known] = self.splits[v[known].astype(np.int64)]
        return ((mix64(v) % np.uint64(self.parts) + mix64(w) % s) % np.uint64(self.parts)).astype(np.int64)

    def count_of(self, w: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """c(w): of known words from here, of others as given."""
        known = w < TOP
        return np.where(known, self.count[np.where(known, w, 0).astype(np.int64)], rare)


class Contexts:
    """Sums over the pairs of each context: how p(w | v) and a(v) follow from them.

    ``by_r``: (contexts, GT_MAX + 1) total counts of pairs with c = 1.. and above GT_MAX; ``seen``: sum of p1.
    """

    def __init__(self, v: np.ndarray, by_r: np.ndarray, seen: np.ndarray, d2: np.ndarray):
        total = by_r.sum(axis=1).astype(float)
        left = (by_r[:, :GT_MAX] * (1 - d2)).sum(axis=1)
        none = left <= 0
        self.v, self.over = v, np.where(none, total + 1, total)
        with np.errstate(divide="ignore"):
            self.log_a = np.log10(np.where(none, 1.0, left) / self.over) - np.log10(np.maximum(1 - seen, 1e-300))


def context_sums(v: np.ndarray, c: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, by_r, seen) of pairs sorted by v."""
    at = runs(v)
    if not len(at):
        return v[:0], np.zeros((0, GT_MAX + 1)), np.zeros(0)
    r = np.minimum(c, GT_MAX + 1).astype(np.int64) - 1
    row = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(v)]))
    by_r = np.bincount(row * (GT_MAX + 1) + r, c, len(at) * (GT_MAX + 1)).reshape(-1, GT_MAX + 1)
    return v[at], by_r, np.add.reduceat(p1, at)


# -- texts to tokens -------------------------------------------------------------

def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches gathered to about ``CHUNK`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bigrams(column, known: Known | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, previous word, word, row) of the tokens of each chunk of rows: hashes, or codes of ``known``."""
    data, offsets = text_buffer(column)
    for i, j in row_chunks(offsets, CHUNK):
        h, first, _, _ = hash_words(data, offsets, i, j, WORD_NONBLANK)
        start, end = START, END
        if known is not None:
            h, (start, end) = known.code(h), known.code(np.array([START, END]))
        yield i, j, np.insert(h, first[:-1], start), np.insert(h, first[1:], end), np.repeat(np.arange(j - i), np.diff(first) + 1)


def _rows(schema: pa.Schema, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


BLOBS = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def dealt(p: np.ndarray, kind: int, *cols: np.ndarray) -> list:
    """A row (partition, kind, block) for each partition; rows keep their order in it."""
    order = np.argsort(p.astype(np.uint16) if len(p) and p.max() < 1 << 16 else p, kind="stable")     # 16 bits: a radix sort
    at = runs(p[order])
    ends = np.r_[at[1:], len(p)] if len(at) else at
    cols = [c[order] for c in cols]
    return [(int(p[order[a]]), kind, pack(*(c[a:z] for c in cols))) for a, z in zip(at, ends)]


def grouped(batches: Iterator[pa.RecordBatch], key: str = "p") -> Iterator[tuple[int, Iterator[dict]]]:
    """(key, its rows) of rows sorted by key; a group's rows are read as they come."""
    from itertools import groupby
    rows = (r for b in batches for r in b.to_pylist())
    for k, group in groupby(rows, lambda r: r[key]):
        yield k, group


# -- learning ----------------------------------------------------------------------

def unigrams(train: DataFrame) -> DataFrame:
    """(w, c) over the training texts, the end token included; written to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunked(batches):
            for _, _, _, w, _ in bigrams(t.column("text")):
                h, c = np.unique(w, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["w", "c"])

    return write_table(train.select("text").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "unigrams", release=True)[0]


def known_words(words: DataFrame) -> Known:
    """The bounded shared part, from the whole unigram table."""
    r = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"),
                  *(F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in range(1, GT_MAX + 2))).first()
    end = words.filter(F.col("w") == int(END.view(np.int64))).first()
    top = words.filter(F.col("c") >= -(-r["n"] // KNOWN)).toArrow()
    return Known(top.column("w").to_numpy().astype(np.int64).view(np.uint64), top.column("c").to_numpy().astype(np.int64),
                 end["c"] if end else 0, r["n"], r["v"], np.array([r[f"n{k}"] for k in range(1, GT_MAX + 2)]))


def pair_table(train: DataFrame, known: Known) -> tuple[DataFrame, str]:
    """The model's pairs, one block (v, w, c, c(w)) sorted by (v, w) for each partition."""
    parts = np.uint64(known.parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunked(batches):
            for _, _, v, w, doc in bigrams(t.column("text"), known):
                v, w, _, c = tally(v, w, np.zeros(len(doc), np.int64), len(known.hash))
                c = narrow(c)
                rare = w >= TOP
                yield _rows(BLOBS, dealt((mix64(w[rare]) % parts).astype(np.int64), 0, v[rare], w[rare], c[rare])
                            + dealt(known.route(v[~rare], w[~rare]), 1, v[~rare], w[~rare], c[~rare]))

    def merged(blobs: list[bytes]) -> list[np.ndarray]:
        got = [unpack(b, *PAIR) for b in blobs]
        return [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, t) for t in PAIR]

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in grouped(batches):
            blobs: list[list] = [[], []]
            for row in rows:
                blobs[row["kind"]].append(row["blob"])
            out = []
            v, w, c = summed(*merged(blobs[1]))
            if len(v):
                out.append((p, 1, pack(v, w, c, np.zeros(len(v), np.uint32))))
            w, v, c = summed(*(lambda a: (a[1], a[0], a[2]))(merged(blobs[0])))       # all pairs of a rare word are here
            if len(w):
                at = runs(w)
                cw = narrow(np.repeat(np.add.reduceat(c.astype(np.int64), at), np.diff(np.r_[at, len(w)])))
                out += dealt(known.route(v, w), 1, v, w, c, cw)
            yield _rows(BLOBS, out)

    def by_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in grouped(batches):
            v, w, c, cw = (np.concatenate(x) for x in zip(*(unpack(r["blob"], "u8", "u8", "u4", "u4") for r in rows)))
            order = np.lexsort((w, v))
            yield _rows(BLOBS, [(p, 0, pack(v[order], w[order], c[order], cw[order]))])

    pairs = (train.select("text").mapInArrow(count, BLOB).repartition("p").sortWithinPartitions("p")
             .mapInArrow(by_word, BLOB).repartition("p").sortWithinPartitions("p").mapInArrow(by_context, BLOB))
    return write_table(pairs, "pairs", release=True)


class Shared:
    """What scoring tasks know besides ``Known``: discounts, split contexts, heavy pairs."""

    def __init__(self, known: Known, pairs: DataFrame):
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for blob in b.column("blob"):
                    v, w, c, cw = unpack(blob.as_py(), "u8", "u8", "u4", "u4")
                    n = np.bincount(np.minimum(c, GT_MAX + 2), minlength=GT_MAX + 3)[1:GT_MAX + 2]
                    out.append(("n", 0, 0, [float(x) for x in n]))
                    heavy = np.flatnonzero(c.astype(np.int64) * HEAVY >= known.total)
                    out += [("heavy", int(v[k].view(np.int64)), int(w[k].view(np.int64)), [float(c[k])]) for k in heavy]
                    split = np.zeros(len(v), bool)
                    split[v < TOP] = known.splits[v[v < TOP].astype(np.int64)] > 1
                    vs, by_r, seen = context_sums(v[split], c[split], known.p1(known.count_of(w, cw))[split])
                    out += [("split", int(x.view(np.int64)), 0, [*map(float, r), float(s)]) for x, r, s in zip(vs, by_r, seen)]
                yield _rows(pa.schema([("what", pa.string()), ("v", pa.int64()), ("w", pa.int64()), ("x", pa.list_(pa.float64()))]), out)

        # at most: one row, HEAVY rows, and one row for each context above half a partition's share
        got = (pairs.select("blob").mapInArrow(look, "what string, v long, w long, x array<double>")
               .groupBy("what", "v", "w").agg(F.array(*(F.sum(F.get("x", F.lit(k))) for k in range(GT_MAX + 2))).alias("x")).toArrow().to_pylist())
        pick = lambda what: [r for r in got if r["what"] == what]
        n = pick("n")
        self.d2 = discounts(np.array(n[0]["x"][:GT_MAX + 1]) if n else np.zeros(GT_MAX + 1))
        split = sorted(pick("split"), key=lambda r: r["v"])
        x = np.array([r["x"] for r in split], float).reshape(-1, GT_MAX + 2)
        self.split = Contexts(np.array([r["v"] for r in split], np.int64).view(np.uint64), x[:, :-1], x[:, -1], self.d2)
        heavy = pick("heavy")
        v, w = (np.array([r[k] for r in heavy], np.int64).view(np.uint64) for k in "vw")
        c = np.array([r["x"][0] for r in heavy], float)
        key = mix64(v) ^ w
        order = np.argsort(key)
        self.heavy, self.heavy_c, self.heavy_v = key[order], c[order], v[order]


# -- scoring ---------------------------------------------------------------------------

PART = ("u4", "f8", "f8", "u4")           # document of the chunk, score, base score, known tokens
WORK = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])


def ask(batches: Iterator[pa.RecordBatch], known: Known, shared: Shared) -> Iterator[pa.RecordBatch]:
    """Requests by partition (kind 1) and what the task can add up itself (kind 2), by chunk of documents."""
    heavy_over = None
    chunk = None
    for t in chunked(batches):
        ids, held = t.column("doc_id"), t.column("held_out")
        part = t.column("part")[0].as_py() if t.num_rows else 0
        chunk = part << 32 if chunk is None else chunk
        for i, j, v, w, doc in bigrams(t.column("text"), known):
            n_tokens = np.bincount(doc, minlength=j - i)
            there = w < TOP
            base, seen, score = np.zeros(j - i), np.zeros(j - i, np.int64), np.zeros(j - i)
            np.add.at(base, doc[there], known.base(known.count[w[there].astype(np.int64)]))
            seen += np.bincount(doc[there], minlength=j - i)
            if len(shared.heavy):
                key = mix64(v) ^ w
                k = np.minimum(np.searchsorted(shared.heavy, key), len(shared.heavy) - 1)
                hit = shared.heavy[k] == key
                if heavy_over is None:
                    heavy_over = heavy_logs(known, shared)
                hit &= ~np.isnan(heavy_over[k])
                np.add.at(score, doc[hit], heavy_over[k[hit]])
                v, w, doc = v[~hit], w[~hit], doc[~hit]
            v, w, doc, n = tally(v, w, doc, len(known.hash))
            rows = [(p, 1, chunk, blob) for p, _, blob in dealt(known.route(v, w), 1, v, w, doc.astype(np.uint32), n.astype(np.uint32))]
            own = pack(np.arange(j - i, dtype=np.uint32), score, base, seen.astype(np.uint32), n_tokens.astype(np.uint32))
            sent = pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(ids.type)), pa.array([held.slice(i, j - i).to_pylist()], pa.list_(pa.bool_()))
            some = _rows(WORK, rows)
            none = [pa.nulls(len(rows), x.type) for x in sent]
            yield pa.RecordBatch.from_arrays([*some.columns, *none], [*WORK.names, "ids", "held"])
            mine = _rows(WORK, [(int(chunk % known.parts), 2, chunk, own)])
            yield pa.RecordBatch.from_arrays([*mine.columns, *sent], [*WORK.names, "ids", "held"])
            chunk += 1


def heavy_logs(known: Known, shared: Shared) -> np.ndarray:
    """log10 p of each heavy pair whose context is split, that is whose sums are shared; NaN for others."""
    out = np.full(len(shared.heavy), np.nan)
    if len(shared.split.v):
        k = np.minimum(np.searchsorted(shared.split.v.view(np.int64), shared.heavy_v.view(np.int64)), len(shared.split.v) - 1)
        ok = shared.split.v[k] == shared.heavy_v
        d = np.r_[shared.d2, 1.0][np.minimum(shared.heavy_c, GT_MAX + 1).astype(int) - 1]
        out[ok] = np.log10(d[ok] * shared.heavy_c[ok] / shared.split.over[k[ok]])
    return out


def answer(batches: Iterator[pa.RecordBatch], known: Known, shared: Shared, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Score requests against the partition's pairs (which come first); unseen pairs of rare words go on."""
    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary()), ("ids", pa.list_(id_type)),
                        ("held", pa.list_(pa.bool_())), ("w", pa.list_(pa.int64())), ("doc", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
    for p, rows in grouped(batches):
        v = w = np.zeros(0, np.uint64)
        c = cw = np.zeros(0, np.uint32)
        key = own = None
        for row in rows:
            if row["kind"] == 0:
                v, w, c, cw = unpack(row["blob"], "u8", "u8", "u4", "u4")
                continue
            if row["kind"] == 2:
                yield _rows(schema, [(row["chunk"], 2, row["blob"], row["ids"], row["held"], None, None, None)])
                continue
            if key is None:
                cw = known.count_of(w, cw).astype(np.int64)
                own = Contexts(*context_sums(v, c, known.p1(cw)), shared.d2)
                key = mix64(v) ^ w
                order = np.argsort(key)
                key, c, cw = key[order], c[order].astype(np.int64), cw[order]
            rv, rw, doc, n = unpack(row["blob"], "u8", "u8", "u4", "u4")
            # contexts: shared sums if split, else this partition's, else never seen
            over, log_a = np.zeros(len(rv)), np.zeros(len(rv))
            for ctx in (own, shared.split):
                if len(ctx.v):
                    at = np.argsort(ctx.v) if ctx is shared.split else None
                    cv = ctx.v if at is None else ctx.v[at]
                    k = np.minimum(np.searchsorted(cv, rv), len(cv) - 1)
                    ok = cv[k] == rv
                    k = k if at is None else at[k]
                    over[ok], log_a[ok] = ctx.over[k[ok]], ctx.log_a[k[ok]]
            want = mix64(rv) ^ rw
            k = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
            seen = (key[k] == want) if len(key) else np.zeros(len(rv), bool)
            score, base, got = np.zeros(len(rv)), np.zeros(len(rv)), np.zeros(len(rv), np.int64)
            ks = k[seen]
            if len(ks):
                d = np.r_[shared.d2, 1.0][np.minimum(c[ks], GT_MAX + 1) - 1]
                score[seen] = np.log10(d * c[ks] / over[seen])
            rare = rw >= TOP
            there = seen & rare
            base[there], got[there] = known.base(cw[k[there]]), 1
            plain = ~seen & ~rare
            score[~seen] = log_a[~seen]
            score[plain] += np.log10(known.p1(known.count[rw[plain].astype(np.int64)]))
            docs, at = np.unique(doc, return_inverse=True)
            part = pack(docs, np.bincount(at, score * n), np.bincount(at, base * n), np.bincount(at, got * n).astype(np.uint32))
            go = ~seen & rare
            yield _rows(schema, [(row["chunk"], 1, part, None, None, rw[go].view(np.int64).tolist(), doc[go].tolist(), n[go].tolist())])


def finish(batches: Iterator[pa.RecordBatch], known: Known, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row per document from all parts of its chunk."""
    for _, rows in grouped(batches, "chunk"):
        parts, own = [], None
        for row in rows:
            if row["kind"] == 2:
                own = row
            elif row["kind"] == 1:
                parts.append(unpack(row["blob"], *PART))
            else:
                x = row["late"]
                parts.append([np.array([r[k] for r in x], t) for k, t in zip(("doc", "score", "base", "known"), PART)])
        _, score, base, got, n = unpack(own["blob"], *PART, "u4")
        got = got.astype(np.int64)
        for doc, s, b, g in parts:
            score[doc] += s
            base[doc] += b
            got[doc] += g
        yield pa.RecordBatch.from_arrays(
            [pa.array(own["ids"], id_type), pa.array(own["held"], pa.bool_()), pa.array(n.astype(np.int64)), pa.array(got),
             pa.array(np.full(len(n), known.total)), pa.array(base), pa.array(score)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_documents(docs: DataFrame, held_out: "F.Column", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the documents that ``held_out`` (a condition on ``docs``) doesn't name; score all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    train = rows.filter("not held_out")
    words = unigrams(train)
    known = known_words(words)
    pairs, pairs_path = pair_table(train, known)
    shared = Shared(known, pairs)

    kind: DataType = rows.schema["doc_id"].dataType
    ddl = kind.simpleString()
    empty = {"chunk": "cast(null as long)", "ids": f"cast(null as array<{ddl}>)", "held": "cast(null as array<boolean>)"}
    wanted = rows.withColumn("part", F.spark_partition_id()).mapInArrow(
        lambda it: ask(it, known, shared), f"p int, kind int, chunk long, blob binary, ids array<{ddl}>, held array<boolean>")
    model = pairs.selectExpr("p", "kind", *(f"{empty[c]} as {c}" if c in empty else c for c in ("chunk", "blob", "ids", "held")))
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(kind)
    answers, path = write_table(
        model.unionByName(wanted).repartition("p").sortWithinPartitions("p", "kind").mapInArrow(
            lambda it: answer(it, known, shared, id_type),
            f"chunk long, kind int, blob binary, ids array<{ddl}>, held array<boolean>, w array<long>, doc array<int>, n array<int>"), "answers", release=True)
    drop_path(spark, pairs_path)
    # unseen pairs of rare words: the word's own count decides
    go = (answers.filter("kind = 1").select("chunk", F.explode(F.arrays_zip("w", "doc", "n")).alias("r"))
          .select("chunk", F.col("r.w").bitwiseAND(F.lit((1 << 63) - 1)).alias("key"), F.col("r.doc").alias("doc"), F.col("r.n").alias("n"))
          .groupBy("key", "chunk", "doc").agg(F.sum("n").alias("n")))
    counted = (words.select(F.col("w").bitwiseAND(F.lit((1 << 63) - 1)).alias("key"), "c"))
    c = F.coalesce("c", F.lit(0))
    p1 = F.when(c == 0, F.lit(float(known.unseen)))
    for r in range(1, GT_MAX + 1):
        p1 = p1.when(c == r, F.lit(float(known.d1[r - 1])) * r / F.lit(float(max(1, known.over))))
    p1 = p1.otherwise(c / F.lit(float(max(1, known.over))))
    base = F.log10((c + F.lit(0.5)) / F.lit(known.total + 0.5 * (known.types + 1)))
    late = (go.join(counted, "key", "left")
            .groupBy("chunk", "doc").agg(F.sum(F.col("n") * F.log10(p1)).alias("score"), F.sum(F.col("n") * base).alias("base"),
                                         F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
            .groupBy("chunk").agg(F.collect_list(F.struct("doc", "score", "base", "known")).alias("late"))
            .select("chunk", F.lit(3).alias("kind"), "late"))
    whole = answers.select("chunk", "kind", "blob", "ids", "held").unionByName(late, allowMissingColumns=True)
    return (whole.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(
        lambda it: finish(it, known, id_type),
        f"doc_id {ddl}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
