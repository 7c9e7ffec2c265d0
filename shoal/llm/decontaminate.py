"""Benchmark decontamination (operator 9): a distributed positional inverted index.

``build_index`` turns documents into index segments of about ``SEGMENT_BYTES``
of text: the postings of a segment are its term hashes in order, where each
term's list starts, and all positions, list by list. Positions count words,
with a gap between documents, so that no phrase crosses two of them. Segments
are written once to the shared folder and are the only shards: any passage,
however common, is spread over the segments of the documents that hold it.

``matches`` looks windows of consecutive benchmark words up. A window's terms
are ordered from the rarest (by their counts over the whole index); the rarest
term's positions, less its offset, are the candidate starts, and each further
list is intersected with them, its own offset taken off. With ``slop`` > 0 a
term may stand that many words from its exact place: the proximity match.

The benchmark is taken in blocks of about ``BLOCK_WORDS`` words; only a block's
windows, that is a bounded table, go to each task. The index keeps postings of
benchmark terms only while these are at most ``VOCABULARY`` (what else a text
holds can't match); beyond that it keeps all postings.

Words: A-Z lower-cased, then maximal runs of digits, letters a-z and non-ASCII
characters. Term identity is a 64-bit hash of the word's bytes.

Defined results: null or empty text has no words and no hits; rows with equal
ids are separate documents; an item without words matches nothing, one shorter
than a window is one window of its words; repeated items count once by id, a
null item id as the empty text; with an empty benchmark nothing is hit; very long
texts are indexed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import WORD_ALNUM, hash_words, row_chunks, small_batches, text_buffer, write_table

WINDOW = 10
SEGMENT_BYTES = 1 << 20
BLOCK_WORDS = 1 << 19
VOCABULARY = 1 << 20
GAP = 64
CANDIDATES = 1 << 20
SEGMENTS_PER_FILE = 64


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Index segments of ``docs``, written to the shared folder.

    Columns: segment, doc_ids, n_words and firsts (per document: words, first
    position), terms, starts, positions (little-endian arrays).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in row_chunks(offsets, SEGMENT_BYTES):
                h, first, _, _ = hash_words(data, offsets, i, j, WORD_ALNUM)
                n = np.diff(first)
                start = first[:-1] + np.arange(j - i) * GAP
                where = np.arange(len(h)) + np.repeat(np.arange(j - i) * GAP, n)
                if vocabulary is not None and len(vocabulary):
                    k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    known = vocabulary[k] == h
                    h, where = h[known], where[known]
                elif vocabulary is not None:
                    h, where = h[:0], where[:0]
                order = np.argsort(h, kind="stable")
                h = h[order]
                begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                part = b.column("part")[i].as_py()
                ids = b.column("doc_id").slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + number]), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids),
                     pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([start.tolist()], pa.list_(pa.int64())),
                     pa.array([h[begin].tobytes()]), pa.array([begin.astype("<i8").tobytes()]),
                     pa.array([where[order].astype("<u4").tobytes()])],
                    ["segment", "doc_ids", "n_words", "firsts", "terms", "starts", "positions"])
                number += 1

    made = rows.mapInArrow(segments, f"segment long, doc_ids array<{kind}>, n_words array<long>, firsts array<long>, "
                                     "terms binary, starts binary, positions binary")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", str(SEGMENTS_PER_FILE))
    try:
        return write_table(made, "index")[0]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): the word hashes of each item, as longs, in order."""
    small_batches(items.sparkSession)
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            out = []
            for i, j in row_chunks(offsets):
                h, first, _, _ = hash_words(data, offsets, i, j, WORD_ALNUM)
                out += [h[first[k]:first[k + 1]].view(np.int64) for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(out, pa.list_(pa.int64()))], ["item", "words"])

    return rows.mapInArrow(words, "item string, words array<long>")


class Block:
    """The windows of one block of items: terms by number in ``vocab``, from the rarest."""

    def __init__(self, items: list[str], words: list[np.ndarray], window: int):
        rows, of, size = [], [], []
        for k, w in enumerate(words):
            w = np.asarray(w, np.int64).view(np.uint64)
            for s in range(max(1, len(w) - window + 1) if len(w) else 0):
                rows.append(w[s:s + window])
                of.append(k)
                size.append(len(rows[-1]))
        self.items, self.of, self.size = items, np.array(of, np.int64), np.array(size, np.int64)
        self.vocab = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
        self.terms = np.full((len(rows), window), -1, np.int64)
        self.shift = np.zeros((len(rows), window), np.int64)
        for k, r in enumerate(rows):
            self.terms[k, :len(r)] = np.searchsorted(self.vocab, r)
            self.shift[k, :len(r)] = np.arange(len(r))

    def rarest_first(self, counts: np.ndarray) -> None:
        by = np.where(self.terms < 0, np.iinfo(np.int64).max, counts[self.terms])
        order = np.argsort(by, axis=1, kind="stable")
        self.terms, self.shift = np.take_along_axis(self.terms, order, 1), np.take_along_axis(self.shift, order, 1)


def lookup(block: Block, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray,
           slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of each match in one segment; a proximity match has its rarest term's start."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms) or not len(block.terms):
        return none
    k = np.minimum(np.searchsorted(terms, block.vocab), len(terms) - 1)
    here = np.where(terms[k] == block.vocab, k, -1)
    used = block.terms >= 0
    local = np.where(used, here[block.terms], 0)
    live = np.flatnonzero((local >= 0).all(axis=1))
    if not len(live):
        return none
    ends = np.r_[starts[1:], len(positions)]
    keys = (np.repeat(np.arange(len(terms), dtype=np.int64), ends - starts) << 32) | positions.astype(np.int64)
    n = (ends - starts)[local[live, 0]]
    out_w, out_s = [], []
    cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) // CANDIDATES)) + 1, len(live)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):      # at most about CANDIDATES starts at a time
        m = n[lo:hi]
        w = np.repeat(live[lo:hi], m)
        at = np.repeat(starts[local[live[lo:hi], 0]] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
        s = positions[at].astype(np.int64) - block.shift[w, 0]
        keep = s >= 0
        w, s = w[keep], s[keep]
        for r in range(1, block.terms.shape[1]):
            if not len(w):
                break
            want = (local[w, r] << 32) | np.maximum(s + block.shift[w, r] - slop, 0)
            p = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = (keys[p] >= want) & (keys[p] <= want + 2 * slop) | ~used[w, r]
            w, s = w[hit], s[hit]
        out_w.append(w)
        out_s.append(s)
    return np.concatenate(out_w), np.concatenate(out_s)


def term_counts(index: DataFrame, vocab: np.ndarray) -> np.ndarray:
    """How often each term of a block occurs in the whole index (at most a block's terms reach the driver)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocab), np.int64)
        for b in batches:
            for t, s, p in zip(*(b.column(c) for c in ("terms", "starts", "positions"))):
                t, s, n = np.frombuffer(t.as_py(), np.uint64), np.frombuffer(s.as_py(), np.int64), len(p.as_py()) // 4
                if len(t):
                    k = np.minimum(np.searchsorted(t, vocab), len(t) - 1)
                    total += np.where(t[k] == vocab, np.diff(np.r_[s, n])[k], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    out = np.zeros(len(vocab), np.int64)
    if len(vocab):
        got = (index.select("terms", "starts", "positions").mapInArrow(count, "k long, n long")
               .groupBy("k").agg(F.sum("n").alias("n")).toArrow())
        out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out


def matches(index: DataFrame, block: Block, slop: int = 0) -> DataFrame:
    """(segment, doc_no, item, spans): where windows of each item match, as merged word spans of the document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seg, firsts, t, s, p in zip(*(b.column(c) for c in ("segment", "firsts", "terms", "starts", "positions"))):
                w, at = lookup(block, np.frombuffer(t.as_py(), np.uint64), np.frombuffer(s.as_py(), np.int64),
                               np.frombuffer(p.as_py(), "<u4"), slop)
                if not len(w):
                    continue
                firsts = np.asarray(firsts.as_py(), np.int64)
                doc = np.searchsorted(firsts, at, "right") - 1
                item, stop = block.of[w], at + block.size[w]
                order = np.lexsort((at, item, doc))
                doc, item, at, stop = doc[order], item[order], at[order], stop[order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]
                new[1:] |= at[1:] > stop[:-1]         # windows of one item: equal lengths, so stops rise with starts
                k = np.flatnonzero(new)
                last = np.r_[k[1:], len(at)] - 1
                out += [(seg.as_py(), int(d), block.items[i], int(a), int(z)) for d, i, a, z in
                        zip(doc[k], item[k], at[k] - firsts[doc[k]], stop[last] - firsts[doc[k]])]
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                             ["segment", "doc_no", "item", "start", "stop"])

    return (index.select("segment", "firsts", "terms", "starts", "positions")
            .mapInArrow(find, "segment long, doc_no int, item string, start long, stop long"))


def blocks(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> tuple[list, np.ndarray | None]:
    """(functions that make each block, the benchmark's terms if they are few enough)."""
    words, _ = write_table(item_words(items, id_col, text_col), "items")
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_WORDS))
    vocabulary = None
    terms = words.select(F.explode("words").alias("t")).distinct()
    if terms.limit(VOCABULARY + 1).count() <= VOCABULARY:
        vocabulary = np.sort(terms.toArrow().column("t").to_numpy().astype(np.int64).view(np.uint64))

    def make(k: int):
        got = words.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k).toArrow()
        return Block(got.column("item").to_pylist(), [np.asarray(w, np.int64) for w in got.column("words").to_pylist()], window)

    return [lambda k=k: make(k) for k in range(n)], vocabulary


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted ids), spans (merged word spans hit)."""
    made, vocabulary = blocks(benchmark, window, item_col, item_text_col)
    index = build_index(docs, vocabulary, id_col, text_col)
    found = None
    for make in made:
        block = make()
        block.rarest_first(term_counts(index, block.vocab))
        part = matches(index, block, slop)
        if len(made) > 1:
            part, _ = write_table(part, "matches")
        found = part if found is None else found.unionByName(part)
    # a document's spans are bounded by its own words
    grown = ("aggregate(sort_array(collect_list(struct(start, stop))), cast(array() as array<struct<start: bigint, stop: bigint>>), (a, x) -> "
             "CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).stop "
             "THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, greatest(x.stop, element_at(a, -1).stop) AS stop))) "
             "ELSE concat(a, array(x)) END)")
    per = found.groupBy("segment", "doc_no").agg(F.expr(grown).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    rows = (index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc_no", "d"))
            .select("segment", "doc_no", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words")))
    return (rows.join(per, ["segment", "doc_no"], "left")
            .select("doc_id", "n_words",
                    F.expr("coalesce(aggregate(spans, 0L, (n, x) -> n + x.stop - x.start), 0L)").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans"))
