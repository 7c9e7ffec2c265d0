"""Quality classifier by co-training (operator 7).

Two views of a document: its text's content (words, their endings, repetition,
shares of character classes) and its page metadata (language, source, size, and
line layout). Each view has a logistic classifier. They start from labelled
documents and work in rounds over all others: each view gives the other the
documents that it is sure of, with its label. Both views are then calibrated on
labelled documents that neither was fitted on, combined, and score all documents.

The fit takes at most ``SAMPLE`` labelled documents, chosen by hash, of rows with the
same id the distinct ones, about ``PER_ID`` of an id and as many rows as ids in all; a third
of them calibrate. Every other document, whether labelled or not, is in the pool: its
features are written once (equal documents once), and each round scores the whole pool
in Spark. Of what a view is sure of, a share by hash, about ``POOL`` rows, is
handed to the other's fit. The last pass scores every document.

Defined results: null text is the empty text; a text without any word is no
good text: its score is 0; null metadata is a value of its own; rows with equal
ids are scored each; of repeated labels of an id the larger holds; labels that
are null or have no document are ignored; with fewer than ``LEAST`` labels of
either class nothing can be learned: every text with words keeps score 1; very
long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import WORD_NONBLANK, bounded_rows, drop_path, hash_words, row_chunks, small_batches, text_buffer, write_table
from shoal.llm.linear import fit_logistic, per_row, scaler, sigmoid

SAMPLE = 8000
POOL = 8000
ROUNDS = 4
SURE = 0.97
SHARE = 0.15
LEAST = 5
HASHED = 24
CATEGORIES = ("lang", "source")
NUMBERS = ("n_chars",)

_CLASS = np.full(256, 5, np.int64)                       # letter, upper, digit, stop mark, symbol, other
_CLASS[97:123] = 0
_CLASS[0x80:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _c in b".,;:?":
    _CLASS[_c] = 3
for _c in b"!#$%&*|@^~=+<>_\\/{}[]":
    _CLASS[_c] = 4
CLASSES = 5


def text_view(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, number of words) of rows i..j-1."""
    h, first, s, e = hash_words(data, offsets, i, j, WORD_NONBLANK)
    n = j - i
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    base, end = int(offsets[i]), int(offsets[j])
    raw, rel = data[base:end], offsets[i:j + 1] - base
    one = np.maximum(words, 1).astype(float)
    letters = np.maximum(np.diff(rel), 1).astype(float)
    out = [per_row(_CLASS[raw] == k, rel) / letters for k in range(CLASSES)]
    length = (e - s).astype(float)
    last, start = _CLASS[data[e - 1]] if len(e) else np.zeros(0, int), _CLASS[data[s]] if len(s) else np.zeros(0, int)
    out += [np.bincount(doc[last == k], minlength=n) / one for k in range(CLASSES)]
    out += [np.bincount(doc[(start == k) & (length == 1)], minlength=n) / one for k in (3, 4)]
    upper = per_row(_CLASS[raw] == 1, np.r_[s, end] - base)[:len(s)] if len(s) else np.zeros(0)
    out.append(np.bincount(doc[(length > 2) & (2 * upper > length)], minlength=n) / one)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out.append(np.bincount(doc[same], minlength=n) / one)
    order = np.lexsort((h, doc))
    hd, dd = h[order], doc[order]
    new = np.r_[True, (hd[1:] != hd[:-1]) | (dd[1:] != dd[:-1])] if len(hd) else np.zeros(0, bool)
    distinct = np.bincount(dd[new], minlength=n)
    out.append(distinct / one)
    out.append(np.log1p(distinct) / np.log1p(one))
    mean = np.bincount(doc, length, n) / one
    out += [mean, np.sqrt(np.maximum(np.bincount(doc, length * length, n) / one - mean * mean, 0))]
    return np.stack(out, axis=1), words


def meta_view(data: np.ndarray, offsets: np.ndarray, i: int, j: int, categories: list[list], numbers: list[list]) -> np.ndarray:
    """Metadata features of rows i..j-1: hashed categories, sizes, line layout."""
    n = j - i
    base, end = int(offsets[i]), int(offsets[j])
    raw, rel = data[base:end], offsets[i:j + 1] - base
    lines = per_row(raw == 10, rel) + 1.0
    size = np.diff(rel).astype(float)
    out = [np.log1p(size), np.log1p(lines), np.log1p(size / lines)]
    cut = np.unique(np.r_[rel[:-1], np.flatnonzero(raw == 10) + 1, len(raw)])
    length = np.diff(cut)
    doc = np.searchsorted(rel, cut[:-1], "right") - 1
    mean = np.bincount(doc, length, n) / lines
    out.append(np.log1p(np.sqrt(np.maximum(np.bincount(doc, length.astype(float) ** 2, n) / lines - mean * mean, 0))))
    out.append(np.bincount(doc[length < 20], minlength=n) / lines)
    for column in numbers:
        v = np.array([-1.0 if x is None or x != x else float(x) for x in column])
        out += [np.log1p(np.maximum(v, 0)), (v < 0).astype(float)]
    for column in categories:
        code = np.array([zlib.crc32(b"\0" if x is None else str(x).encode()) % HASHED for x in column], np.int64)
        hot = np.zeros((n, HASHED))
        hot[np.arange(n), code] = 1
        out += list(hot.T)
    return np.stack(out, axis=1)


class View:
    """A scaled logistic classifier and its calibration (slope and shift of the log odds)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.mean, self.scale = scaler(x)
        self.b = fit_logistic(self._scaled(x), y, weight, l2=1.0)
        self.slope, self.shift = 1.0, 0.0

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (self._scaled(x) @ self.b[:-1] + self.b[-1]) + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "View":
        self.slope, self.shift = 1.0, 0.0
        self.slope, self.shift = (float(v) for v in fit_logistic(self.odds(x)[:, None], y, l2=1e-2))
        return self


def cotrain(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pool_t, pool_m, held: np.ndarray,
            rounds: int = ROUNDS, sure: float = SURE, share: float = SHARE) -> tuple[View, View, np.ndarray, list[int]]:
    """Both views after the exchange, the weights that combine their log odds, and the pseudo-labels given per round.

    The pool is two arrays, or in place of the first a function from both views to
    the rows and labels that each is given next, and their number.
    """
    fit = ~held
    teach = pool_t if callable(pool_t) else _teacher(pool_t, pool_m, y, sure, share)
    given = [(x[:0], y[:0]) for x in (xt, xm)]                    # rows and labels that each view has been given
    views, told = [], []
    for r in range(rounds + 1):
        views = []
        for x, (gx, gy) in zip((xt, xm), given, strict=True):
            w = np.r_[np.ones(fit.sum()), np.full(len(gy), 0.5)]
            views.append(View(np.vstack([x[fit], gx]), np.r_[y[fit], gy], w).calibrate(x[held], y[held]))
        if r == rounds:
            break
        given, new = teach(views)
        if not new:
            break
        told.append(new)
    both = np.stack([v.odds(x[held]) for v, x in zip(views, (xt, xm), strict=True)], axis=1)
    return views[0], views[1], fit_logistic(np.clip(both, -20, 20), y[held], l2=1e-2), told


def _teacher(pool_t: np.ndarray, pool_m: np.ndarray, y: np.ndarray, sure: float, share: float):
    """Pseudo-labels from a pool in memory: each round the surest that have none yet."""
    pools, labels = (pool_t, pool_m), [np.full(len(pool_t), np.nan), np.full(len(pool_t), np.nan)]

    def teach(views: list) -> tuple[list, int]:
        new = 0
        for k in (0, 1) if len(pool_t) else ():
            p = sigmoid(views[k].odds(pools[k]))
            free = np.isnan(labels[1 - k])
            for label, conf in ((1.0, p), (0.0, 1 - p)):
                most = int(share * len(p) * (y.mean() if label else 1 - y.mean())) + 1
                pick = np.flatnonzero(free & (conf >= sure))
                pick = pick[np.argsort(-conf[pick], kind="stable")][:most]
                labels[1 - k][pick] = label
                new += len(pick)
        got = [~np.isnan(x) for x in labels]
        return [(pools[k][got[k]], labels[k][got[k]]) for k in (0, 1)], new
    return teach


def pool_teacher(pool: DataFrame, positive: float, most: int, sure: float = SURE):
    """Pseudo-labels from a table (row, xt, xm): both views score all of it; a share by hash of what either is sure of goes to the other.

    ``most`` rows are handed to a fit, about; ``positive`` is their share of good ones.
    """

    def teach(views: list) -> tuple[list, int]:
        def confident(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                labels = []
                for c, view in zip(("xt", "xm"), views, strict=True):
                    x = b.column(c).flatten().to_numpy().astype(float).reshape(b.num_rows, -1)
                    p = sigmoid(view.odds(x))
                    labels.append(np.where(p >= sure, 1, np.where(1 - p >= sure, 0, -1)).astype(np.int32))
                keep = pa.array((labels[0] >= 0) | (labels[1] >= 0))
                yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(x) for x in labels), b.column("xt"), b.column("xm")],
                                                 ["row", "lt", "lm", "xt", "xm"]).filter(keep)

        scored = pool.mapInArrow(confident, "row long, lt int, lm int, xt array<float>, xm array<float>")
        counts = {(r.lt, r.lm): r["count"] for r in scored.groupBy("lt", "lm").count().collect()}
        picks = []
        for k, c in enumerate(("lt", "lm")):                     # by what share the giver's documents of a label are thinned
            share = F.lit(0.0)
            for label in (0, 1):
                n = sum(v for x, v in counts.items() if x[k] == label)
                want = 1 + int(most * (positive if label else 1 - positive))
                share = F.when(F.col(c) == label, min(1.0, want / max(1, n))).otherwise(share)
            picks.append(F.pmod(F.xxhash64("row", F.lit(c)), F.lit(1 << 20)) < share * (1 << 20))
        some = scored.withColumns({"gt": picks[0], "gm": picks[1]}).filter("gt or gm").limit(4 * most).toArrow().sort_by("row").combine_chunks()
        given = []
        for taken, label, x in (("gm", "lm", "xt"), ("gt", "lt", "xm")):      # the metadata view teaches the text view, and the other way round
            part = some.filter(some.column(taken))
            wide = part.column(x).combine_chunks()
            rows = wide.flatten().to_numpy().astype(float).reshape(part.num_rows, -1) if part.num_rows else np.zeros((0, views[0 if x == "xt" else 1].b.size - 1))
            given.append((rows, part.column(label).to_numpy().astype(float)))
        return given, int(sum(v * ((x[0] >= 0) + (x[1] >= 0)) for x, v in counts.items()))
    return teach


class Quality:
    """The fitted pair of views: scores of rows."""

    def __init__(self, text: View | None, meta: View | None, weights: np.ndarray | None):
        self.text, self.meta, self.weights = text, meta, weights

    def scores(self, xt: np.ndarray, xm: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            one = (words > 0).astype(float)
            return one, one, one
        a, b = np.clip(self.text.odds(xt), -20, 20), np.clip(self.meta.odds(xm), -20, 20)
        z = np.stack([a, b], axis=1) @ self.weights[:-1] + self.weights[-1]
        return np.where(words > 0, sigmoid(z), 0.0), sigmoid(a), sigmoid(b)


def _views(b: pa.RecordBatch, nc: int, nn: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(b.column("text"))
    cats = [b.column(f"c{k}").to_pylist() for k in range(nc)]
    nums = [b.column(f"n{k}").to_pylist() for k in range(nn)]
    for i, j in row_chunks(offsets):
        xt, words = text_view(data, offsets, i, j)
        yield i, j, xt, meta_view(data, offsets, i, j, [c[i:j] for c in cats], [v[i:j] for v in nums]), words


def _inputs(id_col: str, text_col: str, categories: tuple, numbers: tuple) -> list:
    """The columns that the views read, under names of their own."""
    return [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
            *(F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(categories)),
            *(F.col(f"`{c}`").cast("double").alias(f"n{k}") for k, c in enumerate(numbers))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        categories: tuple = CATEGORIES, numbers: tuple = NUMBERS, sample: int = SAMPLE, pool: int = POOL) -> tuple[Quality, list[int]]:
    """(classifier, pseudo-labels given per round). ``sample`` bounds the labelled rows, ``pool`` the pseudo-labelled rows that a round hands to a fit."""
    small_batches(docs.sparkSession)
    slim = docs.select(*_inputs(id_col, text_col, categories, numbers))
    named = (labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("double").alias("y")).filter("lid is not null and y in (0, 1)")
             .groupBy("lid").agg(F.max("y").alias("y")))
    chosen = named.orderBy(F.xxhash64("lid"), "lid").limit(sample)
    ids = slim.join(F.broadcast(chosen), F.col("id") == F.col("lid")).drop("lid")             # at most sample ids
    rows = bounded_rows(ids, sample)                                                          # and rows
    nc, nn = len(categories), len(numbers)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xt, xm = [], []
            for _, _, t, m, _ in _views(b, nc, nn):
                xt += list(t)
                xm += list(m)
            held = [zlib.crc32(f"calibrate {x}".encode()) % 3 == 0 for x in b.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(held, pa.bool_()), pa.array(xt, pa.list_(pa.float64())), pa.array(xm, pa.list_(pa.float64()))],
                                             ["y", "held", "xt", "xm"])

    got = rows.mapInArrow(features, "y double, held boolean, xt array<double>, xm array<double>").toArrow()
    y = got.column("y").to_numpy().astype(float)
    if min((y == 0).sum(), (y == 1).sum()) < LEAST:
        return Quality(None, None, None), []
    order = np.lexsort(tuple(np.round(np.array(got.column("xm").to_pylist(), float).T[:3], 9)))    # not the order of arrival
    xt, xm = (np.array(got.column(c).to_pylist(), float)[order] for c in ("xt", "xm"))
    y, held = y[order], got.column("held").to_numpy()[order].astype(bool)
    if min(len(set(y[held])), len(set(y[~held]))) < 2:
        held = np.cumsum(np.ones(len(y))) % 2 == 0 if len(set(y[::2])) > 1 and len(set(y[1::2])) > 1 else np.zeros(len(y), bool)
        if not held.any():
            return Quality(None, None, None), []

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t, m, _ in _views(b, nc, nn):
                yield pa.RecordBatch.from_arrays([b.column("row").slice(i, j - i), *(pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())) for x in (t, m))],
                                                 ["row", "xt", "xm"])

    # everything else, once per distinct document; at most sample ids are kept out
    rest = slim.join(F.broadcast(chosen.select("lid")), F.col("id") == F.col("lid"), "left_anti")
    rest = rest.withColumn("row", F.xxhash64("text", *(c for c in slim.columns if c not in ("id", "text"))))
    others, path = write_table(rest.mapInArrow(described, "row long, xt array<float>, xm array<float>").dropDuplicates(["row"]), "pool", release=True)
    a, b, w, told = cotrain(xt, xm, y, pool_teacher(others, float(y.mean()), pool), None, held)
    drop_path(docs.sparkSession, path)
    return Quality(a, b, w), told


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          categories: tuple = CATEGORIES, numbers: tuple = NUMBERS, columns: tuple | None = None, out: str = "quality") -> DataFrame:
    """``columns`` (default: the id) of every document with struct ``out``: score, text_score, meta_score, keep."""
    model, _ = fit(docs, labels, id_col, text_col, label_col, categories, numbers)
    columns = (id_col,) if columns is None else columns
    nc, nn = len(categories), len(numbers)
    wide = docs.select(*(F.col(f"`{c}`").alias(f"out{k}") for k, c in enumerate(columns)), *_inputs(id_col, text_col, categories, numbers))
    names = [f"out{k}" for k in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [model.scores(xt, xm, words) for _, _, xt, xm, words in _views(b, nc, nn)]
            s = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(x) for x in s)], [*names, "score", "text_score", "meta_score"])

    kinds = ", ".join(f"{n} {wide.schema[n].dataType.simpleString()}" for n in names)
    found = wide.mapInArrow(run, f"{kinds}, score double, text_score double, meta_score double")
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, columns)),
                        F.struct("score", "text_score", "meta_score", (F.col("score") >= 0.5).alias("keep")).alias(out))

