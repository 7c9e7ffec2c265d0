import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.llm import katz_lm as K
from shoal.llm.common import crc_remainder
from .helpers import awkward_texts, blank_words, docs


class Brute:
    """The model of the module text, with dictionaries."""

    def __init__(self, texts):
        self.c1, self.c2 = Counter(), Counter()
        for w in texts:
            self.c1.update(w)
            self.c2.update(zip([None, *w[:-1]], w))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.d1, self.d2 = (K.discounts(np.array([Counter(c.values())[k] for k in range(1, 7)], float)) for c in (self.c1, self.c2))
        left = sum((1 - self.d(self.d1, c)) * c for c in self.c1.values()) if self.n else 1.0
        self.over = self.n if left > 0 else self.n + 1
        self.unseen = (left if left > 0 else 1.0) / max(1, self.over)
        self.ctx, self.left, self.seen = Counter(), Counter(), Counter()
        for (v, w), c in self.c2.items():
            self.ctx[v] += c
            self.left[v] += (1 - self.d(self.d2, c)) * c
            self.seen[v] += self.p1(w)

    @staticmethod
    def d(table, c):
        return table[c - 1] if c <= K.GT_MAX else 1.0

    def p1(self, w):
        c = self.c1.get(w, 0)
        return self.d(self.d1, c) * c / self.over if c else self.unseen

    def p(self, w, v):
        if v not in self.ctx:
            return self.p1(w)
        none = self.left[v] <= 0
        over, left = self.ctx[v] + none, 1.0 if none else self.left[v]
        c = self.c2.get((v, w), 0)
        return self.d(self.d2, c) * c / over if c else left / over / (1 - self.seen[v]) * self.p1(w)

    def row(self, w):
        base = sum(math.log10((self.c1.get(x, 0) + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        return len(w), sum(x in self.c1 for x in w), self.n, base, sum(math.log10(self.p(x, v)) for v, x in zip([None, *w[:-1]], w))


def tokens(text):
    return [*blank_words(text), "</s> "]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def check(spark, rows):
    model = Brute([tokens(t) for i, t in rows if not held(i)])
    want = sorted(((str(i), held(i), *model.row(tokens(t))) for i, t in rows))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                 for r in K.score_documents(docs(spark, rows), crc_remainder(F.col("doc_id")) == 1).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    return model


@pytest.mark.parametrize("sizes", [{}, {"KNOWN": 40, "HEAVY": 60, "PART_TOKENS": 900, "CHUNK": 3000}])
def test_against_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(K, k, v)
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id + 100, r.text) for r in sf.select("doc_id", "text").limit(60).collect()] + [(i, t) for i, t in awkward_texts() if i != 33]
    model = check(spark, rows)
    for v in [None, *list(model.ctx)[:6], "never seen"]:
        assert abs(sum(model.p(w, v) for w in model.c1) + model.p("unseen word", v) - 1) < 1e-9


def test_one_text_repeated_and_no_training_texts(spark):
    rows = [(i, "a b a b a b") for i in range(40)]
    check(spark, rows)
    only = [(i, "x y z") for i in range(60) if held(i)]
    got = K.score_documents(docs(spark, only), crc_remainder(F.col("doc_id")) == 1).collect()
    assert len(got) == len(only) and all((r.train_tokens, r.n_known, r.score) == (0, 0, 0) for r in got)


def test_empty_table(spark):
    assert K.score_documents(docs(spark, []), crc_remainder(F.col("doc_id")) == 1).count() == 0


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    cols = [rng.integers(0, 2 ** 63, 1000, dtype=np.uint64), rng.integers(0, 9, 1000, dtype=np.uint32), rng.random(1000)]
    assert all((a == b).all() for a, b in zip(cols, K.unpack(K.pack(*cols), "u8", "u4", "f8")))
    assert [len(x) for x in K.unpack(K.pack(cols[0][:0]), "u8")] == [0]


def test_counts_beyond_32_bits():
    import numpy as np
    from shoal.llm import katz_lm as K
    v, w = np.array([1, 1, 2], np.uint64), np.array([5, 5, 5], np.uint64)
    v, w, c = K.summed(v, w, np.array([3_000_000_000, 3_000_000_000, 7], np.uint32))
    assert c.tolist() == [6_000_000_000, 7]
    small = K.narrow(np.array([1, 2]))
    back = K.unpack(K.pack(v, w, c, small), "u8", "u8", "u4", "u4")
    assert [x.tolist() for x in back] == [[1, 2], [5, 5], [6_000_000_000, 7], [1, 2]] and small.dtype == np.uint32
    assert K.unpack(K.pack(v[:0], w[:0], small[:0]), *K.PAIR)[2].tolist() == []
