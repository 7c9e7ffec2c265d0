import hashlib
import random

import pytest

from shoal.llm import decontaminate as D
from shoal.llm.queries import op9_decontamination
from .helpers import alnum_words, awkward_texts, docs, prose


def brute(rows, items, window=10):
    wins = {}
    for i, t in items:
        w = alnum_words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[s:s + window]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, found = alnum_words(t), set()
        hit = [False] * len(w)
        for size in {len(x) for x in wins}:
            for s in range(len(w) - size + 1):
                if (got := wins.get(tuple(w[s:s + size]))):
                    found |= got
                    hit[s:s + size] = [True] * size
        out.append((i, len(w), sum(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def result(spark, rows, items, **kw):
    bench = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, segment string")
    got = D.decontaminate(docs(spark, rows), bench, **kw).collect()
    for r in got:
        assert sum(s.stop - s.start for s in r.spans or []) == r.n_hit
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str)


def planted():
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(11, 30), 200)) for k in range(12)]
    items += [(50, "a b c"), (51, None), (52, "..."), (53, "w1 " * 12), (54, prose(rng, 10, 200)), (7, items[3][1]), (None, items[4][1])]
    rows = [(i, t) for i, t in awkward_texts() if i != 33]
    for k in range(40):
        parts = [prose(rng, rng.randint(0, 30), 200)]
        for _ in range(rng.randint(0, 3)):
            w = (items[rng.randrange(len(items))][1] or "").split(" ")
            cut = rng.randint(0, 3)
            parts += [" ".join(w[cut:]).upper() if k % 2 else ", ".join(w[cut:]), prose(rng, rng.randint(0, 5), 200)]
        rows.append((200 + k, " ".join(parts)))
    rows += [(300, "A, b? C! and w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (301, "a b"), (302, "c a b c a b c"), (303, "naïve")]
    return rows, items


@pytest.mark.parametrize("sizes", [{}, {"SEGMENT_BYTES": 200, "BLOCK_WORDS": 60, "CANDIDATES": 7}, {"VOCABULARY": 5, "BLOCK_WORDS": 100}])
def test_against_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(D, k, v)
    rows, items = planted()
    assert result(spark, rows, items) == brute(rows, items)


def test_empty_tables(spark):
    rows, items = planted()
    assert result(spark, [], items) == []
    assert result(spark, rows, []) == brute(rows, [])


def test_proximity(spark):
    items = [(1, "one two three four five six seven eight nine ten")]
    rows = [(1, "one two three four five six seven eight nine ten"), (2, "one two three four big five six seven eight nine ten"),
            (3, "one two three four five six seven eight nine"), (4, "ten nine eight seven six five four three two one")]
    assert [r[2] > 0 for r in result(spark, rows, items)] == [True, False, False, False]
    assert [r[2] > 0 for r in result(spark, rows, items, slop=1)] == [True, True, False, False]


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [(i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in brute(rows, items)]
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op9_decontamination(spark, sf).collect()]
    assert sorted(got) == sorted(want)
