import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from shoal.llm import jaccard_join as J
from .helpers import awkward_texts, blank_words, docs, prose


def shingles(text, n=5):
    w = blank_words(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = defaultdict(list)
    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in index[g])
        for j, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[find(k)] = find(j)
        for g in s:
            index[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(rng, text, share):
    w = text.split(" ")
    for k in range(len(w)):
        if rng.random() < share:
            w[k] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(w)


def result(spark, rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.groups(docs(spark, rows)).collect()), key=str)


def test_awkward_rows(spark):
    assert result(spark, awkward_texts()) == brute(awkward_texts())


def test_groups_of_near_copies_and_shared_passages(spark, monkeypatch):
    # small limits, so that blocks, large tiles and their bounds are all in use
    for name, value in (("SMALL", 2), ("BIG", 6), ("BLOCK_SHINGLES", 900), ("TILE_ROWS", 8), ("SAMPLE_SHARE", 2), ("FREQUENT", 50)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(11)
    rows, k = [], 0
    for size, words in ((40, 150), (12, 60), (3, 20), (2, 7)):
        base = prose(rng, words, 3000)
        for _ in range(size):
            rows.append((k, edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.05]))))
            k += 1
    passage = prose(rng, 40, 3000)
    for _ in range(60):
        rows.append((k, prose(rng, rng.randint(5, 120), 3000) + " " + passage))
        k += 1
    for _ in range(30):                                    # the passage and little else: borderline links
        rows.append((k, passage + " " + prose(rng, rng.randint(1, 14), 3000)))
        k += 1
    rng.shuffle(rows)
    rows += [rows[0], (None, rows[1][1])]
    assert result(spark, rows) == brute(rows)


def test_given_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.groups(d).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert J.groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_bounds_are_from_above(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2 ** 63, 2000, dtype=np.uint64)
    a, b = (np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in "ab")
    both = len(np.intersect1d(a, b))
    bound = J.overlap_bound(np.array([len(a)]), np.array([len(b)]), [J.signature(a).view(np.uint64)], [J.signature(b).view(np.uint64)])
    assert bound[0] >= both
    if 100 * both >= 75 * (len(a) + len(b) - both):
        keys = [set(x[:len(x) // 4 + 1].tolist()) for x in (a, b)]
        assert len(keys[0] & keys[1]) >= J.could_share(np.array([len(a)]), np.array([len(b)]))[0]
