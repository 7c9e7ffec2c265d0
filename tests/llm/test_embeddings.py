import numpy as np

from shoal.llm.embedding_neardup import codes, hadamard, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, node long, v string, m int, codes string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "v", 2, "c") for i, v, y in rows], SCHEMA)


def near(rng, x, c):
    z = rng.normal(size=len(x))
    z -= (z @ x) * x / (x @ x)
    return c * x / np.linalg.norm(x) + np.sqrt(1 - c * c) * z / np.linalg.norm(z)


def brute(rows, cosine=0.98):
    ok = [k for k, (i, v, y) in enumerate(rows) if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, root = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (_, x, p), (_, y, q) = rows[ok[a]], rows[ok[b]]
            x, y = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
            if p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[ok[a]] += 1
                links[ok[b]] += 1
                root[find(ok[a])] = find(ok[b])
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return {k: (links[k], least.get(find(k))) for k in links}


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vs = []
    for _ in range(60):
        x = rng.normal(size=48)
        y = int(rng.integers(0, 2))
        vs += [(x, y), *((near(rng, x, c), y) for c in rng.uniform(0.97, 0.9999, rng.integers(0, 4)))]
    hot = rng.normal(size=48)
    vs += [(hot, 1)] * 30 + [(near(rng, hot, rng.uniform(0.985, 0.9999)), 1) for _ in range(120)] + [(hot, 0), (hot * 3, 1)]
    rows = [(k, [float(np.float32(a)) for a in v], y) for k, (v, y) in enumerate(vs)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 48, 1), (n + 3, [float("nan")] * 48, 1), (n + 4, [float("inf")] + [1.0] * 47, 1),
             (n + 5, [None] + [1.0] * 47, 1), (n + 6, rows[0][1], None), (n + 7, [1.0, 2.0], 1), (n + 8, [1.0, 2.0], 1), (None, rows[0][1], rows[0][2]),
             (n + 9, [3.0], 0), (n + 10, [5.0], 0), (n + 11, [1e-30] * 48, 1), (n + 12, [1e30] * 48, 1)]
    want = brute(rows)
    got = near_duplicates(table(spark, rows), block=32).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    found = sum(r.n_links for r in got)
    assert found <= sum(w[0] for w in want.values())
    assert found >= 0.97 * sum(w[0] for w in want.values())
    for k, (i, v, y) in enumerate(rows):
        assert by[i].n_links <= want[k][0]
        if want[k][0] == 0 and i is not None:
            assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert sum(by[i].component_id == want[k][1] for k, (i, _, _) in enumerate(rows)) >= 0.97 * len(rows)
    assert by[n + 7].n_links == 1 and by[n + 8].component_id == n + 7


def test_rotation_keeps_length_and_codes_repeat():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert (codes(x, 2) == codes(x, 2)).all() and codes(x, 2).shape == (5, 4, 3)


def test_empty_table(spark):
    assert near_duplicates(table(spark, [])).count() == 0
