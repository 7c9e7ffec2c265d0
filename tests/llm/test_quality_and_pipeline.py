import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from shoal.llm.cotrain_quality import cotrain, score
from shoal.llm.linear import auc
from .helpers import CLASHES, alnum_words, awkward_texts, docs, prose
from .test_jaccard_join import shingles


def noisy(rng, n):
    kind = rng.randrange(3)
    words = prose(rng, n).split(" ")
    if kind == 0:
        return " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in words)
    if kind == 1:
        return "!! ".join(w.upper() for w in words)
    return " ".join(w for w in words[:max(2, n // 12)] for _ in range(12))


def corpus(n=400, seed=9):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.2
        size = rng.randint(25, 120)
        rows.append((k, noisy(rng, size) if bad else prose(rng, size, 5000)))
        labels.append((k, int(not bad), 0))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    rows, labels = corpus()
    known = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]
    got = {r.doc_id: r.quality for r in score(docs(spark, rows), labelled(spark, known)).collect()}
    test = [(y, got[i].score) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    y, s = (np.array(x) for x in zip(*test))
    assert auc(y, s) > 0.98 and ((s >= 0.5) == (y == 1)).mean() > 0.95
    assert all(q.keep == (q.score >= 0.5) and 0 <= q.text_score <= 1 and 0 <= q.meta_score <= 1 for q in got.values())


def test_quality_awkward_rows(spark):
    rows, labels = corpus(120)
    rows = [(100 + i, t) for i, t in rows] + awkward_texts()
    labels = [(100 + i, q, t) for i, q, t in labels] + [(None, 1, 0), (20, None, 0), (9999, 1, 0), (3, 1, 0), (3, 0, 0)]
    got = score(docs(spark, rows), labelled(spark, labels)).collect()
    assert len(got) == len(rows)
    assert all(r.quality.score == 0 and not r.quality.keep for r in got if r.doc_id in (20, 21, 22))
    none = score(docs(spark, rows), labelled(spark, [])).collect()
    assert all(r.quality.keep == (r.doc_id not in (20, 21, 22)) for r in none if r.doc_id is not None)
    assert score(docs(spark, []), labelled(spark, labels)).count() == 0


def test_views_teach_each_other():
    """With few labels the weak view gains from the strong one's pseudo-labels."""
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.7
    a = np.where(y, 1.5, -1.5)[:, None] + rng.normal(size=(3000, 3))
    b = np.where(y, 0.6, -0.6)[:, None] + rng.normal(size=(3000, 8))
    few = slice(0, 60)
    held = np.arange(60) % 3 == 0
    text, meta, _, told = cotrain(a[few], b[few], y[few].astype(float), a[60:1500], b[60:1500], held)
    _, alone, _, _ = cotrain(a[few], b[few], y[few].astype(float), a[:0], b[:0], held)
    assert sum(told) > 100
    late = slice(1500, 3000)
    assert auc(y[late].astype(int), meta.odds(b[late])) > auc(y[late].astype(int), alone.odds(b[late]))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """All stages over a planted corpus: the rows after each."""
    folder = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(1)
    rows, labels = corpus(260)
    item = prose(rng, 14, 300)
    passage = "\n".join(f"shared{k} " + " ".join(f"w{rng.randrange(5000)}" for _ in range(9)) for k in range(12))
    good = prose(rng, 100, 4000).replace("\n", " ")
    rows += [(500, good), (501, good + " one"), (502, good + " two more"), (503, f"Clean start {good[:90]} {item} and end of it")]
    rows += [(510 + k, prose(rng, 60, 5000) + "\n" + passage + "\n" + prose(rng, 60, 5000)) for k in range(5)]
    rows += [(520, prose(rng, 9000, 20000)), (521, None), (522, ""), (None, prose(rng, 50, 5000)), (523, rows[5][1]), (500, good)]
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labelled(spark, labels).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, out = spark.read.parquet(f"{folder}/documents.parquet"), [("documents", rows)]
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, at, folder)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES], name
        got.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        out.append((name, [(r.doc_id, r.text) for r in at.collect()]))
    return folder, out, P.pack(spark, at, folder).collect(), item


def test_stage_by_stage(stages):
    _, out, packed, item = stages
    rows = dict(out)
    kept = {i for i, _ in rows["quality"]}
    assert {500, 501, 502, 503, 520, None} <= kept and not {521, 522} & kept
    bad = [i for i, t in rows["documents"] if i is not None and i < 260 and t and ("###" in t or "!! " in t)]
    assert len(set(bad) & kept) <= 0.05 * len(bad)
    assert sum("shared6 " in t for _, t in rows["quality"]) >= 4
    assert sum("shared6 " in t for _, t in rows["line_dedup"]) == 1
    near = [i for i, _ in rows["near_dups"]]
    assert near.count(500) == 1 and not {501, 502} & set(near)
    sets = [shingles(t) for _, t in rows["near_dups"]]
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            assert not sets[a] or 100 * both < 75 * (len(sets[a]) + len(sets[b]) - both)
    gone = {i for i, _ in rows["near_dups"]} - {i for i, _ in rows["decontaminate"]}
    w = alnum_words(item)
    spoiled = {i for i, t in rows["near_dups"] if any(" ".join(w[s:s + 10]) in " ".join(alnum_words(t)) for s in range(len(w) - 9))}
    assert gone == spoiled and 503 in gone
    assert {r.doc_id for r in packed} == {i for i, _ in rows["decontaminate"]}


def test_run_equals_the_stages(spark, stages):
    folder, _, packed, _ = stages
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, P.run(spark, folder).collect())) == sorted(map(key, packed))


def test_empty_documents(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_rows_of_a_hot_id_do_not_fill_the_fit(spark, monkeypatch):
    from pyspark.sql import functions as F
    from shoal.llm import cotrain_quality, toxicity
    rows, labels = corpus(60)
    rows += [(7, rows[7][1])] * 400 + [(7, f"text {k} of the hot id") for k in range(400)]
    sizes = []
    monkeypatch.setattr(cotrain_quality, "cotrain", lambda xt, xm, y, pt, pm, held: sizes.append(len(y)) or (None, None, None, []))
    cotrain_quality.fit(docs(spark, rows), labelled(spark, labels), sample=500, pool=500)
    assert 60 <= sizes[0] <= 59 + 2 * 64
    named = docs(spark, rows).select("doc_id", "text")
    sets, y, _ = toxicity._sample(named, labelled(spark, labels), F.lit(True), "doc_id", "quality", 500, (np.zeros(0, np.uint64),) * 2)
    assert 60 <= len(sets) == len(y) <= 59 + 2 * 64
    few, _, _ = toxicity._sample(named, labelled(spark, labels), F.lit(True), "doc_id", "quality", 60, (np.zeros(0, np.uint64),) * 2)
    assert len(few) <= 90                                  # 60 ids of 860 rows


def test_rounds_score_the_whole_pool_and_hand_over_a_bounded_share(spark):
    from shoal.llm.common import small_batches
    from shoal.llm.cotrain_quality import View, pool_teacher
    from shoal.llm.linear import sigmoid
    small_batches(spark)
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.6).astype(float)
    xt, xm = (np.where(y > 0, m, -m)[:, None] + rng.normal(size=(400, k)) for m, k in ((1.5, 3), (0.8, 5)))
    views = [View(x, y, np.ones(400)) for x in (xt, xm)]
    z = rng.random(5000) < 0.6
    pt, pm = ((np.where(z, m, -m)[:, None] + rng.normal(size=(5000, k))).astype(np.float32) for m, k in ((1.5, 3), (0.8, 5)))
    pool = spark.createDataFrame([(k, pt[k].tolist(), pm[k].tolist()) for k in range(5000)], "row long, xt array<float>, xm array<float>").repartition(4)
    given, told = pool_teacher(pool, 0.6, 300, sure=0.9)(views)
    odds = [v.odds(x.astype(float)) for v, x in zip(views, (pt, pm), strict=True)]
    sure = [(sigmoid(o) >= 0.9) | (1 - sigmoid(o) >= 0.9) for o in odds]
    assert told == sum(int(s.sum()) for s in sure)                       # all 5,000 were scored
    for (rows, labels), giver, x in zip(given, (1, 0), (pt, pm), strict=True):
        assert 200 <= len(rows) <= 400 and rows.shape[1] == x.shape[1]  # about 300 are handed over
        place = {tuple(np.round(r, 4)): k for k, r in enumerate(x.astype(float))}
        at = [place[tuple(np.round(r, 4))] for r in rows]
        assert all(sure[giver][k] and labels[i] == (odds[giver][k] > 0) for i, k in enumerate(at))
        assert 0.4 <= labels.mean() <= 0.75
    again, _ = pool_teacher(pool.repartition(7), 0.6, 300, sure=0.9)(views)
    assert all((a[0] == b[0]).all() for a, b in zip(given, again, strict=True))      # the same rows whatever the partitions
    none, told = pool_teacher(pool.limit(0), 0.6, 300)(views)
    assert told == 0 and [x.shape for x, _ in none] == [(0, 3), (0, 5)]
