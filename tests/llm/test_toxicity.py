import random

import numpy as np
from pyspark.sql import functions as F

from shoal.llm.common import crc_remainder
from shoal.llm.linear import auc
from shoal.llm.toxicity import VOTERS, LabelModel, score
from .helpers import awkward_texts, docs, prose

INVENTED = ["glorp", "snarvel", "bluzzt", "frimbo", "quaxel", "dorpin"]


def corpus(n=500, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        text, toxic = prose(rng, rng.randint(20, 80)), rng.random() < 0.2
        if toxic:
            words = text.split(" ")
            for w in rng.sample(INVENTED if k % 2 else ["idiot", "moron", "pathetic", "scum"], 3):
                words.insert(rng.randrange(len(words)), w)
            text = " ".join(words)
        rows.append((k, text))
        labels.append((k, int(toxic)))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_mined_words(spark):
    rows, labels = corpus()
    held = crc_remainder(F.col("doc_id")) == 0
    # labels of held-out rows are inverted: they must not matter
    import zlib
    wrong = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    got = {r.doc_id: r for r in score(docs(spark, rows), labelled(spark, wrong), held).collect()}
    y = np.array([t for i, t in labels if got[i].held_out])
    s = np.array([got[i].score for i, _ in labels if got[i].held_out])
    assert auc(y, s) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)


def test_awkward_rows(spark):
    _, labels = corpus(60)
    odd = [(None, 1), (20, None), (20, 1), (999999, 1), (3, 0), (3, 1)]
    rows = awkward_texts() + [(100 + i, t) for i, t in corpus(60)[0]]
    got = score(docs(spark, rows), labelled(spark, odd + [(100 + i, y) for i, y in labels]), crc_remainder(F.col("doc_id")) == 0).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    blank = {round(r.score, 12) for r in got if r.doc_id in (20, 21, 22)}
    assert len(blank) == 1


def test_without_labels_and_without_rows(spark):
    rows, _ = corpus(50)
    held = crc_remainder(F.col("doc_id")) == 0
    got = score(docs(spark, rows), labelled(spark, []), held).collect()
    assert len(got) == 50
    assert score(docs(spark, []), labelled(spark, []), held).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    n, m = 20000, len(VOTERS)
    y = rng.random(n) < 0.15
    v = np.zeros((n, m), int)
    for j in range(m - 1):
        v[:, j] = rng.random(n) < np.where(y, 0.3 + 0.05 * j, 0.01)
    v[:, 1] = np.where(rng.random(n) < 0.9, v[:, 0], v[:, 1])           # two voters that copy each other
    v[:, m - 1] = v[:, :m - 1].sum(axis=1) < 2
    p, c = np.unique(v @ (1 << np.arange(m)), return_counts=True)
    model = LabelModel(p, c, 0.15)
    assert 1 in [k for k, q in enumerate(model.parent) if q == 0] + [0 if model.parent[0] != 1 else 1]
    post = model.label(v @ (1 << np.arange(m)))
    assert ((post >= 0.5) == y).mean() > 0.95
