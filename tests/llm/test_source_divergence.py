"""Source divergence against a plain count in Python, with small limits so that blocks, tiles and partitions are crossed."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from shoal.llm.source_divergence import audit
from tests.llm.helpers import CLASHES, LOWER

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "lang", "source", *CLASHES)])


def brute(rows, min_docs, top=10):
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for text, lang, source in rows:
        lang, words = lang or "", TERM.findall((text or "").translate(LOWER))
        groups[lang][source or ""].update(words)
        n[lang].update(words)
        df[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        v, total = len(kept), sum(n[lang][t] for t in kept)
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept} for s, c in sources.items()} if v else {s: {} for s in sources}
        q = {t: 1 + 10**9 * (n[lang][t] + 2) // (total + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted(((-f(p[s][t], q[t]), t.encode(), t) for t in kept if sources[s][t] and p[s][t] > q[t]))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, *(f"{c}!" for c in CLASHES)) for r in rows], SCHEMA)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}é" if a < "d" else f"{a}{b}" for a in "abcdefgh" for b in "ijklmnopqrstuvwxyz"]
    rows = []
    for k in range(160):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["hot"] * 4 + [f"s{x}" for x in range(7)] + [None])
        words = [vocabulary[int(rng.random() ** 3 * len(vocabulary))] for _ in range(rng.randint(0, 60))]
        rows.append((" ".join(w.title() if rng.random() < 0.2 else w for w in words) + rng.choice(["", ".", " 12 x_y"]), lang, source))
    rows += [(None, "en", "quiet"), ("", "de", "alone"), ("1 2 3", "xx", "a"), ("rare words only", "xx", "b"), ("x" * 5000 + " ai", "en", "hot")]
    rows += [rows[0]] * 5 + [("ai " * 20000, "en", "s1")]
    return rows


@pytest.mark.parametrize("tile, min_docs", [(32, 10), (2, 3), (3, 1)])
def test_equals_plain_counts(spark, tile, min_docs):
    rows = corpus()
    got = audit(table(spark, rows).repartition(5), tile=tile, min_docs=min_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, min_docs)


def test_empty_table(spark):
    assert audit(table(spark, [])).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    from shoal.llm.source_divergence import share
    n, total, kept = 9_000_000_000_123_456, 9_100_000_000_123_456, 70_000_000_001
    got = spark.range(1).select(share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)
