"""Query parameters (M1-M4, M6)."""

from shoal.plans import params as P, tpch
from shoal.sources import fixtures
from conftest import SF_SMALL


def test_defaults_table(spark):
    d = {(r.query, r.n): r.value for r in P.default_params(spark).collect()}
    assert d[(1, 1)] == "90" and d[(8, 3)] == "ECONOMY ANODIZED STEEL" and d[(16, 10)] == "9"
    assert len({q for q, _ in d}) == 22


def test_stream_order_is_a_permutation(spark):
    rows = P.stream_order(spark, 5).collect()
    by_stream = {}
    for r in rows:
        by_stream.setdefault(r.stream, []).append((r.pos, r.query))
    assert [q for _, q in sorted(by_stream[0])] == list(range(1, 23))
    for s, lst in by_stream.items():
        assert sorted(q for _, q in lst) == list(range(1, 23))
    assert [q for _, q in sorted(by_stream[1])] != list(range(1, 23))


def test_draws_respect_domains_and_bind(spark):
    t = fixtures.tables(spark, SF_SMALL)
    draws = {(r.stream, r.query, r.n): r.value for r in P.draw_params(t, streams=3).collect()}
    for s in range(3):
        assert 60 <= int(draws[(s, 1, 1)]) <= 120
        assert draws[(s, 7, 1)] != draws[(s, 7, 2)]                  # two different nations
        assert draws[(s, 12, 1)] != draws[(s, 12, 2)]                # two different ship modes
        sizes = [int(draws[(s, 16, n)]) for n in range(3, 11)]
        assert len(set(sizes)) == 8 and all(1 <= x <= 50 for x in sizes)
        codes = [int(draws[(s, 22, n)]) for n in range(1, 8)]
        assert len(set(codes)) == 7 and all(10 <= x <= 34 for x in codes)
        assert draws[(s, 13, 1)] in ("special", "pending", "unusual", "express")
    # a drawn Q12 parameter set binds into the SQL text and runs (M3)
    fixtures.register(spark, SF_SMALL)
    out = tpch.run_sql(spark, "q12a", mode1=draws[(0, 12, 1)], mode2=draws[(0, 12, 2)],
                       start=draws[(0, 12, 3)])
    assert out.count() >= 0
    log = P.param_log(P.draw_params(t, streams=1)).filter("query = 16").collect()[0].line
    assert log.split("\t")[0] == "16" and len(log.split("\t")) == 11
