"""Operators on tiny inputs, checked against plain-Python brute force:
join strategies (C1-C3), outer join with predicate in ON (C5), windows (E2, E3, E5, E6),
key arithmetic (H13-H15, H22), dates (H19, H20), rounding (H12), refresh (G2, G3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shoal.functions import dates as D
from shoal.functions import keys as K
from shoal.functions import money
from shoal.operators import joins, refresh, windows
from shoal.plans import tpch
from shoal.sources import fixtures
from conftest import SF_SMALL


@pytest.mark.parametrize("strategy", ["auto", "sort_merge", "shuffle_hash", "broadcast"])
def test_join_strategies_return_same_rows(spark, strategy):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    base = tpch.join_orders_lineitem(o, li, "sort_merge")
    other = tpch.join_orders_lineitem(o, li, strategy)
    assert other.count() == base.count() == li.join(o, li.l_orderkey == o.o_orderkey).count()
    assert other.exceptAll(base).count() == 0


def test_broadcast_only_below_the_size_threshold(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(1000).withColumnRenamed("id", "j")
    ok = joins.equi_join(small, big, "k", "j", "broadcast")
    assert "BroadcastHashJoin" in joins.physical_plan(ok, "simple")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.physical_plan(joins.equi_join(small, big, "k", "j", "broadcast"), "simple")
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_join_has_no_exchange_and_the_given_rows(spark):
    """Filters that differ only in a literal with '#', and a source written again, each give a plain join's rows."""
    from shoal.operators.joins import bucketed_join, write_bucketed
    p = fixtures.part(spark, SF_SMALL)
    li = fixtures.lineitem(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_bucketed(li, "t_bk_li", "l_partkey", 4)
        brands = [r.p_brand for r in p.select("p_brand").distinct().orderBy("p_brand").limit(2).collect()]
        for brand in brands:
            side = p.filter(F.col("p_brand") == brand)
            write_bucketed(side, "t_bk_part", "p_partkey", 4)
            j = bucketed_join(spark, "t_bk_part", "t_bk_li", "p_partkey", "l_partkey")
            plain = side.join(li, side.p_partkey == li.l_partkey)
            assert joins.count_exchanges(j) == 0
            assert j.count() == plain.count() and j.exceptAll(plain).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_outer_join_keeps_predicate_in_on(spark):
    c = spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long")
    o = spark.createDataFrame([(10, 1, "special requests"), (11, 1, "plain"), (12, 2, "special x requests")],
                              "o_orderkey long, o_custkey long, o_comment string")
    t = {"customer": c, "orders": o}
    got = {(r.ordercount, r.custdist) for r in tpch.customer_distribution(t).collect()}
    # customer 1 keeps one order, 2 and 3 have none left but still count (with 0)
    assert got == {(1, 1), (0, 2)}
    assert got == {(r.ordercount, r.custdist) for r in tpch.customer_distribution_join_first(t).collect()}


@pytest.mark.parametrize("n_rows,chunks", [(10, 3), (7, 7), (11, 4), (5, 8)])
def test_chunks_and_segments_match_brute_force(spark, n_rows, chunks):
    df = spark.createDataFrame([(k * 3 + 1,) for k in range(n_rows)], "k long").repartition(3)
    got = {r.k: r.chunk for r in windows.assign_chunks(df, ["k"], chunks).collect()}
    per = max(n_rows // chunks, 1)
    want = {k * 3 + 1: min(k // per + 1, chunks) for k in range(n_rows)}
    assert got == want
    seg = {r.k: r.segment for r in windows.assign_segments(df, ["k"], chunks, "insert").collect()}
    q, r = divmod(n_rows, chunks)
    sizes = [q + 1] * r + [q] * (chunks - r)
    want_seg, pos = {}, 0
    for s, size in enumerate(sizes, start=1):
        for _ in range(size):
            want_seg[pos * 3 + 1] = s
            pos += 1
    assert seg == want_seg
    dseg = {r.k: r.segment for r in windows.assign_segments(df, ["k"], chunks, "delete").collect()}
    assert dseg == {k * 3 + 1: k // (n_rows // chunks + 1) + 1 for k in range(n_rows)}


def test_global_row_number_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 7, numPartitions=5).withColumnRenamed("id", "k")
    rows = sorted((r.rn, r.k) for r in windows.global_row_number(df, ["k"]).collect())
    assert [rn for rn, _ in rows] == list(range(1, len(rows) + 1))
    assert [k for _, k in rows] == list(range(0, 1000, 7))


def test_head_per_group_limits_before_shuffle(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(3)], "g string, v int")
    out = windows.head_per_group(df, ["g"], ["v"], 2)
    assert sorted((r.g, r.v) for r in out.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert "WindowGroupLimit" in joins.physical_plan(out, "simple")


def test_last_row_and_cumulative_weights(spark):
    df = spark.createDataFrame([(1, 2, "x"), (3, 1, "y"), (3, 0, "z")], "a int, b int, c string")
    assert windows.last_row(df, ["a", "b"]).collect()[0].c == "y"
    dist = spark.createDataFrame([("d", 1, "p", 3), ("d", 2, "q", 1), ("e", 1, "r", 5)],
                                 "dist string, pos int, text string, weight long")
    got = {(r.dist, r.text): r.cum for r in windows.cumulative_weights(dist).collect()}
    assert got == {("d", "p"): 3, ("d", "q"): 4, ("e", "r"): 5}


def test_key_arithmetic(spark):
    row = spark.range(1).select(
        K.sparse_key(F.lit(7)).alias("s7"), K.sparse_key(F.lit(8)).alias("s8"),
        K.sparse_key(F.lit(8), 1).alias("s8_1"), K.dense_key(K.sparse_key(F.lit(12345), 2)).alias("back"),
        K.sparse_seq(K.sparse_key(F.lit(12345), 2)).alias("seq"),
        K.retail_price_cents(F.lit(1)).alias("rp1"), K.retail_price(F.lit(1000)).alias("rp1000"),
        K.partsupp_bridge(F.lit(1), F.lit(0), F.lit(100)).alias("ps"),
        K.active_customer(F.lit(3), F.lit(10)).alias("c3"), K.active_customer(F.lit(9), F.lit(9)).alias("c9"),
        K.active_customer(F.lit(4), F.lit(10)).alias("c4"),
        money.charged_cents(F.lit(10000), F.lit(5), F.lit(8)).alias("charge"),
    ).collect()[0]
    assert (row.s7, row.s8, row.s8_1) == (7, 32, 40)
    assert (row.back, row.seq) == (12345, 2)
    assert row.rp1 == 90000 + 0 + 100 and str(row.rp1000) == "901.00"
    assert row.ps == (1 + 0) % 100 + 1
    assert (row.c3, row.c9, row.c4) == (4, 8, 4)
    assert row.charge == (10000 * 95 // 100) * 108 // 100


def test_dates_and_rounding(spark):
    d = F.lit(dt.date(1995, 6, 17))
    row = spark.range(1).select(D.julian(d).alias("j"), D.unjulian(F.lit(95168)).alias("u"),
                                D.day_to_date(F.lit(1)).alias("first"), *D.date_parts(F.lit(dt.date(1992, 1, 1))),
                                F.bround(F.lit(0.03125), 4).alias("even"),
                                F.bround(F.lit(2.5), 0).alias("half")).collect()[0]
    assert row.j == 95168 and row.u == dt.date(1995, 6, 17) and row.first == dt.date(1992, 1, 1)
    assert (row.t_timekey, row.t_alpha, row.t_year, row.t_month, row.t_week, row.t_day) == \
        (8036, "1992-01-01", 1992, 265, 1, 1)
    assert row.even == round(0.03125, 4) and row.half == 2.0


def test_refresh_insert_and_delete(spark):
    o = fixtures.orders(spark, SF_SMALL)
    li = fixtures.lineitem(spark, SF_SMALL)
    base_o, base_li = refresh.sparse_form(o, "o_orderkey"), refresh.sparse_form(li, "l_orderkey")
    gone = refresh.sparse_form(refresh.delete_keys(o, residue=3), "o_orderkey")
    sets = [(refresh.insert_orders(o), refresh.insert_lineitem(li), gone)]
    new_o, new_li = refresh.apply_refresh_sets(base_o, base_li, sets, checkpoint_every=1)
    assert new_o.count() == o.count() + refresh.insert_orders(o).count() - gone.count()
    assert new_o.select("o_orderkey").distinct().count() == new_o.count()
    assert new_li.join(gone, F.col("l_orderkey") == F.col("o_orderkey")).count() == 0


def test_insert_keys_are_never_base_keys(spark):
    """Two million dense orders: no inserted key is one of theirs, at any sequence number."""
    base = spark.range(2_000_000).withColumnRenamed("id", "o_orderkey")
    keys = refresh.sparse_form(base, "o_orderkey")
    assert keys.distinct().count() == 2_000_000
    for seq in (1, 2, 3):
        assert refresh.insert_orders(base, modulus=7, seq=seq).join(keys, "o_orderkey", "left_semi").count() == 0


def test_weighted_pick_of_long_lists(spark):
    """A list of more entries than ranges, zero weights among them: each draw finds its one entry."""
    from shoal.functions.draws import weighted_pick
    rows, cum = [], 0
    for k in range(3000):
        cum += k % 4
        rows.append((f"t{k}", k % 4, cum))
    dist = spark.createDataFrame(rows, "text string, weight long, cum long")
    got = weighted_pick(spark.range(1, cum + 1).withColumnRenamed("id", "draw"), "draw", dist, F.lit(cum)).collect()
    want = [f"t{k}" for k in range(3000) for _ in range(k % 4)]
    assert [r.picked for r in sorted(got, key=lambda r: r.draw)] == want


def test_exact_quantiles_match_percentile_on_a_hot_group(spark):
    import numpy as np
    # group "a" holds most rows (a hot key); values repeat, ties broken by id
    rows = [("a", float(i % 37), i) for i in range(300)] + [("b", float(i), 1000 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: r for r in windows.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in ("a", "b"):
        vals = [v for gg, v, _ in rows if gg == g]
        for p in probs:
            assert got[g][f"p{int(round(p * 100))}"] == pytest.approx(np.quantile(vals, p))
        assert got[g].n == len(vals)


def test_embed_and_cents(spark):
    from shoal.functions import text
    row = spark.range(1).select(
        text.embed(F.lit("xxxxxxxxxx"), F.lit("WORD"), 5, F.lit(7)).alias("e"),
        money.cents_to_decimal(F.lit(-12345)).alias("neg"),
        money.cents_to_decimal(F.lit(5)).alias("small")).collect()[0]
    assert len(row.e) == 10 and "WORD" in row.e
    assert str(row.neg) == "-123.45" and str(row.small) == "0.05"
