"""Runs of refresh sets: net change against the loop; a stored table rewritten by key range."""

import os

import pytest
from pyspark.sql import functions as F

from shoal.operators import refresh

SETS = 50


@pytest.fixture(scope="module")
def base(spark):
    return spark.range(600).select(F.col("id").alias("o_orderkey"), (F.col("id") * 3).alias("v")).cache()


def test_net_change_equals_the_loop(spark, base):
    ins, dels = refresh.run_of_sets(base, "o_orderkey", SETS)
    net = refresh.apply_net(base, *refresh.net_change(ins, dels, "o_orderkey"), "o_orderkey")
    rows = [(r.o_orderkey, r.v) for r in base.collect()]
    inserts, deletes = ins.collect(), dels.collect()
    back = 0
    for s in range(1, SETS + 1):
        added = [(r.o_orderkey, r.v) for r in inserts if r.refresh_set == s]
        gone = {r.o_orderkey for r in deletes if r.refresh_set == s}
        back += len(added)
        rows = [r for r in rows + added if r[0] not in gone]
    assert back > 300 and sorted((r.o_orderkey, r.v) for r in net.collect()) == sorted(rows)


def test_loop_of_dataframes_gives_the_same(spark, base):
    ins, dels = refresh.run_of_sets(base, "o_orderkey", 12, back=3, again=5)
    sets = [(ins.filter(F.col("refresh_set") == s).drop("refresh_set"),) * 2 + (dels.filter(F.col("refresh_set") == s).drop("refresh_set"),) for s in range(1, 13)]
    sets = [(a, b.withColumnRenamed("o_orderkey", "l_orderkey"), c) for a, b, c in sets]
    looped, lines = refresh.apply_refresh_sets(base, base.withColumnRenamed("o_orderkey", "l_orderkey"), sets, checkpoint_every=3)
    net = refresh.apply_net(base, *refresh.net_change(ins, dels, "o_orderkey"), "o_orderkey")
    want = sorted(map(tuple, looped.collect()))
    assert sorted(map(tuple, net.collect())) == want == sorted(map(tuple, lines.collect()))


def test_set_order_decides(spark):
    base = spark.createDataFrame([(1, "base"), (2, "base"), (3, "base")], "k long, v string")
    ins = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (4, "c", 2), (4, "c", 2), (5, "d", 2)], "k long, v string, refresh_set int")
    dels = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (5, 2), (9, 1)], "o_orderkey long, refresh_set int")
    net = refresh.apply_net(base, *refresh.net_change(ins, dels, "k"), "k")
    # a set inserts before it deletes: 5 is gone, 1 returns after its deletion, rows inserted twice stay two
    assert sorted(map(tuple, net.collect())) == [(1, "b"), (3, "base"), (4, "c"), (4, "c")]


def test_plan_does_not_grow_with_the_sets(spark, base):
    sizes = set()
    for n in (2, 40):
        ins, dels = refresh.run_of_sets(base, "o_orderkey", n)
        net = refresh.apply_net(base, *refresh.net_change(ins, dels, "o_orderkey"), "o_orderkey")
        sizes.add(len(net._jdf.queryExecution().optimizedPlan().toString().split("\n")))
    assert len(sizes) == 1


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_only_touched_ranges_are_rewritten(spark, base, tmp_path):
    path = str(tmp_path / "t")
    refresh.write_ranges(base, "o_orderkey", 50, path)
    before = _files(path)
    ins = spark.createDataFrame([(601, 7), (120, 8)], "o_orderkey long, v long")
    dels = spark.createDataFrame([(k,) for k in [*range(200, 250), 130, 5000]], "o_orderkey long")
    touched = refresh.refresh_ranges(spark, path, "o_orderkey", 50, ins, dels)
    assert touched == [2, 4, 12, 100]
    after = _files(path)
    kept = {f for f in before if not any(f"key_range={r}/" in f for r in touched)}
    assert all(after.get(f) == before[f] for f in kept)
    assert {f.split("key_range=")[1].split("/")[0] for f in set(after) - kept} == {"2", "12"}     # 4 lost all its rows
    gone = {*range(200, 250), 130}
    want = sorted([(k, k * 3) for k in range(600) if k not in gone] + [(601, 7), (120, 8)])
    assert sorted((r.o_orderkey, r.v) for r in spark.read.parquet(path).collect()) == want
    assert refresh.refresh_ranges(spark, path, "o_orderkey", 50, ins.limit(0), dels.limit(0)) == []


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_delete_keys_move_no_base_row(spark, base, monkeypatch):
    keys = base.filter("o_orderkey % 100 = 0").select("o_orderkey")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = refresh.apply_deletes(base, keys, "o_orderkey")
        assert "BroadcastHashJoin" in _plan(few) and "Exchange hashpartitioning" not in _plan(few)
        monkeypatch.setattr(refresh, "BROADCAST_KEYS", 5)
        many = refresh.apply_deletes(base, keys, "o_orderkey")
        assert "BroadcastHashJoin" not in _plan(many)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [(k, 3 * k) for k in range(600) if k % 100]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_run_of_sets_sorts_no_row(spark, base):
    ins, dels = refresh.run_of_sets(base, "o_orderkey", SETS)
    plan = _plan(refresh.apply_net(base, *refresh.net_change(ins, dels, "o_orderkey"), "o_orderkey"))
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan


def test_derived_columns_are_made_after_the_run(spark):
    from shoal.plans import catalog
    for name, derived in (("refresh_run_lineitem", "l_comment"), ("refresh_run_orders", "o_comment")):
        made, _, moved = catalog.RAW[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString().partition("Union")
        assert derived in made and "Join" in moved and derived not in moved
