"""Generation jobs (I1-I14): valid keys, links, lengths and domains, and the same
rows whatever the partition count (J6)."""

import pytest
from pyspark.sql import functions as F

from shoal.generate import tables as G
from shoal.generate import vocab
from shoal.operators import quality

SF = 0.001


@pytest.fixture(scope="module")
def generated(spark):
    o, li = G.orders_and_lineitem(spark, SF)
    t = {"region": G.region(spark), "nation": G.nation(spark), "supplier": G.supplier(spark, SF),
         "customer": G.customer(spark, SF), "part": G.part(spark, SF), "partsupp": G.partsupp(spark, SF),
         "orders": o, "lineitem": li}
    return {k: v.cache() for k, v in t.items()}


def test_row_counts_follow_scale_factor(generated):
    assert generated["supplier"].count() == 10
    assert generated["customer"].count() == 150
    assert generated["part"].count() == 200
    assert generated["partsupp"].count() == 800
    assert generated["orders"].count() == 1500
    assert 1500 <= generated["lineitem"].count() <= 1500 * 7
    assert G.scaled(0.0005, "orders") == 1 * 1 or G.scaled(0.0005, "orders") >= 1
    assert G.scaled(2.7, "part") == 400_000


def test_nation_regions_from_running_deltas(generated):
    got = {r.n_name: r.n_regionkey for r in generated["nation"].collect()}
    assert got["ALGERIA"] == 0 and got["BRAZIL"] == 1 and got["EGYPT"] == 4
    assert got["FRANCE"] == 3 and got["JAPAN"] == 2 and got["UNITED STATES"] == 1


def test_checks_pass_on_generated_tables(generated):
    pk = {r.tbl: r.dup_keys for r in quality.pk_violations(generated).collect()}
    # with 10 suppliers the bridge repeats pairs (a known property of the formula)
    assert all(v == 0 for k, v in pk.items() if k != "partsupp")
    fk = {(r.child, r.child_cols): r.orphan_rows for r in quality.fk_violations(generated).collect()}
    assert all(v == 0 for v in fk.values()), fk
    assert all(r.over_bound == 0 for r in quality.length_check(generated).collect())
    assert all(r.out_of_range == 0 for r in quality.domain_check(generated).collect())
    assert all(r.null_count == 0 for r in quality.not_null(generated).collect())
    hdr = quality.order_header_check(generated["orders"], generated["lineitem"]).collect()[0]
    assert (hdr.orders_without_lines, hdr.bad_line_count, hdr.status_mismatch, hdr.price_mismatch) == (0, 0, 0, 0)


def test_value_domains(generated):
    types = {r.p_type for r in generated["part"].select("p_type").distinct().collect()}
    assert types <= set(vocab.PART_TYPES)
    names = generated["part"].select(F.split("p_name", " ").alias("w")).collect()
    assert all(len(set(r.w)) == 5 and set(r.w) <= set(vocab.COLORS) for r in names)
    keys = [r.o_orderkey for r in generated["orders"].orderBy("o_orderkey").limit(9).collect()]
    assert keys == [1, 2, 3, 4, 5, 6, 7, 32, 33]          # sparse keys
    bad_cust = generated["orders"].filter(F.col("o_custkey") % 3 == 0).count()
    assert bad_cust == 0                                  # every third customer has no orders


def _checksums(spark, partitions):
    o, li = G.orders_and_lineitem(spark, SF, partitions=partitions)
    t = {"orders": o, "lineitem": li, "part": G.part(spark, SF, partitions=partitions),
         "supplier": G.supplier(spark, SF, partitions=partitions)}
    return {r.tbl: (r.row_count, r.checksum) for r in quality.table_checksum(t).collect()}


def test_same_rows_at_any_parallelism(spark):
    one = _checksums(spark, 1)
    assert one == _checksums(spark, 3) == _checksums(spark, 8)


def test_refresh_sets(spark):
    ins_o, ins_l, dels = G.refresh_set(spark, 0.01, 1)
    assert ins_o.count() == 15 and dels.count() == 15
    seq = {r.s for r in ins_o.select(F.shiftright("o_orderkey", 3).bitwiseAND(3).alias("s")).collect()}
    assert seq == {1}
    assert ins_l.join(ins_o, ins_l.l_orderkey == ins_o.o_orderkey, "left_anti").count() == 0
    base_o, _ = G.orders_and_lineitem(spark, 0.01)
    assert dels.join(base_o, "o_orderkey", "left_anti").count() == 0   # deletes hit base orders


def test_links_reach_all_given_parents(spark):
    """Rows made for given tables use the parents' own counts, whatever the scale factor between."""
    keys = spark.range(1, 3001)
    o, li = G.orders_and_lineitem(spark, 1.5, 4, key_source=keys, sizes={"customer": 50, "part": 40, "supplier": 12, "orders": 3000})
    assert {r.o_custkey for r in o.select("o_custkey").distinct().collect()} == {k for k in range(1, 51) if k % 3}
    assert li.select("l_partkey").distinct().count() == 40 and li.select("l_suppkey").distinct().count() == 12
    n_o, n_l, dels = G.refresh_set(spark, 1.5, 2, key_source=keys, sizes={"customer": 50, "part": 40, "supplier": 12, "orders": 3000})
    assert (n_o.count(), dels.count()) == (3, 3)
    assert n_l.join(n_o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").count() == 0


def test_chunked_write(spark, tmp_path):
    G.write_chunked(G.customer(spark, SF), "c_custkey", 4, str(tmp_path / "cust"))
    back = spark.read.parquet(str(tmp_path / "cust"))
    sizes = sorted(r["count"] for r in back.groupBy("chunk").count().collect())
    assert sizes == [37, 37, 37, 39]   # 150 rows: 37 per chunk, the remainder in the last


def test_refresh_cycle_on_generated_tables(spark):
    from shoal.operators import refresh
    sf = 0.01
    base_o, base_l = G.orders_and_lineitem(spark, sf)
    sets = [G.refresh_set(spark, sf, u) for u in (1, 2)]
    new_o, new_l = refresh.apply_refresh_sets(base_o, base_l, sets, checkpoint_every=1)
    n_base = base_o.count()
    assert new_o.count() == n_base + 2 * 15 - 2 * 15         # 15 inserted and 15 deleted per set
    pk = {r.tbl: r.dup_keys for r in quality.pk_violations({"orders": new_o, "lineitem": new_l}).collect()}
    assert pk == {"orders": 0, "lineitem": 0}
    orphans = new_l.join(new_o, new_l.l_orderkey == new_o.o_orderkey, "left_anti").count()
    assert orphans == 0                                        # deleted orders took their lines along
    hdr = quality.order_header_check(new_o, new_l).collect()[0]
    assert (hdr.orders_without_lines, hdr.status_mismatch, hdr.price_mismatch) == (0, 0, 0)


PERIOD = (1 << 31) - 1                  # of the generator that one 31-bit lane would be


def test_draws_do_not_repeat_after_2_31_keys(spark):
    keys = [11, 11 + PERIOD, 11 + 2 * PERIOD, 11 + (1 << 40), 11 + (1 << 62)]
    o, li = G.orders_and_lineitem(spark, 1, 1, key_source=spark.createDataFrame([(k,) for k in keys], "k long"))
    drawn = [c for c in o.columns if c not in ("o_orderkey", "o_shippriority", "o_orderstatus")]
    rows = [tuple(r[c] for c in drawn) for r in o.collect()]
    assert len(set(rows)) == len(keys)
    assert all(len({r[i] for r in rows}) > 1 for i in range(len(drawn)))
    lines = [tuple(r)[1:] for r in li.collect()]
    assert len(set(lines)) == len(lines)


def test_a_row_is_reached_by_any_way(spark):
    """The jump equals stepping through the stream, for small and for large keys."""
    from shoal.functions import draws
    for key in (0, 1, 2, 17, 300):
        x = list(draws.start(5))
        for _ in range(key):
            x = [v * draws.power(k, draws.ROW) % draws.MODULI[k] for k, v in enumerate(x)]
        got = spark.range(1).select(*draws.jump(F.lit(key), 5), draws.draw(draws.jump(F.lit(key), 5), 77).alias("d")).first()
        want = [v * draws.power(k, 77) % draws.MODULI[k] for k, v in enumerate(x)]
        assert list(got)[:2] == x and got.d == (want[0] - want[1]) % draws.RANGE
    far = (1 << 63) - 5
    got = spark.range(1).select(*draws.jump(F.lit(far), 5)).first()
    assert list(got) == [s * draws.power(k, draws.ROW * far) % draws.MODULI[k] for k, s in enumerate(draws.start(5))]


def test_draws_are_spread_evenly(spark):
    from shoal.functions import draws
    rows = spark.range(20000).select(*(c.alias(n) for c, n in zip(draws.jump(F.col("id")), G.ROW, strict=True)))
    d = [draws.draw(G._state(), draws.position(s)) % 10 for s in (5, 6)]
    cells = rows.select(d[0].alias("x"), d[1].alias("y")).groupBy("x", "y").count().collect()
    assert len(cells) == 100 and sum((r["count"] - 200) ** 2 / 200 for r in cells) < 160      # chi-square, 99 degrees


@pytest.mark.parametrize("size", [1, 512 << 10, 2 << 20, 9 << 20])
def test_no_pool_size_loses_rows(spark, size):
    from shoal.functions import draws, text
    pool = text.text_pool(spark, size)
    rows = spark.range(3000).select("id", *(c.alias(n) for c, n in zip(draws.jump(F.col("id")), G.ROW, strict=True)))
    got = G._with_text(rows, "o_comment", pool)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (pool.chunks <= text.BROADCAST_CHUNKS)
    lo, hi = vocab.bounds("o_comment")
    lengths = [len(r.o_comment) for r in got.collect()]
    assert len(lengths) == 3000 and min(lengths) >= lo and max(lengths) <= hi


def test_pool_is_used_from_end_to_end(spark):
    from shoal.functions import draws, text
    pool = text.text_pool(spark, 2 << 20)
    used = spark.range(40000).select((text._h(G.S["o_comment"], draws.jump(F.col("id")), text.COMMENT_CHUNK) % pool.chunks).alias("c")).distinct().count()
    assert pool.chunks == 2048 and used == 2048
    small = {r._chunk: r._pool for r in text.text_pool(spark, 4096).rows.collect()}
    large = {r._chunk: r._pool for r in pool.rows.filter("_chunk < 4").collect()}
    assert small == large and len(small) == 4
