"""Readers on hand-written inputs: pipe tables (A1-A5, A12), latency and transfer logs
(A8, A9, H6, H9, D11, B13, B14), event logs (A10), unpivot (A13)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from shoal.plans import runs
from shoal.sources import runlogs, tables


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_read_tbl_typed_with_trailing_separator(spark, tmp_path):
    _write(tmp_path / "orders.tbl",
           '1|37|O|131251.81|1996-01-02|5-LOW|Clerk#000000951|0|a "quoted" comment|\n'
           '2|78|F|bad|1996-12-01|1-URGENT|Clerk#000000880|0|plain|\n')
    df = tables.read_tbl(spark, str(tmp_path / "orders.tbl"), "orders")
    rows = {r.o_orderkey: r for r in df.collect()}
    assert df.columns[-1] == "o_comment"
    assert rows[1].o_totalprice == Decimal("131251.81")
    assert rows[1].o_orderdate == dt.date(1996, 1, 2)
    assert rows[1].o_comment == 'a "quoted" comment'   # quotes are plain text
    assert rows[2].o_totalprice is None                  # bad number -> NULL, counted by not_null


def test_write_then_read_tbl_round_trip(spark, tmp_path):
    src = spark.createDataFrame([(1, "AFRICA", None), (2, "ASIA", "x|y")],
                                "r_regionkey long, r_name string, r_comment string")
    out = str(tmp_path / "region")
    tables.write_tbl(src.filter(F.col("r_regionkey") == 1), out)
    lines = [ln for f in sorted((tmp_path / "region").glob("part-*")) for ln in f.read_text().splitlines() if ln]
    assert lines == ["1|AFRICA||"]
    back = tables.read_tbl(spark, out, "region").collect()
    assert back[0].r_regionkey == 1 and back[0].r_name == "AFRICA"


def test_refresh_files_tagged_with_set_and_segment(spark, tmp_path):
    _write(tmp_path / "orders.tbl.u1", "9|1|O|1.00|1996-01-02|5-LOW|Clerk#1|0|c|\n")
    _write(tmp_path / "orders.tbl.u2.3", "10|1|O|1.00|1996-01-02|5-LOW|Clerk#1|0|c|\n")
    _write(tmp_path / "delete.1", "4|\n5|\n")
    ins = {r.o_orderkey: (r.refresh_set, r.segment)
           for r in tables.read_refresh_inserts(spark, str(tmp_path), "orders").collect()}
    assert ins == {9: (1, None), 10: (2, 3)}
    dels = tables.read_refresh_deletes(spark, str(tmp_path)).collect()
    assert sorted((r.o_orderkey, r.refresh_set) for r in dels) == [(4, 1), (5, 1)]


def test_unpivot_columns(spark):
    df = spark.createDataFrame([(1, 2.5, "a")], "k long, x double, s string")
    out = {(r.column, r.value) for r in tables.unpivot_columns(df, ["k"]).collect()}
    assert out == {("x", "2.5"), ("s", "a")}


LAT = "24/01/01 00:00:0{} INFO TpchQuery: End executing query. Time: {}\n"


def test_latency_last_match_wins_and_non_matches_skipped(spark, tmp_path):
    root = tmp_path / "logs"
    _write(root / "run1" / "shuffle" / "scale1.log",
           LAT.format(1, 1000) + "noise line\n" + LAT.format(2, 1500))      # two matches: last wins
    _write(root / "run1" / "noshuffle" / "scale1.log",
           "24/01/01 00:00:01 INFO extra TpchQuery: End executing query. Time: 9\n"  # 4th word: no match
           + LAT.format(3, 1200))
    _write(root / "run1" / "noshuffle" / "scale2.log", "nothing here\n")        # no match at all
    parsed = runlogs.parse_latency(runlogs.read_latency_logs(spark, str(root)))
    files = {(r.run, r.mode, r.name): r.latency_ms for r in runs.file_latency(parsed).collect()}
    assert files == {("run1", "shuffle", "scale1.log"): 1500.0, ("run1", "noshuffle", "scale1.log"): 1200.0}
    gap = runs.latency_gap(runs.file_latency(parsed)).collect()[0]
    assert gap.gap == round((1500 - 1200) / 1200, 4)


def test_transfer_fields_pid_and_seconds(spark, tmp_path):
    root = tmp_path / "logs"
    _write(root / "run1" / "shuffle" / "workerLoad_0.tsv",
           "1551158150472\tx\t1000\t77@host\n"
           "1551158150999\tx\t500\t77@host\n"    # same second: summed
           "1551158151000\tx\t300\n"             # three fields: pid -1
           "1551158152000\tx\n")                 # two fields: skipped
    parsed = runlogs.parse_transfer(runlogs.read_transfer_logs(spark, str(root)))
    per = {(r.pid, r.second): r.bytes for r in runs.transfer_per_second(parsed).collect()}
    assert per == {(77, 1551158150): 1500, (-1, 1551158151): 300}


def test_footprint_pads_to_longest_plus_one(spark):
    ps = spark.createDataFrame([("r", 1, 10, 1048576 * 125), ("r", 1, 11, 0), ("r", 2, 50, 1048576)],
                               "run string, pid int, second long, bytes long")
    fp = sorted((r.pid, r.idx, r.mbps) for r in runs.footprint(ps).collect())
    # longest series has 2 points -> 3 positions each; 125 MiB/s = 1048 Mbps, 1 MiB/s = 8 Mbps
    assert fp == [(1, 0, 1048), (1, 1, 0), (1, 2, 0), (2, 0, 8), (2, 1, 0), (2, 2, 0)]


def test_latency_mean_and_population_std(spark):
    import numpy as np
    files = spark.createDataFrame([("run0", "shuffle", f"f{i}", float(v)) for i, v in enumerate([1000, 2000, 4000])],
                                  "run string, mode string, name string, latency_ms double")
    r = runs.latency_by_run(files).collect()[0]
    assert abs(r.mean_s - np.mean([1, 2, 4])) < 1e-6
    assert abs(r.std_s - np.std([1, 2, 4])) < 1e-6
    assert r.concurrency == 1


def test_event_log_reader_and_stage_metrics(spark, tmp_path):
    _write(tmp_path / "app-1",
           '{"Event":"SparkListenerTaskStart","Stage ID":2}\n'
           '{"Event":"SparkListenerTaskEnd","Stage ID":2,"Task Metrics":{"Executor Run Time":5,'
           '"Shuffle Write Metrics":{"Shuffle Bytes Written":100}}}\n'
           '{"Event":"SparkListenerTaskEnd","Stage ID":2,"Task Metrics":{"Executor Run Time":7,'
           '"Shuffle Write Metrics":{"Shuffle Bytes Written":50}}}\n')
    m = runs.stage_metrics(runlogs.read_event_log(spark, str(tmp_path))).collect()
    assert [(r.stage_id, r.tasks, r.run_time_ms, r.shuffle_bytes_written) for r in m] == [(2, 2, 12, 150)]


def test_stages_of_two_applications_and_attempts_stay_apart(spark, tmp_path):
    line = '{"Event":"SparkListenerTaskEnd","Stage ID":2,"Stage Attempt ID":%d,"Task Metrics":{"Executor Run Time":%d,"Disk Bytes Spilled":3}}\n'
    _write(tmp_path / "app-20190226051541-0000", line % (0, 100) + line % (1, 5))
    _write(tmp_path / "app-20190226051541-0001", line % (0, 200))
    m = runs.stage_metrics(runlogs.read_event_log(spark, str(tmp_path))).collect()
    assert sorted((r.application, r.stage_id, r.attempt, r.tasks, r.run_time_ms, r.disk_spilled_bytes) for r in m) == [
        ("app-20190226051541-0000", 2, 0, 1, 100, 3), ("app-20190226051541-0000", 2, 1, 1, 5, 3), ("app-20190226051541-0001", 2, 0, 1, 200, 3)]


def test_latency_keeps_fractions_and_counts_bad_lines(spark, tmp_path):
    for k, t in enumerate(["123.75", "0.5", "12x"]):
        _write(tmp_path / "run0" / "shuffle" / f"scale{k}", "noise\n" + LAT.format(k, t))
    lines = runlogs.read_latency_logs(spark, str(tmp_path))
    r = runs.latency_by_run(runs.file_latency(runlogs.parse_latency(lines))).collect()
    assert [(x.files, x.mean_s) for x in r] == [(2, round(0.062125, 6))]
    assert [(x.run, x.bad_lines) for x in runlogs.bad_lines(lines, "latency").collect()] == [("run0", 1)]
    _write(tmp_path / "run1" / "shuffle" / "workerLoad_0.tsv", "1\tx\tbad\t1@h\n5000\tx\t7\t1@h\n2\tx\n9\tx\t1\tq@h\n")
    lines = runlogs.read_transfer_logs(spark, str(tmp_path))
    assert [(x.second, x.bytes) for x in runlogs.parse_transfer(lines).collect()] == [(5, 7)]
    assert [(x.run, x.bad_lines) for x in runlogs.bad_lines(lines, "transfer").collect()] == [("run1", 2)]


def test_last_line_of_a_file_read_in_many_splits(spark, tmp_path):
    text = "".join(f"24/01/01 00:00:01 INFO TpchQuery: End executing query. Time: {k}\n" for k in range(5000))
    _write(tmp_path / "run0" / "shuffle" / "scale0", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        f = runs.file_latency(runlogs.parse_latency(runlogs.read_latency_logs(spark, str(tmp_path))))
        assert [r.latency_ms for r in f.collect()] == [4999.0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_seventy_runs(spark):
    files = spark.range(70).select(F.format_string("run%02d", "id").alias("run"), F.lit("shuffle").alias("mode"),
                                   F.lit("f").alias("name"), F.lit(1.0).alias("latency_ms"))
    got = {r.run: r.concurrency for r in runs.latency_by_run(files).collect()}
    assert got == {f"run{k:02d}": 2.0 ** k for k in range(70)}


def test_empty_text_survives_pipe_text(spark, tmp_path):
    cols = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice decimal(15,2), o_orderdate date, " \
           "o_orderpriority string, o_clerk string, o_shippriority int, o_comment string"
    src = spark.createDataFrame([(1, 2, "O", Decimal("1.50"), dt.date(1996, 1, 2), "5-LOW", "", 0, "")], cols)
    tables.write_tbl(src, str(tmp_path / "o"))
    assert tables.read_tbl(spark, str(tmp_path / "o"), "orders").collect() == src.collect()


def test_load_sees_files_added_and_rewritten(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(5).write.parquet(f"{folder}/orders.parquet")
    assert tables.load(spark, folder, "orders").count() == 5
    spark.range(4).write.mode("append").parquet(f"{folder}/orders.parquet")
    assert tables.load(spark, folder, "orders").count() == 9
    spark.range(2).write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    assert tables.load(spark, folder, "orders").count() == 2


def test_distribution_file(spark, tmp_path):
    _write(tmp_path / "dists.txt", "# comment\nbegin colours\ncount|2\nred|3\nsea | green|4\nend colours\n\nBEGIN empty\nCOUNT|0\nEND empty\nbegin one\ncount|1\nx|1\nend one\n")
    got = tables.read_distributions(spark, str(tmp_path / "dists.txt")).collect()
    assert sorted((r.dist, r.pos, r.text, r.weight) for r in got) == [("colours", 1, "red", 3), ("colours", 2, "sea | green", 4), ("one", 1, "x", 1)]


def test_write_per_column_partitions_by_column(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, 3.0, "b")], "k long, x double, s string")
    out = str(tmp_path / "cols")
    tables.write_per_column(df, ["k"], out)
    back = spark.read.parquet(out)
    assert sorted(r.column for r in back.select("column").distinct().collect()) == ["s", "x"]
    assert back.filter("column = 'x' AND k = 2").collect()[0].value == "3.0"
