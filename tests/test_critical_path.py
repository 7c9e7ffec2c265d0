"""Critical path of event logs: a hand-written log, the nested plan tree, ties, retries and missing parents."""

import json

from shoal.plans import critical_path as cp
from shoal.sources import runlogs


def stage(s, ms, parents=(), attempt=0, ids=(), start=1000):
    return {"Event": "SparkListenerStageCompleted", "Stage Info": {
        "Stage ID": s, "Stage Attempt ID": attempt, "Stage Name": "x", "Parent IDs": list(parents), "Submission Time": start, "Completion Time": start + ms,
        "Accumulables": [{"ID": i, "Name": "n", "Value": "7"} for i in ids], "RDD Info": []}}


def node(name, ids=(), *children):
    return {"nodeName": name, "simpleString": name, "children": list(children), "metadata": {},
            "metrics": [{"name": "m", "accumulatorId": i, "metricType": "sum"} for i in ids]}


LOG = [
    {"Event": "SparkListenerApplicationStart", "App ID": "app-1"},
    {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 3, "description": "show",
     "sparkPlanInfo": node("Join", [1], node("Sort", [2], node("Exchange", [3], node("Scan a", [4]))), node("Sort", [5], node("Exchange", [6], node("Scan b", [7]))))},
    {"Event": "SparkListenerJobStart", "Job ID": 2, "Stage IDs": [2, 3, 4], "Submission Time": 5},
    {"Event": "SparkListenerJobStart", "Job ID": 7, "Stage IDs": [4, 9], "Submission Time": 6},
    stage(2, 300, ids=[3, 4]), stage(3, 500, attempt=0, ids=[6, 7]), stage(3, 900, attempt=1, ids=[6, 7]), stage(4, 10, [2, 3, 77], ids=[1, 2, 5, 99]),
    {"Event": "SparkListenerTaskEnd", "Stage ID": 2}, stage(9, 5),
]


def write(folder, name, lines):
    (folder / name).write_text("".join(json.dumps(x) + "\n" for x in lines))


def test_hand_written_log(spark, tmp_path):
    write(tmp_path, "app-20200101000000-0001", LOG)
    write(tmp_path, "app-20200101000000-0002", [stage(0, 10), stage(1, 10), stage(2, 5, [0, 1]), stage(3, 5, [0, 1])])
    write(tmp_path, "app-20200101000000-0003", [{"Event": "SparkListenerApplicationStart"}])
    events = cp.parse(runlogs.read_app_lines(spark, str(tmp_path)))
    got = sorted((r.application[-1], r.pos, r.stage_id, r.job_id, r.ms, r.finish_ms, r.plan_node) for r in cp.critical_path(events).collect())
    assert got == [("1", 0, 3, 2, 900, 900, "Exchange"), ("1", 1, 4, 2, 10, 910, "Join"),
                   ("2", 0, 0, None, 10, 10, None), ("2", 1, 2, None, 5, 15, None)]         # ties: the smaller ids
    nodes = sorted((r.path, r.depth, r.name, list(r.accumulators)) for r in cp.plan_nodes(events).collect())
    assert nodes == [("0", 0, "Join", [1]), ("0.0", 1, "Sort", [2]), ("0.0.0", 2, "Exchange", [3]), ("0.0.0.0", 3, "Scan a", [4]),
                     ("0.1", 1, "Sort", [5]), ("0.1.0", 2, "Exchange", [6]), ("0.1.0.0", 3, "Scan b", [7])]


def test_long_chain_and_cycle(spark, tmp_path):
    write(tmp_path, "app-1-1", [stage(k, k + 1, [k - 1] if k else []) for k in range(12)])
    write(tmp_path, "app-2-1", [stage(0, 5, [1]), stage(1, 7, [0])])                  # no log has this; it must end
    got = cp.critical_path(cp.parse(runlogs.read_app_lines(spark, str(tmp_path)))).collect()
    assert [r.stage_id for r in sorted((r for r in got if "app-1" in r.application), key=lambda r: r.pos)] == list(range(12))
    assert max(r.finish_ms for r in got if "app-1" in r.application) == 78
    assert [r for r in got if "app-2" in r.application]


def test_derived_lines_parse_like_recorded_ones(spark):
    rows = spark.createDataFrame([(k, f"2024-01-01 00:00:{k % 60:02d}", 1.5 * k) for k in range(130)], "event_id long, ts string, value double")
    lines = runlogs.app_log_from_events(rows.selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "value"))
    events = cp.parse(lines)
    assert cp.stages(events).count() == 130 and cp.plan_nodes(events).count() == 3 * 16
    assert {r.application for r in cp.critical_path(events).select("application").distinct().collect()} == {"app-0", "app-1", "app-2"}


def test_folded_paths_equal_the_rounds(spark, monkeypatch):
    rows = [(f"a{a}", s, (s * 7919 + a * 31) % 97 - (s % 50 == 0), [(s - 1) // 2, (s - 1) // 3, s, -5, None] if s else None) for a in range(5) for s in range(40 + a) if s != 11]
    rows += [("a9", 0, 3, [1]), ("a9", 1, 4, [0]), ("a9", 2, 5, [1]), (None, 0, 3, []), (None, 1, 4, [0])]
    found = spark.createDataFrame(rows, "application string, stage_id long, ms long, parents array<long>")
    calls = []
    relaxed = cp._relaxed
    monkeypatch.setattr(cp, "_relaxed", lambda f: calls.append(sorted({r.application or "" for r in f.select("application").collect()})) or relaxed(f))
    got = sorted(map(tuple, cp.longest_paths(found).collect()), key=str)
    assert calls == [["a9"]]                                     # only those that one pass cannot do
    assert got == sorted(map(tuple, relaxed(found).collect()), key=str)
    monkeypatch.setattr(cp, "FOLDED", 41)
    assert sorted(map(tuple, cp.longest_paths(found).collect()), key=str) == got
    assert calls[1] == ["a3", "a4", "a9"]


def test_derived_lines_are_dealt_out(spark):
    rows = spark.createDataFrame([(k, f"2024-01-01 00:00:{k % 60:02d}", 1.5 * k) for k in range(130)], "event_id long, ts string, value double")
    lines = runlogs.app_log_from_events(rows.selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "value").coalesce(1))
    assert lines.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
