"""The mode sweep writes study-format latency logs that the latency operators read back (M5, M8, M9)."""

from conftest import SF_SMALL
from shoal.plans import sweep


def test_mode_sweep_round_trip(spark, tmp_path):
    root = sweep.run_mode_sweep(spark, SF_SMALL, str(tmp_path / "logs"), levels=(1, 2), repeats=1)
    by_run, gap = sweep.analyze(spark, root)
    rows = {(r.run, r.mode): (r.concurrency, r.files) for r in by_run.collect()}
    assert rows == {("run0", "shuffle"): (1, 1), ("run0", "noshuffle"): (1, 1),
                    ("run1", "shuffle"): (2, 2), ("run1", "noshuffle"): (2, 2)}
    assert all(r.mean_s > 0 for r in by_run.collect())
    g = {r.run: r.gap for r in gap.collect()}
    assert set(g) == {"run0", "run1"} and all(v is not None for v in g.values())


def test_cli_runs_study_query_and_logs(spark, tmp_path, capsys):
    from shoal.__main__ import main
    log = tmp_path / "run0" / "shuffle" / "scale1.log"
    assert main(["run", "--query", "1", "--sf-dir", SF_SMALL, "--log", str(log)]) == 0
    lines = log.read_text().splitlines()
    assert lines[0].endswith("Begin executing query")
    assert "End executing query. Time: " in lines[1]
    assert main(["list"]) == 0
    assert "join_orders_lineitem" in capsys.readouterr().out


def test_cli_explain(spark, capsys):
    from shoal.__main__ import main
    assert main(["explain", "--query", "2", "--sf-dir", SF_SMALL, "--mode", "simple"]) == 0
    assert "PushedFilters" in capsys.readouterr().out
