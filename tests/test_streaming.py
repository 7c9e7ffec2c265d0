"""The streaming transfer aggregation equals the batch one on the same files."""

from shoal.plans import runs
from shoal.sources import runlogs
from shoal.streaming.transfer import replay


def rows(df):
    return {(r.run, r.pid, r.second): r.bytes for r in df.collect()}


def test_stream_equals_batch(spark, tmp_path):
    root = tmp_path / "logs"
    lines = {("run1", "workerLoad_0.tsv"): ["1551158150472\tx\t1000\t7@h", "1551158150999\tx\t500\t7@h",
                                            "1551158151000\tx\t300", "1551158152000\tx", "bad\tx\t1\t2@h", "1\tx\tbad\t2@h"],
             ("run2", "workerLoad_1.tsv"): ["1551158170000\tx\t42\t3@h", "1551158190000\tx\t8\t3@h"]}
    for (run, name), text in lines.items():
        d = root / run / "shuffle"
        d.mkdir(parents=True)
        (d / name).write_text("\n".join(text) + "\n")
    got = rows(replay(spark, str(root), str(tmp_path / "out"), "t_stream"))
    assert len(got) == 4
    assert got == rows(runs.transfer_per_second(runlogs.parse_transfer(runlogs.read_transfer_logs(spark, str(root)))))


def test_many_files_of_overlapping_seconds(spark, tmp_path):
    """400 one-file runs over the same and far-apart seconds, in many micro-batches: no row is late."""
    root = tmp_path / "logs"
    for k in range(400):
        d = root / f"run{k:03d}" / "shuffle"
        d.mkdir(parents=True)
        start = 1551158150000 + (k * 7919 % 100) * 60000
        (d / "workerLoad_0.tsv").write_text(f"{start}\tx\t{k}\t1@h\n{start + 3600000 * (k % 3)}\tx\t1\t1@h\n")
    got = rows(replay(spark, str(root), str(tmp_path / "out"), "t_many", files_per_trigger=100))
    want = rows(runs.transfer_per_second(runlogs.parse_transfer(runlogs.read_transfer_logs(spark, str(root)))))
    assert got == want and len(got) > 600
