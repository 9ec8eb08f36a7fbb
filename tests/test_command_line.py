"""Every job of the command line on small files."""

import pytest
from conftest import rows

from slicewise.__main__ import main, parser


@pytest.fixture
def run(spark, tmp_path):
    def job(name, *arguments):
        out = str(tmp_path / f"out-{name}-{len(list(tmp_path.iterdir()))}")
        main([name, *[a.format(out=out) for a in arguments]])
        return out

    return job


@pytest.fixture
def image_folder(tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    (folder / "one.raw").write_bytes(b"ab@c.com 2468 " + bytes(1024))
    (folder / "two.raw").write_bytes(b"ab@c.com xy@z.org ")
    return str(folder)


def lines(spark, out):
    return sorted(r.value for r in spark.read.text(out).select("value").collect())


def test_scan_jobs(spark, run, image_folder, tmp_path):
    found = lines(spark, run("features", image_folder, "{out}"))
    assert [x.split("\t")[:2] for x in found] == [["0", "ab@c.com"], ["0", "ab@c.com"], ["9", "xy@z.org"]]
    assert lines(spark, run("count", image_folder, "{out}")) == ["2\t1056"]
    assert "total: 1056" in lines(spark, run("histogram", image_folder, "{out}"))
    artifacts = run("artifacts", image_folder, "{out}", "--pattern", "number=[0-9]{{4}}")
    assert rows(spark.read.parquet(artifacts).groupBy("artifact_class").count()) == [("email", 3), ("number", 1)]
    again = spark.read.parquet(run("regroup", artifacts, "{out}", "-n", "3"))
    assert again.count() == 4
    h, m, b = (str(tmp_path / n) for n in ("h", "m", "b"))
    run("blocks", image_folder, h, m, b)
    assert spark.read.parquet(h).count() == 2
    assert len(lines(spark, run("addresses", b, "{out}"))) == 2


def test_slices_then_ingest(spark, run, image_folder, tmp_path):
    slices = run("slices", image_folder, "{out}")
    run("slices", image_folder, slices, "--append")
    assert spark.read.parquet(slices).count() == 2
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    run("ingest", slices, table, state)
    assert lines(spark, run("addresses", table, "{out}")) == ["ab@c.com\t2", "xy@z.org\t1"]


def test_log_jobs(spark, run, tmp_path):
    log = tmp_path / "executor.log"
    log.write_text(
        "17/01/10 01:00:01 INFO Executor: Running task 1.0 in stage 0.0\n"
        "17/01/10 01:00:19 INFO Executor: Finished task 1.0 in stage 0.0\n"
    )
    assert len(lines(spark, run("throughput", str(log), "{out}"))) == 2
    assert len(lines(spark, run("throughput", str(log), "{out}", "--bucket", "60", "--cumulative"))) == 1
    progress = tmp_path / "progress.log"
    progress.write_text("2017-01-10 01-12-42.tsv 0\n2017-01-10 01-13-31.tsv 7\n")
    assert lines(spark, run("progress", str(progress), "{out}")) == ["0\t0", "49\t7"]
    counters = tmp_path / "counters.log"
    counters.write_text("seen: 3\nkept: 1\nseen: 4\n")
    assert lines(spark, run("counters", str(counters), "{out}", "seen: ", "kept: ")) == ["7\t1"]


def test_unknown_job():
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])
