import os
import subprocess
import sys

from jobs import contour_report as J

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def test_limited_runs_leave_what_one_run_over_everything_would(spark, tmp_path):
    config = {"block": 2}
    whole = J.run(spark, SF, str(tmp_path / "whole"), config)
    assert {r.status for r in whole.select("status").distinct().collect()} == {"measured", "review", "not measured"}
    want, out = rows(whole), str(tmp_path / "out")
    parts = spark.read.parquet(f"{SF}/part.parquet")
    last = parts.selectExpr("CAST(max(p_partkey) / 40 AS LONG) AS p").first()["p"]
    parts.where("p_partkey < 80").write.parquet(str(tmp_path / "early/part.parquet"))
    first = J.run(spark, str(tmp_path / "early"), out, config)
    assert {r.block for r in first.select("block").distinct().collect()} == {0}
    old = set(first.inputFiles())
    grown = J.run(spark, SF, out, config, (2, last))
    assert rows(grown) == want and old <= set(grown.inputFiles())
    assert rows(J.run(spark, SF, out, config)) == want  # again, everything
    organs = spark.read.parquet(f"{out}/organs")
    assert rows(organs) == rows(spark.read.parquet(str(tmp_path / "whole/organs"))) and organs.selectExpr("sum(pairs)").first()[0] == len(want)


def test_limits_decide_what_is_marked(spark, tmp_path):
    strict = J.run(spark, SF, str(tmp_path / "a"), {"least_dice": 1.0})
    assert strict.where("status = 'measured' AND dice < 1").count() == 0 and strict.where("status = 'review'").count() > 0
    assert J.run(spark, SF, str(tmp_path / "b"), {"least_dice": 0.0, "most_hd95_mm": 1e9}).where("status = 'review'").count() == 0
    none = tmp_path / "none"
    spark.read.parquet(f"{SF}/part.parquet").where("false").write.parquet(str(none / "part.parquet"))
    assert J.run(spark, str(none), str(tmp_path / "c")).collect() == []


def test_command_lines(tmp_path):
    for module, given in (("contour_report", ["--tables", SF, "--output", str(tmp_path / "r"), "--patients", "0", "1"]), ("laterality_audit", ["--input", f"{SF}/conversations.parque[t]", "--output", str(tmp_path / "a"), "--checkpoint", str(tmp_path / "m")])):
        done = subprocess.run([sys.executable, "-m", f"jobs.{module}", *given, "--config", f"jobs/{module}.json"], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and f"{module} " in done.stderr, done.stderr[-2000:]
