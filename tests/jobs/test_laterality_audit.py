import json
import logging
import os

import pytest

from jobs import laterality_audit as J
from jobs.settings import load

FIRST = [
    (1, 0, "user", "Please plan Lung_L"), (1, 1, "assistant", "left lung it is"), (2, 0, "user", "Breast R"), (2, 1, "assistant", "venstre side"),
    (3, 0, "system", "left"), (3, 1, "user", "no side here"), (4, 0, "user", "sin"), (None, 0, "user", "left"), (25, 0, "user", None),
]
LATER = [(2, 2, "assistant", "right then"), (4, 1, "assistant", "L"), (4, 1, "assistant", "L"), (26, 0, None, "right")]


def put(spark, rows, path):
    spark.createDataFrame(rows, J.TURNS).coalesce(1).write.mode("append").parquet(path)


def rows(df):
    return sorted((r.conv_id, r.turns, r.sided_turns, r.asked, r.answered, r.verdict) for r in df.collect())


def test_two_runs_take_only_what_is_new(spark, tmp_path, caplog):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    caplog.set_level(logging.INFO)
    put(spark, FIRST, source)
    config = {"block": 10}
    first = [
        (1, 2, 2, "LEFT", "LEFT", "OK"), (2, 2, 2, "RIGHT", "LEFT", "WARNING"), (3, 2, 1, "NONE", "NONE", "OK"), (4, 1, 1, "LEFT", "NONE", "WARNING"), (25, 1, 0, "NONE", "NONE", "OK"),
    ]
    assert rows(J.run(spark, source, out, mark, config)) == first
    files = sorted(spark.read.parquet(f"{out}/verdicts").inputFiles())
    assert rows(J.run(spark, source, out, mark, config)) == first  # nothing new
    assert sorted(spark.read.parquet(f"{out}/verdicts").inputFiles()) == files
    put(spark, LATER, source)
    caplog.clear()
    both = rows(J.run(spark, source, out, mark, config))
    assert both == [first[0], (2, 3, 3, "RIGHT", "AMBIGUOUS", "WARNING"), first[2], (4, 2, 2, "LEFT", "LEFT", "OK"), first[4], (26, 1, 1, "NONE", "NONE", "OK")]
    assert "read 4 turns, wrote 4 of them in 2 blocks" in caplog.text
    fresh = J.run(spark, source, str(tmp_path / "o2"), str(tmp_path / "m2"), {"block": 10, "max_files": 1})
    assert rows(fresh) == both
    # a lost checkpoint takes all files again, into the same output
    assert rows(J.run(spark, source, out, str(tmp_path / "m3"), config)) == both


def test_a_batch_taken_again_gives_the_same(spark, tmp_path, monkeypatch):
    """The second write of a batch fails; the next run takes that batch again."""
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    put(spark, FIRST, source)
    real, calls = J._replace, []

    def failing(frame, path, *by):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(frame, path, *by)

    monkeypatch.setattr(J, "_replace", failing)
    with pytest.raises(Exception, match="lost"):
        J.run(spark, source, out, mark)
    got = J.run(spark, source, out, mark)
    assert rows(got) == rows(J.run(spark, source, str(tmp_path / "o2"), str(tmp_path / "m2")))
    assert spark.read.parquet(f"{out}/turns").count() == len(FIRST) - 1


def test_empty_source_and_other_columns(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], J.TURNS).write.parquet(source)
    assert rows(J.run(spark, source, str(tmp_path / "out"), str(tmp_path / "mark"))) == []
    spark.createDataFrame([(7, 0, "user", "left", "x", 1)], J.TURNS + ", side string, block int").write.mode("append").parquet(source)
    assert rows(J.run(spark, source, str(tmp_path / "out"), str(tmp_path / "mark"))) == [(7, 1, 1, "LEFT", "NONE", "WARNING")]


def test_config(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"block": 5}))
    assert load(spark, str(path), J.DEFAULTS) == {**J.DEFAULTS, "block": 5}
    assert load(spark, os.path.join(os.path.dirname(J.__file__), "laterality_audit.json"), J.DEFAULTS) == J.DEFAULTS
    path.write_text(json.dumps({"blok": 5}))
    with pytest.raises(ValueError, match="blok"):
        load(spark, str(path), J.DEFAULTS)
