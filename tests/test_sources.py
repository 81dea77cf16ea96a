import gzip
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoplane.operators import matching
from isoplane.sources import exports, nifti, volumes
from isoplane.streaming import filedrop


def label_file(labels: np.ndarray) -> bytes:
    data = bytearray(volumes.encode(np.zeros(labels.shape, "i2"), np.eye(4), (1, 1, 1), "labels")[:352])
    data[70:74] = (2).to_bytes(2, "little") + (8).to_bytes(2, "little")
    return bytes(data) + labels.astype("u1").tobytes()


def test_label_files(spark, tmp_path):
    labels = np.zeros((3, 4, 5), "u1")
    labels[2, 1, 0] = 7
    (tmp_path / "heart.nii.gz").write_bytes(gzip.compress(label_file(labels)))
    (tmp_path / "liver.v2.nii").write_bytes(label_file(np.zeros((1, 1, 1), "u1")))
    got = volumes.read_labels(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("heart", 4, 2, 2, 7)]
    wanted = spark.createDataFrame([("liver",)], "structure_id string")
    assert volumes.read_labels(spark, str(tmp_path), wanted).collect() == []
    with pytest.raises(ValueError):
        volumes.decode(label_file(labels)[:70] + b"\x10\0" + label_file(labels)[72:])


def test_volume_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    grid = rng.integers(-1000, 1000, (2, 3, 4)).astype("i2")
    rows = [(9, x, y, z, int(grid[z, y, x])) for z in range(2) for y in range(3) for x in range(4)]
    df = spark.createDataFrame(rows, "image long, x int, y int, z int, value int")
    packed = volumes.encode_volumes(df, "image", (4, 3, 2), (1.0, 2.0, 3.0), ((1, 0, 0), (0, 1, 0), (0, 0, 1)), (0.5, 0.5, 2.0))
    nifti.register(spark)
    packed.withColumnRenamed("image", "name").write.format("nifti").mode("append").save(str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["9.nii"]
    head, back = volumes.decode((tmp_path / "out" / "9.nii").read_bytes())
    assert head["dims"] == (4, 3, 2) and head["spacing"] == (0.5, 0.5, 2.0) and (back == grid).all()
    half = spark.createDataFrame([(0, 0, 0, 5), (1, 0, 0, 7)], "x int, y int, z int, raw int")
    assert sorted((r.x, r.value) for r in volumes.export_voxels(half, F.lit(0.5), F.lit(0.0), 2, 1).collect()) == [(0, 4), (1, 2)]


def test_nifti_source(spark, tmp_path):
    nifti.register(spark)
    labels = np.zeros((3, 4, 5), "u1")
    labels[2, 1, 0] = 7
    (tmp_path / "in" / "deeper").mkdir(parents=True)
    (tmp_path / "in" / "heart.nii.gz").write_bytes(gzip.compress(label_file(labels)))
    (tmp_path / "in" / "deeper" / "liver.v2.nii").write_bytes(label_file(labels * 2))
    read = spark.read.format("nifti").option("taskBytes", 1)
    got = read.load("file://" + str(tmp_path / "in"))
    assert got.rdd.getNumPartitions() == 2 and sorted(tuple(r) for r in got.collect()) == [("heart", 4, 2, 2, 7), ("liver", 4, 2, 2, 14)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in volumes.read_labels(spark, str(tmp_path / "in" / "*")).unionByName(volumes.read_labels(spark, str(tmp_path / "in"))).distinct().collect())
    assert [tuple(r) for r in read.option("flip", "false").option("structures", "liver, spleen").load(str(tmp_path / "in")).collect()] == [("liver", 0, 1, 2, 14)]
    out = str(tmp_path / "out")
    volume = lambda *names: spark.createDataFrame([(n, label_file(labels)) for n in names], "name string, content binary").repartition(3)
    volume("a", "b/c").write.format("nifti").mode("append").save(out)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.nii", "b_c.nii"]
    with pytest.raises(Exception, match="several volumes"):
        volume("a", "d").write.format("nifti").mode("append").save(out)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.nii", "b_c.nii"]
    volume("d").write.format("nifti").mode("overwrite").save(out)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d.nii"] and spark.read.format("nifti").load(out).count() == 1
    with pytest.raises(ValueError):
        nifti.mounted("hdfs://store/x")


def test_csv_export(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b;x", 0.25, float("nan")), (1, None, 1.0, 2.0)], "g int, k string, d double, e double")
    path = str(tmp_path / "csv")
    exports.write_csv(rows, path, "G;K;D;E", ["g", "k", "d", "e"], [F.col("g")])
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_bytes() == "﻿G;K;D;E\r\n1;;1;2\r\n2;b,x;0.25;\r\n".encode()
    with pytest.raises(ValueError):
        exports.write_csv(rows.limit(0), path + "2", "G", ["g"], [F.col("g")])
    assert exports.AUTO_HEADER.count(";") == 15 and exports.PAIR_HEADER.count(";") == 14


def test_named_exports(spark, tmp_path):
    metrics = {c: F.lit(0.5) for c in exports.METRIC_COLUMNS if c != "note"}
    rows = spark.createDataFrame([(1, "k", "g", "gs", "a", "as", None)], "group_no int, match_key string, gt_set string, gt_structure string, ai_set string, ai_structure string, note string").withColumns(metrics)
    exports.write_auto_csv(rows, str(tmp_path / "a"))
    exports.write_pair_csv(rows.withColumnRenamed("ai_structure", "cmp_structure").drop("gt_set", "ai_set"), str(tmp_path / "p"), "G", "C")
    links = spark.createDataFrame([(1, 2, "AI", "s", "b;c"), (1, 1, "GroundTruth", "m", "d")], "group_no int, member_no int, role string, set_id string, structure_id string")
    exports.write_link_csv(links, str(tmp_path / "l"))
    lines = {k: next((tmp_path / k).glob("part-*")).read_text(encoding="utf-8-sig").split("\n") for k in "apl"}
    assert lines["a"][1].strip() == "1;k;g;gs;a;as;" + "0.5;" * 9 and lines["p"][1].strip() == "k;G;gs;C;as;" + "0.5;" * 9
    assert [x.strip() for x in lines["l"][1:3]] == ["1;GroundTruth;m;d", "1;AI;s;b,c"]


def test_matching_rules(spark):
    rows = [("Manual", "Heart"), ("AutoA", "heart"), ("AutoB", "HEART "), ("Manual", "Heart_1"), ("AutoA", "Liver"), ("AutoB", "liver"), ("Manual", "Lung_L"), ("Replan", "lung sin")]
    df = spark.createDataFrame([(1, s, o, False, i) for i, (s, o) in enumerate(rows)], "patient_id long, set_id string, structure_id string, is_empty boolean, seq long")
    got = {(r.group_no, r.gt_structure, r.ai_set, r.note is None) for r in matching.auto_match(df).collect()}
    assert got == {(1, "Heart", "AutoA", True), (1, "Heart", "AutoB", True), (2, None, "AutoA", False), (2, None, "AutoB", False)}
    with pytest.raises(ValueError):
        matching.pair_match(df, "Manual", "Manual")


def test_file_drop(spark, tmp_path):
    def tool():
        while not (tmp_path / "command.txt").exists():
            time.sleep(0.02)
        (tmp_path / "done.txt").write_text("3 finished")

    threading.Thread(target=tool, daemon=True).start()
    assert filedrop.run(str(tmp_path), "segment", timeout_s=5, poll_s=0.02) == 3
    assert not filedrop.is_alive(str(tmp_path), timeout_s=0.1, poll_s=0.02)
    with pytest.raises(TimeoutError):
        filedrop.run(str(tmp_path), "segment", timeout_s=0.1, poll_s=0.02)


def test_result_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"job{k}.done").write_text(f"{k}\nlog line\n")
    query = filedrop.results(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("drops").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.job, r.exit_code) for r in spark.table("drops").collect()) == [("job0", 0), ("job1", 1), ("job2", 2)]
