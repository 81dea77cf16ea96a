import datetime as dt

from isoplane.streaming import timed

START = dt.datetime(2024, 5, 1, 12, 0, 0)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_late_missing_failing_and_unknown_jobs(spark, tmp_path):
    """Three runs of one stream over growing folders; limits are 60 seconds of event time."""
    inputs = {"commands": "job string, issued timestamp", "results": "job string, ended timestamp, exit_code int"}
    told = []

    def put(kind, *rows):
        spark.createDataFrame(list(rows), inputs[kind]).coalesce(1).write.mode("append").parquet(str(tmp_path / kind))

    def run():
        streams = [spark.readStream.schema(inputs[k]).parquet(str(tmp_path / k)) for k in ("commands", "results")]
        found = timed.outcomes(*streams, limit_s=60, delay="5 seconds")
        before = len(told)

        def keep(batch, number):
            told.extend((r.job, r.outcome, r.exit_code, r.seconds) for r in batch.collect())

        query = found.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(told[before:])

    put("commands", ("good", at(0)), ("bad", at(1)), ("slow", at(2)), ("never", at(3)), ("mute", at(5)), (None, at(0)))
    put("results", ("good", at(20), 0), ("good", at(21), 9), ("early", at(30), 0), ("stray", at(11), 3))
    first = run()
    assert first == [("good", "done", 0, 20.0)]
    put("commands", ("early", at(26)), ("later", at(300)))
    put("results", ("bad", at(30), 2), ("mute", at(33), None))
    second = run()
    put("commands", ("last", at(1000)), ("at once", at(400)))
    put("results", ("slow", at(298), 0), ("later", at(310), 0), ("at once", at(490), 0))
    third = run()
    every = first + second + third
    assert len({job for job, *_ in every}) == len(every)  # one decision each
    got = {job: rest for job, *rest in every}
    assert got["never"] == ["timed out", None, 60.0] and got["slow"] == ["timed out", None, 60.0]
    assert got["bad"] == ["failed", 2, 29.0] and got["mute"] == ["failed", None, 28.0] and got["early"] == ["done", 0, 4.0] and got["at once"] == ["timed out", None, 60.0]
    assert got["stray"] == ["unknown", 3, None] and got["later"] == ["done", 0, 10.0]
    assert "last" not in got


def test_failing_jobs_and_order_of_arrival(spark, tmp_path):
    commands = [("a", at(10)), ("b", at(10)), ("c", at(10)), ("a", at(12))]
    results = [("a", at(15), 1), ("b", at(16), None), ("c", at(70), 0), ("c", at(71), 5)]
    spark.createDataFrame(commands, "job string, issued timestamp").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame(results, "job string, ended timestamp, exit_code int").write.parquet(str(tmp_path / "r"))
    found = timed.outcomes(spark.readStream.schema("job string, issued timestamp").parquet(str(tmp_path / "c")), spark.readStream.schema("job string, ended timestamp, exit_code int").parquet(str(tmp_path / "r")), limit_s=60)
    query = found.writeStream.format("memory").queryName("timed_jobs").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("timed_jobs").collect()) == [("a", "failed", 1, 5.0), ("b", "failed", None, 6.0), ("c", "done", 0, 60.0)]


def test_result_files(spark, tmp_path):
    (tmp_path / "job 7.done").write_text(" -3 ended\n")
    query = timed.result_files(spark, str(tmp_path)).writeStream.format("memory").queryName("result_files").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    (row,) = spark.table("result_files").collect()
    assert row.exit_code == -3 and row.job.replace("%20", " ") == "job 7" and row.ended is not None


def test_many_jobs_share_few_states(spark, tmp_path):
    """A call for each job took the time; a bucket's jobs are decided at once, each as if it were alone."""
    jobs = 3000
    commands = spark.range(jobs).selectExpr("concat('j', id) as job", "timestamp'2024-05-01 12:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 50) as issued")
    results = spark.range(jobs).where("id % 3 > 0").selectExpr("concat('j', id) as job", "timestamp'2024-05-01 12:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 50 + id % 70) as ended", "cast(id % 2 as int) as exit_code")
    commands.write.parquet(str(tmp_path / "c"))
    results.write.parquet(str(tmp_path / "r"))
    found = timed.outcomes(spark.readStream.schema(commands.schema).parquet(str(tmp_path / "c")), spark.readStream.schema(results.schema).parquet(str(tmp_path / "r")), limit_s=60)
    query = found.writeStream.format("memory").queryName("many_jobs").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.job: (r.outcome, r.exit_code, r.seconds) for r in spark.table("many_jobs").collect()}
    for k in range(jobs):
        if k % 3:
            assert got[f"j{k}"] == (("timed out", None, 60.0) if k % 70 > 60 else ("failed" if k % 2 else "done", k % 2, float(k % 70)))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= timed.BUCKETS
