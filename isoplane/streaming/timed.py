"""Many jobs of an external tool at once, each with a time limit: a stream of commands meets a stream of results.

A job's state is a place in the arrays of its bucket, so that a call decides many jobs at a time; its deadline is event time, so
limits follow the times that commands and results carry, not the speed of the stream, and a restarted stream decides as an
uninterrupted one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups that jobs are dealt to by hash; part of a checkpoint's layout.
BUCKETS = 1024

#: Of each job in a bucket; an unknown time is ``_NONE``, and so is the code of a failure without one.
_STATE = "job array<string>, issued array<long>, ended array<long>, code array<long>, closed array<boolean>, deadline array<long>"
_KINDS = {"issued": "int64", "ended": "int64", "code": "int64", "closed": "bool", "deadline": "int64"}
_NONE = np.iinfo(np.int64).max
OUTCOMES = "job string, outcome string, exit_code int, seconds double"


def _met(known: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
    """The jobs of a bucket after new events: of each the first command, and the first result with the smallest code at its time."""
    asks = pdf["asks"].to_numpy(bool)
    asked = pdf[asks].groupby("job")["ms"].min()
    told = pdf[~asks].assign(code=pdf["exit_code"].astype("Int64").fillna(_NONE).astype("int64")).sort_values(["ms", "code"]).drop_duplicates("job").set_index("job")
    new = pd.Index(pdf["job"].unique()).difference(known.index, sort=False)
    blank = {"issued": _NONE, "ended": _NONE, "code": _NONE, "closed": False, "deadline": 0, "due": False}
    found = pd.concat([known, pd.DataFrame(blank, index=new)]) if len(new) else known
    at = found.index.get_indexer(asked.index)
    found.iloc[at, found.columns.get_loc("issued")] = np.minimum(found["issued"].to_numpy()[at], asked.to_numpy())
    at = found.index.get_indexer(told.index)
    ended, code = found["ended"].to_numpy()[at], found["code"].to_numpy()[at]
    first = (told["ms"].to_numpy() < ended) | ((told["ms"].to_numpy() == ended) & (told["code"].to_numpy() < code))
    found.iloc[at[first], found.columns.get_loc("ended")] = told["ms"].to_numpy()[first]
    found.iloc[at[first], found.columns.get_loc("code")] = told["code"].to_numpy()[first]
    found.iloc[found.index.get_indexer(pdf["job"].unique()), found.columns.get_loc("due")] = True
    return found


def outcomes(commands: DataFrame, results: DataFrame, limit_s: float = 1800, delay: str = "10 seconds") -> DataFrame:
    """One row ``(job, outcome, exit_code, seconds)`` for each job of the streams ``commands`` (``job, issued``) and ``results``
    (``job, ended, exit_code``), once it is decided.

    * *done*, *failed*: the first result, within ``limit_s`` seconds of the first command; an exit code other than 0, or none
      that could be read, is a failure (of several at one time the smallest code counts);
    * *timed out*: no result within the limit, as soon as the watermark (``delay`` behind the latest time seen) is past it; a
      result that comes later than that changes nothing;
    * *unknown*: a result without a command within the limit.

    A result may arrive before its command.  A decided job is remembered for another limit, so repeated results and commands
    do not count as new ones; after that its name can be used again (and a result that is later still is *unknown*).  Rows without a job or a time are left out.
    """
    limit = int(limit_s * 1000)

    def millis(name: str):
        return F.unix_millis(F.col(name).cast("timestamp")).alias("ms")

    asked = commands.select("job", F.col("issued").cast("timestamp").alias("at"), millis("issued"), F.lit(True).alias("asks"), F.lit(None).cast("int").alias("exit_code"))
    told = results.select("job", F.col("ended").cast("timestamp").alias("at"), millis("ended"), F.lit(False).alias("asks"), F.col("exit_code").cast("int"))
    events = asked.unionByName(told).where("job is not null and at is not null").withWatermark("at", delay)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = state.get if state.exists else ([], *([] for _ in _KINDS))
        jobs = pd.DataFrame({n: np.array(v, kind) for (n, kind), v in zip(_KINDS.items(), held[1:])}, index=pd.Index(held[0], dtype=object)).assign(due=False)
        for pdf in frames if not state.hasTimedOut else ():
            jobs = _met(jobs, pdf)
        fresh = jobs["due"].to_numpy()  # those with events take their deadlines afterwards
        late = ~fresh & (jobs["deadline"].to_numpy() < now)
        jobs, fresh, late = (v[~(late & jobs["closed"].to_numpy())] for v in (jobs, fresh, late))
        issued, ended, code, closed = (jobs[c].to_numpy() for c in ("issued", "ended", "code", "closed"))
        asked, told = issued < _NONE, ended < _NONE
        start, took = np.where(asked, issued, ended), np.where(asked & told, ended - issued, 0)
        found = (fresh | late) & ~closed & ((asked & told) | late | (start + limit <= now))
        slow = asked & ~(told & (took <= limit))
        names = np.select([slow, ~asked, code == 0], ["timed out", "unknown", "done"], "failed")
        seconds = np.where(slow, limit / 1000, np.where(asked, took / 1000, np.nan))
        out = pd.DataFrame({"job": jobs.index, "outcome": names, "exit_code": pd.array(code, "Int64"), "seconds": seconds})
        out.loc[slow | (code == _NONE), "exit_code"] = pd.NA
        closed = closed | found
        # a decided job waits another limit
        last = np.maximum(np.where(asked, issued, ended), np.where(told, ended, issued))
        wait = np.maximum(now + 1, np.where(closed, last + 2 * limit, start + limit))
        jobs = jobs.assign(closed=closed, deadline=np.where(fresh | late, wait, jobs["deadline"].to_numpy()))
        if len(jobs):
            state.update((jobs.index.tolist(), *(jobs[c].tolist() for c in _KINDS)))
            state.setTimeoutTimestamp(int(jobs["deadline"].min()))
        else:
            state.remove()
        if found.any():
            yield out[found].astype({"exit_code": "Int32"})

    dealt = events.withColumn("bucket", F.pmod(F.xxhash64("job"), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").applyInPandasWithState(step, OUTCOMES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def result_files(spark, folder: str) -> DataFrame:
    """The results of ``filedrop`` as ``(job, ended, exit_code)``: a file ends a job when it was written."""
    files = spark.readStream.schema("value string").option("pathGlobFilter", "*.done").text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    code = F.regexp_extract("value", r"^\s*(-?[0-9]+)", 1).try_cast("int")
    return files.select(F.regexp_replace(name, r"\.done$", "").alias("job"), F.col("_metadata.file_modification_time").alias("ended"), code.alias("exit_code"))
