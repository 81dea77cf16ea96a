"""Talking to an external tool through a folder: a command file goes in, a result file with an exit code comes out."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run(folder: str, command: str, timeout_s: float = 1800, poll_s: float = 0.5) -> int:
    """Leave a command and wait for its exit code; raises ``TimeoutError`` after ``timeout_s``."""
    place = Path(folder)
    (place / "done.txt").unlink(missing_ok=True)
    (place / "command.txt").write_text(command)
    return int(_wait(place / "done.txt", timeout_s, poll_s).split()[0])


def is_alive(folder: str, timeout_s: float = 10, poll_s: float = 0.25) -> bool:
    """Whether the tool answers a ping file with a pong file."""
    place = Path(folder)
    (place / "pong.txt").unlink(missing_ok=True)
    (place / "ping.txt").write_text("ping")
    try:
        _wait(place / "pong.txt", timeout_s, poll_s)
    except TimeoutError:
        (place / "ping.txt").unlink(missing_ok=True)  # no stale ping for the next check
        return False
    return True


def _wait(path: Path, timeout_s: float, poll_s: float) -> str:
    end = time.monotonic() + timeout_s
    while time.monotonic() < end:
        if path.exists() and (text := path.read_text()).strip():
            path.unlink()
            return text
        time.sleep(poll_s)
    raise TimeoutError(path.name)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the exit codes of many tools, from result files ``<job>.done`` that appear below ``folder``."""
    files = spark.readStream.schema("value string").option("pathGlobFilter", "*.done").text(folder, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return files.select(F.regexp_replace(name, r"\.done$", "").alias("job"), F.regexp_extract("value", r"^\s*(-?[0-9]+)", 1).try_cast("int").alias("exit_code"))
