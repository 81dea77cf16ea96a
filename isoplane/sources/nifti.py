"""Volumes as a data source: ``spark.read.format("nifti")`` and ``df.write.format("nifti")``, after ``register(spark)``.

Reading gives the voxels other than 0 of every ``*.nii`` and ``*.nii.gz`` file below a path, as ``(structure_id, x, y, z, value)``;
files are dealt to tasks by size, and a task sends on one slice at a time.  Writing takes ``(name, content)`` rows, as
``volumes.encode_volumes`` makes them: each task writes its files beside their place, and the commit moves them there, so a failed
job leaves nothing and no content passes the driver.

Options of the reader: ``flip`` (default true) mirrors x and y as label imports do; ``structures``, a comma-separated list,
picks files by their name up to the first dot before they are opened; ``taskBytes``
are the bytes of files for a task.  The files are opened by the tasks themselves, so the
path must be one that all machines have mounted; ``volumes.read_labels`` reads through Spark's file systems instead.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .volumes import decode

#: Bytes of files that one reading task takes, at least one file.
TASK_BYTES = 64 << 20


def mounted(path: str) -> str:
    """The plain path of a ``file:`` URL; other schemes are refused."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"nifti files are opened by the tasks: {path} is not a mounted path")
    return unquote(found.path) if found.scheme else path


@dataclass
class Files(InputPartition):
    paths: list[str]


class NiftiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = mounted(options["path"])
        self.flip = options.get("flip", "true").lower() != "false"
        names = options.get("structures")
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.wanted = None if names is None else {n.strip() for n in names.split(",")}

    def partitions(self) -> list[Files]:
        found = []
        for folder, folders, names in os.walk(self.path):
            folders[:] = [f for f in folders if not f.startswith(("_", "."))]  # what a writer has not committed
            for name in names:
                if name.endswith((".nii", ".nii.gz")) and (self.wanted is None or name.split(".")[0] in self.wanted):
                    found.append(os.path.join(folder, name))
        tasks, size = [Files([])], 0
        for path in sorted(found):
            own = os.path.getsize(path)
            if tasks[-1].paths and size + own > self.task_bytes:
                tasks, size = [*tasks, Files([])], 0
            tasks[-1].paths.append(path)
            size += own
        return tasks

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            with open(path, "rb") as file:
                _, voxels = decode(file.read())
            nz, ny, nx = voxels.shape
            for k in range(nz):
                y, x = np.nonzero(voxels[k])
                if len(x):
                    at = (nx - 1 - x, ny - 1 - y) if self.flip else (x, y)
                    columns = [*at, np.full(len(x), k), voxels[k, y, x]]
                    name = pa.array([os.path.basename(path).split(".")[0]] * len(x))
                    yield pa.RecordBatch.from_arrays([name, *[pa.array(c.astype(np.int32)) for c in columns]], names=["structure_id", "x", "y", "z", "value"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class NiftiWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = mounted(options["path"]), overwrite
        self.beside = os.path.join(self.path, "_writing-" + uuid.uuid4().hex)

    def write(self, rows: Iterator) -> Written:
        files = []
        for row in rows:
            os.makedirs(self.beside, exist_ok=True)
            name = "".join(c if c.isalnum() or c in "_-" else "_" for c in str(row["name"])) + ".nii"
            here = os.path.join(self.beside, uuid.uuid4().hex)
            with open(here, "wb") as file:
                file.write(row["content"])
            files.append((here, name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        os.makedirs(self.path, exist_ok=True)
        old = [n for n in os.listdir(self.path) if n.endswith(".nii")]
        if double := sorted({n for n in names if names.count(n) > 1} | (set() if self.overwrite else set(names) & set(old))):
            self.abort(messages)
            raise ValueError(f"several volumes for {', '.join(double[:5])}")
        for name in old if self.overwrite else ():
            os.remove(os.path.join(self.path, name))
        for here, name in files:
            os.replace(here, os.path.join(self.path, name))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.beside, ignore_errors=True)


class NiftiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return "structure_id string, x int, y int, z int, value int"

    def reader(self, schema) -> NiftiReader:
        return NiftiReader(self.options)

    def writer(self, schema, overwrite: bool) -> NiftiWriter:
        return NiftiWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NiftiSource)
