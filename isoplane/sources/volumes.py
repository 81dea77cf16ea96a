"""NIfTI-1 volumes: reading label files as voxel rows, writing 16-bit volumes, and the export geometry."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: header size, data offset of a single file, and the codes of its two types.
HEADER, OFFSET, UINT8, INT16 = 348, 352, 2, 4


def header(content: bytes) -> dict:
    """The fields of a header that the readers need; ``content`` may be gzipped."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    order = "<" if struct.unpack_from("<i", content)[0] == HEADER else ">"
    dims = struct.unpack_from(order + "8h", content, 40)
    (datatype,) = struct.unpack_from(order + "h", content, 70)
    (offset,) = struct.unpack_from(order + "f", content, 108)
    return {
        "order": order, "dims": dims[1:4], "datatype": datatype, "offset": int(offset), "spacing": struct.unpack_from(order + "3f", content, 80),
        "description": content[148:228].split(b"\0")[0].decode("latin-1"), "data": content,
    }


def decode(content: bytes) -> tuple[dict, np.ndarray]:
    """Header and voxels in (z, y, x) order; raises on types other than 8-bit labels and 16-bit volumes."""
    head = header(content)
    kind = {UINT8: "u1", INT16: head["order"] + "i2"}.get(head["datatype"])
    if kind is None:
        raise ValueError(f"unsupported voxel type {head['datatype']}")
    nx, ny, nz = head["dims"]
    return head, np.frombuffer(head["data"], kind, nx * ny * nz, head["offset"]).reshape(nz, ny, nx)


def encode(voxels: np.ndarray, affine: np.ndarray, spacing: tuple[float, float, float], description: str = "") -> bytes:
    """A 16-bit single-file volume from voxels in (z, y, x) order and the first three rows of its affine matrix."""
    nz, ny, nx = voxels.shape
    out = bytearray(OFFSET)
    struct.pack_into("<i", out, 0, HEADER)
    struct.pack_into("<8h", out, 40, 3, nx, ny, nz, 1, 1, 1, 1)
    struct.pack_into("<2h", out, 70, INT16, 16)
    struct.pack_into("<8f", out, 76, 1.0, *spacing, 0, 0, 0, 0)
    struct.pack_into("<2f", out, 108, OFFSET, 1.0)
    out[123] = 2
    text = description.encode("latin-1", "replace")[:79]
    out[148 : 148 + len(text)] = text
    struct.pack_into("<2h", out, 252, 0, 1)
    struct.pack_into("<12f", out, 280, *np.asarray(affine, float)[:3].ravel())
    out[344:348] = b"n+1\0"
    return bytes(out) + voxels.astype("<i2").tobytes()


def affine(origin: tuple, directions: tuple, spacing: tuple) -> np.ndarray:
    """The 4 x 4 matrix from index to patient coordinates."""
    m = np.eye(4)
    m[:3, :3] = np.array(directions, float).T * np.array(spacing)
    m[:3, 3] = origin
    return m


def read_labels(spark: SparkSession, path: str, wanted: DataFrame | None = None, glob: str = "*.nii*", flip: bool = True) -> DataFrame:
    """Foreground voxels ``(structure_id, x, y, z, value)`` of the label files below ``path``.

    A file's structure is its name up to the first dot; with ``wanted`` (``structure_id``) only those are read, before
    their content is.  ``flip`` mirrors x and y, as label imports do.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    files = files.withColumn("structure_id", F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^([^.]*)", 1))
    if wanted is not None:
        files = files.join(wanted.select("structure_id").distinct(), "structure_id", "left_semi")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["structure_id"], pdf["content"]):
                _, voxels = decode(bytes(content))
                nz, ny, nx = voxels.shape
                for k in range(nz):
                    y, x = np.nonzero(voxels[k])
                    if len(x):
                        value = voxels[k, y, x].astype("int32")
                        yield pd.DataFrame({"structure_id": name, "x": nx - 1 - x if flip else x, "y": ny - 1 - y if flip else y, "z": k, "value": value}).astype({c: "int32" for c in "xyz"})

    return files.select("structure_id", "content").mapInPandas(unpack, "structure_id string, x int, y int, z int, value int")


def export_voxels(hu: DataFrame, slope: Column, intercept: Column, width: int, height: int) -> DataFrame:
    """Voxels as an exported volume holds them: rescaled, rounded half to even, x and y mirrored."""
    return hu.withColumn("value", F.bround(slope * F.col("raw") + intercept, 0).cast("int")).withColumn("x", F.lit(width - 1) - F.col("x")).withColumn("y", F.lit(height - 1) - F.col("y"))


def encode_volumes(voxels: DataFrame, key: str, shape: tuple[int, int, int], origin: tuple, directions: tuple, spacing: tuple) -> DataFrame:
    """``(key, content)``: each key's voxels (``x, y, z, value``) as one volume; a task holds one volume at a time."""
    nx, ny, nz = shape
    matrix = affine(origin, directions, spacing)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((nz, ny, nx), "<i2")
        grid[pdf["z"], pdf["y"], pdf["x"]] = pdf["value"]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [encode(grid, matrix, spacing)]})

    return voxels.select(key, "x", "y", "z", "value").groupBy(key).applyInPandas(pack, f"{key} {dict(voxels.dtypes)[key]}, content binary")
