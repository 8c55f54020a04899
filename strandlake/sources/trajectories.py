"""Trajectories: frames of coordinates and boxes as rows (path, frame, atom_idx, x, y, z) in angstrom.

DCD, TRR (uncompressed) and classic NetCDF. A frame is a row's array until exploded, so selecting frames or atoms early is cheap.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Frame = tuple[np.ndarray, np.ndarray | None, float | None]  # coordinates, box, time


def read_dcd(data: bytes) -> Iterator[Frame]:
    """Frames of a DCD file of either byte order; a unit cell gives the box lengths' diagonal or its full vectors."""
    order = "<" if struct.unpack_from("<i", data)[0] == 84 else ">"
    at = 0

    def record() -> bytes:
        nonlocal at
        size = struct.unpack_from(f"{order}i", data, at)[0]
        body = data[at + 4 : at + 4 + size]
        at += size + 8
        return body

    head = record()
    if head[:4] != b"CORD":
        raise ValueError("not a DCD file")
    icntrl = struct.unpack(f"{order}20i", head[4:84])
    has_cell, step = bool(icntrl[10]), struct.unpack(f"{order}f", head[40:44])[0]
    record()
    atoms = struct.unpack(f"{order}i", record())[0]
    count = 0
    while at < len(data):
        box = None
        if has_cell:
            a, gamma, b, beta, alpha, c = struct.unpack(f"{order}6d", record())
            box = _vectors(a, b, c, alpha, beta, gamma)
        xyz = np.stack([np.frombuffer(record(), f"{order}f4", atoms) for _ in range(3)], axis=1).astype(float)
        yield xyz, box, count * step
        count += 1


def _vectors(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    """Box vectors; angles in degrees, or as cosines where all are within one."""
    angles = np.array([alpha, beta, gamma])
    cos = angles if (np.abs(angles) <= 1).all() else np.cos(np.radians(angles))
    sin = np.sqrt(1 - cos[2] ** 2)
    x, y = c * cos[1], c * (cos[0] - cos[1] * cos[2]) / sin
    out = np.array([[a, 0, 0], [b * cos[2], b * sin, 0], [x, y, np.sqrt(max(0.0, c * c - x * x - y * y))]])
    return np.where(np.abs(out) < 1e-9, 0.0, out)


def write_dcd(frames: list[np.ndarray], step: float = 1.0) -> bytes:
    rec = lambda body: struct.pack("<i", len(body)) + body + struct.pack("<i", len(body))
    icntrl = struct.pack("<9i", len(frames), 0, 1, len(frames), 0, 0, 0, 0, 0) + struct.pack("<f", step) + struct.pack("<10i", *[0] * 9, 24)
    out = rec(b"CORD" + icntrl) + rec(struct.pack("<i", 1) + b"frames".ljust(80)) + rec(struct.pack("<i", len(frames[0])))
    for f in frames:
        out += b"".join(rec(np.ascontiguousarray(f[:, k], "<f4").tobytes()) for k in range(3))
    return out


def read_trr(data: bytes) -> Iterator[Frame]:
    """Frames of a TRR file: big-endian, nanometres, single or double precision."""
    at = 0
    while at < len(data):
        if struct.unpack_from(">i", data, at)[0] != 1993:
            raise ValueError("not a TRR frame")
        text = struct.unpack_from(">i", data, at + 8)[0]
        at += 12 + (text + 3) // 4 * 4
        sizes = struct.unpack_from(">13i", data, at)
        at += 52
        box_size, vir, pres, x_size, v_size, f_size, atoms = sizes[2], sizes[3], sizes[4], sizes[7], sizes[8], sizes[9], sizes[10]
        width = x_size // (3 * atoms) if x_size else box_size // 9
        real = {4: ">f4", 8: ">f8"}[width]
        time = float(np.frombuffer(data, real, 1, at)[0])
        at += 2 * width
        box = np.frombuffer(data, real, 9, at).reshape(3, 3).astype(float) * 10 if box_size else None
        at += box_size + vir + pres
        if x_size:
            yield np.frombuffer(data, real, 3 * atoms, at).reshape(-1, 3).astype(float) * 10, box, time
        at += x_size + v_size + f_size


def write_trr(frames: list[np.ndarray], box: np.ndarray | None = None, step: float = 1.0) -> bytes:
    out = b""
    for i, f in enumerate(frames):
        n, size = len(f), 0 if box is None else 36
        out += struct.pack(">ii", 1993, 13) + struct.pack(">i", 12) + b"GMX_trn_file" + struct.pack(">13i", 0, 0, size, 0, 0, 0, 0, 12 * n, 0, 0, n, i, 0) + struct.pack(">2f", i * step, 0)
        out += (b"" if box is None else (np.asarray(box) / 10).astype(">f4").tobytes()) + (f / 10).astype(">f4").tobytes()
    return out


_NETCDF = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def read_netcdf(data: bytes) -> Iterator[Frame]:
    """Frames of a classic NetCDF file with variables coordinates, and time and cell_lengths if there are."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a classic NetCDF file")
    at, wide = 4, data[3] == 2

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">i", data, at - 4)[0]

    def name() -> str:
        nonlocal at
        n = number()
        text = data[at : at + n].decode()
        at += (n + 3) // 4 * 4
        return text

    def attributes() -> None:
        nonlocal at
        number()
        for _ in range(number()):
            name()
            kind, n = number(), number()
            at += (np.dtype(_NETCDF[kind]).itemsize * n + 3) // 4 * 4

    records = number()
    number()
    dims = [(name(), number()) for _ in range(number())]
    attributes()
    number()
    variables = {}
    for _ in range(number()):
        key = name()
        shape = [dims[number()][1] for _ in range(number())]
        attributes()
        kind, size = number(), number()
        begin = struct.unpack_from(">q", data, at)[0] if wide else struct.unpack_from(">i", data, at)[0]
        at += 8 if wide else 4
        variables[key] = (shape, _NETCDF[kind], size, begin)
    stride = sum(v[2] for v in variables.values() if v[0][:1] == [0])

    def value(key: str, i: int) -> np.ndarray | None:
        if key not in variables:
            return None
        shape, kind, _, begin = variables[key]
        return np.frombuffer(data, kind, int(np.prod(shape[1:])), begin + i * stride).reshape(shape[1:]).astype(float)

    for i in range(records):
        lengths, angles, time = value("cell_lengths", i), value("cell_angles", i), value("time", i)
        box = None if lengths is None else _vectors(*lengths, *(angles if angles is not None else (90, 90, 90)))
        yield value("coordinates", i), box, None if time is None else float(time)


READERS = {"dcd": read_dcd, "trr": read_trr, "nc": read_netcdf, "netcdf": read_netcdf}
SCHEMA = "path string, frame int, time double, box array<array<double>>, xyz array<array<double>>"


def read_frames(spark: SparkSession, path: str, *, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """(path, frame, time, box, xyz) of the chosen frames; the format is that of each file's suffix."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in zip(part["path"], part["content"], strict=True):
                for i, (xyz, box, time) in enumerate(READERS[p.rsplit(".", 1)[-1].lower()](data)):
                    if stop is not None and i >= stop:
                        break
                    if i >= start and (i - start) % step == 0:
                        yield pd.DataFrame({"path": [p], "frame": [i], "time": [time], "box": [None if box is None else box.tolist()], "xyz": [xyz.tolist()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def coordinates(frames: DataFrame) -> DataFrame:
    """(path, frame, atom_idx, x, y, z)."""
    rows = frames.select("path", "frame", F.posexplode("xyz").alias("atom_idx", "_v"))
    return rows.select("path", "frame", "atom_idx", *[F.get("_v", F.lit(i)).alias(c) for i, c in enumerate("xyz")])
