"""Column encodings of binary structure files, as relational operators and as kernels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delta(rows: DataFrame, *, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds ``delta``: the difference to the value before; the first keeps its value."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("delta", (F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))).cast("long"))


def run_length(rows: DataFrame, *, by: Sequence[str], order: str, value: str) -> DataFrame:
    """(by…, start, value, n): runs of equal values of a gapless order."""
    island = F.col(order) - F.row_number().over(Window.partitionBy(*by, value).orderBy(order))
    runs = rows.withColumn("_island", island).groupBy(*by, value, "_island").agg(F.min(order).alias("start"), F.count("*").alias("n"))
    return runs.select(*by, "start", value, "n")


def undo_delta(rows: DataFrame, *, by: Sequence[str], order: str, value: str = "delta", name: str = "value") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(value).over(w))


# Kernels: one array in, one out -----------------------------------------------------------

#: Type codes of byte arrays.
BYTE_TYPES = {1: "<i1", 2: "<i2", 3: "<i4", 4: "<u1", 5: "<u2", 6: "<u4", 32: "<f4", 33: "<f8"}


def decode(data: bytes | np.ndarray, encoding: list[dict]) -> np.ndarray:
    """Undo a chain of encodings, the last one first."""
    for step in reversed(encoding):
        kind = step["kind"]
        if kind == "ByteArray":
            data = np.frombuffer(data, BYTE_TYPES[step["type"]])
        elif kind == "FixedPoint":
            data = (data / step["factor"]).astype(BYTE_TYPES[step.get("srcType", 33)])
        elif kind == "IntervalQuantization":
            data = step["min"] + data * ((step["max"] - step["min"]) / (step["numSteps"] - 1))
        elif kind == "RunLength":
            data = np.repeat(data[::2], data[1::2])
        elif kind == "Delta":
            data = np.cumsum(data, dtype=np.int64) + step.get("origin", 0)
        elif kind == "IntegerPacking":
            data = _unpack(np.asarray(data), step["byteCount"], step.get("isUnsigned", False))
        elif kind == "StringArray":
            index = decode(data, step["dataEncoding"])
            offsets = decode(step["offsets"], step["offsetEncoding"])
            text = step["stringData"]
            words = np.array([text[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], object)
            data = np.array([None if i < 0 else words[i] for i in index], object)
        else:
            raise ValueError(f"unknown encoding {kind}")
    return data


def _unpack(data: np.ndarray, size: int, unsigned: bool) -> np.ndarray:
    """Values packed in small integers: the extremes of the small type say that the value goes on."""
    high = (1 << 8 * size) - 1 if unsigned else (1 << 8 * size - 1) - 1
    low = None if unsigned else -(1 << 8 * size - 1)
    data = data.astype(np.int64)
    goes_on = data == high
    if low is not None:
        goes_on |= data == low
    starts = np.flatnonzero(np.r_[True, ~goes_on[:-1]]) if len(data) else np.zeros(0, int)
    return np.add.reduceat(data, starts) if len(data) else data


def pack(data: np.ndarray, size: int, unsigned: bool = False) -> np.ndarray:
    """The reverse of unpacking."""
    high = (1 << 8 * size) - 1 if unsigned else (1 << 8 * size - 1) - 1
    low = 0 if unsigned else -(1 << 8 * size - 1)
    out = []
    for v in data.tolist():
        edge = high if v >= 0 else low
        while v >= high or (not unsigned and v <= low):
            out.append(edge)
            v -= edge
        out.append(v)
    return np.array(out, f"<{'u' if unsigned else 'i'}{size}")


def encode(data: np.ndarray, kind: str, **options) -> tuple[np.ndarray, dict]:
    """One encoding step and its description."""
    if kind == "FixedPoint":
        return np.round(data * options["factor"]).astype(np.int32), {"kind": kind, "factor": options["factor"], "srcType": 33}
    if kind == "Delta":
        return np.diff(data, prepend=0).astype(np.int32), {"kind": kind, "origin": 0, "srcType": 3}
    if kind == "RunLength":
        starts = np.flatnonzero(np.r_[True, data[1:] != data[:-1]]) if len(data) else np.zeros(0, int)
        lengths = np.diff(np.r_[starts, len(data)])
        return np.stack([data[starts], lengths], axis=1).ravel().astype(np.int32), {"kind": kind, "srcType": 3, "srcSize": len(data)}
    if kind == "IntegerPacking":
        size, unsigned = options["size"], options.get("unsigned", bool((data >= 0).all()))
        return pack(data, size, unsigned), {"kind": kind, "byteCount": size, "srcSize": len(data), "isUnsigned": unsigned}
    raise ValueError(f"unknown encoding {kind}")
