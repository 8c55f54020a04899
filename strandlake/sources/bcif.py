"""BinaryCIF: MessagePack trees of encoded columns, read without other libraries."""

from __future__ import annotations

import struct

import numpy as np

from strandlake.operators.encodings import decode, encode

_FIXED = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZED = {0xC4: (1, "bin"), 0xC5: (2, "bin"), 0xC6: (4, "bin"), 0xD9: (1, "str"), 0xDA: (2, "str"), 0xDB: (4, "str"), 0xDC: (2, "arr"), 0xDD: (4, "arr"), 0xDE: (2, "map"), 0xDF: (4, "map")}


def unpack(data: bytes):
    """The value of a MessagePack text."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        if at > len(data):
            raise ValueError("the data ends within a value")
        return data[at - n : at]

    def group(kind: str, n: int):
        if kind == "str":
            return take(n).decode()
        if kind == "bin":
            return take(n)
        if kind == "arr":
            return [value() for _ in range(n)]
        return {value(): value() for _ in range(n)}

    def value():
        tag = take(1)[0]
        if tag < 0x80:
            return tag
        if tag >= 0xE0:
            return tag - 256
        if tag < 0x90:
            return group("map", tag & 15)
        if tag < 0xA0:
            return group("arr", tag & 15)
        if tag < 0xC0:
            return group("str", tag & 31)
        if tag in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[tag]
        if tag in _FIXED:
            form = _FIXED[tag]
            return struct.unpack(form, take(struct.calcsize(form)))[0]
        if tag in _SIZED:
            size, kind = _SIZED[tag]
            return group(kind, int.from_bytes(take(size), "big"))
        raise ValueError(f"unsupported MessagePack tag {tag:#x}")

    return value()


def pack(value) -> bytes:
    """MessagePack of None, booleans, integers, floats, text, bytes, lists and dictionaries."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, (int, np.integer)):
        value = int(value)
        if -32 <= value < 128:
            return struct.pack("b", value) if value < 0 else bytes([value])
        return b"\xd3" + struct.pack(">q", value)
    if isinstance(value, (float, np.floating)):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return b"\xdb" + struct.pack(">I", len(raw)) + raw
    if isinstance(value, (bytes, bytearray)):
        return b"\xc6" + struct.pack(">I", len(value)) + bytes(value)
    if isinstance(value, (list, tuple)):
        return b"\xdd" + struct.pack(">I", len(value)) + b"".join(map(pack, value))
    if isinstance(value, dict):
        return b"\xdf" + struct.pack(">I", len(value)) + b"".join(pack(k) + pack(v) for k, v in value.items())
    raise TypeError(type(value))


def parse(data: bytes) -> dict:
    """Block to category to column to values, None where masked."""
    out = {}
    for block in unpack(data)["dataBlocks"]:
        categories = out[block["header"]] = {}
        for category in block["categories"]:
            columns = categories[category["name"].lstrip("_")] = {}
            for column in category["columns"]:
                values = decode(column["data"]["data"], column["data"]["encoding"]).tolist()
                mask = column.get("mask")
                if mask:
                    hidden = decode(mask["data"], mask["encoding"])
                    values = [None if m else v for v, m in zip(values, hidden, strict=True)]
                columns[column["name"]] = values
    return out


def _bytes(data: np.ndarray) -> tuple[bytes, dict]:
    code = {"i1": 1, "i2": 2, "i4": 3, "u1": 4, "u2": 5, "u4": 6, "f4": 32, "f8": 33}[data.dtype.str[1:]]
    return data.astype(data.dtype.newbyteorder("<")).tobytes(), {"kind": "ByteArray", "type": code}


def _integers(data: np.ndarray) -> tuple[bytes, list[dict]]:
    """The smallest of plain, delta, run-length and packed forms of integers."""
    data = np.asarray(data, np.int64)
    best = None
    for chain in ((), ("Delta",), ("RunLength",), ("Delta", "RunLength")):
        steps, now = [], data
        for kind in chain:
            now, step = encode(now, kind)
            steps.append(step)
        for size in (1, 2, 4):
            if size == 4:
                raw, step = _bytes(now.astype(np.int32))
                whole = [*steps, step]
            else:
                if len(now) and np.abs(now).max() > 50 * (1 << 8 * size):
                    continue
                packed, step = encode(now, "IntegerPacking", size=size)
                raw, last = _bytes(packed)
                whole = [*steps, step, last]
            if best is None or len(raw) < len(best[0]):
                best = raw, whole
    return best


def encode_column(values: list) -> dict:
    """A column's data and mask: integers, floats (exact) or text."""
    masked = np.array([v is None for v in values], np.uint8) * 2
    known = [v for v in values if v is not None]
    if known and all(isinstance(v, (int, np.integer)) and not isinstance(v, bool) for v in known):
        raw, chain = _integers(np.array([0 if v is None else v for v in values]))
    elif known and all(isinstance(v, (float, int, np.floating)) for v in known):
        data, step = _bytes(np.array([0.0 if v is None else v for v in values], np.float64))
        raw, chain = data, [step]
    else:
        words = list(dict.fromkeys(str(v) for v in known))
        place = {w: i for i, w in enumerate(words)}
        index, index_chain = _integers(np.array([-1 if v is None else place[str(v)] for v in values]))
        offsets, offset_chain = _integers(np.cumsum([0, *map(len, words)]))
        raw, chain = index, [{"kind": "StringArray", "dataEncoding": index_chain, "stringData": "".join(words), "offsetEncoding": offset_chain, "offsets": offsets}]
    mask = None
    if masked.any():
        data, steps = _integers(masked)
        mask = {"data": data, "encoding": steps}
    return {"data": {"data": raw, "encoding": chain}, "mask": mask}


def text(blocks: dict) -> bytes:
    """The file of blocks, the reverse of ``parse``."""
    made = [
        {"header": name, "categories": [{"name": f"_{c}", "rowCount": len(next(iter(cols.values()), [])), "columns": [{"name": k, **encode_column(v)} for k, v in cols.items()]} for c, cols in cats.items()]}
        for name, cats in blocks.items()
    ]
    return pack({"version": "0.3.0", "encoder": "strandlake", "dataBlocks": made})
