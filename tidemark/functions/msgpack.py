"""MessagePack payloads with named maps, turned into the JSON text that the decoder reads.

One small function a value, run over Arrow batches.  The turn keeps what
strict decoding needs: repeated keys stay repeated, whole numbers stay whole,
binary becomes a list of numbers, and input after the value makes the text
null, as does anything that has no JSON form.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.history import History
from tidemark.shapes import Shape

_FIXED = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZED = {0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"), 0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"), 0xDC: (">H", "list"), 0xDD: (">I", "list"), 0xDE: (">H", "map"), 0xDF: (">I", "map")}


def to_json(data: bytes, wide: dict[str, bool]) -> str | None:
    """The JSON text of one value; ``wide`` are the paths of 128-bit integers, true if signed."""
    try:
        text, end = _value(data, 0, "", wide, 0)
    except (IndexError, struct.error, ValueError):
        return None
    return text if end == len(data) else None


def _value(data: bytes, at: int, path: str, wide: dict[str, bool], depth: int) -> tuple[str, int]:
    if depth > 200:
        raise ValueError("too deep")
    b = data[at]
    at += 1
    if b < 0x80 or b >= 0xE0:
        return str(b if b < 0x80 else b - 256), at
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: "null", 0xC2: "false", 0xC3: "true"}[b], at
    if b in _FIXED:
        (x,) = struct.unpack_from(_FIXED[b], data, at)
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError("not finite")
        return repr(x), at + struct.calcsize(_FIXED[b])
    if b < 0x90:
        kind, n = "map", b & 0x0F
    elif b < 0xA0:
        kind, n = "list", b & 0x0F
    elif b < 0xC0:
        kind, n = "str", b & 0x1F
    elif b in _SIZED:
        form, kind = _SIZED[b]
        (n,) = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
    else:
        raise ValueError("an extension or unused type")
    if kind in ("str", "bin"):
        raw, at = data[at : at + n], at + n
        if len(raw) != n:
            raise ValueError("cut short")
        if kind == "str":
            return json.dumps(raw.decode()), at
        if path in wide:
            if n != 16:
                raise ValueError("a 128-bit integer has 16 bytes")
            return str(int.from_bytes(raw, "big", signed=wide[path])), at
        return "[" + ",".join(map(str, raw)) + "]", at
    parts = []
    for _ in range(n):
        if kind == "map":
            key, at = _value(data, at, "", {}, depth + 1)
            if key[0] != '"':
                raise ValueError("a key is a text")
            value, at = _value(data, at, f"{path}.{json.loads(key)}", wide, depth + 1)
            parts.append(f"{key}:{value}")
        else:
            value, at = _value(data, at, f"{path}.*", wide, depth + 1)
            parts.append(value)
    return ("{%s}" if kind == "map" else "[%s]") % ",".join(parts), at


def wide_paths(shape: Shape, path: str = "") -> dict[str, bool]:
    """The paths of 128-bit integers in a shape."""
    if shape.kind in ("u128", "i128"):
        return {path: shape.kind == "i128"}
    out: dict[str, bool] = {}
    for m in shape.members:
        out |= wide_paths(m.shape, f"{path}.{m.name}")
    for s in shape.items:
        out |= wide_paths(s, path if shape.kind == "option" else f"{path}.*")
    for tag, _, s in shape.variants:
        if s is not None:
            out |= wide_paths(s, f"{path}.{tag}")
    return out


def payload_json(payload: Column, version: Column, history: History) -> Column:
    """The JSON text of MessagePack payloads, each by the fields of its version; null if it has none."""
    wide = {v: wide_paths(history.shape_at(v)) for v in history.retained_versions()}

    @F.pandas_udf("string")
    def turn(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, versions in batches:
            yield pd.Series([None if d is None or pd.isna(v) else to_json(bytes(d), wide.get(int(v), {})) for d, v in zip(data, versions, strict=True)], dtype=object)

    return turn(payload, version)
