"""Level-5 MAT files: a header of 128 bytes, then tagged elements, most of them compressed.

Numeric and logical arrays come out as numpy arrays, in the file's order of columns; of other variables (cells, structs, text, sparse and complex arrays,
objects) the name of the class comes out. Files that are cut short or of another format raise ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Fixed values of the format: element types, and classes of arrays.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED = 14, 15
_CLASSES = {1: "cell", 2: "struct", 3: "object", 4: "char", 5: "sparse", 6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8", 16: "function", 17: "opaque"}
_COMPLEX = 0x0800


def _elements(data: bytes, order: str, padded: bool = True) -> Iterator[tuple[int, bytes]]:
    """(type, bytes) of the elements one after the other; inside arrays they are padded to eight bytes."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("the file is cut short")
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:  # a small element: its size and data share eight bytes
            kind, size, begin = kind & 0xFFFF, kind >> 16, at + 4
            after = at + 8
        else:
            begin = at + 8
            after = begin + size + (-size % 8 if padded and kind != _COMPRESSED else 0)
        if begin + size > len(data):
            raise ValueError("the file is cut short")
        yield kind, data[begin : begin + size]
        at = after


def _numbers(kind: int, raw: bytes, order: str) -> np.ndarray:
    if kind not in _TYPES:
        raise ValueError(f"an element of type {kind} holds no numbers")
    return np.frombuffer(raw, dtype=order + _TYPES[kind])


def _variable(data: bytes, order: str) -> tuple[str, np.ndarray | str] | None:
    parts = list(_elements(data, order))
    if len(parts) < 3:
        raise ValueError("an array without its parts")
    flags = int(_numbers(*parts[0], order)[0])
    name = parts[2][1].decode("ascii", "replace")
    kind = _CLASSES.get(flags & 0xFF, "unknown")
    if flags & 0xFF not in range(6, 16):
        # Opaque objects put their names elsewhere.
        return (name if kind != "opaque" else "opaque", kind)
    if flags & _COMPLEX:
        return name, "complex"
    shape = _numbers(*parts[1], order).astype(np.int64)
    values = _numbers(*parts[3], order).astype(kind)
    if len(values) != shape.prod():
        raise ValueError(f"{name} has {len(values)} of {shape.prod()} values")
    return name, values.reshape(shape, order="F")


def variables(data: bytes) -> Iterator[tuple[str, np.ndarray | str]]:
    """(name, array or the name of its class) of each variable."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level-5 MAT file")
    order = "<" if data[126:128] == b"IM" else ">"
    for kind, raw in _elements(data[128:], order):
        if kind == _COMPRESSED:
            try:
                raw = zlib.decompress(raw)
            except zlib.error as e:
                raise ValueError(f"a compressed variable is damaged: {e}") from e
            kind, raw = next(_elements(raw, order), (0, b""))
        if kind == _MATRIX:
            found = _variable(raw, order)
            if not found[0].startswith("__") and found[0]:
                yield found
