"""Values of operator graphs as bytes: a tag, then the value, little-endian; and back.

In a table values have their own columns and types; this form is for single values of any type in one column.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TENSOR, _TOKENS, _SCHEMA, _TEXT, _DOUBLE, _LONG = range(1, 7)


class ValueFormatError(ValueError):
    pass


@dataclass(frozen=True)
class Tensor:
    shape: tuple[int, ...]
    data: tuple[float, ...]
    backend: str = "default"


@dataclass(frozen=True)
class Tokens:
    ids: tuple[int, ...]


@dataclass(frozen=True)
class Schema:
    json: str


def _sized(raw: bytes) -> bytes:
    return struct.pack("<Q", len(raw)) + raw


def to_bytes(value: Any) -> bytes:
    """A Tensor (single precision), Tokens, Schema, text, float or integer as bytes; other types are an error."""
    match value:
        case Tensor(shape, data, backend):
            if int(np.prod(shape, dtype=np.int64)) != len(data):
                raise ValueFormatError("a tensor's data do not fill its shape")
            return bytes([_TENSOR]) + _sized(backend.encode()) + _sized(np.array(shape, "<i8").tobytes()) + _sized(np.array(data, "<f4").tobytes())
        case Tokens(ids):
            return bytes([_TOKENS]) + _sized(np.array(ids, "<i4").tobytes())
        case Schema(json):
            return bytes([_SCHEMA]) + _sized(json.encode())
        case str():
            return bytes([_TEXT]) + _sized(value.encode())
        case bool():
            raise ValueFormatError("no value type for bool")
        case float():
            return bytes([_DOUBLE]) + struct.pack("<d", value)
        case int():
            return bytes([_LONG]) + struct.pack("<q", value)
    raise ValueFormatError(f"no value type for {type(value).__name__}")


def from_bytes(raw: bytes) -> Any:
    """The value of to_bytes(). Empty, cut or longer bytes and unknown tags are an error, whatever they hold."""
    if not raw:
        raise ValueFormatError("no bytes")
    at = 1

    def taken(n: int) -> bytes:
        nonlocal at
        if n > len(raw) - at:
            raise ValueFormatError("the bytes end too early")
        at += n
        return raw[at - n : at]

    sized = lambda: taken(struct.unpack("<Q", taken(8))[0])

    def numbers(kind: str) -> tuple:
        part = sized()
        if len(part) % np.dtype(kind).itemsize:
            raise ValueFormatError("a part of a number")
        return tuple(np.frombuffer(part, kind).tolist())

    try:
        match raw[0]:
            case 1:
                backend, shape, data = sized().decode(), numbers("<i8"), numbers("<f4")
                if min(shape, default=0) < 0 or int(np.prod(shape, dtype=np.int64)) != len(data):
                    raise ValueFormatError("a tensor's data do not fill its shape")
                out = Tensor(shape, data, backend)
            case 2:
                out = Tokens(numbers("<i4"))
            case 3:
                out = Schema(sized().decode())
            case 4:
                out = sized().decode()
            case 5:
                out = struct.unpack("<d", taken(8))[0]
            case 6:
                out = struct.unpack("<q", taken(8))[0]
            case _:
                raise ValueFormatError("unknown tag")
    except UnicodeDecodeError as e:
        raise ValueFormatError("not a text") from e
    if at != len(raw):
        raise ValueFormatError("bytes are left over")
    return out


def bytes_column(value: Column, kind: str) -> Column:
    """A column of one kind (see plans.graph.kind_of) as value bytes, in Arrow batches; null stays null."""
    make = {
        "text": str, "tokens": lambda v: Tokens(tuple(map(int, v))), "tensor": lambda v: Tensor((len(v),), tuple(map(float, v))), "number": float, "integer": int,
    }[kind]

    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or (kind in ("number", "integer") and pd.isna(v)) else to_bytes(make(v)))

    return encode(value)
