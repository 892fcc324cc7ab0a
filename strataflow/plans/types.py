"""Types of operator graphs, their order and their meet, for single values and as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TensorType:
    shape: tuple[int, ...] = ()  # -1: any
    dtype: str = "F32"
    device: str = "CPU"


@dataclass(frozen=True)
class TokensType:
    vocab_id: str = ""
    max_len: int = 0
    model_family: str = ""


@dataclass(frozen=True)
class SchemaType:
    canonical_json: str = ""
    schema_hash: int = 0


@dataclass(frozen=True)
class EffectType:
    bits: int = 0


Type = TensorType | TokensType | SchemaType | EffectType
# The Spark type of each element type; halves are floats with a note in the column's metadata.
SPARK_TYPES = {"F32": "float", "F16": "float", "BF16": "float", "I32": "int", "I64": "bigint", "U8": "smallint", "Bool": "boolean"}


def is_subtype(a: Type, b: Type) -> bool:
    match a, b:
        case TensorType(), TensorType():
            return a.dtype == b.dtype and a.device == b.device and len(a.shape) == len(b.shape) and all(y in (-1, x) for x, y in zip(a.shape, b.shape, strict=True))
        case TokensType(), TokensType():
            return (a.vocab_id, a.model_family) == (b.vocab_id, b.model_family) and a.max_len <= b.max_len
        case SchemaType(), SchemaType():
            return a == b
        case EffectType(), EffectType():
            return a.bits & b.bits == a.bits
    return False


def meet(a: Type, b: Type) -> Type:
    """The type of what fits both; of different kinds no effect at all."""
    match a, b:
        case TensorType(), TensorType():
            one = lambda x, y: x if x == y else y if x == -1 else x if y == -1 else -1
            shape = tuple(one(x, y) for x, y in zip(a.shape, b.shape, strict=True)) if len(a.shape) == len(b.shape) else ()
            return TensorType(shape, a.dtype if a.dtype == b.dtype else "F32", a.device if a.device == b.device else "CPU")
        case TokensType(), TokensType():
            same = (a.vocab_id, a.model_family) == (b.vocab_id, b.model_family)
            return TokensType(a.vocab_id, min(a.max_len, b.max_len), a.model_family) if same else TokensType()
        case SchemaType(), SchemaType():
            return a if a == b else SchemaType()
        case EffectType(), EffectType():
            return EffectType(a.bits & b.bits)
    return EffectType(0)


def shape_is_subtype(a: Column, b: Column) -> Column:
    """Whether one array of dimensions fits another, in which -1 stands for any."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (y == -1) | (x == y)), lambda ok: ok)


def shape_meet(a: Column, b: Column) -> Column:
    one = lambda x, y: F.when(x == y, x).when(x == -1, y).when(y == -1, x).otherwise(F.lit(-1))
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, one)).otherwise(F.array().cast("array<bigint>"))
