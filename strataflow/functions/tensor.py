"""Tensor operators over array<float> columns; a tensor of more dimensions is struct<shape, data>.

Shapes are strict: binary operators take equal lengths and fail otherwise, because zip_with alone would pad
with nulls. Broadcasting of a single element is an option of `add`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.functions.text import let

UNARY = {"input", "identity", "id", "relu", "softmax"}
BINARY = {"add", "mul", "matmul"}


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).when(F.size(a) != F.size(b), F.raise_error(F.lit("tensor shapes differ")))


def identity(a: Column) -> Column:
    return a


def const(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0).cast("float")))


def softmax(a: Column) -> Column:
    """exp(x - max) over its sum, in double precision inside."""
    grown = lambda top: F.transform(a, lambda x: F.exp(x.cast("double") - top))
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda s, x: s + x)
    shares = lambda g: let(total(g), lambda t: F.transform(g, lambda x: (x / t).cast("float")))
    return let(F.array_max(a).cast("double"), lambda top: let(grown(top), shares))


def softmax_rows(data: Column, width: int) -> Column:
    """softmax along the last axis of a row-major matrix with `width` columns."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(data), F.lit(1)), F.lit(width))
    return F.flatten(F.transform(starts, lambda s: softmax(F.slice(data, s, F.lit(width)))))


def add(a: Column, b: Column, broadcast: bool = False) -> Column:
    if broadcast:
        grow = lambda x, y: F.when(F.size(x) == 1, F.array_repeat(F.get(x, F.lit(0)), F.size(y))).otherwise(x)
        a, b = grow(a, b), grow(b, a)
    return _same(a, b, F.zip_with(a, b, lambda x, y: x + y))


def mul(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: x * y))


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return _same(a, b, F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def matmul(a: Column, b: Column, rows: int = 1, inner: int | None = None, columns: int = 1) -> Column:
    """Row-major rows x inner by inner x columns; for two vectors an array of their one inner product."""
    if inner is None:
        return F.array(dot(a, b).cast("float"))
    fits = (F.size(a) == rows * inner) & (F.size(b) == inner * columns)
    cells = F.sequence(F.lit(0), F.lit(rows * columns - 1))
    terms = F.sequence(F.lit(0), F.lit(inner - 1))

    def cell(c: Column) -> Column:
        i, j = F.floor(c / columns), c % columns
        term = lambda k: F.get(a, (i * inner + k).cast("int")).cast("double") * F.get(b, (k * columns + j).cast("int")).cast("double")
        return F.aggregate(F.transform(terms, term), F.lit(0.0), lambda s, x: s + x).cast("float")

    return F.when(fits, F.transform(cells, cell)).otherwise(F.raise_error(F.lit("matmul: inner dimensions differ")))


def linear(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """W x + b with fixed parameters: one inner product per output."""
    out = []
    for row, b in zip(weights, bias, strict=True):
        out.append((dot(x, const(row)) + F.lit(float(b))).cast("float"))
    return F.array(*out)


def max_abs_diff(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.zip_with(a, b, lambda x, y: x - y), F.abs)), F.lit(0.0).cast("float"))


def convert(value: Column, shape: Column | None = None) -> Column:
    """A flat array<float>, or struct<shape, data> where a shape is given; an empty shape becomes {1}."""
    data = value.cast("array<float>")
    if shape is None:
        return data
    return F.struct(F.when(F.size(shape) == 0, F.array(F.lit(1).cast("long"))).otherwise(shape).alias("shape"), data.alias("data"))


# Tensors of any rank: struct<shape array<long>, data array<float>>, data in row-major order ----------------


def shaped(shape: Column, data: Column) -> Column:
    return F.struct(shape.cast("array<bigint>").alias("shape"), data.cast("array<float>").alias("data"))


def _product(dims: Column) -> Column:
    return F.aggregate(dims, F.lit(1).cast("long"), lambda a, x: a * x)


def _int(c: Column) -> Column:
    return c.cast("int")


def softmax_along(t: Column, dim: int = -1) -> Column:
    """softmax along one axis, counted from the end if negative; an axis that is not there is an error."""

    def over(data: Column, size: Column, axis: Column, inner: Column) -> Column:
        member = lambda g, k: F.get(data, _int(F.floor(g / inner) * axis * inner + g % inner + k * inner)).cast("double")
        places = F.sequence(F.lit(0).cast("long"), axis - 1)

        def stats(g: Column) -> Column:
            top = F.array_max(F.transform(places, lambda k: member(g, k)))
            return let(top, lambda m: F.struct(m.alias("top"), F.aggregate(places, F.lit(0.0), lambda a, k: a + F.exp(member(g, k) - m)).alias("sum")))

        def shares(every: Column) -> Column:
            own = lambda i: F.get(every, _int(F.floor(i / (axis * inner)) * inner + i % inner))
            return F.transform(data, lambda x, i: (F.exp(x.cast("double") - own(i)["top"]) / own(i)["sum"]).cast("float"))

        lanes = F.when(size > 0, F.sequence(F.lit(0).cast("long"), (size / axis).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
        return let(F.transform(lanes.cast("array<bigint>"), stats), shares)

    def out(v: Column) -> Column:
        rank = F.size(v["shape"])
        at = F.lit(dim) if dim >= 0 else rank + dim
        dims = lambda x: over(v["data"], F.size(v["data"]).cast("long"), x["axis"], x["inner"])
        known = F.struct(F.get(v["shape"], at).alias("axis"), _product(F.slice(v["shape"], at + 2, rank)).alias("inner"))
        made = let(known, lambda x: F.struct(v["shape"].alias("shape"), dims(x).alias("data")))
        return F.when((at >= 0) & (at < rank), made).otherwise(F.raise_error(F.lit("softmax: no such axis")))

    return let(t, out)


def matmul_any(a: Column, b: Column) -> Column:
    """The product of tensors by the usual rules of rank.

    Two vectors give their inner product, of shape {1}; a vector before a matrix counts as one row, behind one
    as one column, and that axis goes again. Further axes in front are batches, of which one of length 1 is
    repeated. Inner or batch axes that do not fit are an error.
    """
    fail = lambda m: F.raise_error(F.lit(m))
    ones = lambda n: F.array_repeat(F.lit(1).cast("long"), _int(n))

    def grown(x: Column, y: Column) -> Column:
        """Both with at least two axes and as many batch axes."""
        row = F.when(F.size(x["shape"]) == 1, F.concat(ones(F.lit(1)), x["shape"])).otherwise(x["shape"])
        col = F.when(F.size(y["shape"]) == 1, F.concat(y["shape"], ones(F.lit(1)))).otherwise(y["shape"])
        longest = F.greatest(F.size(row), F.size(col))
        return F.struct(F.concat(ones(longest - F.size(row)), row).alias("p"), F.concat(ones(longest - F.size(col)), col).alias("q"))

    def product(x: Column, y: Column, s: Column) -> Column:
        p, q, n = s["p"], s["q"], F.size(s["p"])
        m, inner, width = F.element_at(p, -2), F.element_at(p, -1), F.element_at(q, -1)
        front = F.zip_with(F.slice(p, F.lit(1), n - 2), F.slice(q, F.lit(1), n - 2), lambda u, v: F.when(u == v, u).when(u == 1, v).when(v == 1, u).otherwise(fail("matmul: batch axes differ").cast("long")))

        def placed(own: Column, batch: Column, b: Column) -> Column:
            """Which matrix of a tensor belongs to a batch."""
            coord = lambda k: F.when(F.get(own, k) == 1, 0).otherwise(F.floor(b / _product(F.slice(batch, k + 2, n))) % F.get(batch, k))
            every = F.sequence(F.lit(0), n - 3)
            return F.when(n > 2, F.aggregate(F.when(n > 2, every), F.lit(0).cast("long"), lambda acc, k: acc * F.get(own, k) + coord(k))).otherwise(0)

        def cells(batch: Column) -> Column:
            def cell(c: Column) -> Column:
                which, i, j = F.floor(c / (m * width)), F.floor(c / width) % m, c % width

                def dot_of(starts: Column) -> Column:
                    term = lambda k: F.get(x["data"], _int(starts["x"] + k)).cast("double") * F.get(y["data"], _int(starts["y"] + k * width)).cast("double")
                    return F.aggregate(F.sequence(F.lit(0).cast("long"), inner - 1), F.lit(0.0), lambda acc, k: acc + term(k)).cast("float")

                first = F.struct(((placed(p, batch, which) * m + i) * inner).alias("x"), (placed(q, batch, which) * inner * width + j).alias("y"))
                return let(first, dot_of)

            return F.transform(F.sequence(F.lit(0).cast("long"), _product(batch) * m * width - 1), cell)

        left = F.when(F.size(x["shape"]) == 1, F.array().cast("array<bigint>")).otherwise(F.array(m))
        right = F.when(F.size(y["shape"]) == 1, F.array().cast("array<bigint>")).otherwise(F.array(width))
        named = lambda batch: F.concat(batch, left, right)
        made = let(front, lambda batch: F.struct(F.when(F.size(named(batch)) == 0, ones(F.lit(1))).otherwise(named(batch)).alias("shape"), cells(batch).alias("data")))
        return F.when(inner == F.element_at(q, -2), made).otherwise(fail("matmul: inner dimensions differ"))

    return let(a, lambda x: let(b, lambda y: let(grown(x, y), lambda s: product(x, y, s))))


def _elementwise(op: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda t: F.struct(t["shape"].alias("shape"), op(t["data"]).alias("data"))


def _alike(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    def run(a: Column, b: Column) -> Column:
        out = F.struct(a["shape"].alias("shape"), op(a["data"], b["data"]).alias("data"))
        return F.when(a["shape"] == b["shape"], out).when(a["shape"] != b["shape"], F.raise_error(F.lit("tensor shapes differ")))

    return run


def apply(op: str, a: Column, b: Column | None = None, width: int | None = None, shaped: bool = False, dim: int = -1) -> Column:
    """A tensor operator by name; unknown names fail when the plan is built. `dim`: the axis of a softmax."""
    if op in BINARY and b is None:
        raise ValueError(f"{op} takes two tensors")
    if op in ("input", "identity", "id"):
        return identity(a)
    if op == "relu":
        return _elementwise(relu)(a) if shaped else relu(a)
    if op == "softmax":
        if shaped:
            return softmax_along(a, dim)
        if dim not in (-1, 0):
            raise ValueError("softmax: a flat tensor has one axis")
        return softmax(a) if width is None else softmax_rows(a, width)
    if op == "matmul":
        return matmul_any(a, b) if shaped else matmul(a, b)
    if op in BINARY:
        plain = {"add": add, "mul": mul}[op]
        return _alike(plain)(a, b) if shaped else plain(a, b)
    raise ValueError(f"unsupported tensor op: {op}")
