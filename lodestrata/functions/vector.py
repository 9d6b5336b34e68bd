"""Vector functions, as column expressions in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this many dimensions a product with a constant vector is written out term by term, which
#: compiles to straight-line code; longer ones go through higher-order functions.
UNROLLED = 128


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def _written_out(terms: list[str]) -> Column:
    """One expression, parsed at once: far fewer calls than building it column by column."""
    return F.expr(" + ".join(["0.0D", *terms]))


def _place(v: str, i: int) -> str:
    return f"cast(get(`{v}`, {i}) as double)"


def dot_constant(v: str, q: Sequence[float]) -> Column:
    """Product of a vector column, by name, and a constant."""
    if len(q) > UNROLLED:
        return dot(F.col(v), F.array(*[F.lit(float(x)) for x in q]))
    return _written_out([f"{_place(v, i)} * ({float(x)!r}D)" for i, x in enumerate(q)])


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def usable(v: Column, dim: int) -> Column:
    """Of the right length, without nulls, not zero."""
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull()) & (squared_norm(v) > 0)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(squared_norm(a) * squared_norm(b))


def cosine_constant(v: str, q: Sequence[float]) -> Column:
    """Cosine of a vector column, by name, and a constant of as many dimensions."""
    own = sum(float(x) * float(x) for x in q)
    norm = squared_norm(F.col(v)) if len(q) > UNROLLED else _written_out([f"{_place(v, i)} * {_place(v, i)}" for i in range(len(q))])
    return dot_constant(v, q) / F.sqrt(norm * F.lit(own))


def checked(v: Column, dim: int) -> Column:
    """The vector, or an error if its length is wrong."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(v).cast("string"))))


def clamp01(x: Column) -> Column:
    return F.when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x)
