"""Distances (smaller is better) between vectors, as Spark columns and as numpy blocks.

l2: squared Euclidean.  dot: (1 - a.b) / 2 for unit vectors.  cos: the same after normalising.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {"euclidean": "l2", "l2": "l2", "cosine": "cos", "cos": "cos", "dot": "dot"}


def parse(name: str) -> str:
    """Canonical name of a similarity: l2, cos or dot."""
    if name not in ALIASES:
        raise ValueError(f"unknown similarity {name!r}: one of {', '.join(ALIASES)}")
    return ALIASES[name]


def angular(similarity: str) -> bool:
    return parse(similarity) != "l2"


def _doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _fold(terms: Column) -> Column:
    """Sum from left to right, in double."""
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot_product(a: Column | str, b: Column | str) -> Column:
    return _fold(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def distance(a: Column | str, b: Column | str, similarity: str = "l2") -> Column:
    """Distance of two array columns; stays in the JVM."""
    kind = parse(similarity)
    if kind == "l2":
        return _fold(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))
    if kind == "dot":
        return (F.lit(1.0) - dot_product(a, b)) / 2
    return (F.lit(1.0) - dot_product(a, b) / F.sqrt(dot_product(a, a) * dot_product(b, b))) / 2


def norm(v: Column | str) -> Column:
    return F.sqrt(dot_product(v, v))


def normalize(v: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = norm(v)
    return F.transform(_doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def sign_words(v: Column | str, dims: int) -> Column:
    """Array of 64-bit words whose bit i tells whether component i is above zero."""
    def word(at: int) -> Column:
        part = F.slice(_doubles(v), at + 1, 64)
        return F.aggregate(
            F.transform(part, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.lit(0).cast("long"))),
            F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("i")),
            lambda s, b: F.struct(s["w"].bitwiseOR(F.call_function("shiftleft", b, s["i"])).alias("w"), (s["i"] + 1).alias("i")),
            lambda s: s["w"],
        )

    return F.array(*[word(at) for at in range(0, dims, 64)])


def hamming(a: Column, b: Column, dims: int) -> Column:
    """Share of different bits; the denominator counts whole bytes."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return bits / F.lit(float(8 * -(-dims // 8)))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay."""
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(n > 0, n, 1)[:, None]


def block(a: np.ndarray, b: np.ndarray, similarity: str = "l2") -> np.ndarray:
    """(rows of a, rows of b) -> distance, by one matrix product in the dtype of the inputs."""
    kind = parse(similarity)
    if kind == "cos":
        a, b = unit_rows(a), unit_rows(b)
    dots = a @ b.T
    if kind == "l2":
        out = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * dots
        return np.maximum(out, 0, out=out)
    return (1 - dots) / 2
