"""Dense-vector arithmetic: Column expressions for single rows, Arrow/numpy helpers for batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

FUSION_WEIGHTS = {"name": 0.4, "definition": 0.3, "head": 0.15, "tail": 0.15}
HASH_DIM = 64
# Similarities are rounded before they are compared, so that equal ones tie whatever block they were computed in.
DIGITS = 12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is.

    Vector and norm are bound by lambdas over arrays of one: an expression named inside a lambda is worked out for every element.
    """
    def unit(w):
        return F.transform(F.array(F.sqrt(dot(w, w))), lambda n: F.transform(w, lambda x: F.when(n == 0, x.cast("double")).otherwise(x / n)))[0]

    return F.transform(F.array(v), unit)[0]


def scale(v: Column, w) -> Column:
    w = w if isinstance(w, Column) else F.lit(float(w))
    return F.transform(v, lambda x: x.cast("double") * w)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def fuse_concat(name: Column, definition: Column, head: Column, tail: Column) -> Column:
    return l2_normalize(F.concat(name, definition, head, tail))


def fuse_weighted(name: Column, definition: Column, head: Column, tail: Column, weights=None) -> Column:
    w = {**FUSION_WEIGHTS, **(weights or {})}
    total = add(add(add(scale(name, w["name"]), scale(definition, w["definition"])), scale(head, w["head"])),
                scale(tail, w["tail"]))
    return l2_normalize(total)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one Arrow batch as a row-major float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


def hash_rows(texts) -> np.ndarray:
    """Unit vectors of hashed character trigrams (text padded with one blank on both sides)."""
    padded = [f" {t or ''} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
    inside = row[:-2] == row[2:]  # trigrams of one text
    slots = (codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) % HASH_DIM
    out = np.bincount(row[:-2][inside] * HASH_DIM + slots[inside], minlength=len(padded) * HASH_DIM).astype(np.float64).reshape(-1, HASH_DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def hashing_vector(texts: pa.Array) -> pa.Array:
    """Deterministic text embedding without a model: hashed character trigrams, L2 normalised."""
    rows = hash_rows(texts.to_pylist())
    offsets = np.arange(0, rows.size + 1, HASH_DIM, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
