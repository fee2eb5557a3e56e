"""Connected components of links: union-find inside tasks, then minimum labels between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.operators.components import connected_components


def _find(parent: dict, x: int) -> int:
    root = x
    while parent.get(root, root) != root:
        root = parent[root]
    while parent.get(x, x) != root:
        parent[x], x = root, parent[x]
    return root


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of links only a spanning forest, as links to the smallest member: at most a link per node."""
    for batch in batches:
        parent: dict[int, int] = {}
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = _find(parent, a), _find(parent, b)
            parent[max(x, y)] = parent.setdefault(min(x, y), min(x, y))
        nodes = np.fromiter(parent, np.int64, len(parent))
        roots = np.fromiter((_find(parent, int(x)) for x in nodes), np.int64, len(nodes))
        far = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(roots[far])], ["a", "b"])


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes(node)``, ``links(a, b)`` -> ``(node, group)``, the group named by its smallest node."""
    forest = links.select("a", "b").mapInArrow(_forest, "a long, b long").distinct()
    out = connected_components(nodes.select(F.col("node").alias("id")), forest)
    return out.select(F.col("id").alias("node"), F.col("component").alias("group"))
