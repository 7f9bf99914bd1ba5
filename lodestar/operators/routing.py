"""Key routing: a ring of virtual nodes and highest-score routing. Node tables are literals, bounded by the cluster's size."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.mixers import GOLDEN32, GOLDEN64, LOW32_A, LOW32_B, M32, MIX_A, MIX_B

VIRTUAL = 160


def _finalise(h: int) -> int:
    h ^= h >> 16
    h = h * LOW32_A & M32
    h ^= h >> 15
    h = h * LOW32_B & M32
    return h ^ (h >> 16)


def ring(nodes: list[tuple[str, int, int]]) -> list[tuple[int, str]]:
    """Sorted (position, node); equal positions go to the node first in order of names."""
    at: dict[int, str] = {}
    for name, weight, h in sorted(nodes):
        for r in range(VIRTUAL * weight):
            at.setdefault(_finalise((h + r * GOLDEN32) & M32), name)
    return sorted(at.items())


def _owners(nodes: list[tuple[str, int, int]], count: int) -> list[tuple[int, list[str]]]:
    """For each position, the next distinct owners clockwise."""
    points = ring(nodes)
    out = []
    for k, (p, _) in enumerate(points):
        seen: list[str] = []
        for j in range(len(points)):
            owner = points[(k + j) % len(points)][1]
            if owner not in seen:
                seen.append(owner)
                if len(seen) == count:
                    break
        out.append((p, seen))
    return out


def ring_replicas(keys: DataFrame, nodes: list[tuple[str, int, int]], key: str, count: int) -> DataFrame:
    """keys with `nodes`: the first `count` distinct owners from the first position at or after the key, around the end.

    The ring is cut into equal arcs, each with its few positions in order, so a key looks through one arc's list only.
    """
    points = _owners(nodes, count)
    arcs = 1 << 10
    width = (1 << 32) // arcs
    positions = [p for p, _ in points]
    rows = []
    for a in range(arcs):
        low, high = bisect_left(positions, a * width), bisect_left(positions, (a + 1) * width)
        within = [points[k] for k in range(low, high)]
        rows.append((a, [(p, o) for p, o in within], points[high % len(points)][1]))
    table = keys.sparkSession.createDataFrame(rows, "arc long, points array<struct<p:long,o:array<string>>>, rest array<string>")
    found = keys.withColumn("arc", F.shiftright(F.col(key), 22)).join(F.broadcast(table), "arc")  # bounded by the ring
    first = F.get(F.filter("points", lambda x: x["p"] >= F.col(key)), F.lit(0))
    return found.withColumn("nodes", F.coalesce(first["o"], F.col("rest"))).drop("arc", "points", "rest")


def ring_route(keys: DataFrame, nodes: list[tuple[str, int, int]], key: str) -> DataFrame:
    return ring_replicas(keys, nodes, key, 1).withColumn("node", F.get("nodes", F.lit(0))).drop("nodes")


def rendezvous(keys: DataFrame, nodes: list[tuple[str, int, int]], key: str) -> DataFrame:
    """keys with `node`: the one of the highest unsigned score; a weight takes the best of as many scores; ties to the first name.

    A batch of keys is scored against one node after another; a null key has no node.
    """
    ordered = sorted(nodes)
    names = np.array([name for name, _, _ in ordered], object)

    @F.pandas_udf("string")
    def routed(k: pd.Series) -> pd.Series:
        known = k.notna().to_numpy()
        low = k[known].to_numpy(np.int64).view(np.uint64)
        best, at = np.zeros(len(low), np.uint64), np.zeros(len(low), np.int64)
        for n, (_, weight, h) in enumerate(ordered):
            for r in range(weight):
                score = _mixed((np.uint64(h if not r else _finalise((h + r * GOLDEN32) & M32)) << np.uint64(32)) | low)
                better = score > best
                best[better], at[better] = score[better], n
        out = np.full(len(k), None, object)
        out[known] = names[at]
        return pd.Series(out)

    return keys.withColumn("node", routed(F.col(key)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """mixers.mix64 over arrays."""
    x = x + np.uint64(GOLDEN64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))
