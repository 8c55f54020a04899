"""Trees: clustering distances, and node tables (tree_id, node_id, parent_id, distance, label).

A clustering needs all of one matrix at once: one tree is one group; many trees run at once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Node = tuple  # (label or None, children [(Node, length)])


def _matrix(d: np.ndarray) -> np.ndarray:
    d = np.array(d, float)
    if d.ndim != 2 or d.shape[0] != d.shape[1] or not np.allclose(d, d.T):
        raise ValueError("distances must be a symmetric square matrix")
    if not np.isfinite(d).all() or (d < 0).any():
        raise ValueError("distances must be finite and not negative")
    return d


def upgma(distances: np.ndarray, labels: Sequence) -> Node:
    """Average linkage: join the nearest clusters (the first in row order of the lower triangle), at half their distance."""
    d = _matrix(distances)
    n = len(d)
    nodes: list[Node] = [(label, []) for label in labels]
    height, size, alive = np.zeros(n), np.ones(n), np.ones(n, bool)
    for _ in range(n - 1):
        masked = np.where(np.tri(n, k=-1, dtype=bool) & alive[:, None] & alive[None, :], d, np.inf)
        i, j = np.unravel_index(np.argmin(masked), masked.shape)
        top = d[i, j] / 2
        nodes[i] = (None, [(nodes[i], top - height[i]), (nodes[j], top - height[j])])
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i, :] = d[:, i] = merged
        d[i, i] = 0
        height[i], size[i], alive[j] = top, size[i] + size[j], False
    return nodes[int(np.flatnonzero(alive)[0])]


def neighbor_joining(distances: np.ndarray, labels: Sequence) -> Node:
    """Join the pair with the least corrected distance; the last three nodes meet in the root."""
    d = _matrix(distances)
    if len(d) < 4:
        raise ValueError("neighbor joining needs at least four nodes")
    nodes: list[Node] = [(label, []) for label in labels]
    left = list(range(len(d)))
    while len(left) > 3:
        sub = d[np.ix_(left, left)]
        total, n = sub.sum(axis=1), len(left)
        q = (n - 2) * sub - total[:, None] - total[None, :]
        q[np.triu_indices(n)] = np.inf
        i, j = np.unravel_index(np.argmin(q), q.shape)
        a, b = left[i], left[j]
        to_a = sub[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        nodes[a] = (None, [(nodes[a], to_a), (nodes[b], sub[i, j] - to_a)])
        merged = (d[a] + d[b] - d[a, b]) / 2
        d[a, :] = d[:, a] = merged
        d[a, a] = 0
        left.remove(b)
    x, y, z = left
    return (None, [(nodes[x], (d[x, y] + d[x, z] - d[y, z]) / 2), (nodes[y], (d[x, y] + d[y, z] - d[x, z]) / 2), (nodes[z], (d[x, z] + d[y, z] - d[x, y]) / 2)])


def to_newick(node: Node, *, lengths: bool = True, round_to: int | None = None) -> str:
    def write(n: Node, length: float | None) -> str:
        label, children = n
        text = "(" + ",".join(write(c, d) for c, d in children) + ")" if children else str(label)
        if length is None or not lengths:
            return text
        return f"{text}:{length if round_to is None else round(length, round_to)}"

    return write(node, None) + ";"


def from_newick(text: str) -> Node:
    """A tree from Newick text; labels of inner nodes are read and dropped."""
    tokens = re.findall(r"[(),;:]|[^(),;:\s]+", text)
    at = 0

    def read() -> tuple[Node, float]:
        nonlocal at
        children = []
        if tokens[at] == "(":
            while tokens[at] in "(,":
                at += 1
                children.append(read())
            if tokens[at] != ")":
                raise ValueError("unbalanced brackets")
            at += 1
        label = None
        if at < len(tokens) and tokens[at] not in "(),;:":
            label, at = tokens[at], at + 1
        length = 0.0
        if at < len(tokens) and tokens[at] == ":":
            length, at = float(tokens[at + 1]), at + 2
        if not children and label is None:
            raise ValueError("leaf without a label")
        return (label if not children else None, children), length

    made = read()[0]
    if at < len(tokens) and tokens[at:] != [";"]:
        raise ValueError("text after the tree")
    return made


def rows_of(node: Node) -> list[tuple[int, int | None, float | None, str | None]]:
    """(node_id, parent_id, distance, label) in depth-first order."""
    out: list = []
    stack = [(node, None, None)]
    while stack:
        (label, children), up, length = stack.pop()
        me = len(out)
        out.append((me, up, length, None if label is None else str(label)))
        stack += [(c, me, d) for c, d in reversed(children)]
    return out


def as_binary(node: Node) -> Node:
    """Nodes with more than two children become chains of joints without length; those with one are left out."""
    label, children = node
    if not children:
        return node
    children = [(as_binary(c), d) for c, d in children]
    flat = []
    for (sub, grand), d in children:
        while len(grand) == 1:
            ((sub, grand), extra) = grand[0]
            d += extra
        flat.append(((sub, grand), d))
    while len(flat) > 2:
        flat = [((None, flat[:2]), 0.0), *flat[2:]]
    return (label, flat)


def cluster(pairs: DataFrame, method: str, *, key: str = "tree_id") -> DataFrame:
    """(key, newick): one tree for each key of (key, i, j, distance)."""
    make = {"upgma": upgma, "nj": neighbor_joining}[method]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        labels = sorted(set(rows["i"]) | set(rows["j"]))
        d = rows.pivot_table(index="i", columns="j", values="distance", aggfunc="min").reindex(index=labels, columns=labels).fillna(0.0).to_numpy()
        return pd.DataFrame({key: [rows[key].iloc[0]], "newick": [to_newick(make(np.maximum(d, d.T), labels), round_to=6)]})

    kind = dict(pairs.dtypes)[key]
    return pairs.groupBy(key).applyInPandas(run, f"{key} {kind}, newick string")


def node_table(trees: DataFrame, *, key: str = "tree_id", newick: str = "newick") -> DataFrame:
    """(key, node_id, parent_id, distance, label) of Newick texts."""

    @F.pandas_udf("array<struct<node_id:int,parent_id:int,distance:double,label:string>>")
    def run(texts: pd.Series) -> pd.Series:
        names = ("node_id", "parent_id", "distance", "label")
        return pd.Series([[dict(zip(names, r, strict=True)) for r in rows_of(from_newick(t))] for t in texts])

    return trees.select(key, F.explode(run(F.col(newick))).alias("_n")).select(key, "_n.*")


def ancestors(nodes: DataFrame, *, key: str = "tree_id") -> DataFrame:
    """(key, node_id, ancestor, distance, steps), each node its own ancestor at 0; paths double in every round."""
    from strandlake.plans.shared import written

    own = nodes.select(key, "node_id", F.col("node_id").alias("ancestor"), F.lit(0.0).alias("distance"), F.lit(0).alias("steps"))
    one = nodes.where("parent_id IS NOT NULL").select(key, "node_id", F.col("parent_id").alias("ancestor"), F.coalesce("distance", F.lit(0.0)).alias("distance"), F.lit(1).alias("steps"))
    out, hop = own.unionAll(one), one
    while hop.limit(1).count():
        nxt = hop.select(key, F.col("node_id").alias("ancestor"), F.col("ancestor").alias("_a"), F.col("distance").alias("_d"), F.col("steps").alias("_s"))
        size = hop.agg(F.max("steps")).first()[0]
        far = hop.where(F.col("steps") == size).join(nxt, [key, "ancestor"]).select(key, "node_id", F.col("_a").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance"), (F.col("steps") + F.col("_s")).alias("steps"))
        far = written(far, "paths")
        out = out.unionAll(far)
        hop = written(hop.unionAll(far), "hops") if far.limit(1).count() else far
    return out


def distances(nodes: DataFrame, *, key: str = "tree_id") -> DataFrame:
    """(key, label1, label2, distance, ancestor): every pair of leaves and its lowest common ancestor."""
    up = ancestors(nodes, key=key).join(nodes.where("label IS NOT NULL").select(key, "node_id", "label"), [key, "node_id"])
    a = up.select(key, "ancestor", F.col("label").alias("label1"), F.col("distance").alias("_d1"), F.col("steps").alias("_s1"))
    b = up.select(key, "ancestor", F.col("label").alias("label2"), F.col("distance").alias("_d2"))
    pairs = a.join(b, [key, "ancestor"]).where("label1 < label2")
    best = pairs.groupBy(key, "label1", "label2").agg(F.min(F.struct("_s1", (F.col("_d1") + F.col("_d2")).alias("distance"), "ancestor")).alias("m"))
    return best.select(key, "label1", "label2", "m.distance", "m.ancestor")
