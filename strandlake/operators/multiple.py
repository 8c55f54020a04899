"""Progressive multiple alignment, and substitution matrices. One family is one group; families run side by side."""

from __future__ import annotations

import math
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from strandlake.operators import kernels, trees


def parse_matrix(text: str) -> dict[tuple[str, str], int]:
    """Scores of a matrix text: a line of symbols, then a line of scores for each symbol; # begins a comment."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    columns = lines[0]
    return {(row[0], c): int(v) for row in lines[1:] for c, v in zip(columns, row[1:], strict=True)}


def load_matrix(path: str) -> dict[tuple[str, str], int]:
    """A matrix from a file of the common text format; matrices are parameters, none is shipped."""
    with open(path, encoding="utf-8") as f:
        return parse_matrix(f.read())


def list_matrices(folder: str) -> list[str]:
    """Names of the matrix files (``.mat``) of a folder."""
    return sorted(p.stem for p in Path(folder).glob("*.mat"))


def match_matrix(alphabet: str, match: int, mismatch: int) -> dict[tuple[str, str], int]:
    return {(a, b): match if a == b else mismatch for a in alphabet for b in alphabet}


def score_frame(spark: SparkSession, matrix: dict[tuple[str, str], int], alphabet: str, other: str | None = None) -> DataFrame:
    """(code1, code2, score) for k-mer similarity and joins; codes count in the alphabets."""
    other = alphabet if other is None else other
    rows = [(i, j, matrix[a, b]) for i, a in enumerate(alphabet) for j, b in enumerate(other)]
    return spark.createDataFrame(rows, "code1 long, code2 long, score long")


def matrix_text(matrix: dict[tuple[str, str], int]) -> str:
    """The text that ``parse_matrix`` reads."""
    rows, columns = list(dict.fromkeys(a for a, _ in matrix)), list(dict.fromkeys(b for _, b in matrix))
    return "\n".join([" ".join(columns)] + [" ".join([a, *[str(matrix[a, b]) for b in columns]]) for a in rows]) + "\n"


def is_symmetric(matrix: dict[tuple[str, str], int]) -> bool:
    return all(matrix.get((b, a)) == v for (a, b), v in matrix.items())


def transposed(matrix: dict[tuple[str, str], int]) -> dict[tuple[str, str], int]:
    return {(b, a): v for (a, b), v in matrix.items()}


def distance(a: np.ndarray, b: np.ndarray, trace: np.ndarray, score: float, table: np.ndarray, gap: tuple[int, int] | int) -> float:
    """-ln((S - S_random) / (S_max - S_random)): S_max is the mean self score; S_random is that of shuffled sequences."""
    opening, extend = gap if isinstance(gap, tuple) else (gap, gap)
    top = (table[a, a].sum() + table[b, b].sum()) / 2
    ca, cb = np.bincount(a, minlength=128), np.bincount(b, minlength=128)
    random = float(ca @ table @ cb) / max(len(trace), 1)
    gaps = trace < 0
    starts = gaps & ~np.vstack([np.zeros((1, 2), bool), gaps[:-1]])
    random += int(starts.sum()) * opening + int((gaps & ~starts).sum()) * extend
    if score < random:
        raise ValueError("an alignment scores less than a random one: the sequences are too unlike")
    share = (score - random) / (top - random) if top > random else 1.0
    return math.inf if share <= 0 else max(0.0, -math.log(share))


def _merged(left: list[list[int]], right: list[list[int]], ids: tuple[int, int], trace: np.ndarray) -> list[list[int]]:
    """Two groups' rows with gaps put in where the alignment of their representatives has them."""
    a, b = ids
    lead_a, lead_b = left[a], right[b]
    out = [[] for _ in range(len(left) + len(right))]
    i = j = 0

    def take(side: str) -> None:
        nonlocal i, j
        for r, row in enumerate(left):
            out[r].append(row[i] if side in ("a", "m") else -1)
        for r, row in enumerate(right):
            out[len(left) + r].append(row[j] if side in ("b", "m") else -1)
        if side in ("a", "m"):
            i += 1
        if side in ("b", "m"):
            j += 1

    for p, q in trace:
        while i < len(lead_a) and lead_a[i] < 0 and p >= 0:
            take("a")
        while j < len(lead_b) and lead_b[j] < 0 and q >= 0:
            take("b")
        take("m" if p >= 0 and q >= 0 else "a" if p >= 0 else "b")
    while i < len(lead_a):
        take("a")
    while j < len(lead_b):
        take("b")
    return out


def align_family(texts: Sequence[str], table: np.ndarray, gap: tuple[int, int] | int) -> tuple[list[str], str, np.ndarray]:
    """(gapped texts, guide tree as Newick, distances): pairs are aligned, clustered, and merged along the tree.

    Where two groups meet, the alignment of their nearest members decides, and gaps once made stay.
    """
    coded = [kernels.codes(t) for t in texts]
    n = len(coded)
    d = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            score, traces = kernels.traceback(coded[i], coded[j], table, gap)
            d[i, j] = d[j, i] = distance(coded[i], coded[j], traces[0], score, table, gap)
    finite = d[np.isfinite(d)]
    d[~np.isfinite(d)] = (finite.max() if len(finite) else 1.0) * 2 + 1
    tree = trees.as_binary(trees.upgma(d, range(n))) if n > 1 else (0, [])

    def build(node) -> tuple[list[int], list[list[int]]]:
        label, children = node
        if not children:
            return [label], [list(range(len(coded[label])))]
        (la, ra), (lb, rb) = build(children[0][0]), build(children[1][0])
        a, b = min(((p, q) for p in range(len(la)) for q in range(len(lb))), key=lambda x: (d[la[x[0]], lb[x[1]]], x))
        _, traces = kernels.traceback(coded[la[a]], coded[lb[b]], table, gap)
        return la + lb, _merged(ra, rb, (a, b), traces[0])

    order, rows = build(tree)
    gapped = [""] * n
    for label, row in zip(order, rows, strict=True):
        gapped[label] = "".join("-" if p < 0 else texts[label][p] for p in row)
    return gapped, trees.to_newick(tree, round_to=6), d


def align_multiple(sequences: DataFrame, *, key: str, id: str = "seq_id", seq: str = "seq", match: int = 5, mismatch: int = -4, matrix: dict | None = None, gap: tuple[int, int] | int = -10) -> DataFrame:
    """(key, id, gapped, guide_tree): each family's multiple alignment."""
    from strandlake.operators.alignments import _table

    table = _table(match, mismatch, matrix)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id)
        gapped, tree, _ = align_family(rows[seq].tolist(), table, gap)
        return pd.DataFrame({key: rows[key].to_numpy(), id: rows[id].to_numpy(), "gapped": gapped, "guide_tree": tree})

    kinds = dict(sequences.dtypes)
    return sequences.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {id} {kinds[id]}, gapped string, guide_tree string")
