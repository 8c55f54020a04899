"""Partial charges by iterative equalisation of orbital electronegativity. One structure is one group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Published parameters a, b, c by element and hybridisation, named by the number of bound atoms.
PARAMETERS = {
    ("H", 1): (7.17, 6.24, -0.56), ("C", 4): (7.98, 9.18, 1.88), ("C", 3): (8.79, 9.32, 1.51), ("C", 2): (10.39, 9.45, 0.73),
    ("N", 3): (11.54, 10.82, 1.36), ("N", 4): (11.54, 10.82, 1.36), ("N", 2): (12.87, 11.15, 0.85), ("N", 1): (15.68, 11.70, -0.27),
    ("O", 2): (14.18, 12.92, 1.39), ("O", 1): (17.07, 13.79, 0.47), ("F", 1): (14.66, 13.85, 2.31), ("CL", 1): (11.00, 9.69, 1.35),
    ("BR", 1): (10.08, 8.47, 1.16), ("I", 1): (9.90, 7.96, 0.96), ("S", 2): (10.14, 9.13, 1.38), ("S", 1): (10.14, 9.13, 1.38),
}
HYDROGEN_POSITIVE = 20.02


def equalise(elements: list[str], bonds: list[tuple[int, int]], charges: np.ndarray, steps: int = 6) -> np.ndarray:
    """Charges after ``steps`` rounds, each damped by half of the one before; NaN for atoms without parameters.

    Electronegativities are those at a round's beginning; charge flows over a bond by their difference, over
    that of the less electronegative atom's positive ion.
    """
    degree = np.bincount(np.array(bonds, int).ravel(), minlength=len(elements)) if bonds else np.zeros(len(elements), int)
    table = np.array([PARAMETERS.get((e.upper(), int(d)), (np.nan,) * 3) for e, d in zip(elements, degree, strict=True)])
    a, b, c = table.T
    positive = a + b + c
    positive = np.where(np.char.upper(np.array(elements, str)) == "H", HYDROGEN_POSITIVE, positive)
    q, damping = np.array(charges, float), 1.0
    pairs = np.array(bonds, int).reshape(-1, 2)
    for _ in range(steps):
        damping /= 2
        x = a + b * q + c * q * q
        i, j = pairs.T
        low = np.where(x[j] > x[i], i, j)
        flow = (x[j] - x[i]) / positive[low] * damping
        flow = np.where(np.isnan(flow), 0.0, flow)
        np.add.at(q, i, flow)
        np.add.at(q, j, -flow)
    return np.where(np.isnan(a), np.nan, q)


def partial_charges(atoms: DataFrame, bonds: DataFrame, *, key: str = "structure_id", steps: int = 6) -> DataFrame:
    """(key, atom_idx, partial_charge) of atoms (key, atom_idx, element, charge) and bonds (key, atom1, atom2)."""

    def run(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("atom_idx")
        place = {v: i for i, v in enumerate(left["atom_idx"])}
        pairs = [(place[a], place[b]) for a, b in zip(right["atom1"], right["atom2"], strict=True)]
        q = equalise(left["element"].tolist(), pairs, left["charge"].to_numpy(float), steps)
        return pd.DataFrame({key: left[key].to_numpy(), "atom_idx": left["atom_idx"].to_numpy(), "partial_charge": q})

    kinds = dict(atoms.dtypes)
    return atoms.groupBy(key).cogroup(bonds.groupBy(key)).applyInPandas(run, f"{key} {kinds[key]}, atom_idx {kinds['atom_idx']}, partial_charge double")
