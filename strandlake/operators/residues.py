"""From atoms to residues: sequences, names of atoms in residues, rings and their interactions with charges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.geometry import dot, minus, norm, vector
from strandlake.functions.sequences import three_to_one
from strandlake.operators.bonds import AROMATIC, AROMATIC_DOUBLE, AROMATIC_SINGLE, AROMATIC_TRIPLE
from strandlake.operators.spatial import XYZ, within


def to_sequence(residues: DataFrame, by: Sequence[str], order: str = "segment", *, names: DataFrame | None = None) -> DataFrame:
    """(by…, seq): one letter a residue in order, X for an unknown amino acid.

    Nucleotides give their base. ``names`` (res_name, letter) is asked first.
    """
    base = F.regexp_replace(F.upper("res_name"), "^D(?=[ACGTU]$)", "")
    letter = F.coalesce(three_to_one(F.col("res_name")), F.when(base.isin("A", "C", "G", "T"), base).when(base == "U", "T"), F.lit("X"))
    rows = residues
    if names is not None:
        rows = rows.join(names.withColumnRenamed("letter", "_letter"), "res_name", "left")
        letter = F.coalesce("_letter", letter)
    rows = rows.select(*by, F.struct(order, letter.alias("l")).alias("x"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "").alias("seq"))


def atom_by_name(atoms: DataFrame, names: Sequence[str], by: Sequence[str], residue: str = "segment") -> DataFrame:
    """(by…, residue, one column a name): the index of each named atom, the last of several, -1 without one."""
    found = [F.coalesce(F.max(F.when(F.col("atom_name") == n, F.col("atom_idx"))), F.lit(-1)).alias(n) for n in names]
    return atoms.groupBy(*by, residue).agg(*found)


def aromatic_rings(bonds: DataFrame, key: str = "structure_id") -> DataFrame:
    """(key, ring, atoms): the smallest rings of aromatic bonds, by breadth-first search from each bond; one structure is one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["bond_type"].isin([AROMATIC, AROMATIC_SINGLE, AROMATIC_DOUBLE, AROMATIC_TRIPLE])]
        near: dict[int, list[int]] = {}
        for a, b in zip(rows["atom1"], rows["atom2"], strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        rings = set()
        for a, b in zip(rows["atom1"], rows["atom2"], strict=True):
            back, todo = {a: a}, [a]
            while todo and b not in back:
                after = []
                for v in todo:
                    for u in near[v]:
                        if u not in back and not (v == a and u == b):
                            back[u] = v
                            after.append(u)
                todo = after
            if b in back:
                path = [b]
                while path[-1] != a:
                    path.append(back[path[-1]])
                rings.add(tuple(sorted(int(p) for p in path)))
        return pd.DataFrame({key: [rows[key].iloc[0]] * len(rings), "ring": range(len(rings)), "atoms": [list(r) for r in sorted(rings)]}) if rings else pd.DataFrame(columns=[key, "ring", "atoms"])

    return bonds.groupBy(key).applyInPandas(run, f"{key} {dict(bonds.dtypes)[key]}, ring int, atoms array<int>")


def ring_planes(rings: DataFrame, atoms: DataFrame, key: str = "structure_id") -> DataFrame:
    """(key, ring, x, y, z, nx, ny, nz): centres and normals; a kernel finds the direction of least spread of six sums a ring."""
    rows = rings.select(key, "ring", F.explode("atoms").alias("atom_idx")).join(atoms.select(key, "atom_idx", *XYZ), [key, "atom_idx"])
    sums = rows.groupBy(key, "ring").agg(*[F.avg(c).alias(c) for c in XYZ], *[F.covar_pop(a, b).alias(f"_{i}{j}") for i, a in enumerate(XYZ) for j, b in enumerate(XYZ)])

    @F.pandas_udf("nx double, ny double, nz double")
    def normal(cols: pd.DataFrame) -> pd.DataFrame:
        made = [np.linalg.eigh(v.reshape(3, 3))[1][:, 0] for v in cols.to_numpy(float)]
        return pd.DataFrame(np.array(made).reshape(-1, 3), columns=["nx", "ny", "nz"])

    return sums.select(key, "ring", *XYZ, normal(F.struct(*[f"_{i}{j}" for i in range(3) for j in range(3)])).alias("_n")).select(key, "ring", *XYZ, "_n.*")


def pi_cation(planes: DataFrame, cations: DataFrame, *, cutoff: float = 5.0, most_angle: float = 30.0, key: str = "structure_id") -> DataFrame:
    """(key, ring, atom_idx, dist): cations within the cutoff of a ring's centre and near its normal."""
    pairs = within(planes, cations.select(key, "atom_idx", *XYZ), cutoff, by=[key])
    d, n = minus(vector("r_x", "r_y", "r_z"), vector(*XYZ)), vector("nx", "ny", "nz")
    bend = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot(d, n)) / (norm(d) * norm(n)))))
    return pairs.where(bend <= most_angle).select(key, "ring", F.col("r_atom_idx").alias("atom_idx"), F.sqrt("dist2").alias("dist"))
