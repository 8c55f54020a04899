"""Comparison of structures as aggregates: sums combine on the map side, kernels see one row a group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.spatial import XYZ, within


def _pairs(fixed: DataFrame, mobile: DataFrame, keys: Sequence[str]) -> DataFrame:
    a = fixed.select(*keys, *[F.col(c).cast("double").alias(f"f{c}") for c in XYZ])
    b = mobile.select([c for c in mobile.columns if c not in XYZ] + [F.col(c).cast("double").alias(c) for c in XYZ])
    return a.join(b, list(keys))


def _square() -> Column:
    return sum(((F.col(f"f{c}") - F.col(c)) ** 2 for c in XYZ), F.lit(0.0))


def rmsd(fixed: DataFrame, mobile: DataFrame, *, atom: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by…, rmsd): root of the mean squared deviation of all atoms, one row for each ``by`` (model)."""
    return _pairs(fixed, mobile, atom).groupBy(*by).agg(F.sqrt(F.avg(_square())).alias("rmsd"))


def rmsf(fixed: DataFrame, models: DataFrame, *, atom: Sequence[str]) -> DataFrame:
    """(atom…, rmsf): root of the mean squared deviation over models."""
    return _pairs(fixed, models, atom).groupBy(*atom).agg(F.sqrt(F.avg(_square())).alias("rmsf"))


def average(models: DataFrame, *, atom: Sequence[str]) -> DataFrame:
    return models.groupBy(*atom).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in XYZ])


def centroid(atoms: DataFrame, by: Sequence[str]) -> DataFrame:
    return average(atoms, atom=by)


def mass_center(atoms: DataFrame, by: Sequence[str], mass: str = "mass") -> DataFrame:
    return atoms.groupBy(*by).agg(*[(F.sum(F.col(c) * F.col(mass)) / F.sum(mass)).alias(c) for c in XYZ])


def gyration_radius(atoms: DataFrame, by: Sequence[str], mass: str = "mass") -> DataFrame:
    """(by…, rg) around the mass centre, by the sums of m, m x and m x^2: one pass."""
    m = F.col(mass)
    sums = atoms.groupBy(*by).agg(F.sum(m).alias("_m"), *[F.sum(m * F.col(c)).alias(f"_{c}") for c in XYZ], F.sum(m * sum((F.col(c) ** 2 for c in XYZ), F.lit(0.0))).alias("_q"))
    return sums.select(*by, F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_m") - sum(((F.col(f"_{c}") / F.col("_m")) ** 2 for c in XYZ), F.lit(0.0)))).alias("rg"))


def rmspd(fixed: DataFrame, mobile: DataFrame, *, atom: str, by: Sequence[str]) -> DataFrame:
    """(by…, rmspd): root of the summed squared differences of all ordered pairs' distances, over n. A model's atoms meet all others of it: quadratic in a structure, not in the table."""
    rows = _pairs(fixed, mobile, [atom])
    other = rows.select(*by, F.col(atom).alias("_o"), *[F.col(c).alias(f"o{c}") for c in (*XYZ, "fx", "fy", "fz")])
    d1 = F.sqrt(sum(((F.col(f"f{c}") - F.col(f"of{c}")) ** 2 for c in XYZ), F.lit(0.0)))
    d2 = F.sqrt(sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in XYZ), F.lit(0.0)))
    return rows.join(other, list(by)).groupBy(*by).agg((F.sqrt(F.sum((d1 - d2) ** 2)) / F.count_distinct(atom)).alias("rmspd"))


def lddt(reference: DataFrame, subject: DataFrame, *, atom: str = "atom_idx", chain: str = "chain_id", residue: str = "res_id", radius: float = 15.0, bins: Sequence[float] = (0.5, 1.0, 2.0, 4.0), level: str = "all", by: Sequence[str] = ()) -> DataFrame:
    """(by…, level's keys…, lddt): the share of the reference's contacts between residues that the subject preserves.

    ``level``: all, chain, residue or atom.
    """
    keys = {"all": [], "chain": [chain], "residue": [chain, residue], "atom": [atom]}[level]
    rows = reference.select(*by, atom, chain, residue, *XYZ)
    pairs = within(rows, rows, radius, by=by)
    other = (F.col(chain) != F.col(f"r_{chain}")) | (F.col(residue) != F.col(f"r_{residue}"))
    pairs = pairs.where((F.col(atom) != F.col(f"r_{atom}")) & other).select(*by, atom, chain, residue, F.col(f"r_{atom}").alias("_o"), F.sqrt("dist2").alias("_d"))
    s = subject.select(*by, atom, *[F.col(c).alias(f"s{c}") for c in XYZ])
    o = subject.select(*by, F.col(atom).alias("_o"), *[F.col(c).alias(f"o{c}") for c in XYZ])
    both = pairs.join(s, [*by, atom]).join(o, [*by, "_o"])
    off = F.abs(F.sqrt(sum(((F.col(f"s{c}") - F.col(f"o{c}")) ** 2 for c in XYZ), F.lit(0.0))) - F.col("_d"))
    share = sum((F.when(off <= b, 1.0).otherwise(0.0) for b in bins), F.lit(0.0)) / len(bins)
    return both.groupBy(*by, *keys).agg(F.avg(share).alias("lddt"))


# Superimposition ------------------------------------------------------------------------

ROTATION = ", ".join(f"r{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3))


def _rotation(cov: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(cov)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        u[:, -1] *= -1
    return u @ vt


def fit(fixed: DataFrame, mobile: DataFrame, *, atom: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by…, fcx…, cx…, r11 … r33, n): the best rotation of each group's mobile atoms onto the fixed ones.

    Sums of coordinates and their products are one aggregate; a kernel decomposes nine numbers a group.
    """
    rows = _pairs(fixed, mobile, atom)
    aggs = [F.avg(f"f{c}").alias(f"fc{c}") for c in XYZ] + [F.avg(c).alias(f"c{c}") for c in XYZ]
    aggs += [F.covar_pop(f"f{a}", b).alias(f"v{i}{j}") for i, a in enumerate(XYZ) for j, b in enumerate(XYZ)] + [F.count("*").alias("n")]
    sums = rows.groupBy(*by).agg(*aggs)

    @F.pandas_udf(ROTATION)
    def rotate(cols: pd.DataFrame) -> pd.DataFrame:
        made = [_rotation(v.reshape(3, 3)).ravel() for v in cols.to_numpy(float)]
        return pd.DataFrame(np.array(made).reshape(-1, 9), columns=[f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)])

    out = sums.withColumn("_r", rotate(F.struct(*[f"v{i}{j}" for i in range(3) for j in range(3)])))
    return out.select(*by, *[f"fc{c}" for c in XYZ], *[f"c{c}" for c in XYZ], "_r.*", "n")


def moved(mobile: DataFrame, fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """The mobile atoms under their group's fit."""
    rows = mobile.join(fits, list(by)) if by else mobile.crossJoin(F.broadcast(fits))  # without keys there is one fit
    d = [F.col(c) - F.col(f"c{c}") for c in XYZ]
    new = [sum((F.col(f"r{i}{j}") * d[j - 1] for j in (1, 2, 3)), F.col(f"fc{c}")) for i, c in zip((1, 2, 3), XYZ, strict=True)]
    return rows.select(*[c for c in mobile.columns if c not in XYZ], *[n.alias(c) for n, c in zip(new, XYZ, strict=True)])


def superimpose(fixed: DataFrame, mobile: DataFrame, *, atom: Sequence[str], by: Sequence[str]) -> DataFrame:
    return moved(mobile, fit(fixed, mobile, atom=atom, by=by), by)


def superimpose_without_outliers(fixed: DataFrame, mobile: DataFrame, *, atom: Sequence[str], by: Sequence[str], rounds: int = 10, least: int = 3, quantiles: tuple[float, float] = (0.25, 0.75), factor: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(superimposed atoms, anchors by…, atom…): repeated fits on the atoms whose squared deviation is no outlier."""
    from strandlake.plans.shared import written

    anchors = written(_pairs(fixed, mobile, atom).select(*by, *atom), "anchors")
    for _ in range(rounds):
        fits = fit(fixed, mobile.join(anchors, [*by, *atom], "left_semi"), atom=atom, by=by)
        now = written(moved(mobile, fits, by), "moved")
        d2 = _pairs(fixed, now.join(anchors, [*by, *atom], "left_semi"), atom).withColumn("_d", _square())
        low, high = (F.percentile("_d", F.lit(q)) for q in quantiles)
        limit = d2.groupBy(*by).agg((high + factor * (high - low)).alias("_limit"))
        kept = written((d2.join(limit, list(by)) if by else d2.crossJoin(F.broadcast(limit))).where("_d <= _limit").select(*by, *atom), "anchors")
        smallest = kept.groupBy(*by).count().agg(F.min("count")).first()[0] or 0
        if kept.count() == anchors.count() or smallest < least:
            break
        anchors = kept
    return now, anchors


def tm_score(fixed: DataFrame, superimposed: DataFrame, *, atom: Sequence[str], by: Sequence[str], length: int | str = "shorter", least_d0: float = 0.5) -> DataFrame:
    """(by…, tm): sum of 1 / (1 + (d / d0)^2) over the reference length, which also gives d0.

    The length is the atoms of the group: the "shorter" or "longer" of both sides, those of the fixed one
    ("reference"), or a given number. All but a number need the columns ``by`` on both sides.
    """
    pairs = _pairs(fixed, superimposed, atom)
    if isinstance(length, int):
        pairs = pairs.withColumn("_length", F.lit(length))
    else:
        if length not in ("shorter", "longer", "reference"):
            raise ValueError(f"unsupported reference length: {length!r}")
        missing = [c for c in by if c not in fixed.columns]
        if missing:
            raise ValueError(f"the fixed atoms lack {missing}, so the length of a group is unknown")
        sides = [side.select(*by, F.lit(one).alias("_fixed"), F.lit(1 - one).alias("_mobile")) for side, one in ((fixed, 1), (superimposed, 0))]
        a, b = F.sum("_fixed"), F.sum("_mobile")
        value = {"shorter": F.least(a, b), "longer": F.greatest(a, b), "reference": a}[length]
        sizes = sides[0].unionByName(sides[1]).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(value.alias("_length"))
        pairs = pairs.join(sizes, [pairs[c].eqNullSafe(sizes[f"_{c}"]) for c in by]) if by else pairs.crossJoin(F.broadcast(sizes))
    d0 = F.greatest(1.24 * F.cbrt(F.greatest(F.col("_length") - 15, F.lit(0))) - 1.8, F.lit(least_d0))
    return pairs.groupBy(*by).agg((F.sum(1 / (1 + _square() / (d0 * d0))) / F.first("_length")).alias("tm"))
