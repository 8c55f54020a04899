"""Range joins in space, and analyses built on them.

A grid of cells as wide as the radius turns "within r" into an equi-join: one side's
points go to their own cell, the other side's to the 27 cells around theirs, and an exact test follows. A cell's
points are bounded by what fits in r^3, so no key grows with the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.geometry import angle, cross, distance, dot, minus, norm, vector

XYZ = ("x", "y", "z")


def _finite(coords: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in coords:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return ok


def _cells(radius: float, coords: Sequence[str], around: bool) -> Column:
    own = [F.floor(F.col(c) / radius) for c in coords]
    if not around:
        return F.struct(*[v.alias(f"c{i}") for i, v in enumerate(own)])
    near = [F.struct(*[(v + d).alias(f"c{i}") for i, (v, d) in enumerate(zip(own, ds, strict=True))]) for ds in [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]]
    return F.explode(F.array(*near))


def within(left: DataFrame, right: DataFrame, radius: float, *, by: Sequence[str] = (), coords: Sequence[str] = XYZ) -> DataFrame:
    """Pairs with distance <= radius within each group; right's columns get the prefix r_, ``dist2`` is the squared distance.

    Points that are not finite have no pairs.
    """
    a = left.where(_finite(coords)).withColumn("_cell", _cells(radius, coords, True))
    b = right.where(_finite(coords)).select(_cells(radius, coords, False).alias("_rcell"), *[F.col(c).alias(f"r_{c}") for c in right.columns])
    on = F.col("_cell") == F.col("_rcell")
    for c in by:
        on = on & (F.col(c) == F.col(f"r_{c}"))
    square = sum(((F.col(c) - F.col(f"r_{c}")) ** 2 for c in coords), F.lit(0.0))
    return a.join(b, on).withColumn("dist2", square).where(F.col("dist2") <= radius * radius).drop("_cell", "_rcell")


def contacts(points: DataFrame, radius: float, *, id: str = "atom_idx", by: Sequence[str] = (), coords: Sequence[str] = XYZ) -> DataFrame:
    """(by…, id, r_id, dist2): ordered pairs of different points within the radius."""
    pairs = within(points.select(*by, id, *coords), points.select(*by, id, *coords), radius, by=by, coords=coords)
    return pairs.where(F.col(id) != F.col(f"r_{id}")).select(*by, id, f"r_{id}", "dist2")


def degrees(points: DataFrame, radius: float, *, id: str = "atom_idx", by: Sequence[str] = (), coords: Sequence[str] = XYZ) -> DataFrame:
    """(by…, id, degree) of the adjacency matrix without its diagonal; points without neighbours too."""
    counts = contacts(points, radius, id=id, by=by, coords=coords).groupBy(*by, id).agg(F.count("*").alias("degree"))
    return points.select(*by, id).join(counts, [*by, id], "left").select(*by, id, F.coalesce("degree", F.lit(0)).alias("degree"))


def rdf(points: DataFrame, *, radius: float, bins: int, by: Sequence[str] = (), id: str = "atom_idx", coords: Sequence[str] = XYZ, volume: float) -> DataFrame:
    """(by…, bin, pairs, g): the radial distribution of all points around all points; the last bin is closed.

    g is the pair density of a shell over the mean density in ``volume``.
    """
    width = radius / bins
    pairs = contacts(points, radius, id=id, by=by, coords=coords)
    at = F.least(F.floor(F.sqrt("dist2") / width), F.lit(bins - 1))
    counts = pairs.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("pairs"))
    sizes = points.groupBy(*by).agg(F.count("*").alias("_n"))
    grid = sizes.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    out = grid.join(counts, [*by, "bin"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    shell = F.lit(4 / 3 * math.pi * width**3) * (F.pow(F.col("bin") + 1, F.lit(3)) - F.pow(F.col("bin"), F.lit(3)))
    return out.select(*by, "bin", "pairs", (F.col("pairs") / F.col("_n") / shell / (F.col("_n") / F.lit(float(volume)))).alias("g"))


def density(points: DataFrame, *, delta: float, by: Sequence[str] = (), coords: Sequence[str] = XYZ, weight: Column | None = None) -> DataFrame:
    """(by…, i, j, k, n): the histogram of points on a grid with cells of width ``delta``; empty cells are left out."""
    cells = [F.floor(F.col(c) / delta).alias(n) for c, n in zip(coords, "ijk", strict=True)]
    value = F.count("*") if weight is None else F.sum(weight)
    return points.where(_finite(coords)).groupBy(*by, *cells).agg(value.alias("n"))


def hydrogen_bonds(donors: DataFrame, acceptors: DataFrame, *, cutoff: float = 2.5, least_angle: float = 120.0, by: Sequence[str] = ()) -> DataFrame:
    """(by…, donor, hydrogen, acceptor, theta, dist): triplets with d(H, A) <= cutoff and an angle D-H-A above the limit.

    ``donors`` is (by…, donor, hydrogen, x, y, z of the hydrogen, dx, dy, dz of the donor), ``acceptors`` (by…, acceptor, x, y, z).
    """
    pairs = within(donors, acceptors, cutoff, by=by).where(F.col("donor") != F.col("r_acceptor"))
    theta = F.degrees(angle(vector("dx", "dy", "dz"), vector("x", "y", "z"), vector("r_x", "r_y", "r_z")))
    out = pairs.withColumn("theta", theta).where((F.col("theta") > least_angle) & ~F.isnan("theta"))
    return out.select(*by, "donor", "hydrogen", F.col("r_acceptor").alias("acceptor"), "theta", F.sqrt("dist2").alias("dist"))


def donor_hydrogens(atoms: DataFrame, *, residue: Sequence[str], longest: float = 1.5, elements: Sequence[str] = ("O", "N", "S"), by: Sequence[str] = ()) -> DataFrame:
    """Donors and hydrogens by distance within a residue, where no bonds are known."""
    h = atoms.where("element = 'H'").select(*by, *residue, F.col("atom_idx").alias("hydrogen"), *XYZ)
    d = atoms.where(F.col("element").isin(*elements)).select(*by, *residue, F.col("atom_idx").alias("donor"), *[F.col(c).alias(f"d{c}") for c in XYZ])
    return h.join(d, [*by, *residue]).where(distance(vector(*XYZ), vector("dx", "dy", "dz")) <= longest)


def frequency(triplets: DataFrame, models: int, keys: Sequence[str] = ("donor", "hydrogen", "acceptor")) -> DataFrame:
    """(keys…, frequency): in what share of the models a bond occurs."""
    return triplets.groupBy(*keys).agg((F.count_distinct("model") / models).alias("frequency"))


def stacking(rings: DataFrame, *, parallel: tuple[float, float] = (6.5, 2.0), perpendicular: tuple[float, float] = (5.5, 2.0), tolerance: float = 30.0, by: Sequence[str] = ()) -> DataFrame:
    """(by…, ring, r_ring, kind, dist): pairs of ring centres (ring, x, y, z, normal nx, ny, nz) that stack.

    Parallel rings: close centres, normals within the tolerance and a bounded offset; perpendicular ones: normals within
    the tolerance of a right angle.
    """
    reach = max(parallel[0], perpendicular[0])
    pairs = within(rings, rings, reach, by=by).where("ring < r_ring")
    n, m, d = vector("nx", "ny", "nz"), vector("r_nx", "r_ny", "r_nz"), minus(vector("r_x", "r_y", "r_z"), vector(*XYZ))
    bend = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot(n, m)) / (norm(n) * norm(m)))))
    offset = F.least(norm(cross(d, n)) / norm(n), norm(cross(d, m)) / norm(m))
    gap = F.sqrt("dist2")
    kind = F.when((bend <= tolerance) & (gap <= parallel[0]) & (offset <= parallel[1]), "parallel").when((bend >= 90 - tolerance) & (gap <= perpendicular[0]) & (offset <= perpendicular[1]), "perpendicular")
    return pairs.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*by, "ring", "r_ring", "kind", gap.alias("dist"))


def sphere_points(n: int) -> list[tuple[float, float, float]]:
    """Points spread evenly on the unit sphere along a golden spiral."""
    out = []
    for i in range(n):
        z = 1 - (2 * i + 1) / n
        r, t = math.sqrt(1 - z * z), math.pi * (3 - math.sqrt(5)) * i
        out.append((r * math.cos(t), r * math.sin(t), z))
    return out


def sasa(atoms: DataFrame, *, probe: float = 1.4, points: int = 1000, most_radius: float = 3.0, id: str = "atom_idx", by: Sequence[str] = ()) -> DataFrame:
    """(by…, id, sasa): solvent accessible area of atoms (x, y, z, radius).

    A point of an atom's enlarged sphere is hidden if it lies strictly inside another's. Neighbours come
    from the grid join as one list an atom (their number is bounded by space), and a kernel tests the points against them.
    """
    unit = np.array(sphere_points(points))
    pairs = within(atoms.select(*by, id, *XYZ, "radius"), atoms.select(*by, id, *XYZ, "radius"), 2 * (most_radius + probe), by=by)
    pairs = pairs.where((F.col(id) != F.col(f"r_{id}")) & (F.sqrt("dist2") < F.col("radius") + F.col("r_radius") + 2 * probe))
    near = pairs.groupBy(*by, id).agg(F.collect_list(F.array(F.col("r_x").cast("double"), F.col("r_y").cast("double"), F.col("r_z").cast("double"), F.col("r_radius").cast("double"))).alias("_near"))
    rows = atoms.join(near, [*by, id], "left")

    @F.pandas_udf("double")
    def area(x: pd.Series, y: pd.Series, z: pd.Series, r: pd.Series, near: pd.Series) -> pd.Series:
        out = []
        for a, b, c, q, others in zip(x, y, z, r, near, strict=True):
            if not np.isfinite([a, b, c, q]).all():
                out.append(float("nan"))
                continue
            size = q + probe
            free = np.ones(points, bool)
            if isinstance(others, (list, np.ndarray)) and len(others):
                o = np.stack([np.asarray(v, float) for v in others])
                d = (np.array([a, b, c]) + unit * size)[:, None] - o[None, :, :3]
                free = ~((d**2).sum(axis=2) < (o[:, 3] + probe) ** 2).any(axis=1)
            out.append(4 * math.pi * size**2 * free.mean())
        return pd.Series(out)

    args = [F.col(c).cast("double") for c in (*XYZ, "radius")]
    return rows.select(*by, id, F.coalesce(area(*args, F.col("_near")), F.lit(float("nan"))).alias("sasa"))
