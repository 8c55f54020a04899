"""Vector maths as Column expressions over coordinate triples; NaN and null pass through."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(*names: str) -> Vector:
    return tuple(F.col(n) for n in names)


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def angle(a: Vector, b: Vector, c: Vector) -> Column:
    """The angle at b in radians."""
    u, v = minus(a, b), minus(c, b)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(u, v) / (norm(u) * norm(v)))))


def dihedral(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """The signed angle between the planes abc and bcd in radians."""
    u, v, w = minus(b, a), minus(c, b), minus(d, c)
    n1, n2 = cross(u, v), cross(v, w)
    return F.atan2(dot(cross(n1, n2), v) / norm(v), dot(n1, n2))


def translated(a: Vector, by: Sequence[float]) -> Vector:
    return tuple(x + F.lit(float(t)) for x, t in zip(a, by, strict=True))


def transformed(a: Vector, rotation: Sequence[Sequence[float]], shift: Sequence[float] = (0, 0, 0), center: Sequence[float] = (0, 0, 0)) -> Vector:
    """Rotation about ``center`` and a shift."""
    moved = translated(a, [-c for c in center])
    return tuple(sum((F.lit(float(r)) * x for r, x in zip(row, moved, strict=True)), F.lit(float(s + c))) for row, s, c in zip(rotation, shift, center, strict=True))


def rotation_matrix(angles: Sequence[float]) -> list[list[float]]:
    """Rotation about x, then y, then z."""
    (cx, sx), (cy, sy), (cz, sz) = ((math.cos(t), math.sin(t)) for t in angles)
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def axis_rotation(axis: Sequence[float], theta: float) -> list[list[float]]:
    """Rotation about an axis through the origin."""
    size = math.sqrt(sum(c * c for c in axis))
    if not size:
        raise ValueError("the axis has no length")
    x, y, z = (c / size for c in axis)
    c, s, t = math.cos(theta), math.sin(theta), 1 - math.cos(theta)
    return [[t * x * x + c, t * x * y - s * z, t * x * z + s * y], [t * x * y + s * z, t * y * y + c, t * y * z - s * x], [t * x * z - s * y, t * y * z + s * x, t * z * z + c]]


# Boxes ----------------------------------------------------------------------------------


def box_from_cell(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[list[float]]:
    """Box vectors of a unit cell (angles in radians)."""
    bx, by = b * math.cos(gamma), b * math.sin(gamma)
    cx = c * math.cos(beta)
    cy = c * (math.cos(alpha) - math.cos(beta) * math.cos(gamma)) / math.sin(gamma)
    return [[a, 0.0, 0.0], [bx, by, 0.0], [cx, cy, math.sqrt(c * c - cx * cx - cy * cy)]]


def cell_from_box(box: Sequence[Sequence[float]]) -> tuple[float, ...]:
    size = [math.sqrt(sum(x * x for x in v)) for v in box]
    between = lambda i, j: math.acos(sum(p * q for p, q in zip(box[i], box[j], strict=True)) / size[i] / size[j])
    return (*size, between(1, 2), between(0, 2), between(0, 1))


def box_volume(box: Sequence[Sequence[float]]) -> float:
    (a, b, c), (d, e, f), (g, h, i) = box
    return abs(a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g))


def is_orthogonal(box: Sequence[Sequence[float]], tolerance: float = 1e-6) -> bool:
    return all(abs(sum(p * q for p, q in zip(box[i], box[j], strict=True))) < tolerance for i, j in ((0, 1), (0, 2), (1, 2)))


def _inverse(m: Sequence[Sequence[float]]) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [
        [(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det],
        [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det],
        [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det],
    ]


def to_fraction(a: Vector, box: Sequence[Sequence[float]]) -> Vector:
    inv = _inverse(box)
    return tuple(sum((a[i] * F.lit(inv[i][j]) for i in range(3)), F.lit(0.0)) for j in range(3))


def from_fraction(f: Vector, box: Sequence[Sequence[float]]) -> Vector:
    return tuple(sum((f[i] * F.lit(float(box[i][j])) for i in range(3)), F.lit(0.0)) for j in range(3))


def inside_box(a: Vector, box: Sequence[Sequence[float]]) -> Vector:
    """Coordinates moved into the box by whole box vectors."""
    return from_fraction(tuple(f - F.floor(f) for f in to_fraction(a, box)), box)


def is_in_box(a: Vector, box: Sequence[Sequence[float]]) -> Column:
    return F.forall(F.array(*to_fraction(a, box)), lambda f: (f >= 0) & (f < 1))


def nearest_image(d: Vector, box: Sequence[Sequence[float]]) -> Vector:
    """A difference vector's shortest periodic image: by fractions in orthogonal boxes, else the best of eight shifts."""
    f = tuple(x - F.floor(x) for x in to_fraction(d, box))
    if is_orthogonal(box):
        return from_fraction(tuple(F.when(x > 0.5, x - 1).otherwise(x) for x in f), box)
    images = [from_fraction(tuple(x - s for x, s in zip(f, (i & 1, i >> 1 & 1, i >> 2), strict=True)), box) for i in range(8)]
    best = F.array_min(F.array(*[F.struct(dot(v, v).alias("q"), *[x.alias(n) for x, n in zip(v, "xyz", strict=True)]) for v in images]))
    return tuple(best[n] for n in "xyz")


def pbc_distance(a: Vector, b: Vector, box: Sequence[Sequence[float]]) -> Column:
    return norm(nearest_image(minus(a, b), box))


def repeat_box(atoms: DataFrame, box: Sequence[Sequence[float]], amount: int = 1, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The atoms with copies in the boxes around; ``image`` is 0 for the original, then counts in order of shifts."""
    span = range(-amount, amount + 1)
    shifts = [(0, 0, 0)] + [(i, j, k) for i in span for j in span for k in span if (i, j, k) != (0, 0, 0)]
    rows = [F.struct(F.lit(n).alias("image"), *[F.lit(float(sum(s[i] * box[i][j] for i in range(3)))).alias(f"d{j}") for j in range(3)]) for n, s in enumerate(shifts)]
    out = atoms.withColumn("_s", F.explode(F.array(*rows)))
    for j, c in enumerate(coords):
        out = out.withColumn(c, F.col(c) + F.col(f"_s.d{j}"))
    return out.withColumn("image", F.col("_s.image")).drop("_s")


def apply_operations(atoms: DataFrame, operations: DataFrame, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Each atom under each operation (op_id, r11 … r33, t1 … t3): assemblies and unit cells. The few operations are broadcast."""
    x = [F.col(c) for c in coords]
    out = atoms.crossJoin(F.broadcast(operations))
    moved = [sum((F.col(f"r{i}{j}") * x[j - 1] for j in (1, 2, 3)), F.col(f"t{i}")) for i in (1, 2, 3)]
    keep = [c for c in atoms.columns if c not in coords]
    return out.select(*keep, "op_id", *[m.alias(c) for m, c in zip(moved, coords, strict=True)])


def remove_pbc(atoms: DataFrame, box: Sequence[Sequence[float]], by: Sequence[str], order: Sequence[str], coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Atoms of each molecule (``by``) joined again across the box's borders: each lies at the image nearest to the atom before it.

    A molecule keeps the place of its first atom. A missing coordinate breaks the chain: what follows is missing too.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    here = vector(*coords)
    first = F.row_number().over(w) == 1
    step = [F.lag(c).over(w) for c in coords]
    out = atoms.withColumn("_first", first).withColumn("_before", F.struct(*[s.alias(c) for s, c in zip(step, coords, strict=True)]))
    near = nearest_image(minus(here, tuple(F.col(f"_before.{c}") for c in coords)), box)
    out = out.withColumn("_step", F.struct(*[F.when(F.col("_first"), x).otherwise(n).alias(c) for x, n, c in zip(here, near, coords, strict=True)]))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.max(F.col(f"_step.{coords[0]}").isNull()).over(run)
    return out.withColumns({c: F.when(~gap, F.sum(f"_step.{c}").over(run)) for c in coords}).drop("_first", "_before", "_step")


# Symmetry -------------------------------------------------------------------------------


def parse_symmetry(text: str) -> list[list[float]]:
    """Rows (three factors and a shift) of an operation on fractions such as "x-y, -y+1/2, z"."""
    rows = []
    for part in text.lower().replace(" ", "").split(","):
        row = [0.0] * 4
        terms = re.findall(r"([+-]?)(?:([xyz])|(\d+(?:\.\d+)?)(?:/(\d+))?)", part)
        if "".join(s + v + n + (f"/{d}" if d else "") for s, v, n, d in terms) != part or not part:
            raise ValueError(f"no symmetry operation: {text!r}")
        for sign, name, number, below in terms:
            factor = -1.0 if sign == "-" else 1.0
            if name:
                row["xyz".index(name)] += factor
            else:
                row[3] += factor * float(number) / float(below or 1)
        rows.append(row)
    if len(rows) != 3:
        raise ValueError(f"no symmetry operation: {text!r}")
    return rows


def operations(spark: SparkSession, rows: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """A table for ``apply_operations`` of operations with rows of three factors and a shift."""
    names = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)] + ["t1", "t2", "t3"]
    flat = [(n, *[float(v) for r in o for v in r[:3]], *[float(r[3]) for r in o]) for n, o in enumerate(rows)]
    return spark.createDataFrame(flat, "op_id long, " + ", ".join(f"{n} double" for n in names))


def symmetry_mates(atoms: DataFrame, box: Sequence[Sequence[float]], symmetry: Sequence[str], coords: Sequence[str] = ("x", "y", "z"), inside: bool = False) -> DataFrame:
    """The unit cell: each atom under each symmetry operation; with ``inside`` every copy is moved into the box."""
    ops = operations(atoms.sparkSession, [parse_symmetry(s) for s in symmetry])
    in_cell = atoms.withColumns(dict(zip(coords, to_fraction(vector(*coords), box), strict=True)))
    moved = apply_operations(in_cell, ops, coords)
    place = tuple(f - F.floor(f) for f in vector(*coords)) if inside else vector(*coords)
    return moved.withColumns(dict(zip(coords, from_fraction(place, box), strict=True)))


def parse_assembly(expression: str) -> list[tuple[str, ...]]:
    """Operation names of an assembly expression, each a product applied from the right: "(1-2)(X0)" gives (1, X0), (2, X0)."""
    factors = re.findall(r"\(([^()]*)\)", expression) or [expression]

    def names(part: str) -> list[str]:
        out = []
        for item in part.replace(" ", "").split(","):
            span = re.fullmatch(r"(\d+)-(\d+)", item)
            out += [str(i) for i in range(int(span[1]), int(span[2]) + 1)] if span else [item]
        return out

    return list(product(*map(names, factors)))


def compose(first: Sequence[Sequence[float]], then: Sequence[Sequence[float]]) -> list[list[float]]:
    """Rows of the operation ``then`` after ``first``."""
    return [[sum(t[k] * first[k][j] for k in range(3)) + (t[3] if j == 3 else 0.0) for j in range(4)] for t in then]


def as_matrix(rows: Sequence[Sequence[float]]) -> list[list[float]]:
    """The 4 x 4 matrix of an operation."""
    return [[float(v) for v in r] for r in rows] + [[0.0, 0.0, 0.0, 1.0]]


def aligning_rotation(source: Sequence[float], target: Sequence[float]) -> list[list[float]]:
    """The rotation that turns the direction of ``source`` to that of ``target``."""
    def unit(v):
        size = math.sqrt(sum(c * c for c in v))
        if not size:
            raise ValueError("a direction has no length")
        return [c / size for c in v]

    a, b = unit(source), unit(target)
    axis = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    sine, cosine = math.sqrt(sum(c * c for c in axis)), sum(p * q for p, q in zip(a, b, strict=True))
    if sine > 1e-12:
        return axis_rotation(axis, math.atan2(sine, cosine))
    if cosine > 0:
        return [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    least = min(range(3), key=lambda i: abs(a[i]))  # half a turn about any direction at a right angle
    other = [float(i == least) for i in range(3)]
    return axis_rotation([a[1] * other[2] - a[2] * other[1], a[2] * other[0] - a[0] * other[2], a[0] * other[1] - a[1] * other[0]], math.pi)


# Dihedrals of residues ------------------------------------------------------------------

# Atoms of the side chains' dihedral angles.
CHI = {
    "ARG": "N CA CB CG CD NE CZ", "ASN": "N CA CB CG OD1", "ASP": "N CA CB CG OD1", "CYS": "N CA CB SG", "GLN": "N CA CB CG CD OE1", "GLU": "N CA CB CG CD OE1",
    "HIS": "N CA CB CG ND1", "ILE": "N CA CB CG1 CD1", "LEU": "N CA CB CG CD1", "LYS": "N CA CB CG CD CE NZ", "MET": "N CA CB CG SD CE", "PHE": "N CA CB CG CD1",
    "PRO": "N CA CB CG CD", "SER": "N CA CB OG", "THR": "N CA CB OG1", "TRP": "N CA CB CG CD1", "TYR": "N CA CB CG CD1", "VAL": "N CA CB CG1",
}
# Atoms of nucleotides' backbone angles; - and + are the residues before and after.
BACKBONE = {
    "alpha": "-O3' P O5' C5'", "beta": "P O5' C5' C4'", "gamma": "O5' C5' C4' C3'", "delta": "C5' C4' C3' O3'", "epsilon": "C4' C3' O3' +P", "zeta": "C3' O3' +P +O5'",
}
GLYCOSIDIC = {"purine": "O4' C1' N9 C4", "pyrimidine": "O4' C1' N1 C2"}


def _places(atoms: DataFrame, by: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """A row for each residue: ``at`` maps atom names to coordinates (the first of a name)."""
    rows = atoms.groupBy(*by, "atom_name").agg(F.first(F.struct("x", "y", "z")).alias("xyz"), *more)
    return rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("atom_name", "xyz"))).alias("at"), *[F.first(c).alias(c) for c in ("res_name",) if c in rows.columns])


def _angle_of(names: Sequence[str], maps: dict[str, Column]) -> Column:
    point = lambda n: tuple(F.try_element_at(maps[n[0] if n[0] in "-+" else ""], F.lit(n.lstrip("-+")))[c] for c in "xyz")
    return dihedral(*[point(n) for n in names])


def dihedral_side_chain(atoms: DataFrame, by: Sequence[str] = ("chain_id", "res_id")) -> DataFrame:
    """(by, res_name, chi1 to chi4) of each residue in radians; null where an atom or the angle is missing."""
    rows = _places(atoms, by, [F.first("res_name").alias("res_name")])
    chis = []
    for n in range(4):
        value = F.lit(None).cast("double")
        for name, chain in CHI.items():
            four = chain.split()[n : n + 4]
            if len(four) == 4:
                value = F.when(F.col("res_name") == name, _angle_of(four, {"": F.col("at")})).otherwise(value)
        chis.append(value.alias(f"chi{n + 1}"))
    return rows.select(*by, "res_name", *chis)


def nucleotide_dihedrals(atoms: DataFrame, by: Sequence[str] = ("chain_id", "res_id")) -> DataFrame:
    """(by, alpha to zeta, chi) of each nucleotide in radians; neighbours are the residues before and after in the chain."""
    w = Window.partitionBy(*by[:-1]).orderBy(by[-1])
    rows = _places(atoms, by).withColumn("_prev", F.lag("at").over(w)).withColumn("_next", F.lead("at").over(w))
    maps = {"": F.col("at"), "-": F.col("_prev"), "+": F.col("_next")}
    angles = [_angle_of(names.split(), maps).alias(name) for name, names in BACKBONE.items()]
    chi = F.coalesce(*[_angle_of(GLYCOSIDIC[k].split(), maps) for k in ("purine", "pyrimidine")]).alias("chi")
    return rows.select(*by, *angles, chi)
