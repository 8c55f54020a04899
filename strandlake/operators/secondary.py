"""Secondary structure: helices and strands from CA traces by windows, base-pair notations, protein blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.geometry import angle, dihedral, distance
from strandlake.operators.segments import with_positions
from strandlake.operators.spatial import within

# Published ranges of the P-SEA method, angstrom and degrees.
HELIX = {"d3": (4.8, 5.8), "d4": (5.8, 7.0), "r": (77.0, 101.0), "a": (30.0, 70.0)}
STRAND = {"d2": (6.1, 7.3), "d3": (9.0, 10.8), "d4": (11.3, 13.5), "r": (110.0, 138.0), "a": ((-180.0, -125.0), (145.0, 180.0))}
CONTACT = (4.2, 5.2)


def _in(value: Column, low: float, high: float) -> Column:
    return F.coalesce(value.between(low, high) & ~F.isnan(value), F.lit(False))


def annotate_sse(ca: DataFrame, by: Sequence[str], order: str = "res_idx", number: str = "res_id") -> DataFrame:
    """(by…, order, sse) of one CA row (x, y, z) a residue: a helix, b strand, c coil, '' without coordinates.

    Windows do not cross a step of residue numbers other than one; structures of up to five residues are coil.
    """
    w = Window.partitionBy(*by).orderBy(order)
    step = F.col(number) - F.lag(number).over(w)
    rows = ca.withColumn("_break", F.coalesce((step != 1).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_size", F.count("*").over(Window.partitionBy(*by)))
    rows = rows.withColumn("_has", ~(F.isnan("x") | F.isnan("y") | F.isnan("z")) & F.col("x").isNotNull())
    r = Window.partitionBy(*by, "_run").orderBy(order)
    at = lambda k: tuple(F.lag(c, -k).over(r) if k < 0 else F.lead(c, k).over(r) if k else F.col(c) for c in "xyz")
    rows = (
        rows.withColumn("_d2", distance(at(-1), at(1)))
        .withColumn("_d3", distance(at(-1), at(2)))
        .withColumn("_d4", distance(at(-1), at(3)))
        .withColumn("_r", F.degrees(angle(at(-1), at(0), at(1))))
        .withColumn("_a", F.degrees(dihedral(at(-1), at(0), at(1), at(2))))
    )
    c = F.col
    strict = {
        "a": (_in(c("_d3"), *HELIX["d3"]) & _in(c("_d4"), *HELIX["d4"])) | (_in(c("_r"), *HELIX["r"]) & _in(c("_a"), *HELIX["a"])),
        "b": (_in(c("_d2"), *STRAND["d2"]) & _in(c("_d3"), *STRAND["d3"]) & _in(c("_d4"), *STRAND["d4"])) | (_in(c("_r"), *STRAND["r"]) & (_in(c("_a"), *STRAND["a"][0]) | _in(c("_a"), *STRAND["a"][1]))),
    }
    relaxed = {"a": _in(c("_d3"), *HELIX["d3"]) | _in(c("_r"), *HELIX["r"]), "b": _in(c("_d3"), *STRAND["d3"])}
    for kind in "ab":
        rows = rows.withColumn(f"_s{kind}", strict[kind]).withColumn(f"_l{kind}", relaxed[kind])
        rows = with_positions(rows, [*by, "_run"], [order], [f"_s{kind}"], (), f"_i{kind}")
        rows = rows.withColumn(f"_n{kind}", F.when(c(f"_s{kind}"), F.count("*").over(Window.partitionBy(*by, "_run", f"_i{kind}"))).otherwise(0))
    touch = within(rows.where("_nb >= 3 AND _has").select(*by, order, "x", "y", "z"), rows.where("_has").select(*by, F.col(order).alias("_o"), "x", "y", "z"), CONTACT[1], by=by)
    touch = touch.where(F.sqrt("dist2") > CONTACT[0]).groupBy(*by, order).agg(F.count("*").alias("_t"))
    rows = rows.join(touch, [*by, order], "left")
    contacts = F.sum(F.coalesce("_t", F.lit(0))).over(Window.partitionBy(*by, "_run", "_ib"))
    rows = rows.withColumn("_ba", c("_na") >= 5).withColumn("_bb", (c("_nb") >= 4) | ((c("_nb") == 3) & (contacts >= 5)))
    for kind in "ab":
        edge = F.coalesce(F.lag(f"_b{kind}").over(r), F.lit(False)) | F.coalesce(F.lead(f"_b{kind}").over(r), F.lit(False))
        rows = rows.withColumn(f"_m{kind}", c(f"_b{kind}") | (edge & c(f"_l{kind}")))
    sse = F.when(~c("_has"), "").when(c("_size") <= 5, "c").when(c("_mb"), "b").when(c("_ma"), "a").otherwise("c")
    return rows.select(*by, order, sse.alias("sse"))


# Protein blocks -------------------------------------------------------------------------------

#: Published reference dihedrals of the 16 blocks a to p (psi-2, phi-1, psi-1, phi, psi, phi+1, psi+1, phi+2).
PROTEIN_BLOCKS = {
    "a": (41.14, 75.53, 13.92, -99.80, 131.88, -96.27, 122.08, -99.68), "b": (108.24, -90.12, 119.54, -92.21, -18.06, -128.93, 147.04, -99.90),
    "c": (-11.61, -105.66, 94.81, -106.09, 133.56, -106.93, 135.97, -100.63), "d": (141.98, -112.79, 132.20, -114.79, 140.11, -111.05, 139.54, -103.16),
    "e": (133.25, -112.37, 137.64, -108.13, 133.00, -87.30, 120.54, 77.40), "f": (116.40, -105.53, 129.32, -96.68, 140.72, -74.19, -26.65, -94.51),
    "g": (0.40, -81.83, 4.91, -100.59, 85.50, -71.65, 130.78, 84.98), "h": (119.14, -102.58, 130.83, -67.91, 121.55, 76.25, -2.95, -90.88),
    "i": (130.68, -56.92, 119.26, 77.85, 10.42, -99.43, 141.40, -98.01), "j": (114.32, -121.47, 118.14, 82.88, -150.05, -83.81, 23.35, -85.82),
    "k": (117.16, -95.41, 140.40, -59.35, -29.23, -72.39, -25.08, -76.16), "l": (139.20, -55.96, -32.70, -68.51, -26.09, -74.44, -22.60, -71.74),
    "m": (-39.62, -64.73, -39.52, -65.54, -38.88, -66.89, -37.76, -70.19), "n": (-35.34, -65.03, -38.12, -66.34, -29.51, -89.10, -2.91, 77.90),
    "o": (-45.29, -67.44, -27.72, -87.27, 5.13, 77.49, 30.71, -93.23), "p": (-27.09, -86.14, 0.30, 59.85, 21.51, -96.30, 132.67, -92.91),
}


def backbone_dihedrals(backbone: DataFrame, by: Sequence[str], order: str = "res_idx") -> DataFrame:
    """(by…, order, phi, psi, omega) in radians of one row a residue with n, ca, c coordinates (nx … cz)."""
    w = Window.partitionBy(*by).orderBy(order)
    atom = lambda name, k=0: tuple((F.lead(f"{name}{d}", k).over(w) if k > 0 else F.lag(f"{name}{d}", -k).over(w) if k < 0 else F.col(f"{name}{d}")) for d in "xyz")
    phi = dihedral(atom("c", -1), atom("n"), atom("ca"), atom("c"))
    psi = dihedral(atom("n"), atom("ca"), atom("c"), atom("n", 1))
    omega = dihedral(atom("ca"), atom("c"), atom("n", 1), atom("ca", 1))
    return backbone.select(*by, order, phi.alias("phi"), psi.alias("psi"), omega.alias("omega"))


def protein_blocks(dihedrals: DataFrame, by: Sequence[str], order: str = "res_idx") -> DataFrame:
    """(by…, order, block): the nearest block of each residue's eight dihedrals, 'z' where one is missing. Angles in radians."""
    w = Window.partitionBy(*by).orderBy(order)
    at = lambda c, k: F.degrees((F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w) if k else F.col(c))
    seen = [at("psi", -2), at("phi", -1), at("psi", -1), at("phi", 0), at("psi", 0), at("phi", 1), at("psi", 1), at("phi", 2)]
    rows = dihedrals.select(*by, order, F.array(*seen).alias("_v"))
    gap = lambda x, ref: F.pow(F.pmod(x - ref + 180.0, F.lit(360.0)) - 180.0, F.lit(2.0))
    costs = [F.struct(sum((gap(F.get("_v", F.lit(i)), F.lit(v)) for i, v in enumerate(ref)), F.lit(0.0)).alias("d"), F.lit(name).alias("b")) for name, ref in PROTEIN_BLOCKS.items()]
    whole = ~F.exists("_v", lambda x: x.isNull() | F.isnan(x))
    return rows.select(*by, order, F.when(whole, F.array_min(F.array(*costs))["b"]).otherwise("z").alias("block"))


# Base pairs -----------------------------------------------------------------------------------

BRACKETS = "()[]{}<>" + "".join(c + c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def nested(pairs: list[tuple[int, int]], scores: list[float] | None = None) -> list[bool]:
    """Which pairs stay in a heaviest set of pairs that nest: dynamic programming over the positions that are paired."""
    scores = scores or [1.0] * len(pairs)
    ends = sorted({p for pair in pairs for p in pair})
    place = {p: i for i, p in enumerate(ends)}
    closes: dict[int, list[tuple[int, int]]] = {}
    for k, (a, b) in enumerate(pairs):
        closes.setdefault(place[max(a, b)], []).append((place[min(a, b)], k))
    n = len(ends)
    best = np.zeros((n + 1, n + 1))
    for j in range(1, n + 1):
        for i in range(j - 1, -1, -1):
            best[i, j] = best[i, j - 1]
            for a, k in closes.get(j - 1, []):
                if a >= i:
                    best[i, j] = max(best[i, j], best[i, a] + best[a + 1, j - 1] + scores[k])
    keep = [False] * len(pairs)
    stack = [(0, n)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        for a, k in closes.get(j - 1, []):
            if a >= i and best[i, j] == best[i, a] + best[a + 1, j - 1] + scores[k]:
                keep[k] = True
                stack += [(i, a), (a + 1, j - 1)]
                break
        else:
            stack.append((i, j - 1))
    return keep


def orders(pairs: list[tuple[int, int]], scores: list[float] | None = None, most: int | None = None) -> list[int]:
    """The pseudoknot order of each pair: those left over from one nested set make the next; -1 above ``most``."""
    scores = scores or [1.0] * len(pairs)
    out, left, order = [-1] * len(pairs), list(range(len(pairs))), 0
    while left and (most is None or order <= most):
        keep = nested([pairs[i] for i in left], [scores[i] for i in left])
        for i, k in zip(left, keep, strict=True):
            if k:
                out[i] = order
        left = [i for i, k in zip(left, keep, strict=True) if not k]
        order += 1
    return out


def dot_bracket(pairs: list[tuple[int, int]], length: int, scores: list[float] | None = None, most: int | None = None) -> str:
    out = ["."] * length
    for (a, b), order in zip(pairs, orders(pairs, scores, most), strict=True):
        if order >= 0:
            out[min(a, b)], out[max(a, b)] = BRACKETS[2 * order : 2 * order + 2]
    return "".join(out)


def pairs_of(text: str) -> list[tuple[int, int]]:
    """The base pairs of a dot-bracket text, by first position."""
    open_: dict[int, list[int]] = {}
    out = []
    for i, c in enumerate(text):
        if c == ".":
            continue
        kind = BRACKETS.find(c)
        if kind < 0:
            raise ValueError(f"{c!r} is no dot-bracket symbol")
        if kind % 2 == 0:
            open_.setdefault(kind, []).append(i)
        elif open_.get(kind - 1):
            out.append((open_[kind - 1].pop(), i))
        else:
            raise ValueError(f"bracket at {i} closes nothing")
    if any(open_.values()):
        raise ValueError("a bracket is not closed")
    return sorted(out)


def dot_brackets(pairs: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(key, notation) of base pairs (key, base1, base2) and lengths (key, length); molecules run side by side."""

    def run(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame(columns=[key, "notation"])
        rows = sorted(zip(left["base1"], left["base2"], strict=True))
        return pd.DataFrame({key: [k[0]], "notation": [dot_bracket(rows, int(right["length"].iloc[0]))]})

    kind = dict(lengths.dtypes)[key]
    return pairs.groupBy(key).cogroup(lengths.groupBy(key)).applyInPandas(run, f"{key} {kind}, notation string")


def unique_pairs(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each base in one pair only: of its pairs, one with the most hydrogen bonds, the first of equals."""
    a = Window.partitionBy(*by, "base1").orderBy(F.col("hbonds").desc(), "base2")
    b = Window.partitionBy(*by, "base2").orderBy(F.col("hbonds").desc(), "base1")
    rows = pairs.withColumn("_a", F.row_number().over(a)).withColumn("_b", F.row_number().over(b))
    return rows.where("_a = 1 AND _b = 1").drop("_a", "_b")
