"""Bond graphs as edge tables (structure_id?, atom1, atom2, bond_type), atom1 < atom2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.graph import connected_components
from strandlake.operators.spatial import within

# Codes of bond types.
ANY, SINGLE, DOUBLE, TRIPLE, QUADRUPLE, AROMATIC_SINGLE, AROMATIC_DOUBLE, AROMATIC_TRIPLE, COORDINATION, AROMATIC = range(10)
WITHOUT_AROMATICITY = {AROMATIC_SINGLE: SINGLE, AROMATIC_DOUBLE: DOUBLE, AROMATIC_TRIPLE: TRIPLE, AROMATIC: ANY}
WITHOUT_KEKULE = {AROMATIC_SINGLE: AROMATIC, AROMATIC_DOUBLE: AROMATIC, AROMATIC_TRIPLE: AROMATIC}


def normalized(bonds: DataFrame, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Low atom first and one row a pair, the first by ``order`` of duplicates; a bond of an atom with itself is an error."""
    a, b = F.col("atom1"), F.col("atom2")
    low = F.when(a == b, F.raise_error(F.lit("an atom is bonded to itself")).cast("long")).otherwise(F.least(a, b))
    rows = bonds.select(*by, low.alias("atom1"), F.greatest(a, b).alias("atom2"), "bond_type", *([order] if order else []))
    first = F.min_by("bond_type", order) if order else F.min("bond_type")
    return rows.groupBy(*by, "atom1", "atom2").agg(first.alias("bond_type"))


def merge(bonds: DataFrame, other: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All bonds of both; where both have one, the other's type wins."""
    keys = [*by, "atom1", "atom2"]
    return bonds.withColumnRenamed("bond_type", "_t").join(other, keys, "full").select(*keys, F.coalesce("bond_type", "_t").alias("bond_type"))


def remove(bonds: DataFrame, other: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return bonds.join(other, [*by, "atom1", "atom2"], "left_anti")


def remove_bonds_to(bonds: DataFrame, atoms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    gone = atoms.select(*by, "atom_idx")
    return bonds.join(gone.withColumnRenamed("atom_idx", "atom1"), [*by, "atom1"], "left_anti").join(gone.withColumnRenamed("atom_idx", "atom2"), [*by, "atom2"], "left_anti").select(bonds.columns)


def offset(bonds: DataFrame, by: int) -> DataFrame:
    return bonds.withColumn("atom1", F.col("atom1") + by).withColumn("atom2", F.col("atom2") + by)


def _mapped(bonds: DataFrame, table: dict[int, int]) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return bonds.withColumn("bond_type", F.coalesce(F.try_element_at(names, F.col("bond_type").cast("int")), F.col("bond_type").cast("int")))


def without_aromaticity(bonds: DataFrame) -> DataFrame:
    return _mapped(bonds, WITHOUT_AROMATICITY)


def without_kekule(bonds: DataFrame) -> DataFrame:
    return _mapped(bonds, WITHOUT_KEKULE)


def without_order(bonds: DataFrame) -> DataFrame:
    return bonds.withColumn("bond_type", F.lit(ANY))


def converted(bonds: DataFrame, source: int, target: int) -> DataFrame:
    return bonds.withColumn("bond_type", F.when(F.col("bond_type") == source, target).otherwise(F.col("bond_type")))


def both_ways(bonds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, atom, partner, bond_type): each bond from both of its atoms."""
    one = bonds.select(*by, F.col("atom1").alias("atom"), F.col("atom2").alias("partner"), "bond_type")
    return one.unionAll(bonds.select(*by, F.col("atom2"), F.col("atom1"), "bond_type"))


def partner_counts(bonds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return both_ways(bonds, by).groupBy(*by, "atom").agg(F.count("*").alias("degree"))


def subset(bonds: DataFrame, atoms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bonds among the given atoms (by…, atom_idx), renumbered by their order."""
    place = (F.row_number().over(Window.partitionBy(*by).orderBy("atom_idx")) - 1).cast("long")
    new = atoms.select(*by, "atom_idx", place.alias("_new"))
    a = new.select(*by, F.col("atom_idx").alias("atom1"), F.col("_new").alias("_a"))
    b = new.select(*by, F.col("atom_idx").alias("atom2"), F.col("_new").alias("_b"))
    return bonds.join(a, [*by, "atom1"]).join(b, [*by, "atom2"]).select(*by, F.col("_a").alias("atom1"), F.col("_b").alias("atom2"), "bond_type")


def connected(bonds: DataFrame) -> DataFrame:
    """(node, component): molecules; component is the least atom of each."""
    return connected_components(bonds, "atom1", "atom2")


def connect_by_distance(atoms: DataFrame, ranges: DataFrame, *, longest: float, residue: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Bonds within residues whose length lies in the range of their elements (element1, element2, low, high), both ends included."""
    rows = atoms.select(*by, *residue, "atom_idx", "element", "x", "y", "z")
    pairs = within(rows, rows, longest, by=[*by, *residue]).where("atom_idx < r_atom_idx")
    limits = ranges.unionByName(ranges.select(F.col("element2").alias("element1"), F.col("element1").alias("element2"), "low", "high")).distinct()
    hit = pairs.join(F.broadcast(limits), (pairs["element"] == limits["element1"]) & (pairs["r_element"] == limits["element2"]))
    return hit.where((F.sqrt("dist2") >= F.col("low")) & (F.sqrt("dist2") <= F.col("high"))).select(*by, F.col("atom_idx").alias("atom1"), F.col("r_atom_idx").alias("atom2"), F.lit(ANY).alias("bond_type"))


def connect_by_residue(atoms: DataFrame, dictionary: DataFrame, *, residue: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Bonds from a dictionary (res_name, name1, name2, bond_type) of residues' bonds."""
    one = atoms.select(*by, *residue, "res_name", F.col("atom_name").alias("name1"), F.col("atom_idx").alias("_a"))
    two = atoms.select(*by, *residue, F.col("atom_name").alias("name2"), F.col("atom_idx").alias("_b"))
    hit = one.join(dictionary, ["res_name", "name1"]).join(two, [*by, *residue, "name2"])
    return hit.select(*by, F.least("_a", "_b").alias("atom1"), F.greatest("_a", "_b").alias("atom2"), "bond_type")


def connect_residues(residues: DataFrame, atoms: DataFrame, *, by: Sequence[str] = (), link: tuple[str, str] = ("C", "N")) -> DataFrame:
    """Bonds from each residue's last to the next one's first linking atom, in one chain where res_id rises by at most one.

    ``residues`` is (by…, segment, chain_id, res_id), ``atoms`` has segment, atom_name and atom_idx.
    """
    w = Window.partitionBy(*by).orderBy("segment")
    pairs = residues.select(*by, "segment", (F.lead("segment").over(w)).alias("_n"), (F.lead("chain_id").over(w) == F.col("chain_id")).alias("_same"), (F.lead("res_id").over(w) - F.col("res_id")).alias("_step"))
    pairs = pairs.where("_same AND _step <= 1")
    a = atoms.where(F.col("atom_name") == link[0]).select(*by, "segment", F.col("atom_idx").alias("_a"))
    b = atoms.where(F.col("atom_name") == link[1]).select(*by, F.col("segment").alias("_n"), F.col("atom_idx").alias("_b"))
    return pairs.join(a, [*by, "segment"]).join(b, [*by, "_n"]).select(*by, F.least("_a", "_b").alias("atom1"), F.greatest("_a", "_b").alias("atom2"), F.lit(SINGLE).alias("bond_type"))


def rotatable(bonds: DataFrame, key: str) -> DataFrame:
    """Single bonds whose atoms both have other partners and that lie in no ring; one molecule (``key``) is one task's row group."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(rows["atom1"], rows["atom2"], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        # A bridge is an edge below which no vertex reaches back above it.
        order, low, bridges, clock = {}, {}, set(), 0
        for root in near:
            if root in order:
                continue
            order[root] = low[root] = clock
            clock += 1
            stack = [(root, None, iter(sorted(near[root])))]
            while stack:
                v, up, todo = stack[-1]
                for u in todo:
                    if u == up:
                        continue
                    if u in order:
                        low[v] = min(low[v], order[u])
                    else:
                        order[u] = low[u] = clock
                        clock += 1
                        stack.append((u, v, iter(sorted(near[u]))))
                        break
                else:
                    stack.pop()
                    if up is not None:
                        low[up] = min(low[up], low[v])
                        if low[v] > order[up]:
                            bridges.add((min(v, up), max(v, up)))
        keep = [
            t == SINGLE and (a, b) in bridges and len(near[a]) > 1 and len(near[b]) > 1
            for a, b, t in zip(rows["atom1"], rows["atom2"], rows["bond_type"], strict=True)
        ]
        return rows[keep]

    return bonds.groupBy(key).applyInPandas(run, bonds.schema)
