"""Filters on atom tables, integrity checks and repair. Masks are Columns; semi-joins and windows return tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Canonical residue names and backbone atoms.
AMINO_ACIDS = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "PYL", "SEC", "SER", "THR", "TRP", "TYR", "VAL")
NUCLEOTIDES = ("A", "DA", "G", "DG", "C", "DC", "U", "DT")
SOLVENT = ("HOH", "SOL")
PEPTIDE_BACKBONE = ("N", "CA", "C")
PHOSPHATE_BACKBONE = ("P", "O5'", "C5'", "C4'", "C3'", "O3'")


def is_heavy(element: Column) -> Column:
    return ~element.isin("H", "D")


def is_solvent(res_name: Column) -> Column:
    return res_name.isin(*SOLVENT)


def is_canonical_amino_acid(res_name: Column) -> Column:
    return res_name.isin(*AMINO_ACIDS)


def is_canonical_nucleotide(res_name: Column) -> Column:
    return res_name.isin(*NUCLEOTIDES)


def is_peptide_backbone(res_name: Column, atom_name: Column) -> Column:
    return is_canonical_amino_acid(res_name) & atom_name.isin(*PEPTIDE_BACKBONE)


def is_phosphate_backbone(res_name: Column, atom_name: Column) -> Column:
    return is_canonical_nucleotide(res_name) & atom_name.isin(*PHOSPHATE_BACKBONE)


def in_dictionary(atoms: DataFrame, names: DataFrame, column: str = "res_name") -> DataFrame:
    """Rows whose residue name a dictionary table lists (amino acids, nucleotides, carbohydrates, ions)."""
    return atoms.join(names.select(F.col(names.columns[0]).alias(column)).distinct(), column, "left_semi").select(atoms.columns)


def monoatomic_ions(atoms: DataFrame, ions: DataFrame, by: Sequence[str] = ("structure_id",)) -> DataFrame:
    """Rows of single-atom residues whose name the ion table lists."""
    return in_dictionary(atoms, ions)


def intersection(atoms: DataFrame, other: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Rows whose annotations also occur in ``other``; nulls match nulls."""
    cond = None
    right = other.select(*[F.col(c).alias(f"_r_{c}") for c in categories]).distinct()
    for c in categories:
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = one if cond is None else cond & one
    return atoms.join(right, cond, "left_semi")


def polymer(rows: DataFrame, by: Sequence[str], chain: str, residue: str, least: int = 2) -> DataFrame:
    """Rows of chains with at least ``least`` residues."""
    sizes = rows.groupBy(*by, chain).agg(F.count_distinct(residue).alias("_n")).where(F.col("_n") >= least)
    return rows.join(sizes.drop("_n"), [*by, chain], "left_semi").select(rows.columns)


def linear_continuity(rows: DataFrame, by: Sequence[str], order: Sequence[str], coords: Sequence[str], low: float, high: float) -> DataFrame:
    """Adds ``continuous``: is the bond to the row before within [low, high]? A first row is continuous."""
    w = Window.partitionBy(*by).orderBy(*order)
    square = sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in coords), F.lit(0.0))
    return rows.withColumn("continuous", F.coalesce(F.sqrt(square).between(low, high), F.lit(True)))


def discontinuities(rows: DataFrame, by: Sequence[str], order: Sequence[str], number: str, *, steps: Sequence[int] = (1,)) -> DataFrame:
    """Rows whose number does not follow the one before by one of ``steps``."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.col(number) - F.lag(number).over(w)
    return rows.withColumn("_step", step).where(F.col("_step").isNotNull() & ~F.col("_step").isin(*steps)).drop("_step")


def first_altloc(rows: DataFrame, residue: Sequence[str], order: Sequence[str], altloc: str = "altloc_id") -> DataFrame:
    """Rows without an alternative location, and of each residue those of its first alphanumeric one."""
    w = Window.partitionBy(*residue)
    named = F.col(altloc).rlike("^[A-Za-z0-9]$")
    first = F.min(F.when(named, F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.col(altloc).alias("_a")))).over(w)
    return rows.withColumn("_first", first["_a"]).where(~F.coalesce(named, F.lit(False)) | (F.col(altloc) == F.col("_first"))).drop("_first")


def highest_occupancy_altloc(rows: DataFrame, residue: Sequence[str], altloc: str = "altloc_id", occupancy: str = "occupancy") -> DataFrame:
    """As ``first_altloc``, but of the location with the highest summed occupancy, the first by name of equals."""
    named = F.col(altloc).rlike("^[A-Za-z0-9]$")
    sums = rows.where(named).groupBy(*residue, altloc).agg(F.sum(occupancy).alias("_sum"))
    best = sums.groupBy(*residue).agg(F.min(F.struct((-F.col("_sum")).alias("s"), F.col(altloc).alias("a")))["a"].alias("_best"))
    out = rows.join(best, list(residue), "left")
    return out.where(~F.coalesce(named, F.lit(False)) | (F.col(altloc) == F.col("_best"))).select(rows.columns)


def duplicates(rows: DataFrame, by: Sequence[str], order: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """All rows but the first of those that share all categories; coordinates do not count."""
    w = Window.partitionBy(*by, *categories).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def infer_element(atom_name: Column) -> Column:
    """Element from an atom name: one-letter biological elements first, then two letters."""
    letters = F.regexp_replace(F.upper(atom_name), "[^A-Z]", "")
    one = F.substring(letters, 1, 1)
    two = F.substring(letters, 1, 2)
    known = ("CL", "BR", "NA", "MG", "ZN", "FE", "MN", "CU", "SE", "LI", "SI", "AL", "NI")
    return F.when(letters == "", "").when(one.isin("C", "N", "O", "S", "H", "P") & ~two.isin("CL", "NA", "SE", "SI"), one).when(two.isin(*known), two).otherwise(one)


def atom_names(rows: DataFrame, residue: Sequence[str], order: Sequence[str], element: str = "element") -> DataFrame:
    """Adds ``atom_name``: the element and a running number within the residue; a single atom of its element has no number."""
    w = Window.partitionBy(*residue, element)
    number = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("atom_name", F.concat(F.col(element), F.when(F.count("*").over(w) > 1, number.cast("string")).otherwise("")))
