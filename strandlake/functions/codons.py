"""Genetic codes: codon tables by NCBI number or name, from a text, or changed from another."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.sequences import codon_table

# Number, name, codons that differ from the standard code, start codons.
CODES = (
    (1, "Standard", "", "TTG CTG ATG"),
    (2, "Vertebrate Mitochondrial", "AGA=* AGG=* ATA=M TGA=W", "ATT ATC ATA ATG GTG"),
    (3, "Yeast Mitochondrial", "ATA=M CTT=T CTC=T CTA=T CTG=T TGA=W", "ATA ATG GTG"),
    (4, "Mold Mitochondrial", "TGA=W", "TTA TTG CTG ATT ATC ATA ATG GTG"),
    (5, "Invertebrate Mitochondrial", "AGA=S AGG=S ATA=M TGA=W", "TTG ATT ATC ATA ATG GTG"),
    (6, "Ciliate Nuclear", "TAA=Q TAG=Q", "ATG"),
    (9, "Echinoderm Mitochondrial", "AAA=N AGA=S AGG=S TGA=W", "ATG GTG"),
    (10, "Euplotid Nuclear", "TGA=C", "ATG"),
    (11, "Bacterial", "", "TTG CTG ATT ATC ATA ATG GTG"),
    (12, "Alternative Yeast Nuclear", "CTG=S", "CTG ATG"),
    (13, "Ascidian Mitochondrial", "AGA=G AGG=G ATA=M TGA=W", "TTG ATA ATG GTG"),
    (14, "Alternative Flatworm Mitochondrial", "AAA=N AGA=S AGG=S TAA=Y TGA=W", "ATG"),
    (15, "Blepharisma Macronuclear", "TAG=Q", "ATG"),
    (16, "Chlorophycean Mitochondrial", "TAG=L", "ATG"),
    (21, "Trematode Mitochondrial", "AAA=N AGA=S AGG=S ATA=M TGA=W", "ATG GTG"),
    (22, "Scenedesmus obliquus Mitochondrial", "TCA=* TAG=L", "ATG"),
    (23, "Thraustochytrium Mitochondrial", "TTA=*", "ATT ATG GTG"),
    (24, "Pterobranchia Mitochondrial", "AGA=S AGG=K TGA=W", "TTG CTG ATG GTG"),
)


@dataclass(frozen=True)
class CodonTable:
    """A code: each of the 64 codons to its amino acid (* stops), and the codons that may start."""

    name: str
    codons: dict[str, str]
    starts: tuple[str, ...]
    number: int | None = None

    def __post_init__(self):
        if sorted(self.codons) != sorted(codon_table()):
            raise ValueError("a codon table maps the 64 codons of ACGT")
        if set(self.starts) - set(self.codons):
            raise ValueError("a start codon is no codon")

    def codons_of(self, amino_acid: str) -> tuple[str, ...]:
        return tuple(c for c, a in self.codons.items() if a == amino_acid)

    def with_start_codons(self, starts: Iterable[str]) -> CodonTable:
        return replace(self, starts=tuple(starts), number=None)

    def with_codon_mappings(self, changes: dict[str, str]) -> CodonTable:
        return replace(self, codons=self.codons | changes, number=None)

    def letters(self) -> str:
        """The 64 amino acids in TCAG order."""
        return "".join(self.codons[c] for c in codon_table())

    def amino_acid(self, codon: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in self.codons.items() for x in pair]), codon)

    def is_start(self, codon: Column) -> Column:
        return codon.isin(*self.starts)


def table(key: int | str = 1) -> CodonTable:
    """A table by its number or name."""
    for number, name, changes, starts in CODES:
        if key in (number, name):
            return CodonTable(name, codon_table() | dict(c.split("=") for c in changes.split()), tuple(starts.split()), number)
    raise KeyError(f"no codon table {key!r}")


def table_names() -> list[str]:
    return [name for _, name, _, _ in CODES]


def parse_tables(text: str) -> list[CodonTable]:
    """Tables of a text: blocks of lines with a key and a value, among them name, id, AA, Init and Base1 to Base3.

    The letters of AA, Init and the bases stand below each other; M in Init marks a start codon. A block ends where a key comes again.
    """
    blocks: list[dict[str, str]] = [{}]
    for line in text.splitlines():
        key, _, value = line.strip().replace("=", " ").partition(" ")
        if not key or key.startswith("#"):
            continue
        if key in blocks[-1]:
            blocks.append({})
        blocks[-1][key] = value.strip()
    out = []
    for b in blocks:
        if "AA" in b:
            names = ["".join(x) for x in zip(b["Base1"], b["Base2"], b["Base3"], strict=True)]
            starts = tuple(c for c, i in zip(names, b.get("Init", "").ljust(64, "-"), strict=True) if i not in "-*")
            out.append(CodonTable(b.get("name", ""), dict(zip(names, b["AA"], strict=True)), starts, int(b["id"]) if "id" in b else None))
    return out
