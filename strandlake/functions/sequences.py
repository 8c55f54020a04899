"""Sequence functions as Column expressions: everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public alphabets, in code order.
NUCLEOTIDE = "ACGT"
NUCLEOTIDE_AMBIGUOUS = "ACGTRYWSMKHBVDN"
PROTEIN = "ACDEFGHIKLMNPQRSTVWYBZX*"
COMPLEMENT = ("ACGTRYWSMKHBVDN", "TGCAYRWSKMDVBHN")
#: Letters of each nucleotide ambiguity code.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "W": "AT", "S": "CG", "M": "AC", "K": "GT",
    "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT",
}
#: The standard genetic code: amino acids of the codons in TCAG order, and its start codons.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STANDARD_STARTS = ("TTG", "CTG", "ATG")
THREE_LETTER = {
    "ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H", "ILE": "I", "LYS": "K", "LEU": "L", "MET": "M", "ASN": "N",
    "PRO": "P", "GLN": "Q", "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y", "ASX": "B", "GLX": "Z", "UNK": "X", " * ": "*",
}
#: Average residue weights in dalton, without the water of a free amino acid.
RESIDUE_WEIGHT = {
    "A": 71.0788, "C": 103.1388, "D": 115.0886, "E": 129.1155, "F": 147.1766, "G": 57.0519, "H": 137.1411, "I": 113.1594, "K": 128.1741, "L": 113.1594,
    "M": 131.1926, "N": 114.1038, "P": 97.1167, "Q": 128.1307, "R": 156.1875, "S": 87.0782, "T": 101.1051, "V": 99.1326, "W": 186.2132, "Y": 163.1760,
}
MONOISOTOPIC_WEIGHT = {
    "A": 71.03711, "C": 103.00919, "D": 115.02694, "E": 129.04259, "F": 147.06841, "G": 57.02146, "H": 137.05891, "I": 113.08406, "K": 128.09496, "L": 113.08406,
    "M": 131.04049, "N": 114.04293, "P": 97.05276, "Q": 128.05858, "R": 156.10111, "S": 87.03203, "T": 101.04768, "V": 99.06841, "W": 186.07931, "Y": 163.06333,
}
WATER, MONOISOTOPIC_WATER = 18.015, 18.01056


def only(text: Column, letters: str) -> Column:
    """The letters of an alphabet that a text holds, in upper case. Case is folded for these letters alone."""
    escaped = letters.replace("*", "\\*")
    return F.upper(F.regexp_replace(text, f"[^{escaped}{escaped.lower()}]", ""))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once a row, also where ``f`` uses it inside a lambda of its own."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def symbols(seq: Column) -> Column:
    """One string a symbol; the empty sequence has none."""
    return F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def encode(seq: Column, alphabet: str) -> Column:
    """Codes of a sequence; a symbol outside the alphabet is an error."""
    code = lambda s: F.instr(F.lit(alphabet), s) - 1
    return F.transform(symbols(seq), lambda s: F.when(code(s) < 0, F.raise_error(F.concat(F.lit("symbol not in alphabet: "), s)).cast("int")).otherwise(code(s)))


def decode(codes: Column, alphabet: str) -> Column:
    """The sequence of codes; a code outside the alphabet is an error."""
    table = F.split(F.lit(alphabet), "")
    one = lambda c: F.coalesce(F.get(table, c), F.raise_error(F.concat(F.lit("code not in alphabet: "), c.cast("string"))).cast("string"))
    return F.array_join(F.transform(codes, one), "")


def is_valid(seq: Column, alphabet: str) -> Column:
    return F.length(F.translate(seq, alphabet, "")) == 0


def map_codes(codes: Column, source: str, target: str) -> Column:
    """Codes of one alphabet as codes of another that has all its symbols."""
    table = F.array(*[F.lit(target.index(s) if s in target else None).cast("int") for s in source])
    return F.transform(codes, lambda c: F.coalesce(F.get(table, c), F.raise_error(F.lit("symbol missing in target alphabet")).cast("int")))


def common_alphabet(alphabets: list[str]) -> str | None:
    """The alphabet that extends all others, None without one."""
    widest = max(alphabets, key=len, default=None)
    return widest if widest is not None and all(widest.startswith(a) for a in alphabets) else None


def complement(seq: Column) -> Column:
    return F.translate(seq, *COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def frequency(seq: Column, symbol: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(symbol), F.lit("")))


def frequencies(seq: Column, alphabet: str) -> Column:
    """Map of each symbol of the alphabet, absent ones too, to its count."""
    return F.create_map(*[x for s in alphabet for x in (F.lit(s), frequency(seq, s))])


# Codons ---------------------------------------------------------------------------------


def codon_table(amino_acids: str = STANDARD_CODE) -> dict[str, str]:
    """Codon to amino acid from the 64 letters in TCAG order."""
    bases = "TCAG"
    return {a + b + c: amino_acids[16 * i + 4 * j + k] for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)}


def translate(seq: Column, table: dict[str, str] | None = None) -> Column:
    """The protein of a whole coding sequence; its length must be a multiple of three."""
    table = table or codon_table()
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    codons = F.regexp_extract_all(seq, F.lit("(?s).{3}"), F.lit(0))
    made = F.array_join(F.transform(codons, lambda c: F.try_element_at(lookup, c)), "")
    return F.when(F.length(seq) % 3 == 0, made).otherwise(F.raise_error(F.lit("sequence length is no multiple of 3")).cast("string"))


def three_to_one(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in THREE_LETTER.items() for x in pair])
    return F.try_element_at(table, F.upper(name))


def one_to_three(letter: Column) -> Column:
    table = F.create_map(*[F.lit(x) for three, one in THREE_LETTER.items() for x in (one, three)])
    return F.try_element_at(table, letter)


def remove_stops(protein: Column) -> Column:
    return F.replace(protein, F.lit("*"), F.lit(""))


def molecular_weight(protein: Column, monoisotopic: bool = False) -> Column:
    """Weight of the residues and one water; a symbol without weight is an error."""
    table, water = (MONOISOTOPIC_WEIGHT, MONOISOTOPIC_WATER) if monoisotopic else (RESIDUE_WEIGHT, WATER)
    known = F.length(F.translate(protein, "".join(table), "")) == 0
    total = F.lit(water)
    for letter, weight in table.items():
        total = total + frequency(protein, letter) * weight
    return F.when(known, total).otherwise(F.raise_error(F.lit("residue without weight")).cast("double"))


# Search ---------------------------------------------------------------------------------


def find_subsequence(seq: Column, query: Column | str) -> Column:
    """0-based starts of a query, overlapping ones too."""
    query = F.lit(query) if isinstance(query, str) else query

    def places(both: Column) -> Column:
        """Arrays of symbols make each comparison cost the query's length, wherever it is."""
        last = F.size(both["s"]) - F.size(both["q"])
        every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda i: F.slice(both["s"], i + 1, F.size(both["q"])) == both["q"])

    return let(F.struct(symbols(seq).alias("s"), symbols(query).alias("q")), places)


def find_symbol(seq: Column, symbol: str) -> Column:
    return find_subsequence(seq, symbol)


def find_symbol_first(seq: Column, symbol: str) -> Column:
    """0-based, -1 if absent."""
    return F.instr(seq, symbol) - 1


def find_symbol_last(seq: Column, symbol: str) -> Column:
    at = F.instr(F.reverse(seq), symbol)
    return F.when(at == 0, -1).otherwise(F.length(seq) - at)
