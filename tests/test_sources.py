"""Readers and writers on small files made here."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.operators import encodings
from strandlake.sources import bcif, cif, fasta, fastq, genbank, gff, structures

FASTA = ">one a b\nACGT\nAC\n\n;note\n>two\r\nNNAA\r\n>three\nMKV*\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    rows = fasta.read_fasta(spark, str(tmp_path))
    assert [(r.header, r.seq) for r in rows.collect()] == [("one a b", "ACGTAC"), ("two", "NNAA"), ("three", "MKV*")]
    assert [r.t.type for r in rows.select(fasta.typed(F.col("seq")).alias("t")).collect()] == ["nucleotide", "ambiguous nucleotide", "protein"]
    fasta.write_fasta(rows, str(tmp_path / "out"), width=4)
    again = fasta.read_fasta(spark, str(tmp_path / "out"))
    assert sorted((r.header, r.seq) for r in again.collect()) == sorted((r.header, r.seq) for r in rows.collect())


def test_fasta_of_many_splits(spark, tmp_path):
    want = [(f"s{i}", "ACGT" * (i % 7 + 1)) for i in range(2000)]
    (tmp_path / "a.fasta").write_text("".join(f">{h}\n{s}\n" for h, s in want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = fasta.read_fasta(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        assert sorted((r.header, r.seq) for r in rows.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fasta_of_neither_alphabet_is_an_error(spark):
    with pytest.raises(Exception, match="neither nucleotide nor protein"):
        spark.createDataFrame([("J1",)], "seq string").select(fasta.typed(F.col("seq"))).collect()


def test_a3m(spark):
    rows = spark.createDataFrame([("p", 0, "q", "ACDE"), ("p", 1, "t", "A-kDE")], "path string, n int, header string, seq string")
    r = fasta.a3m_pairs(rows, "n").first()
    assert (r.query, r.target) == ("AC-DE", "A-KDE")


def test_clustal(spark, tmp_path):
    (tmp_path / "a.aln").write_text(fasta.clustal_text(["a", "bb"], ["AC-GTACGT", "ACCGT-CGT"], width=5))
    rows = fasta.read_clustal(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.name, r.seq) for r in rows] == [("a", "AC-GTACGT"), ("bb", "ACCGT-CGT")]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1\nACG\nT\n+\n@II\nI\n@r2\nAC\n+r2\n+@\n")
    rows = fastq.read_fastq(spark, str(tmp_path))
    assert [(r.header, r.seq, r.quality) for r in rows.collect()] == [("r1", "ACGT", [31, 40, 40, 40]), ("r2", "AC", [10, 31])]
    fastq.write_fastq(rows, str(tmp_path / "out"), width=3)
    assert sorted(fastq.read_fastq(spark, str(tmp_path / "out")).drop("path").collect()) == sorted(rows.drop("path").collect())
    with pytest.raises(ValueError):
        list(fastq.parse_fastq("@a\nACGT\n+\nII\n"))


GFF = """##gff-version 3
##sequence-region c1 1 100
c1\tsrc\tCDS\t1\t10\t.\t+\t0\tID=x;Note=a%3Bb%2Cc+d
c1\tsrc\tCDS\t21\t27\t1.5\t+\t2\tID=x
# note
c1\t.\tgene\t5\t9\t.\t-\t.\t.
"""


def test_gff(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(GFF)
    rows = gff.read_gff(spark, str(tmp_path / "a.gff3")).orderBy("line")
    got = [(r.type, r.start, r.end, r.score, r.strand, r.phase) for r in rows.collect()]
    assert got == [("CDS", 1, 10, None, 1, 0), ("CDS", 21, 27, 1.5, 1, 2), ("gene", 5, 9, None, -1, None)]
    assert rows.first().attributes == {"ID": "x", "Note": "a;b,c+d"}
    assert [r.directive for r in gff.directives(spark, str(tmp_path / "a.gff3")).collect()] == ["gff-version 3", "sequence-region c1 1 100"]
    made = {r.key: sorted((x.first, x.last, x.strand) for x in r.locs) for r in gff.features(rows).collect()}
    assert made == {"CDS": [(1, 10, 1), (21, 27, 1)], "gene": [(5, 9, -1)]}
    gff.write_gff(rows, str(tmp_path / "out"))
    assert sorted(map(str, gff.read_gff(spark, str(tmp_path / "out")).drop("path", "line").collect())) == sorted(map(str, rows.drop("path", "line").collect()))


def test_gff_phase(spark):
    rows = [("f", "CDS", 1, 10, 1), ("f", "CDS", 21, 27, 1), ("g", "CDS", 1, 10, -1), ("g", "CDS", 21, 27, -1), ("h", "gene", 1, 2, 1)]
    out = gff.with_phase(spark.createDataFrame(rows, "feature_id string, key string, first long, last long, strand int")).collect()
    assert sorted((r.feature_id, r.first, r.phase) for r in out if r.phase is not None) == [("f", 1, 0), ("f", 21, 2), ("g", 1, 2), ("g", 21, 0)]


RECORD = (
    genbank.locus_text("AB123", 120, "DNA", True, "BCT", "01-JAN-2001")
    + """
DEFINITION  A small
            record.
ACCESSION   AB123
VERSION     AB123.1  GI:42
DBLINK      BioProject: PRJ1
            BioSample: SAM2
SOURCE      Some organism
  ORGANISM  Some organism
            Bacteria.
"""
    + genbank.features_text([("gene", [(1, 9, 1, 0)], {"gene": "abc", "pseudo": ""}), ("CDS", [(3, 8, -1, genbank.BEYOND_LEFT), (20, 25, -1, 0)], {"note": "one two", "translation": "MK"})])
    + "\n"
    + genbank.origin_text("ACGTN" * 24)
    + "\n//\n"
)


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gb").write_text(RECORD + RECORD.replace("AB123", "XY9"))
    rows = genbank.read_genbank(spark, str(tmp_path))
    c = F.col("record")
    got = rows.select(genbank.locus(c).alias("l"), genbank.definition(c).alias("d"), genbank.accession(c).alias("a"), genbank.version(c).alias("v"), genbank.gi(c).alias("g"), genbank.db_link(c).alias("b"), genbank.source(c).alias("s"), genbank.sequence(c).alias("q")).collect()
    r = got[0]
    assert len(got) == 2 and got[1].a == "XY9"
    assert tuple(r.l) == ("AB123", 120, "DNA", True, "BCT", "01-JAN-2001")
    assert (r.d, r.a, r.v, r.g, r.b, r.s) == ("A small record.", "AB123", "AB123.1", 42, {"BioProject": "PRJ1", "BioSample": "SAM2"}, "Some organism")
    assert r.q == "ACGTN" * 24
    features = genbank.annotation(rows).where("feature_id < 2").limit(2).collect()
    assert [(f.key, [tuple(x) for x in f.locs]) for f in features] == [("gene", [(1, 9, 1, 0)]), ("CDS", [(3, 8, -1, genbank.BEYOND_LEFT), (20, 25, -1, 0)])]
    assert features[0].qual == {"gene": "abc", "pseudo": ""} and features[1].qual == {"note": "one two", "translation": "MK"}


@pytest.mark.parametrize(
    "text, want",
    [
        ("7", [(7, 7, 1, 0)]),
        ("3..9", [(3, 9, 1, 0)]),
        ("<3..>9", [(3, 9, 1, genbank.BEYOND_LEFT | genbank.BEYOND_RIGHT)]),
        ("3^4", [(3, 4, 1, genbank.BETWEEN)]),
        ("3.9", [(3, 9, 1, genbank.UNK_LOC)]),
        ("complement(join(1..2,5..8))", [(1, 2, -1, 0), (5, 8, -1, 0)]),
        ("join(complement(1..2),5..8)", [(1, 2, -1, 0), (5, 8, 1, 0)]),
    ],
)
def test_genbank_locations(text, want):
    assert genbank.parse_location(text) == want
    assert genbank.parse_location(genbank.location_text(want)) == want


@given(st.integers(-999, 36**4 - 1))
def test_hybrid36(n):
    if n < 10**4 + 52 * 36**3:
        assert structures.hybrid36_decode(structures.hybrid36_encode(n, 4)) == n


def _atoms(models=1):
    rows = []
    for m in range(1, models + 1):
        for i, (name, element) in enumerate([("N", "N"), ("CA", "C"), ("HB12", "H"), ("ZN", "ZN")]):
            rows.append({"model": m, "atom_idx": i, "chain_id": "A", "res_id": 5 + i, "ins_code": "", "res_name": "ALA" if i < 3 else "ZN", "hetero": i == 3, "atom_name": name, "element": element, "x": 1.5 + i, "y": -2.25 * m, "z": 0.125, "b_factor": 10.0, "occupancy": 1.0, "charge": 2 if i == 3 else 0, "altloc_id": "", "atom_id": i + 1})
    return rows


NAMES = [c for c in structures.COLUMNS if c != "structure_id"]


@pytest.mark.parametrize("models", [1, 2])
def test_pdb_round_trip(models):
    rows = _atoms(models)
    assert [dict(zip(NAMES, r, strict=True)) for r in structures.parse_pdb(structures.pdb_text(rows))] == rows


def test_pdb_short_line_is_an_error():
    with pytest.raises(ValueError):
        list(structures.parse_pdb("ATOM      1  N   ALA A   1"))


def test_pdb_records():
    text = "CRYST1   10.000   20.000   30.000  90.00  90.00 120.00 P 1\nREMARK 350\nREMARK 350 BIOMOLECULE: 1\nREMARK 350 APPLY THE FOLLOWING TO CHAINS: A, B\n" + "".join(f"REMARK 350   BIOMT{i}   1  {r}\n" for i, r in ((1, "1.0 0.0 0.0 0.5"), (2, "0.0 1.0 0.0 0.0"), (3, "0.0 0.0 1.0 0.0")))
    assert structures.parse_pdb_cell(text) == (10, 20, 30, 90, 90, 120)
    ((chains, op),) = structures.parse_pdb_assemblies(text)["1"]
    assert chains == ["A", "B"] and op[0].tolist() == [1, 0, 0, 0.5]
    atoms = structures.pdb_text(_atoms())
    assert structures.parse_pdb_bonds(atoms + "\nCONECT    1    2    3\nCONECT    2    1\n") == [(0, 1), (0, 2)]


def test_structure_files(spark, tmp_path):
    rows = _atoms()
    (tmp_path / "a.pdb").write_text(structures.pdb_text(rows))
    (tmp_path / "b.cif").write_text(structures.cif_text(rows))
    (tmp_path / "c.bcif").write_bytes(bcif.text({"c": {"atom_site": {k: v for k, v in cif.parse(structures.cif_text(rows))["structure"]["atom_site"].items()}}}))
    (tmp_path / "d.gro").write_text(structures.gro_text(rows))
    got = structures.read_structures(spark, str(tmp_path)).toPandas()
    for suffix in ("pdb", "cif", "bcif", "gro"):
        part = got[got["structure_id"].str.endswith("." + suffix)].sort_values("atom_idx")
        assert part["atom_name"].tolist() == ["N", "CA", "HB12", "ZN"]
        assert np.allclose(part[["x", "y", "z"]].to_numpy(), [[r["x"], r["y"], r["z"]] for r in rows], atol=0.01 if suffix == "gro" else 1e-6)
    structures.write_structures(structures.read_structures(spark, str(tmp_path / "a.pdb")), str(tmp_path / "out"), "pdb")
    again = structures.read_structures(spark, str(tmp_path / "out"), "pdb").toPandas()
    assert again.drop(columns="structure_id").to_dict("records") == rows


CIF = """# a comment
data_x
_entry.id 'it''s'
_cell.length_a   10.5 # note
loop_
_t.a
_t.b
1 'two words'
. ?
'.' "say 'x'"
;multi
line
; end
_last.v "a;b"
data_y
_q.r 1
"""


def test_cif_text(spark, tmp_path):
    got = cif.parse(CIF)
    assert got["x"]["t"] == {"a": ["1", None, ".", "multi\nline"], "b": ["two words", None, "say 'x'", "end"]}
    assert got["x"]["entry"]["id"] == ["it''s"] and got["x"]["cell"]["length_a"] == ["10.5"] and got["y"] == {"q": {"r": ["1"]}}
    assert cif.parse(cif.text(got)) == got
    with pytest.raises(ValueError):
        cif.parse("data_x\nloop_\n_a.b\n_a.c\n1 2 3\n")
    (tmp_path / "a.cif").write_text(CIF)
    table = cif.category_frame(cif.read_cif(spark, str(tmp_path), ["t"]), "t", ["a", "b"]).orderBy("row").collect()
    assert [(r.a, r.b) for r in table][1:3] == [(None, None), (".", "say 'x'")]


WORD = st.one_of(st.none(), st.text(alphabet=st.characters(codec="ascii", exclude_categories=["Cc"]), max_size=8))


@given(st.lists(WORD, min_size=1, max_size=6))
def test_cif_values_round_trip(values):
    blocks = {"x": {"c": {"v": values, "n": ["1"] * len(values)}}}
    assert cif.parse(cif.text(blocks)) == blocks


VALUE = st.one_of(st.none(), st.booleans(), st.integers(-(2**40), 2**40), st.floats(allow_nan=False), st.text(max_size=40), st.binary(max_size=300))


@given(st.recursive(VALUE, lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(st.text(max_size=5), inner, max_size=4)), max_leaves=12))
def test_messagepack_round_trip(value):
    assert bcif.unpack(bcif.pack(value)) == value


def test_messagepack_short_forms():
    assert bcif.unpack(bytes([0x82, 0xA1, 97, 0x93, 1, 0xFF, 0xC3, 0xA1, 98, 0xCD, 1, 0])) == {"a": [1, -1, True], "b": 256}
    assert bcif.unpack(b"\xca" + b"\x3f\x80\x00\x00") == 1.0
    with pytest.raises(ValueError):
        bcif.unpack(b"\xc4\x05a")


COLUMN = st.one_of(
    st.lists(st.one_of(st.none(), st.integers(-(2**31) + 1, 2**31 - 1)), min_size=1, max_size=40), st.lists(st.one_of(st.none(), st.floats(allow_nan=False)), min_size=1, max_size=20), st.lists(st.one_of(st.none(), st.text(max_size=4)), min_size=1, max_size=20)
)


@given(COLUMN)
def test_bcif_columns_round_trip(values):
    if all(v is None for v in values):
        return
    assert bcif.parse(bcif.text({"b": {"c": {"v": values}}})) == {"b": {"c": {"v": values}}}


def test_bcif_encodings():
    data = np.array([1, 1, 1, 2, 2, 300, -300, 5])
    for size in (1, 2):
        packed, step = encodings.encode(data, "IntegerPacking", size=size)
        assert encodings.decode(packed, [step]).tolist() == data.tolist()
    runs, step = encodings.encode(data, "RunLength")
    assert encodings.decode(runs, [step]).tolist() == data.tolist()
    fixed, step = encodings.encode(np.array([0.25, 1.5, 2.5]), "FixedPoint", factor=1)
    assert fixed.tolist() == [0, 2, 2] and encodings.decode(fixed, [step]).tolist() == [0, 2, 2]
    q = [{"kind": "IntervalQuantization", "min": 0.0, "max": 10.0, "numSteps": 11}]
    assert encodings.decode(np.array([0, 5, 10]), q).tolist() == [0.0, 5.0, 10.0]


def test_mol_and_sdf(spark, tmp_path):
    atoms = [{"x": 0.0, "y": 0.5, "z": -1.25, "element": "C", "charge": 0}, {"x": 1.0, "y": 0, "z": 0, "element": "CL", "charge": -1}]
    text = structures.mol_text("mol a", atoms, [(0, 1, 2)], {"k": "v1\nv2"})
    made, bonds = structures.parse_mol(text)
    assert [(a[8], a[9], a[14]) for a in made] == [("C", 0.0, 0), ("CL", 1.0, -1)] and bonds == [(0, 1, 2)]
    (tmp_path / "a.sdf").write_text(text + "\n" + text.replace("mol a", "mol b") + "\n")
    rows = structures.read_sdf(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.metadata) for r in rows] == [("mol a", {"k": "v1\nv2"}), ("mol b", {"k": "v1\nv2"})]
    v3 = "x\n\n\n  0  0  0     0  0            999 V3000\nM  V30 BEGIN CTAB\nM  V30 BEGIN ATOM\nM  V30 1 C 0 0 0 0\nM  V30 7 N 1 2 -\nM  V30 3 0 CHG=1\nM  V30 END ATOM\nM  V30 BEGIN BOND\nM  V30 1 3 1 7\nM  V30 END BOND\nM  V30 END CTAB\nM  END\n"
    made, bonds = structures.parse_mol(v3)
    assert [(a[8], a[11], a[14]) for a in made] == [("C", 0.0, 0), ("N", 3.0, 1)] and bonds == [(0, 1, 3)]


def test_nan_passes_through_pdb():
    row = _atoms()[0] | {"b_factor": math.nan}
    assert "  0.00" in structures.pdb_line(row)
