import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import codons
from strandlake.functions import geometry as g
from strandlake.operators import kmers, multiple


def test_codon_tables():
    standard, mito = codons.table(), codons.table("Vertebrate Mitochondrial")
    assert (standard.codons["TGA"], mito.codons["TGA"], mito.number) == ("*", "W", 2)
    assert set(standard.codons_of("*")) == {"TAA", "TAG", "TGA"} and len(codons.table_names()) == len(codons.CODES)
    changed = standard.with_start_codons(["ATG"]).with_codon_mappings({"TAA": "X"})
    assert changed.starts == ("ATG",) and changed.codons["TAA"] == "X" and standard.codons["TAA"] == "*"
    with pytest.raises(KeyError):
        codons.table("none")
    with pytest.raises(ValueError):
        standard.with_codon_mappings({"TAAA": "X"})
    names = list(standard.codons)
    text = "\n".join(f"name N{i}\nid {i}\nAA {t.letters()}\nInit {''.join('M' if c in t.starts else '-' for c in names)}\n" + "\n".join(f"Base{k + 1} {''.join(c[k] for c in names)}" for k in range(3)) for i, t in ((7, standard), (8, mito)))
    first, second = codons.parse_tables(text)
    assert (first.codons, first.starts, first.number) == (standard.codons, standard.starts, 7)
    assert (second.codons, set(second.starts), second.name) == (mito.codons, set(mito.starts), "N8")


def test_matrices(spark, tmp_path):
    made = multiple.match_matrix("ACGT", 5, -4)
    (tmp_path / "nuc.mat").write_text("# comment\n" + multiple.matrix_text(made))
    assert multiple.load_matrix(str(tmp_path / "nuc.mat")) == made and multiple.list_matrices(str(tmp_path)) == ["nuc"]
    rows = multiple.score_frame(spark, made, "ACGT").collect()
    assert len(rows) == 16 and all((r.score == 5) == (r.code1 == r.code2) for r in rows)


def test_symmetry_and_assemblies():
    assert g.parse_symmetry("-x+1/2, x-y, z") == [[-1, 0, 0, 0.5], [1, -1, 0, 0], [0, 0, 1, 0]]
    for bad in ("x,y", "x,y,q", "x,,z"):
        with pytest.raises(ValueError):
            g.parse_symmetry(bad)
    assert g.parse_assembly("1,3") == [("1",), ("3",)]
    assert g.parse_assembly("(1-2)(X0,5)") == [("1", "X0"), ("1", "5"), ("2", "X0"), ("2", "5")]
    a, b = g.parse_symmetry("-y,x,z+1/4"), g.parse_symmetry("x+1,-z,y")
    assert np.allclose(np.array(g.as_matrix(b)) @ np.array(g.as_matrix(a)), g.as_matrix(g.compose(a, b)))


@pytest.mark.parametrize("source, target", [((1, 0, 0), (0, 2, 0)), ((1, 2, 3), (-1, -2, -3)), ((0, 0, 1), (0, 0, 5)), ((1, -1, 0.5), (0.2, 3, -1))])
def test_aligning_rotation(source, target):
    turn = np.array(g.aligning_rotation(source, target))
    assert np.allclose(turn @ np.array(source) / np.linalg.norm(source), np.array(target) / np.linalg.norm(target)) and np.isclose(np.linalg.det(turn), 1)


def test_molecules_are_joined_across_a_skewed_box(spark):
    box = [[5.0, 0.0, 0.0], [2.0, 6.0, 0.0], [1.0, 1.0, 7.0]]
    walk = np.cumsum(np.random.default_rng(1).uniform(-0.8, 0.8, (60, 3)), axis=0) + 2
    inside = (lambda f: (f - np.floor(f)) @ np.array(box))(walk @ np.linalg.inv(box))
    atoms = spark.createDataFrame([(i, i // 30, *map(float, p)) for i, p in enumerate(inside)], "i int, m int, x double, y double, z double")
    rows = g.remove_pbc(atoms, box, ["m"], ["i"]).orderBy("i").collect()
    got = np.array([[r.x, r.y, r.z] for r in rows])
    for m in (slice(0, 30), slice(30, 60)):
        assert np.allclose(got[m] - got[m][0], walk[m] - walk[m][0]) and np.allclose(got[m][0], inside[m][0])
    gap = g.remove_pbc(atoms.withColumn("x", F.when(F.col("i") != 3, F.col("x"))), box, ["m"], ["i"])
    assert gap.where("x IS NULL").count() == 27
    cells = g.symmetry_mates(atoms, box, ["x,y,z", "-x,-y,z+1/2"], inside=True)
    assert cells.count() == 120 and cells.where(~g.is_in_box(tuple(F.col(c) + 1e-9 for c in "xyz"), box)).count() <= 2


def _plain_dihedral(p):
    a, b, c, d = map(np.array, p)
    n1, n2 = np.cross(b - a, c - b), np.cross(c - b, d - c)
    return math.atan2(np.dot(np.cross(n1, n2), c - b) / np.linalg.norm(c - b), np.dot(n1, n2))


def test_side_chain_and_nucleotide_dihedrals(spark):
    rng = np.random.default_rng(2)
    xyz = {n: rng.normal(size=3) for n in "N CA CB CG CD NE CZ".split()}
    rows = [("A", 1, "ARG", n, *map(float, p)) for n, p in xyz.items()] + [("A", 2, "GLY", "CA", 0.0, 0.0, 0.0)]
    schema = "chain_id string, res_id int, res_name string, atom_name string, x double, y double, z double"
    arg, gly = g.dihedral_side_chain(spark.createDataFrame(rows, schema)).orderBy("res_id").collect()
    names = list(xyz)
    assert [arg[f"chi{n + 1}"] for n in range(4)] == pytest.approx([_plain_dihedral([xyz[k] for k in names[n : n + 4]]) for n in range(4)])
    assert gly.chi1 is None
    names = "P O5' C5' C4' C3' O3' O4' C1' N9 C4 N1 C2".split()
    res = [{n: rng.normal(size=3) for n in names if i or n != "P"} for i in range(3)]
    for r, gone in zip(res, ("N1", "N9", "N1"), strict=True):
        del r[gone]
    rows = [("A", i, "N", n, *map(float, p)) for i, r in enumerate(res) for n, p in r.items()]
    got = g.nucleotide_dihedrals(spark.createDataFrame(rows, schema)).orderBy("res_id").collect()
    assert got[0].alpha is None and got[0].beta is None and got[2].epsilon is None
    one = res[1]
    assert got[1].alpha == pytest.approx(_plain_dihedral([res[0]["O3'"], one["P"], one["O5'"], one["C5'"]]))
    assert got[1].zeta == pytest.approx(_plain_dihedral([one["C3'"], one["O3'"], res[2]["P"], res[2]["O5'"]]))
    assert got[1].chi == pytest.approx(_plain_dihedral([one[n] for n in g.GLYCOSIDIC["pyrimidine"].split()]))


def test_selectors_of_rows_are_those_of_the_index(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("ACGT"), n))) for i, n in enumerate([0, 3, 7, 8, 17, 18, 200, 3000])] + [(99, None)]
    seqs = spark.createDataFrame(rows, "seq_id long, seq string")
    key = lambda df: sorted(map(tuple, df.select("ref_id", "pos", "kmer").collect()))
    assert key(kmers.row_minimizers(seqs, "ACGT", 8, 10)) == key(kmers.minimizers(kmers.explode_kmers(seqs, "ACGT", 8), 10))
    masked = kmers.explode_kmers(seqs, "ACGT", 3, spacing="1011", masked="G")
    places = seqs.where("seq IS NOT NULL AND seq <> ''").select(F.col("seq_id").alias("ref_id"), F.posexplode(F.split("seq", "")).alias("pos", "c")).where("c = 'G'")
    assert key(masked) == key(kmers.without_masked(kmers.explode_kmers(seqs, "ACGT", 3, spacing="1011"), places, 3, "1011"))
    plan = kmers.syncmers(seqs, "ACGT", 8, 4)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    assert kmers.syncmers(seqs.limit(0), "ACGT", 8, 4).count() == 0
