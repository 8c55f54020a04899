import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.operators import charges, kernels, multiple, secondary


def _trace(n, turn, rise, radius):
    return [(i, i + 1, radius * math.cos(turn * i), radius * math.sin(turn * i), rise * i) for i in range(n)]


CA = "s string, res_idx int, res_id int, x double, y double, z double"


def test_sse_of_ideal_traces(spark):
    helix = _trace(12, math.radians(100), 1.5, 2.3)
    strand = [(i, i + 1, 3.3 * i, 0.9 * (i % 2), 0.0) for i in range(12)]
    short = helix[:5]
    rows = [("h", *r) for r in helix] + [("e", *r) for r in strand] + [("t", *r) for r in short]
    got = {}
    for r in secondary.annotate_sse(spark.createDataFrame(rows, CA), ["s"]).orderBy("s", "res_idx").collect():
        got.setdefault(r.s, []).append(r.sse)
    assert "".join(got["h"])[1:9] == "a" * 8 and "b" not in got["h"]
    assert "".join(got["e"])[1:9] == "b" * 8
    assert got["t"] == ["c"] * 5
    broken = [("h", i, i + 1 + (5 if i >= 4 else 0), x, y, z) for i, _, x, y, z in helix[:8]] + [("h", 8, 15, float("nan"), 0.0, 0.0)]
    out = [r.sse for r in secondary.annotate_sse(spark.createDataFrame(broken, CA), ["s"]).orderBy("res_idx").collect()]
    assert out[-1] == "" and set(out[:-1]) == {"c"}


def test_protein_blocks_of_their_own_angles(spark):
    rows = []
    for name, v in secondary.PROTEIN_BLOCKS.items():
        psi2, phi1, psi1, phi, psi, phin, psin, phin2 = map(math.radians, v)
        rows += [(name, 0, None, psi2), (name, 1, phi1, psi1), (name, 2, phi, psi), (name, 3, phin, psin), (name, 4, phin2, None)]
    out = secondary.protein_blocks(spark.createDataFrame(rows, "s string, res_idx int, phi double, psi double"), ["s"])
    assert all((r.block == r.s) if r.res_idx == 2 else r.block == "z" for r in out.collect())


@settings(deadline=None)
@given(st.integers(0, 7).flatmap(lambda k: st.permutations(list(range(14))).map(lambda p: [tuple(sorted(p[2 * i : 2 * i + 2])) for i in range(k)])))
def test_nested_sets_are_the_heaviest(pairs):
    cross = lambda p, q: p[0] < q[0] < p[1] < q[1] or q[0] < p[0] < q[1] < p[1]
    best = max((len(c) for n in range(len(pairs) + 1) for c in itertools.combinations(pairs, n) if not any(cross(p, q) for p, q in itertools.combinations(c, 2))), default=0)
    keep = [p for p, k in zip(pairs, secondary.nested(pairs), strict=True) if k]
    assert len(keep) == best and not any(cross(p, q) for p, q in itertools.combinations(keep, 2))
    text = secondary.dot_bracket(pairs, 14)
    assert secondary.pairs_of(text) == sorted(pairs)


def test_dot_bracket_tables(spark):
    assert secondary.dot_bracket([(0, 5), (2, 8)], 9) in ("(.[..)..]", "[.(..]..)")
    assert secondary.dot_bracket([(0, 5), (2, 8)], 9, scores=[1, 5], most=0) == "..(.....)"
    for bad in ("(", ")", "(x)"):
        with pytest.raises(ValueError):
            secondary.pairs_of(bad)
    pairs = spark.createDataFrame([("a", 0, 4), ("a", 1, 3)], "m string, base1 int, base2 int")
    lengths = spark.createDataFrame([("a", 6), ("b", 3)], "m string, length int")
    assert {r.m: r.notation for r in secondary.dot_brackets(pairs, lengths, "m").collect()} == {"a": "((.)).", "b": "..."}
    many = spark.createDataFrame([(0, 9, 2), (0, 8, 3), (1, 9, 1)], "base1 int, base2 int, hbonds int")
    assert [(r.base1, r.base2) for r in secondary.unique_pairs(many).collect()] == [(0, 8)]


def test_charges_of_methane_and_fluoromethane(spark):
    q = charges.equalise(["C", "H", "H", "H", "H"], [(0, i) for i in range(1, 5)], np.zeros(5))
    assert q.sum() == pytest.approx(0) and q[0] < 0 < q[1] and q[1] == pytest.approx(q[4])
    assert q[0] == pytest.approx(-0.078, abs=0.002)
    f = charges.equalise(["C", "F", "H", "H", "H"], [(0, i) for i in range(1, 5)], np.zeros(5))
    assert f[1] == pytest.approx(-0.253, abs=0.005) and f[0] == pytest.approx(0.079, abs=0.005)
    assert np.isnan(charges.equalise(["XE"], [], np.zeros(1)))[0]
    atoms = spark.createDataFrame([("m", i, e, 0) for i, e in enumerate(["C", "F", "H", "H", "H"])], "structure_id string, atom_idx int, element string, charge int")
    bonds = spark.createDataFrame([("m", 0, i) for i in range(1, 5)], "structure_id string, atom1 int, atom2 int")
    rows = charges.partial_charges(atoms, bonds).orderBy("atom_idx").collect()
    assert [r.partial_charge for r in rows] == pytest.approx(f.tolist())




@settings(deadline=None, max_examples=25)
@given(st.text(alphabet="ACGT", min_size=30, max_size=40), st.lists(st.tuples(st.integers(0, 29), st.sampled_from("ACGT-")), min_size=1, max_size=5))
def test_multiple_alignment_keeps_the_sequences(base, edits):
    texts = [base] + [(base[:i] + c + base[i + 1 :]).replace("-", "") for i, c in edits]
    gapped, _, _ = multiple.align_family(texts, kernels.score_table(5, -4), (-10, -1))
    assert [g.replace("-", "") for g in gapped] == texts
    assert len({len(g) for g in gapped}) == 1
    assert not any(set(col) == {"-"} for col in zip(*gapped, strict=True))


def test_multiple_alignment_of_families(spark):
    rows = spark.createDataFrame([("f", 1, "ACGTACGTTACG"), ("f", 2, "ACGTCGTTACG"), ("g", 1, "TTTT")], "fam string, seq_id int, seq string")
    out = {(r.fam, r.seq_id): r.gapped for r in multiple.align_multiple(rows, key="fam", gap=(-6, -1)).collect()}
    assert out == {("f", 1): "ACGTACGTTACG", ("f", 2): "ACGT-CGTTACG", ("g", 1): "TTTT"}


def test_unlike_sequences_have_no_distance():
    table = kernels.score_table(1, -1)
    a, b = kernels.codes("AAAA"), kernels.codes("AAAA")
    assert multiple.distance(a, b, np.array([[i, i] for i in range(4)]), 4, table, -1) == 0
    with pytest.raises(ValueError):
        multiple.distance(a, b, np.array([[i, i] for i in range(4)]), -9, table, -1)


def test_matrix_text():
    m = multiple.parse_matrix("# note\n   A  B\nA  4 -1\nB -2  5\n")
    assert m == {("A", "A"): 4, ("A", "B"): -1, ("B", "A"): -2, ("B", "B"): 5}
    assert not multiple.is_symmetric(m) and multiple.transposed(m)["A", "B"] == -2
