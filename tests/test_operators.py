"""Operators against plain Python on small cases."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import geometry
from strandlake.functions import sequences as s
from strandlake.operators import alignments, annotations, bonds, compare, filters, graph, kernels, kmers, segments, spatial, trees
from strandlake.plans import search

# Alignments ---------------------------------------------------------------------------------


def _brute(a, b, gap, local, terminal=True):
    """The best score by trying every alignment of two short texts."""
    opening, extend = gap if isinstance(gap, tuple) else (gap, gap)
    linear = not isinstance(gap, tuple)
    best = [0 if local else -(10**9)]

    def walk(i, j, last, total, started):
        if local:
            best[0] = max(best[0], total)
        elif i == len(a) and j == len(b):
            best[0] = max(best[0], total)
        if i < len(a) and j < len(b):
            walk(i + 1, j + 1, "m", total + (1 if a[i] == b[j] else -1), True)
        if local and not started:
            return
        if i < len(a) and (linear or last in "mx"):
            free = not terminal and (j == 0 or j == len(b))
            walk(i + 1, j, "x", total + (0 if free else extend if last == "x" else opening), True)
        if j < len(b) and (linear or last in "my"):
            free = not terminal and (i == 0 or i == len(a))
            walk(i, j + 1, "y", total + (0 if free else extend if last == "y" else opening), True)

    if local:
        for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            walk(i, j, "m", 0, False)
    else:
        walk(0, 0, "m", 0, True)
    return best[0]


WORD = st.text(alphabet="ab", max_size=5)


@settings(deadline=None, max_examples=150)
@given(WORD, WORD, st.sampled_from([-1, -2, (-2, -1), (-3, -1)]), st.booleans())
def test_optimal_scores(a, b, gap, local):
    table = kernels.score_table(1, -1)
    x, y = kernels.codes(a), kernels.codes(b)
    want = _brute(a, b, gap, local)
    assert kernels.best_score(x, y, table, gap, local=local) == want
    score, traces = kernels.traceback(x, y, table, gap, local=local, most=50)
    assert score == want and len({t.tobytes() for t in traces}) == len(traces)
    for t in traces:
        total, last = 0, "m"
        for i, j in t:
            kind = "m" if i >= 0 and j >= 0 else "x" if j < 0 else "y"
            opening, extend = gap if isinstance(gap, tuple) else (gap, gap)
            total += (1 if a[i] == b[j] else -1) if kind == "m" else extend if kind == last else opening
            last = kind
        assert total == want


@settings(deadline=None, max_examples=100)
@given(WORD, WORD, st.sampled_from([-1, -2]))
def test_free_end_gaps(a, b, gap):
    table = kernels.score_table(1, -1)
    assert kernels.best_score(kernels.codes(a), kernels.codes(b), table, gap, terminal=False) == _brute(a, b, gap, False, terminal=False)


def test_band_limits_diagonals():
    table, a, b = kernels.score_table(5, -4), kernels.codes("ACGTACGT"), kernels.codes("TTTTACGTACGT")
    assert kernels.best_score(a, b, table, (-10, -1), local=True, band=(4, 4)) == 40
    assert kernels.best_score(a, b, table, (-10, -1), local=True, band=(-20, 20)) == kernels.best_score(a, b, table, (-10, -1), local=True)
    assert kernels.best_score(a, b, table, (-10, -1), local=True, band=(1, 2)) < 40


def test_extension_stops_at_the_drop():
    table = kernels.score_table(1, -2)
    a, b = kernels.codes("AAAATTTTAAAA"), kernels.codes("AAAACCCCAAAA")
    assert kernels.extend(a, b, 1, 1, table, 3) == (4, 1, 3)
    assert kernels.extend(a, b, 1, 1, table, 100) == (4, 1, 3)
    assert kernels.extend(kernels.codes("AAT"), kernels.codes("AAG"), 0, 0, table, 5) == (2, 0, 2)


def test_gapped_extension_crosses_a_gap():
    table = kernels.score_table(5, -4)
    a, b = kernels.codes("ACGTACGTAC"), kernels.codes("ACGTAACGTAC")
    assert kernels.gapped_local_from_seed(a, b, 0, 0, table, (-6, -1), 50) == 44


def test_cigar_both_ways():
    trace = np.array([[0, 0], [1, 1], [2, -1], [-1, 2], [3, 3]])
    a, b = kernels.codes("ACGT"), kernels.codes("AGTT")
    assert kernels.cigar(trace) == "2M1D1I1M" and kernels.cigar(trace, a, b, distinguish=True) == "1=1X1D1I1="
    assert kernels.trace_of_cigar("2M1D1I1M").tolist() == trace.tolist()
    assert kernels.trace_of_cigar("3S1M2H", 5).tolist() == [[5, 3]]
    with pytest.raises(ValueError):
        kernels.trace_of_cigar("3P")


def test_identity_modes():
    trace = np.array([[-1, 0], [0, 1], [1, -1], [2, 2]])
    seqs = [kernels.codes("ACG"), kernels.codes("TAG")]
    assert kernels.identity(trace, seqs, "all") == 0.5
    assert kernels.identity(trace, seqs, "not_terminal") == pytest.approx(2 / 3)
    assert kernels.identity(trace, seqs, "shortest") == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        kernels.identity(np.array([[0, -1], [-1, 0]]), [kernels.codes("A"), kernels.codes("A")])


def test_alignment_tables(spark):
    rows = spark.createDataFrame([(1, 0, "-ACG-"), (1, 1, "TA-GT")], "aln_id int, seq_idx int, seq string")
    cols = alignments.columns_of(rows)
    assert sorted((r.seq_idx, r.col, r.pos) for r in cols.collect())[:5] == [(0, 0, -1), (0, 1, 0), (0, 2, 1), (0, 3, 2), (0, 4, -1)]
    assert tuple(alignments.terminal_range(cols).first()) == (1, 1, 4)
    assert alignments.remove_gaps(cols).select("col").distinct().count() == 2
    symbols = rows.select("aln_id", "seq_idx", F.posexplode(F.split(F.replace("seq", F.lit("-"), F.lit("")), "")).alias("pos", "symbol"))
    assert alignments.alignment_score(cols, symbols, match=5, mismatch=-4, gap=(-10, -1)).first().score == 10 - 30
    assert alignments.alignment_score(cols, symbols, match=5, mismatch=-4, gap=(-10, -1), terminal=False).first().score == 10 - 10


def test_align_column(spark):
    r = spark.createDataFrame([("ACGTT", "AGTT")], "a string, b string").select(alignments.align(F.col("a"), F.col("b"), gap=-1).alias("x")).first().x
    assert (r.score, r.cigar, r.identity) == (3, "1M1D3M", pytest.approx(0.8))


def test_evalue_parameters(spark):
    rng = np.random.default_rng(0)
    lam, k, n = 0.3, 0.1, 1000
    scores = (math.log(k * n * n) - np.log(-np.log(rng.random(20000)))) / lam
    got = alignments.estimate_evalue_parameters(spark.createDataFrame([(float(v),) for v in scores], "score double"), n)
    assert got == (pytest.approx(lam, rel=0.05), pytest.approx(k, rel=0.4))


# Sequences and k-mers -------------------------------------------------------------------------


def test_sequence_errors(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).collect()[0].v
    for bad in (s.encode(F.lit("AX"), s.NUCLEOTIDE), s.decode(F.array(F.lit(9)), s.NUCLEOTIDE), s.translate(F.lit("ACGT")), s.molecular_weight(F.lit("AX"))):
        with pytest.raises(Exception, match="alphabet|multiple|weight"):
            one(bad)
    assert one(s.encode(F.lit(""), s.NUCLEOTIDE)) == [] and one(s.translate(F.lit("ATGTAA"))) == "M*"
    assert one(s.three_to_one(F.lit("Ala"))) == "A" and one(s.one_to_three(F.lit("W"))) == "TRP"
    assert one(s.map_codes(F.array(F.lit(3)), s.NUCLEOTIDE, s.PROTEIN)) == [16]
    assert s.common_alphabet([s.NUCLEOTIDE, s.NUCLEOTIDE_AMBIGUOUS]) == s.NUCLEOTIDE_AMBIGUOUS and s.common_alphabet([s.PROTEIN, s.NUCLEOTIDE]) is None
    assert one(s.reverse_complement(F.lit("ACGTRYN"))) == "NRYACGT"


@settings(deadline=None, max_examples=5)
@given(st.lists(st.text(alphabet="ACGT", max_size=25), min_size=1, max_size=6))
def test_kmer_operators(spark, seqs):
    rows = spark.createDataFrame(list(enumerate(seqs)), "seq_id int, seq string")
    code = lambda w: sum("ACGT".index(c) * 4 ** (len(w) - 1 - i) for i, c in enumerate(w))
    plain = {(i, p): code(q[p : p + 3]) for i, q in enumerate(seqs) for p in range(len(q) - 2)}
    index = kmers.explode_kmers(rows, "ACGT", 3)
    assert {(r.ref_id, r.pos): r.kmer for r in index.collect()} == plain
    spaced = {(i, p): code(q[p] + q[p + 1] + q[p + 3]) for i, q in enumerate(seqs) for p in range(len(q) - 3)}
    assert {(r.ref_id, r.pos): r.kmer for r in kmers.explode_kmers(rows, "ACGT", 3, spacing="1101").collect()} == spaced
    mins = set()
    for i, q in enumerate(seqs):
        ks = [plain[i, p] for p in range(len(q) - 2)]
        for at in range(len(ks) - 3):
            p = min(range(at, at + 4), key=lambda x: (ks[x], x))
            mins.add((i, p, ks[p]))
    assert {(r.ref_id, r.pos, r.kmer) for r in kmers.minimizers(index, 4).collect()} == mins
    matches = {(a, p, b, q) for (a, p), x in plain.items() for (b, q), y in plain.items() if x == y}
    assert {tuple(r) for r in kmers.match(index, index).select("query_id", "query_pos", "ref_id", "ref_pos").collect()} == matches


def test_kmer_codes(spark):
    row = spark.range(1).select(kmers.fuse(F.array(*[F.lit(c) for c in (3, 0, 2)]), 4).alias("f"), kmers.split_code(F.lit(50).cast("long"), 4, 3).alias("s"), kmers.decode_kmer(F.lit(50).cast("long"), "ACGT", 3).alias("d")).first()
    assert (row.f, row.s, row.d) == (50, [3, 0, 2], "TAG")
    with pytest.raises(ValueError):
        kmers.informative(3, "11")


# Graphs ---------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=6)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    up = {v: v for e in edges for v in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = graph.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == {v: top(v) for v in up}


def test_components_of_a_long_path_and_a_star(spark):
    n = 3000
    path = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(n).select(F.lit(10_000).cast("long").alias("src"), (F.col("id") + 20_000).alias("dst"))
    got = graph.connected_components(path.unionAll(star)).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {0: n, 10_000: n + 1}


EDGES = "atom1 long, atom2 long, bond_type int"


def test_bond_lists(spark):
    a = spark.createDataFrame([(2, 1, 5), (1, 3, 2), (3, 4, 1)], EDGES)
    low = bonds.normalized(a)
    assert sorted(map(tuple, low.collect())) == [(1, 2, 5), (1, 3, 2), (3, 4, 1)]
    with pytest.raises(Exception, match="itself"):
        bonds.normalized(spark.createDataFrame([(1, 1, 1)], EDGES)).collect()
    other = spark.createDataFrame([(1, 2, 1), (4, 9, 3)], EDGES)
    assert sorted(map(tuple, bonds.merge(low, other).collect())) == [(1, 2, 1), (1, 3, 2), (3, 4, 1), (4, 9, 3)]
    assert sorted(map(tuple, bonds.remove(low, other).collect())) == [(1, 3, 2), (3, 4, 1)]
    assert sorted(map(tuple, bonds.without_aromaticity(low).collect()))[0] == (1, 2, 1)
    assert sorted(map(tuple, bonds.without_kekule(low).collect()))[0] == (1, 2, 9)
    atoms = spark.createDataFrame([(1,), (3,), (4,)], "atom_idx long")
    assert sorted(map(tuple, bonds.subset(low, atoms).collect())) == [(0, 1, 2), (1, 2, 1)]
    assert {r.atom: r.degree for r in bonds.partner_counts(low).collect()} == {1: 2, 2: 1, 3: 2, 4: 1}


def test_rotatable_bonds(spark):
    ring = [(0, 1), (1, 2), (0, 2)]
    rows = [("m", a, b, 1) for a, b in [*ring, (2, 3), (3, 4), (4, 5), (4, 6)]] + [("m", 6, 7, 2)]
    got = bonds.rotatable(spark.createDataFrame(rows, f"mol string, {EDGES}"), "mol").collect()
    assert sorted((r.atom1, r.atom2) for r in got) == [(2, 3), (3, 4), (4, 6)]


# Structures -----------------------------------------------------------------------------------


def test_dihedral_and_angle(spark):
    v = lambda *xyz: tuple(F.lit(float(c)) for c in xyz)
    row = spark.range(1).select(geometry.dihedral(v(1, 0, 0), v(0, 0, 0), v(0, 1, 0), v(0, 1, 1)).alias("d"), geometry.angle(v(1, 0, 0), v(0, 0, 0), v(0, 2, 0)).alias("a")).first()
    assert row.d == pytest.approx(-math.pi / 2) and row.a == pytest.approx(math.pi / 2)


def test_boxes(spark):
    cell = (10.0, 12.0, 15.0, math.radians(80), math.radians(95), math.radians(110))
    box = geometry.box_from_cell(*cell)
    assert geometry.cell_from_box(box) == pytest.approx(cell)
    a, b, c, al, be, ga = cell
    assert geometry.box_volume(box) == pytest.approx(a * b * c * math.sqrt(1 + 2 * math.cos(al) * math.cos(be) * math.cos(ga) - math.cos(al) ** 2 - math.cos(be) ** 2 - math.cos(ga) ** 2))
    assert not geometry.is_orthogonal(box)
    p = tuple(F.lit(x) for x in (31.0, -7.5, 4.0))
    inside = geometry.inside_box(p, box)
    f = spark.range(1).select(*[x.alias(n) for x, n in zip(geometry.to_fraction(inside, box), "abc", strict=True)]).first()
    assert all(-1e-9 <= x < 1 + 1e-9 for x in f)
    near = spark.range(1).select(geometry.pbc_distance(tuple(F.lit(float(x)) for x in (0, 0, 0)), tuple(F.lit(x) for x in (9.5, 0.0, 0.0)), box).alias("d")).first().d
    assert near == pytest.approx(0.5)


def test_rotations():
    m = np.array(geometry.rotation_matrix((0.1, 0.2, 0.3)))
    assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)
    assert np.allclose(geometry.axis_rotation((0, 0, 2), math.pi / 2), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])


ATOMS = "atom_idx int, chain_id string, res_id int, x double, y double, z double"


def _cloud(n, seed=0, scale=3.0):
    rng = np.random.default_rng(seed)
    return [(i, "A" if i < n // 2 else "B", i // 3, *map(float, rng.uniform(-scale, scale, 3))) for i in range(n)]


def test_contacts_and_sasa(spark):
    rows = _cloud(60)
    points = spark.createDataFrame([*rows, (99, "A", 1, float("nan"), 0.0, 0.0)], ATOMS)
    xyz = {r[0]: np.array(r[3:]) for r in rows}
    want = {(a, b) for a in xyz for b in xyz if a != b and ((xyz[a] - xyz[b]) ** 2).sum() <= 2.25}
    assert {(r.atom_idx, r.r_atom_idx) for r in spatial.contacts(points, 1.5).collect()} == want
    area = {r.atom_idx: r.sasa for r in spatial.sasa(points.withColumn("radius", F.lit(1.0)), probe=0.4, points=100).collect()}
    unit = np.array(spatial.sphere_points(100))
    for i, c in xyz.items():
        d = np.stack([((c + unit * 1.4 - o) ** 2).sum(axis=1) for j, o in xyz.items() if j != i])
        assert area[i] == pytest.approx(4 * math.pi * 1.96 * (~(d < 1.96).any(axis=0)).mean())
    assert math.isnan(area[99])


def test_superimposition(spark):
    rows = _cloud(20)
    turn, shift = np.array(geometry.rotation_matrix((0.4, -1.1, 2.0))), np.array([3.0, -1.0, 0.5])
    fixed = spark.createDataFrame(rows, ATOMS)
    moved = spark.createDataFrame([(*r[:3], *map(float, turn @ np.array(r[3:]) + shift)) for r in rows], ATOMS)
    back = compare.superimpose(fixed.drop("chain_id", "res_id"), moved, atom=["atom_idx"], by=[])
    assert compare.rmsd(fixed.drop("chain_id", "res_id"), back, atom=["atom_idx"], by=[]).first().rmsd < 1e-9
    assert compare.tm_score(fixed.drop("chain_id", "res_id"), back, atom=["atom_idx"], by=[], length=20).first().tm == pytest.approx(1)
    mirrored = moved.withColumn("x", -F.col("x"))
    assert compare.rmsd(fixed.drop("chain_id", "res_id"), compare.superimpose(fixed.drop("chain_id", "res_id"), mirrored, atom=["atom_idx"], by=[]), atom=["atom_idx"], by=[]).first().rmsd > 0.5


def test_outliers_are_left_out_of_the_fit(spark):
    rows = _cloud(30)
    other = [(*r[:3], *(v + 40.0 for v in r[3:])) if i < 3 else r for i, r in enumerate(rows)]
    fixed, mobile = spark.createDataFrame(rows, ATOMS).drop("chain_id", "res_id"), spark.createDataFrame(other, ATOMS)
    now, anchors = compare.superimpose_without_outliers(fixed, mobile, atom=["atom_idx"], by=[])
    assert set(range(3)).isdisjoint(r.atom_idx for r in anchors.collect()) and anchors.count() >= 3
    assert now.where("atom_idx = 5").first().x == pytest.approx(rows[5][3])


def test_lddt_of_an_equal_structure(spark):
    p = spark.createDataFrame(_cloud(30), ATOMS)
    assert compare.lddt(p, p).first().lddt == 1
    levels = {level: compare.lddt(p, p.withColumn("x", F.col("x") * 1.3), level=level).count() for level in ("all", "chain", "residue", "atom")}
    assert levels == {"all": 1, "chain": 2, "residue": 10, "atom": 30}


def test_segments(spark):
    rows = [(0, i, c, r) for i, (c, r) in enumerate([("A", 1), ("A", 1), ("A", 2), ("B", 2), ("B", 1), ("B", 3)])]
    t = spark.createDataFrame(rows, "s int, i int, chain_id string, res_id int")
    residue = segments.with_positions(t, ["s"], ["i"], ["chain_id", "res_id"])
    assert [r.segment for r in residue.orderBy("i").collect()] == [0, 0, 1, 2, 3, 4]
    chain = segments.with_positions(t, ["s"], ["i"], ["chain_id"], ["res_id"])
    assert [r.segment for r in chain.orderBy("i").collect()] == [0, 0, 0, 1, 2, 2]
    assert [(r.start, r.stop) for r in segments.starts(chain, ["s"], "i", exclusive_stop=True).orderBy("start").collect()] == [(0, 3), (3, 4), (4, 6)]
    mask = segments.members(chain, t.where("i = 5"), ["s"], "i").collect()
    assert sorted(r.i for r in mask) == [4, 5]
    assert [r.new_id for r in segments.continuous_ids(t, ["s"], ["i"], ["chain_id"], ["res_id"]).orderBy("i").collect()] == [1, 1, 2, 1, 2, 3]


def test_filters(spark):
    rows = [(1, 0, "", 1.0), (1, 1, "B", 0.4), (1, 2, "A", 0.6), (1, 3, "B", 0.4), (2, 4, "A", 0.5), (2, 5, "B", 0.5)]
    t = spark.createDataFrame(rows, "res int, i int, altloc_id string, occupancy double")
    assert [r.i for r in filters.first_altloc(t, ["res"], ["i"]).orderBy("i").collect()] == [0, 1, 3, 4]
    assert [r.i for r in filters.highest_occupancy_altloc(t, ["res"]).orderBy("i").collect()] == [0, 1, 3, 4]
    names = spark.createDataFrame([("CA",), ("1HB",), ("CL1",), ("ZN",), ("",)], "n string").select(filters.infer_element(F.col("n")).alias("e")).collect()
    assert [r.e for r in names] == ["C", "H", "CL", "ZN", ""]


# Annotations, trees, search ---------------------------------------------------------------------


def test_annotations(spark):
    f = spark.createDataFrame([("s", 1, "a", 2, 4, 1), ("s", 1, "a", 8, 9, 1), ("s", 2, "b", 3, 5, -1), ("s", 2, "b", 7, 7, -1)], "seq_id string, feature_id int, key string, first long, last long, strand int")
    seqs = spark.createDataFrame([("s", "ACGTTGCATC")], "seq_id string, seq string")
    assert {r.feature_id: r.seq for r in annotations.subsequence(f, seqs).collect()} == {1: "CGTAT", 2: "GAAC"}
    cut = annotations.cut(f, 4, 9).orderBy("first", "last").collect()
    assert [(r.first, r.last, r.defect) for r in cut] == [(4, 4, 1), (4, 5, 1), (7, 7, 0), (8, 8, 2)]
    assert annotations.cut(f, None, None).count() == 4
    back = annotations.reverse_complement_features(annotations.reverse_complement_features(f, 10), 10)
    assert sorted(map(tuple, back.select(f.columns).collect())) == sorted(map(tuple, f.collect()))
    pairs = annotations.overlap_join(f, f, "seq_id", width=2)
    assert pairs.count() == 6


def test_trees(spark):
    d = np.array([[0, 2, 6, 6], [2, 0, 6, 6], [6, 6, 0, 4], [6, 6, 4, 0]], float)
    assert trees.to_newick(trees.upgma(d, "abcd")) in ("((b:1.0,a:1.0):2.0,(d:2.0,c:2.0):1.0);", "((d:2.0,c:2.0):1.0,(b:1.0,a:1.0):2.0);")
    text = trees.to_newick(trees.neighbor_joining(d, "abcd"))
    rows = spark.createDataFrame([(0, text), (1, "((a:1,b:2):3,(c:4,(d:5,e:6):7):8);")], "tree_id int, newick string")
    nodes = trees.node_table(rows)
    got = {(r.tree_id, r.label1, r.label2): r.distance for r in trees.distances(nodes).collect()}
    for (i, a), (j, b) in itertools.combinations(enumerate("abcd"), 2):
        assert got[0, a, b] == pytest.approx(d[i, j])
    assert got[1, "a", "e"] == 1 + 3 + 8 + 7 + 6 and got[1, "d", "e"] == 11 and got[1, "a", "b"] == 3
    assert trees.to_newick(trees.from_newick("(a,b,c);"), lengths=False) == "(a,b,c);"
    assert trees.to_newick(trees.as_binary(trees.from_newick("(a:1,b:2,((c:3):1):1);"))) == "((a:1.0,b:2.0):0.0,c:5.0);"
    for bad in ("((a,b);", "(a,);", "(a,b)) ;"):
        with pytest.raises((ValueError, IndexError)):
            trees.from_newick(bad)
    with pytest.raises(ValueError):
        trees.upgma(np.array([[0, 1], [2, 0]]), "ab")


def test_search(spark):
    t = spark.createDataFrame([(i, f"name {i}", "ACDEFG"[: i + 1], i % 2) for i in range(6)], "i int, name string, seq string, g int")
    ids = lambda q, **k: [r.i for r in search.search(t, q, **k).collect()]
    f = search.field
    assert sorted(ids(f("i", greater=1) & ~f("i", is_in=[3, 4]))) == [2, 5]
    assert sorted(ids(f("i", less=2) ^ f("i", less_or_equal=3))) == [2, 3]
    assert sorted(ids(search.Text("NAME 3", ["name"]))) == [3]
    assert sorted(ids(search.Motif("C-x-E", "prosite", "seq"))) == [3, 4, 5]
    assert ids(f("i"), sort_by=[search.Sorting("i")], window=(1, 3)) == [4, 3]
    assert sorted(ids(f("i", less=5), group_by="g", rank_by=[search.Sorting("i")])) == [3, 4]
    assert search.count(t, f("i", less=5), group_by="g").first().n == 2
    assert search.motif_regex("<A-[ST]-{P}-x(2,3)-G>.", "prosite") == "^A[ST][^P].{2,3}G$"
    assert search.term_text('a "b"', "title") == '"a \\"b\\""[title]'
