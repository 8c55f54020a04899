import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import programs, residues
from strandlake.sources import trajectories as t

FRAMES = [np.arange(12, dtype=float).reshape(4, 3) + i for i in range(3)]


def _netcdf(frames):
    """A classic NetCDF file with time, coordinates and cells."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    n = len(frames[0])
    dims = [("frame", 0), ("atom", n), ("spatial", 3)]
    head = b"CDF\x01" + struct.pack(">i", len(frames)) + struct.pack(">ii", 10, 3) + b"".join(name(d) + struct.pack(">i", s) for d, s in dims) + struct.pack(">ii", 0, 0)
    parts = [("time", [0], 5, 4), ("coordinates", [0, 1, 2], 5, 12 * n), ("cell_lengths", [0, 2], 6, 24)]

    def table(begin):
        out = struct.pack(">ii", 11, 3)
        for key, ids, kind, size in parts:
            out += name(key) + struct.pack(">i", len(ids)) + struct.pack(f">{len(ids)}i", *ids) + struct.pack(">ii", 0, 0) + struct.pack(">iii", kind, size, begin)
            begin += size
        return out

    body = head + table(len(head + table(0)))
    for i, f in enumerate(frames):
        body += struct.pack(">f", i * 0.5) + f.astype(">f4").tobytes() + struct.pack(">3d", 10, 20, 30)
    return body


def test_trajectories(spark, tmp_path):
    box = np.diag([10.0, 20.0, 30.0])
    (tmp_path / "a.dcd").write_bytes(t.write_dcd(FRAMES, 0.5))
    (tmp_path / "b.trr").write_bytes(t.write_trr(FRAMES, box, 0.5))
    (tmp_path / "c.nc").write_bytes(_netcdf(FRAMES))
    rows = t.read_frames(spark, str(tmp_path), start=1).collect()
    assert len(rows) == 6
    for r in rows:
        assert np.allclose(r.xyz, FRAMES[r.frame], atol=1e-5) and r.time == pytest.approx(r.frame * 0.5)
        assert (r.box is None) if r.path.endswith("dcd") else np.allclose(r.box, box, atol=1e-5)
    xyz = t.coordinates(t.read_frames(spark, str(tmp_path / "a.dcd"), step=2))
    assert xyz.count() == 8 and tuple(xyz.where("frame = 2 AND atom_idx = 3").select("x", "y", "z").first()) == (11.0, 12.0, 13.0)
    for read in (t.read_dcd, t.read_trr, t.read_netcdf):
        with pytest.raises((ValueError, struct.error)):
            list(read(b"none of these" * 10))


def test_programs(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, i int, text string")
    got = {r.k: r.output for r in programs.apply_program(rows, ["cat"], key="k", order="i").collect()}
    assert got == {"a": "y\nx\n", "b": "z\n"}
    out, files = programs.run_program(["cp", "in.txt", "out.txt"], {"in.txt": "hello"}, outputs=["out.txt"])
    assert (out, files) == ("", {"out.txt": "hello"})
    for bad in (["no-such-program"], ["false"], ["sleep", "5"]):
        with pytest.raises(programs.ProgramError):
            programs.run_program(bad, {}, timeout=0.5)


def test_sequences_of_residues(spark):
    rows = [("s", i, n) for i, n in enumerate(["MET", "ALA", "UNK", "FOO", "MSE"])] + [("n", 0, "DA"), ("n", 1, "U"), ("n", 2, "G")]
    t_ = spark.createDataFrame(rows, "s string, segment int, res_name string")
    names = spark.createDataFrame([("MSE", "M")], "res_name string, letter string")
    assert {r.s: r.seq for r in residues.to_sequence(t_, ["s"], names=names).collect()} == {"s": "MAXXM", "n": "ATG"}
    atoms = spark.createDataFrame([("s", 0, "CA", 5), ("s", 0, "CA", 7), ("s", 1, "N", 9)], "s string, segment int, atom_name string, atom_idx int")
    assert sorted((r.segment, r.CA, r.N) for r in residues.atom_by_name(atoms, ["CA", "N"], ["s"]).collect()) == [(0, 7, -1), (1, -1, 9)]


def test_rings_and_cations(spark):
    six, five = [(i, (i + 1) % 6) for i in range(6)], [(4, 10), (10, 11), (11, 12), (12, 5)]
    bonds = spark.createDataFrame([("m", a, b, 9) for a, b in six + five] + [("m", 0, 20, 1)], "structure_id string, atom1 int, atom2 int, bond_type int")
    rings = residues.aromatic_rings(bonds)
    assert sorted(r.atoms for r in rings.collect()) == [[0, 1, 2, 3, 4, 5], [4, 5, 10, 11, 12]]
    xyz = [("m", i, 1.4 * math.cos(i * math.pi / 3), 1.4 * math.sin(i * math.pi / 3), 1.0) for i in range(6)]
    atoms = spark.createDataFrame(xyz, "structure_id string, atom_idx int, x double, y double, z double")
    planes = residues.ring_planes(rings.where(F.size("atoms") == 6), atoms)
    p = planes.first()
    assert (abs(p.nz), p.z) == (pytest.approx(1), pytest.approx(1))
    cations = spark.createDataFrame([("m", 30, 0.3, 0.0, 4.5), ("m", 31, 4.0, 0.0, 1.5), ("m", 32, 0.0, 0.0, 9.0)], "structure_id string, atom_idx int, x double, y double, z double")
    assert [r.atom_idx for r in residues.pi_cation(planes, cations).collect()] == [30]
