"""Structure files: one file is one structure; parsers are kernels, files are read side by side.

Every reader gives atom rows: structure_id, model, atom_idx, chain_id, res_id, ins_code, res_name, hetero,
atom_name, element, x, y, z, b_factor, occupancy, charge, altloc_id, atom_id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources import bcif, cif

COLUMNS = ["structure_id", "model", "atom_idx", "chain_id", "res_id", "ins_code", "res_name", "hetero", "atom_name", "element", "x", "y", "z", "b_factor", "occupancy", "charge", "altloc_id", "atom_id"]
ATOMS = (
    "structure_id string, model int, atom_idx int, chain_id string, res_id int, ins_code string, res_name string, hetero boolean, atom_name string, element string, "
    "x double, y double, z double, b_factor double, occupancy double, charge int, altloc_id string, atom_id int"
)
BONDS = "structure_id string, atom1 int, atom2 int, bond_type int"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# PDB ------------------------------------------------------------------------------------


def hybrid36_decode(text: str) -> int:
    """Numbers of a fixed width that go on in base 36, upper case first, then lower case."""
    text = text.strip()
    if not text or text[0].isdigit() or text[0] == "-":
        return int(text)
    n, lower = len(text), text[0].islower()
    return int(text, 36) - 10 * 36 ** (n - 1) + 10**n + (26 * 36 ** (n - 1) if lower else 0)


def hybrid36_encode(number: int, width: int) -> str:
    if -(10 ** (width - 1)) < number < 10**width:
        return str(number)
    number -= 10**width
    lower = number >= 26 * 36 ** (width - 1)
    number = number - 26 * 36 ** (width - 1) * lower + 10 * 36 ** (width - 1)
    out = ""
    while number:
        number, d = divmod(number, 36)
        out = _DIGITS[d] + out
    if len(out) != width:
        raise ValueError("number too large for its field")
    return out.lower() if lower else out


def _charge(text: str) -> int:
    found = re.fullmatch(r"(\d)([+-])|([+-])(\d)", text.strip())
    return 0 if not found else int((found[2] or found[3]) + (found[1] or found[4]))


def parse_pdb(text: str) -> Iterator[tuple]:
    """(model, atom_idx, …) of ATOM and HETATM lines; a line under 80 columns is an error."""
    model, index = 1, 0
    for line in text.splitlines():
        if line.startswith("MODEL "):
            model, index = int(line[10:]), 0
        elif line.startswith(("ATOM  ", "HETATM")):
            if len(line) < 80:
                raise ValueError("atom line under 80 columns")
            yield (
                model, index, line[21].strip(), hybrid36_decode(line[22:26]), line[26].strip(), line[17:20].strip(), not line.startswith("ATOM"), line[12:16].strip(), line[76:78].strip(),
                float(line[30:38]), float(line[38:46]), float(line[46:54]), float(line[60:66].strip() or "nan"), float(line[54:60].strip() or "nan"), _charge(line[78:80]), line[16].strip(), hybrid36_decode(line[6:11]),
            )
            index += 1


def parse_pdb_bonds(text: str) -> list[tuple[int, int]]:
    """Pairs of atom indices from CONECT lines."""
    index, pairs = {}, set()
    for line in text.splitlines():
        if line.startswith("ENDMDL"):
            break
        if line.startswith(("ATOM  ", "HETATM")):
            index.setdefault(hybrid36_decode(line[6:11]), len(index))
    for line in text.splitlines():
        if line.startswith("CONECT"):
            ids = [hybrid36_decode(line[i : i + 5]) for i in range(6, len(line.rstrip()), 5) if line[i : i + 5].strip()]
            for other in ids[1:]:
                if ids[0] in index and other in index:
                    pairs.add(tuple(sorted((index[ids[0]], index[other]))))
    return sorted(pairs)


def parse_pdb_cell(text: str) -> tuple[float, ...] | None:
    """(a, b, c, alpha, beta, gamma) of CRYST1, angles in degrees."""
    for line in text.splitlines():
        if line.startswith("CRYST1"):
            return tuple(float(line[a:b]) for a, b in ((6, 15), (15, 24), (24, 33), (33, 40), (40, 47), (47, 54)))
    return None


def parse_pdb_remark(text: str, number: int) -> list[str] | None:
    """The lines of one REMARK, without its first, blank line."""
    lines = [x[11:].rstrip() for x in text.splitlines() if re.match(rf"REMARK {number:>3}\b", x)]
    return lines[1:] or None


def parse_pdb_assemblies(text: str) -> dict[str, list[tuple[list[str], np.ndarray]]]:
    """Assembly id to (chains, 3x4 operation) rows, from REMARK 350."""
    out: dict = {}
    name, chains, rows = None, [], []
    for line in parse_pdb_remark(text, 350) or []:
        if line.startswith("BIOMOLECULE:"):
            name, chains = line.split(":")[1].strip(), []
        elif "CHAINS:" in line:
            if not line.strip().startswith("AND"):
                chains = []
            chains = chains + [c.strip() for c in line.split("CHAINS:")[1].split(",") if c.strip()]
        elif line.strip().startswith("BIOMT"):
            rows.append([float(x) for x in line.split()[2:6]])
            if len(rows) == 3:
                out.setdefault(name, []).append((list(chains), np.array(rows)))
                rows = []
    return out


def pdb_line(row: dict) -> str:
    """One ATOM or HETATM line of a row."""
    name = row["atom_name"]
    name = name.ljust(4) if len(name) > 3 or len(row["element"]) > 1 else " " + name.ljust(3)
    charge = row.get("charge") or 0
    charge = f"{abs(charge)}{'+' if charge > 0 else '-'}" if charge else "  "
    number = lambda v, w, d: f"{0.0 if v is None or v != v else v:>{w}.{d}f}"
    occupancy = row.get("occupancy")
    return (
        f"{'HETATM' if row['hetero'] else 'ATOM  '}{hybrid36_encode(row.get('atom_id') or row['atom_idx'] + 1, 5):>5} {name}{row.get('altloc_id') or ' ':1}{row['res_name']:>3} {row['chain_id'] or ' ':1}"
        f"{hybrid36_encode(row['res_id'], 4):>4}{row['ins_code'] or ' ':1}   {row['x']:>8.3f}{row['y']:>8.3f}{row['z']:>8.3f}{number(1.0 if occupancy is None else occupancy, 6, 2)}{number(row.get('b_factor'), 6, 2)}"
        f"          {row['element']:>2}{charge}"
    )


def pdb_text(rows: list[dict]) -> str:
    """A PDB file of atom rows in order; MODEL records if there is more than one model."""
    models: dict[int, list[str]] = {}
    for r in rows:
        models.setdefault(r["model"], []).append(pdb_line(r))
    if len(models) == 1:
        return "\n".join(next(iter(models.values())))
    return "\n".join("\n".join([f"MODEL     {m:>4}", *lines, "ENDMDL"]) for m, lines in sorted(models.items()))


# GRO ------------------------------------------------------------------------------------


def parse_gro(text: str) -> Iterator[tuple]:
    """Frames in nanometres as models in angstrom."""
    lines, at, model = text.splitlines(), 0, 1
    while at + 1 < len(lines) and lines[at + 1].strip():
        n = int(lines[at + 1])
        for i, line in enumerate(lines[at + 2 : at + 2 + n]):
            width = line.index(".", line.index(".", 20) + 1) - line.index(".", 20)
            x, y, z = (float(line[20 + k * width : 20 + (k + 1) * width]) * 10 for k in range(3))
            name = line[10:15].strip()
            yield model, i, "", int(line[:5]), "", line[5:10].strip(), False, name, re.sub("[^A-Za-z]", "", name)[:1].upper(), x, y, z, None, None, 0, "", int(line[15:20])
        at, model = at + 3 + n, model + 1


def gro_text(rows: list[dict], box: tuple[float, float, float] = (0, 0, 0), title: str = "structure") -> str:
    out = [title, f"{len(rows):>5}"]
    for r in rows:
        out.append(f"{r['res_id'] % 100000:>5}{r['res_name']:<5}{r['atom_name']:>5}{(r['atom_idx'] + 1) % 100000:>5}" + "".join(f"{r[c] / 10:>8.3f}" for c in "xyz"))
    return "\n".join([*out, "".join(f"{v / 10:>10.5f}" for v in box)])


# MOL and SDF ------------------------------------------------------------------------------

_MOL_CHARGES = {0: 0, 1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}
_MOL_BONDS = {1: 1, 2: 2, 3: 3, 4: 9, 5: 0, 6: 5, 7: 6, 8: 0}


def parse_mol(text: str) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """Atoms and (atom1, atom2, type) bonds of a connection table, V2000 or V3000."""
    lines = text.split("\n")
    counts = lines[3]
    atoms, bonds = [], []
    row = lambda i, element, x, y, z, charge: (1, i, "", 0, "", "", True, element, element.upper(), x, y, z, None, None, charge, "", i + 1)
    if "V3000" in counts:
        body = re.sub(r"-\nM  V30 ", "", text)
        part = lambda name: re.search(rf"M  V30 BEGIN {name}\n(.*?)M  V30 END {name}", body, re.S)
        number = {}
        for i, line in enumerate(part("ATOM")[1].strip().split("\n")):
            cells = line[7:].split()
            charge = next((int(c[4:]) for c in cells[6:] if c.startswith("CHG=")), 0)
            number[cells[0]] = i
            atoms.append(row(i, cells[1], *map(float, cells[2:5]), charge))
        if part("BOND"):
            for line in part("BOND")[1].strip().split("\n"):
                _, kind, a, b = line[7:].split()[:4]
                bonds.append((number[a], number[b], _MOL_BONDS.get(int(kind), 0)))
        return atoms, bonds
    n, m = int(counts[:3]), int(counts[3:6])
    charges = {}
    for line in lines[4 + n + m :]:
        if line.startswith("M  CHG"):
            cells = line.split()[3:]
            charges |= {int(a) - 1: int(c) for a, c in zip(cells[::2], cells[1::2], strict=True)}
    for i, line in enumerate(lines[4 : 4 + n]):
        charge = charges.get(i, 0) if charges else _MOL_CHARGES.get(int(line[36:39] or 0), 0)
        atoms.append(row(i, line[31:34].strip(), float(line[:10]), float(line[10:20]), float(line[20:30]), charge))
    for line in lines[4 + n : 4 + n + m]:
        bonds.append((int(line[:3]) - 1, int(line[3:6]) - 1, _MOL_BONDS.get(int(line[6:9]), 0)))
    return atoms, bonds


def parse_sdf(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(name, connection table, metadata) of the records."""
    for record in re.split(r"(?m)^\$\$\$\$.*\n?", text):
        if record.strip():
            table, _, rest = record.partition("M  END")
            meta = {k: v.rstrip("\n") for k, v in re.findall(r"(?m)^>.*?<([^>\n]+)>.*\n((?:.+\n?)*)", rest)}
            yield record.split("\n", 1)[0].strip(), table + "M  END", meta


def mol_text(name: str, atoms: list[dict], bonds: list[tuple[int, int, int]], meta: dict[str, str] | None = None) -> str:
    """A V2000 record; with metadata an SDF record."""
    code = {v: k for k, v in reversed(_MOL_BONDS.items())}
    out = [name, "", "", f"{len(atoms):>3}{len(bonds):>3}  0  0  0  0  0  0  0  0  1 V2000"]
    out += [f"{a['x']:>10.4f}{a['y']:>10.4f}{a['z']:>10.4f} {a['element'].capitalize():<3} 0  0  0  0  0  0  0  0  0  0  0  0" for a in atoms]
    out += [f"{a + 1:>3}{b + 1:>3}{code.get(t, 8):>3}  0  0  0  0" for a, b, t in bonds]
    charged = [(i + 1, a["charge"]) for i, a in enumerate(atoms) if a.get("charge")]
    for at in range(0, len(charged), 8):
        some = charged[at : at + 8]
        out.append(f"M  CHG{len(some):>3}" + "".join(f"{i:>4}{c:>4}" for i, c in some))
    out.append("M  END")
    if meta is not None:
        for k, v in meta.items():
            out += [f"> <{k}>", v, ""]
        out.append("$$$$")
    return "\n".join(out)


# mmCIF and BinaryCIF ------------------------------------------------------------------------


def atoms_of_category(site: dict[str, list], *, author: bool = True) -> list[tuple]:
    """Atom rows of an _atom_site category (columns of strings, None where masked)."""
    n = len(next(iter(site.values()), []))
    get = lambda *names: next((site[c] for c in names if c in site), [None] * n)
    pre = ("auth", "label") if author else ("label", "auth")
    chain, res, name, comp = (get(f"{pre[0]}_{c}", f"{pre[1]}_{c}") for c in ("asym_id", "seq_id", "atom_id", "comp_id"))
    number = lambda v: float("nan") if v is None else float(v)
    columns = [get(c) for c in ("group_PDB", "pdbx_PDB_ins_code", "type_symbol", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "occupancy", "pdbx_formal_charge", "label_alt_id", "id", "pdbx_PDB_model_num")]
    out, seen = [], {}
    for c, r, a, p, group, ins, element, x, y, z, b, q, charge, alt, id_, model in zip(chain, res, name, comp, *columns, strict=True):
        model = 1 if model is None else int(model)
        i = seen[model] = seen.get(model, -1) + 1
        out.append((model, i, c or "", -1 if r is None else int(r), ins or "", p or "", group == "HETATM", a or "", element or "", number(x), number(y), number(z), number(b), number(q), 0 if charge is None else int(float(charge)), alt or "", int(id_ or i + 1)))
    return out


def parse_cif_atoms(text: str) -> list[tuple]:
    blocks = cif.parse(text)
    block = next(iter(blocks.values()), {})
    return atoms_of_category({c: v for c, v in block.get("atom_site", {}).items()})


def parse_bcif_atoms(data: bytes) -> list[tuple]:
    block = next(iter(bcif.parse(data).values()), {})
    return atoms_of_category(block.get("atom_site", {}))


# Readers ----------------------------------------------------------------------------------

PARSERS: dict[str, Callable[[bytes], list[tuple]]] = {
    "pdb": lambda b: list(parse_pdb(b.decode())),
    "gro": lambda b: list(parse_gro(b.decode())),
    "cif": lambda b: parse_cif_atoms(b.decode()),
    "bcif": parse_bcif_atoms,
    "mol": lambda b: parse_mol(b.decode())[0],
}


def read_structures(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Atom rows of all files of a path; the kind is that of each file's suffix unless given."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in zip(part["path"], part["content"], strict=True):
                suffix = kind or p.rsplit(".", 1)[-1].lower()
                suffix = {"ent": "pdb", "mmcif": "cif", "sdf": "mol", "mol2": "mol"}.get(suffix, suffix)
                if suffix not in PARSERS:
                    raise ValueError(f"no parser for {p}")
                yield pd.DataFrame([(p, *r) for r in PARSERS[suffix](data)], columns=COLUMNS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ATOMS)


def read_bonds(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Bond rows of PDB (CONECT) or MOL/SDF files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in zip(part["path"], part["content"], strict=True):
                text = data.decode()
                rows = [(a, b, 0) for a, b in parse_pdb_bonds(text)] if kind == "pdb" else parse_mol(text)[1]
                yield pd.DataFrame([(p, *r) for r in rows], columns=["structure_id", "atom1", "atom2", "bond_type"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, BONDS)


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, name, table, metadata): one row a record; large files split between records."""
    rows = spark.read.option("lineSep", "$$$$\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("record"), "value")
    rows = rows.where(F.contains("value", F.lit("M  END")))

    @F.pandas_udf("name string, table string, metadata map<string,string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([next(parse_sdf(t)) for t in texts], columns=["name", "table", "metadata"])

    return rows.select("path", "record", run("value").alias("_r")).select("path", "record", "_r.*")


def write_structures(atoms: DataFrame, path: str, kind: str = "pdb") -> None:
    """One text row a structure, in order of model and atom, below ``path``: a file for each partition of structures."""
    make = {"pdb": pdb_text, "gro": gro_text, "cif": cif_text}[kind]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["model", "atom_idx"])
        return pd.DataFrame({"structure_id": rows["structure_id"].iloc[:1], "value": [make(rows.to_dict("records"))]})

    texts = atoms.groupBy("structure_id").applyInPandas(run, "structure_id string, value string")
    texts.select("value").write.option("maxRecordsPerFile", 1).text(path)


def cif_text(rows: list[dict], name: str = "structure") -> str:
    """An mmCIF block with one _atom_site category."""
    columns = {
        "group_PDB": ["HETATM" if r["hetero"] else "ATOM" for r in rows],
        "id": [r.get("atom_id") or i + 1 for i, r in enumerate(rows)],
        "type_symbol": [r["element"] for r in rows], "label_atom_id": [r["atom_name"] for r in rows], "label_alt_id": [r.get("altloc_id") or None for r in rows],
        "label_comp_id": [r["res_name"] for r in rows], "label_asym_id": [r["chain_id"] for r in rows], "label_seq_id": [r["res_id"] for r in rows], "pdbx_PDB_ins_code": [r["ins_code"] or None for r in rows],
        "Cartn_x": [f"{r['x']:.3f}" for r in rows], "Cartn_y": [f"{r['y']:.3f}" for r in rows], "Cartn_z": [f"{r['z']:.3f}" for r in rows],
        "occupancy": [r.get("occupancy") for r in rows], "B_iso_or_equiv": [r.get("b_factor") for r in rows], "pdbx_formal_charge": [r.get("charge") or None for r in rows],
        "auth_seq_id": [r["res_id"] for r in rows], "auth_comp_id": [r["res_name"] for r in rows], "auth_asym_id": [r["chain_id"] for r in rows], "auth_atom_id": [r["atom_name"] for r in rows],
        "pdbx_PDB_model_num": [r["model"] for r in rows],
    }
    return cif.text({name: {"atom_site": columns}})
