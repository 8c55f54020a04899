"""GenBank and GenPept: records are rows; fields are cut by expressions, feature tables by a parser."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.annotations import BETWEEN, BEYOND_LEFT, BEYOND_RIGHT, FORWARD, REVERSE, UNK_LOC


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(path, record): one row a record; files split between records."""
    rows = spark.read.option("lineSep", "\n//").text(path)
    return rows.where(F.contains("value", F.lit("LOCUS"))).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^\n+", "").alias("record"))


def field(record: Column, name: str) -> Column:
    """A field's content, its lines joined by newlines; null without the field."""
    body = F.regexp_extract(record, rf"(?m)^{name}\b[ ]*((?:.*)(?:\n[ ].*)*)", 1)
    return F.when(record.rlike(rf"(?m)^{name}\b"), F.trim(F.regexp_replace(body, r"\n[ ]{1,12}", "\n")))


def _flat(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*\n\s*", " ")


def locus(record: Column) -> Column:
    """Struct (name, length, mol_type, is_circular, division, date)."""
    line = F.regexp_extract(record, r"(?m)^LOCUS\s+(.*)$", 1)
    pattern = r"^(\S+)\s+(\d+) (?:bp|aa)\s+(?:(\S*[DR]NA\S*)\s+)?(?:(linear|circular)\s+)?(?:([A-Z]{3})\s+)?(\S+)?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    return F.struct(part(1).alias("name"), part(2).cast("long").alias("length"), part(3).alias("mol_type"), (part(4) == "circular").alias("is_circular"), part(5).alias("division"), part(6).alias("date"))


def definition(record: Column) -> Column:
    return _flat(field(record, "DEFINITION"))


def accession(record: Column) -> Column:
    return _flat(field(record, "ACCESSION"))


def version(record: Column) -> Column:
    return F.regexp_extract(field(record, "VERSION"), r"^(\S+)", 1)


def gi(record: Column) -> Column:
    return F.nullif(F.regexp_extract(field(record, "VERSION"), r"GI:(\d+)", 1), F.lit("")).cast("long")


def source(record: Column) -> Column:
    return F.regexp_extract(field(record, "SOURCE"), r"^(.*)", 1)


def db_link(record: Column) -> Column:
    """Map of database to identifier."""
    lines = F.filter(F.split(field(record, "DBLINK"), "\n"), lambda x: F.contains(x, F.lit(":")))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))


def raw_sequence(record: Column) -> Column:
    return F.regexp_replace(field(record, "ORIGIN"), r"[0-9\s]", "")


def sequence(record: Column) -> Column:
    """The sequence in upper case, U as T in nucleotides."""
    up = F.upper(raw_sequence(record))
    return F.when(F.length(F.translate(up, "ACGTURYWSMKHBVDN", "")) == 0, F.translate(up, "U", "T")).otherwise(up)


def parse_location(text: str) -> list[tuple[int, int, int, int]]:
    """(first, last, strand, defect) of a location expression."""
    text = text.strip()
    inner = re.fullmatch(r"(complement|join|order)\((.*)\)", text, re.S)
    if inner:
        parts, depth, at = [], 0, 0
        for i, c in enumerate(inner[2]):
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(inner[2][at:i])
                at = i + 1
        parts.append(inner[2][at:])
        out = [x for p in parts for x in parse_location(p)]
        return [(a, b, -s, d) for a, b, s, d in out] if inner[1] == "complement" else out
    simple = re.fullmatch(r"([<>]?)(\d+)(?:(\.\.|\.|\^)([<>]?)(\d+))?", text)
    if not simple:
        raise ValueError(f"unsupported location {text!r}")
    first, last = int(simple[2]), int(simple[5] or simple[2])
    defect = (BEYOND_LEFT if simple[1] == "<" else 0) | (BEYOND_RIGHT if ">" in (simple[1], simple[4] or "") else 0)
    defect |= {".": UNK_LOC, "^": BETWEEN}.get(simple[3] or "", 0)
    return [(first, last, FORWARD, defect)]


def parse_features(text: str) -> list[tuple[str, list, dict[str, str]]]:
    """(key, locations, qualifiers) of a FEATURES field; features at unsupported locations are skipped."""
    out, key, body = [], None, []

    def close():
        if key is None:
            return
        lines = [x.strip() for x in body]
        cut = next((i for i, x in enumerate(lines) if x.startswith("/")), len(lines))
        try:
            locs = parse_location("".join(lines[:cut]))
        except ValueError:
            return
        qual: dict[str, str] = {}
        name = None
        for x in lines[cut:]:
            found = re.match(r"/([^=\s]+)(?:=(.*))?$", x)
            if found and (name is None or not open_[0]):
                name, value = found[1], found[2]
                open_[0] = value is not None and value.startswith('"') and not (len(value) > 1 and value.endswith('"'))
                value = "" if value is None else value
                qual[name] = qual[name] + "\n" + value if name in qual else value
            else:
                qual[name] += ("" if name == "translation" else " ") + x
                open_[0] = open_[0] and not x.endswith('"')
        out.append((key, locs, {k: "\n".join(v.strip().strip('"') for v in val.split("\n")) for k, val in qual.items()}))

    open_ = [False]
    for line in text.split("\n")[1:]:
        if re.match(r"^ {5}\S", line):
            close()
            open_[0] = False
            key, _, rest = line.strip().partition(" ")
            body = [rest]
        elif line.startswith(" ") and key is not None:
            body.append(line)
    close()
    return out


FEATURES = "array<struct<key:string,locs:array<struct<first:long,last:long,strand:int,defect:int>>,qual:map<string,string>>>"


def annotation(records: DataFrame, record: str = "record") -> DataFrame:
    """(path, feature_id, key, locs, qual): each record's features."""

    @F.pandas_udf(FEATURES)
    def run(texts: pd.Series) -> pd.Series:
        names = ("first", "last", "strand", "defect")
        return pd.Series([[{"key": k, "locs": [dict(zip(names, x, strict=True)) for x in locs], "qual": q} for k, locs, q in parse_features(t)] for t in texts])

    text = F.regexp_extract(record, r"(?m)^(FEATURES.*(?:\n .*)*)", 1)
    return records.select("path", F.posexplode(run(text)).alias("feature_id", "_f")).select("path", "feature_id", "_f.*")


def location_text(locs: list[tuple[int, int, int, int]]) -> str:
    """The location expression of (first, last, strand, defect) rows."""

    def one(first, last, strand, defect):
        low, high = "<" if defect & BEYOND_LEFT else "", ">" if defect & BEYOND_RIGHT else ""
        link = "^" if defect & BETWEEN else "." if defect & UNK_LOC else ".."
        text = f"{low}{first}{link}{high}{last}" if first != last or defect & (BETWEEN | UNK_LOC) else f"{low}{high}{first}"
        return f"complement({text})" if strand == REVERSE else text

    parts = [one(*x) for x in locs]
    return parts[0] if len(parts) == 1 else f"join({','.join(parts)})"


def features_text(rows: list[tuple[str, list, dict[str, str]]]) -> str:
    """A FEATURES field."""
    out = ["FEATURES             Location/Qualifiers"]
    for key, locs, qual in rows:
        out.append("     " + key.ljust(16) + location_text(locs))
        for name, value in qual.items():
            for v in value.split("\n"):
                out.append(" " * 21 + (f'/{name}="{v}"' if v else f"/{name}"))
    return "\n".join(out)


def origin_text(seq: str, start: int = 1) -> str:
    """An ORIGIN field: lines of 60 symbols in groups of ten."""
    out = ["ORIGIN"]
    for at in range(0, len(seq), 60):
        row = seq[at : at + 60].lower()
        out.append(f"{at + start:>9} " + " ".join(row[i : i + 10] for i in range(0, len(row), 10)))
    return "\n".join(out)


def locus_text(name: str, length: int, mol_type: str | None = None, circular: bool = False, division: str | None = None, date: str | None = None) -> str:
    unit = "bp" if mol_type and "NA" in mol_type else "aa"
    shape = "circular" if circular else "linear"
    return f"LOCUS       {name:<16} {length:>11} {unit}    {mol_type or '':<7} {shape:<8} {division or '':<3} {date or ''}".rstrip()
