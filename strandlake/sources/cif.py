"""CIF text: blocks of categories of columns. Values are strings; a masked value ('.' or '?') is None."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: A quoted word ends at its quote before white space; a comment runs to the line's end.
TOKEN = re.compile(r"""(?:^|(?<=\n));(?P<text>.*?)\n;|'(?P<one>.*?)'(?=\s|$)|"(?P<two>.*?)"(?=\s|$)|(?P<note>\#[^\n]*)|(?P<word>[^\s'"]\S*|['"]\S*)""", re.S)

Blocks = dict[str, dict[str, dict[str, list[str | None]]]]


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(token, quoted)."""
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            yield m["word"], False
        elif kind != "note":
            yield m[kind], True


def parse(text: str) -> Blocks:
    """Block to category to column to values."""
    out: Blocks = {}
    block: dict = {}
    stream = iter([*tokens(text), ("data_", False)])
    value = lambda token, quoted: None if not quoted and token in (".", "?") else token
    token, quoted = next(stream)
    while True:
        low = token.lower()
        if not quoted and low.startswith("data_"):
            name = token[5:]
            if not name:
                return out
            block = out[name] = {}
            token, quoted = next(stream)
        elif not quoted and low == "loop_":
            names = []
            token, quoted = next(stream)
            while not quoted and token.startswith("_"):
                names.append(token)
                token, quoted = next(stream)
            values = []
            while quoted or not (token.startswith("_") or token.lower() == "loop_" or token.lower().startswith(("data_", "save_"))):
                values.append(value(token, quoted))
                token, quoted = next(stream)
            if not names or len(values) % len(names):
                raise ValueError(f"a loop of {len(names)} columns has {len(values)} values")
            for i, n in enumerate(names):
                category, _, column = n[1:].partition(".")
                block.setdefault(category, {})[column] = values[i :: len(names)]
        elif not quoted and token.startswith("_"):
            category, _, column = token[1:].partition(".")
            content, was = next(stream)
            block.setdefault(category, {})[column] = [value(content, was)]
            token, quoted = next(stream)
        elif not quoted and low.startswith("save_"):
            token, quoted = next(stream)
        else:
            raise ValueError(f"unexpected {token!r}")


def _word(value) -> str:
    if value is None:
        return "?"
    value = str(value)
    if "\n" in value or "'" in value and '"' in value:
        return f"\n;{value}\n;"
    if value in ("", ".", "?") or re.search(r"\s", value) or value[0] in "_#$'\"[];" or re.match(r"(data_|loop_|save_|stop_|global_)", value, re.I):
        return f'"{value}"' if "'" in value else f"'{value}'"
    return f'"{value}"' if "'" in value else f"'{value}'" if '"' in value else value


def text(blocks: Blocks) -> str:
    """The text of blocks; a category of one row has a line for each column, others are loops."""
    out = []
    for name, categories in blocks.items():
        out.append(f"data_{name}")
        for category, columns in categories.items():
            out.append("#")
            n = len(next(iter(columns.values())))
            if n == 1:
                width = max(map(len, columns)) + len(category) + 5
                out += [f"_{category}.{c}".ljust(width) + _word(v[0]) for c, v in columns.items()]
            else:
                out += ["loop_", *[f"_{category}.{c}" for c in columns]]
                out += [" ".join(_word(columns[c][i]) for c in columns) for i in range(n)]
        out.append("#")
    return "\n".join(out) + "\n"


def read_cif(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    """(path, block, category, column, row, value): every value of the chosen categories, null where masked."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in zip(part["path"], part["content"], strict=True):
                rows = [
                    (p, b, c, k, i, v)
                    for b, cats in parse(data.decode()).items() for c, cols in cats.items() if categories is None or c in categories for k, vs in cols.items() for i, v in enumerate(vs)
                ]
                yield pd.DataFrame(rows, columns=["path", "block", "category", "column", "row", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, block string, category string, column string, row int, value string")


def category_frame(values: DataFrame, category: str, columns: list[str]) -> DataFrame:
    """One category as a table of its columns."""
    from pyspark.sql import functions as F

    rows = values.where(F.col("category") == category)
    return rows.groupBy("path", "block", "row").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])
