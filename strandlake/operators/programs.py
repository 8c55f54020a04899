"""External programs on the executors: each group's text goes to a process, whose output is the group's row."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame


class ProgramError(RuntimeError):
    """A program is missing, ran too long, or ended with an error."""


def run_program(command: Sequence[str], files: dict[str, str], *, stdin: str = "", timeout: float = 600, outputs: Sequence[str] = ()) -> tuple[str, dict[str, str]]:
    """Standard output and chosen output files of a program that runs in a folder of its own."""
    if shutil.which(command[0]) is None:
        raise ProgramError(f"{command[0]} is not installed")
    with tempfile.TemporaryDirectory() as folder:
        for name, text in files.items():
            Path(folder, name).write_text(text)
        try:
            done = subprocess.run(list(command), cwd=folder, input=stdin, capture_output=True, text=True, timeout=timeout, check=False)
        except subprocess.TimeoutExpired as e:
            raise ProgramError(f"{command[0]} ran over {timeout} s") from e
        if done.returncode:
            raise ProgramError(f"{command[0]} ended with {done.returncode}: {done.stderr[-500:]}")
        return done.stdout, {name: Path(folder, name).read_text() for name in outputs}


def apply_program(rows: DataFrame, command: Sequence[str], *, key: str, text: str = "text", order: str | None = None, separator: str = "\n", timeout: float = 600) -> DataFrame:
    """(key, output): each group's texts, joined in order, are a program's standard input."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if order is not None:
            group = group.sort_values(order)
        out, _ = run_program(command, {}, stdin=separator.join(group[text]) + separator, timeout=timeout)
        return pd.DataFrame({key: group[key].iloc[:1].to_numpy(), "output": [out]})

    return rows.groupBy(key).applyInPandas(run, f"{key} {dict(rows.dtypes)[key]}, output string")
