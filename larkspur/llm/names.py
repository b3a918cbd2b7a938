"""Column names: outputs that replace columns whatever the case of their names, and inner columns that clash with none."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col(quoted(name))


def others(columns: Iterable[str], new: Iterable[str]) -> list[str]:
    """The columns without those that have one of the new names, in any case."""
    taken = {c.lower() for c in new}
    return [c for c in columns if c.lower() not in taken]


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
