"""Names of columns that operators add, kept apart from those that a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names with as many underscores in front as make them unlike all of the table's, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns of these names, in any case of letters."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))
