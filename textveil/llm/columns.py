"""Names of temporary columns that a table doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underlines in front as it takes to differ from df's columns."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out
