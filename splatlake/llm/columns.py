"""Names of other columns that can't clash with those that an operator works with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], dict[str, str]]:
    """The table with all columns but those used under other names, a function that gives the table its columns back, and the names."""
    safe = {c: c if c in used else f"other_{i}" for i, c in enumerate(docs.columns)}

    def restored(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(s).alias(c) for c, s in safe.items()])

    return docs.toDF(*safe.values()), restored, safe


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column has it."""
    while name in docs.columns:
        name += "_"
    return name
