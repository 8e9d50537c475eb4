"""Column references by name, whatever characters the name holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """The top-level column of that name; dots are part of the name."""
    return F.col(quote(name))
