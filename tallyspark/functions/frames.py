"""Columns that the optimiser leaves whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sealed(df: DataFrame, kept: list[str], made: dict[str, Column]) -> DataFrame:
    """The columns kept of df, and those made of it, evaluated once for each row whatever is done with them.

    Through a plain projection the optimiser pushes a filter down, and writes out the whole expression for each mention of its
    column there, of what that is made of again, and so on. A generator stops it: the made columns are the one element of an array."""
    whole = F.struct(*[c.alias(name) for name, c in made.items()])
    return df.select(*kept, F.explode(F.array(whole)).alias("_made")).select(*kept, *[F.col("_made")[name].alias(name) for name in made])
