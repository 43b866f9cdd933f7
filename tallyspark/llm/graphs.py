"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (id, component): for every id in a link the smallest id that links reach from it.

    In a round every id hooks on to its smallest neighbour, or stays, and then on to what that one hooked on to; links are
    carried over to these, and those within one go. So the links, of which a hub's meet in joins that Spark can split, are fewer
    from round to round. When none is left the rounds' hooks are followed one after the other: ids only ever move to smaller ones
    of their component, whose smallest never moves. Only one number a round reaches the driver."""
    onward = lambda hooks: hooks.select(F.col("id").alias("to"), F.col("to").alias("next"))
    edges = stored(links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = []
    while not rounds or edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("to")), "hooks")
        hooks = stored(hooks.join(onward(hooks), "to").select("id", F.col("next").alias("to")), "hooks")
        rounds.append(hooks)
        left, right = hooks.select(F.col("id").alias("a"), F.col("to").alias("x")), hooks.select(F.col("id").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").filter(F.col("x") != F.col("y"))
        edges = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    out = rounds[0]
    for hooks in rounds[1:]:
        out = out.join(onward(hooks), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    return out.select("id", F.col("to").alias("component"))
