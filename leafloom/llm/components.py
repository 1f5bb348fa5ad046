"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.session import discard, materialise


def _edges(df: DataFrame) -> DataFrame:
    return df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(a, b) -> (key, comp): comp is the least key of the component; keys without links do not occur.

    Each round lets every key point to its least neighbour if that is less
    than itself, follows two steps, and contracts the links: ends become what
    they point to, links inside go, and where two steps did not reach the end
    of a chain, the next step stays as a link. Few links survive a round, and
    none is the end. Least neighbours are combined before the shuffle, so a key
    with very many links is no obstacle. Rounds are written to the shared folder.
    """
    edges, total, turn, base = materialise(_edges(links), f"{label}-links"), None, 0, None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("key"), F.least("a", "low").alias("up")), f"{label}-up{turn}")
        step = lambda df, at, to: df.join(up.select(F.col("key").alias(at), F.col("up").alias(to)), at)
        # Whatever a key points to has links itself, so it is in the table.
        steps = step(step(up.select("key", F.col("up").alias("one")), "one", "two"), "two", "three")
        steps = materialise(steps.select("key", F.col("two").alias("comp"), F.col("three").alias("then")), f"{label}-{turn}")
        side = lambda c: steps.select(F.col("key").alias(c), F.col("comp").alias(f"c{c}"))
        moved = edges.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        before, edges = edges, materialise(_edges(moved.unionByName(steps.select(F.col("comp").alias("a"), F.col("then").alias("b")))), f"{label}-links")
        if total is None:
            total, base = steps.select("key", "comp"), steps
        else:
            further = steps.select(F.col("key").alias("comp"), F.col("comp").alias("to"))
            total = materialise(total.join(further, "comp", "left").select("key", F.coalesce("to", "comp").alias("comp")), f"{label}-keys")
            discard(base, steps)
            base = total
        turn += 1
        discard(before, up)
        if edges.isEmpty():
            discard(edges)
            return total


def grow(comp: DataFrame | None, links: DataFrame, label: str = "components") -> DataFrame:
    """Components after more links: those are contracted to the components there are before anything else."""
    if comp is None:
        return components(links, label)
    side = lambda c: comp.select(F.col("key").alias(c), F.col("comp").alias(f"c{c}"))
    moved = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(moved, label)
    old = comp.join(top.select(F.col("key").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("key", F.coalesce("to", "comp").alias("comp"))
    return materialise(old.unionByName(top.join(comp.select("key"), "key", "left_anti")), f"{label}-all")
