"""Connected components by contraction.

Nodes are ranked by a hash of their ids. In a round, every node points to its neighbour of least rank (or to itself), then to
what that one points to, and edges are carried over to these; edges inside one image go. In a star all leaves meet after two
rounds, and of a chain, whatever the order of its ids, about a third of the nodes are left by each round, so rounds grow with
the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.storage import materialise


def contractions(edges: DataFrame, a: str = "a", b: str = "b") -> list[DataFrame]:
    """(node, root) of the nodes that each round still has; a round's roots are the next one's nodes, or have no edge any more."""
    live = materialise(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "cc-edges")
    steps: list[DataFrame] = []
    ranked = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("id"))
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b"), F.col("a")))
        one = both.groupBy(F.col("a").alias("node")).agg(F.min(ranked("b")).alias("low"))
        one = one.select("node", F.least(ranked("node"), "low")["id"].alias("root"))
        two = one.select(F.col("node").alias("root"), F.col("root").alias("above"))
        steps.append(materialise(one.join(two, "root").select("node", F.col("above").alias("root")), "cc-step"))
        for end in ("a", "b"):
            live = live.join(steps[-1].select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end)
        live = materialise(live.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "cc-edges")
    return steps


def components(edges: DataFrame, a: str = "a", b: str = "b", least: bool = True) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component, or any one of it without ``least``.

    Self loops and null ends are ignored, repeated edges count once, no edges give no rows. Nothing is collected. Joins on a
    component's root are between written tables, so that adaptive execution can split a root that most nodes share.
    """
    steps = contractions(edges, a, b)
    if not steps:
        return edges.select(F.col(a).alias("node"), F.col(b).alias("root")).where("false")
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    if len(steps) == 1 and not least:
        return out
    out = materialise(out, "cc-roots")
    if not least:
        return out
    low = materialise(out.groupBy("root").agg(F.min("node").alias("low")), "cc-least")
    return out.join(low, "root").select("node", F.col("low").alias("root"))
