"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlelake.llm.shared import keep


def _moves(edges: DataFrame, number: int) -> DataFrame:
    """Where each node (u) goes over to (to): the first of itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if number % 3 < 2:
        return both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
    placed = lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("at"), F.col(c).alias("n"))
    return both.groupBy("u").agg(F.min(placed("v")).alias("v")).select("u", F.least("v", placed("u"))["n"].alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """Columns (node, label) for every node of the edges (a, b); the label is one of the nodes of its component.

    In each round every node goes over to the first of itself and its neighbours, by number in two rounds of three and by
    hash in the third, and edges are renamed. Stars around their least node vanish in one round; where the numbers run
    against a graph (a path in order), rounds by hash still take a part of its nodes, so rounds grow with the logarithm
    of the nodes. One table is written a round, whether it is empty is the stop test; no neighbourhood is gathered.
    """
    rounds = [keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())]
    while not rounds[-1].isEmpty():
        moves = _moves(rounds[-1], len(rounds) - 1)
        a, b = (moves.select(F.col("u").alias(n), F.col("to").alias(f"to_{n}")) for n in "ab")
        renamed = rounds[-1].join(a, "a").join(b, "b").filter("to_a <> to_b")
        rounds.append(keep(renamed.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct()))
    out = _moves(rounds[0], 0).select(F.col("u").alias("node"), F.col("to").alias("label"))
    for number, left in enumerate(rounds[1:-1], 1):
        move = _moves(left, number).withColumnRenamed("u", "label")
        out = out.join(move, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return out if len(rounds) < 3 else keep(out)
