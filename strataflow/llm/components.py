"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a long, b long); nodes of one component, and no others, share a root.

    Each round every node moves to the one of least rank among itself and its neighbours, ranks being
    hashes that change with the round; edges follow their ends, and those whose ends meet vanish. That
    shrinks long chains by a constant share a round, so there are about log(nodes) rounds, each of a
    few shuffles of what is left. A node with very many neighbours is a partial minimum per task in
    the aggregation, and split by adaptive execution in the joins. Each round ends in the shared folder.
    """
    moves, left = [], edges.where("a != b").select("a", "b").distinct()
    while True:
        salt = F.lit(len(moves))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), salt).alias("h"), F.col(c).alias("n"))
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = cut(ends.groupBy("a").agg(F.min(rank("b")).alias("r")).select(F.col("a").alias("node"), F.least("r", rank("a"))["n"].alias("to")), "moves")
        a = move.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = move.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moves.append(move)
        left = cut(left.join(a, "a").join(b, "b").where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if left.isEmpty():
            break
    roots = moves.pop().select("node", F.col("to").alias("root"))
    while moves:
        later = roots.select(F.col("node").alias("to"), "root")
        roots = moves.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots
