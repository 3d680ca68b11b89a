"""Connected components of an edge table, by alternating large and small stars.

Each round is two joins on the smallest neighbour and a table in the shared folder, so nothing but two numbers comes
to the driver and a lost executor costs one round. A hub's many edges are ordinary rows of a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import discard, stored, stored_at

ROWS_PER_FILE = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the larger (or, in the small star, the smaller) neighbours of each node on its smallest one."""
    seen = edges.select("u", "v")
    if large:
        seen = seen.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = seen.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    back = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return back.where("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every node of edges (u, v); component is the smallest id reachable. Loops and repeats are fine."""
    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = now
    state = path = None
    for _ in range(rounds):
        files = now.count() // ROWS_PER_FILE + 1  # rounds have fewer and fewer edges: no swarm of tiny files
        old = path
        now, path = stored_at(_star(_star(now, True), False).coalesce(files), "edges")
        if old:
            discard(now.sparkSession, old)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == state:
            break
        state = mark
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.union(nodes.select(F.col("v").alias("id")).distinct().join(now.select(F.col("u").alias("id")), "id", "left_anti").select("id", F.col("id").alias("component")))
