"""Column lineage as an edge table, and traces through it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.transforms import TransformPlan
from tablewright.schemas import LINEAGE_SCHEMA
from tablewright.session import checkpoint_root


def lineage_edges(plan: TransformPlan, source: DataFrame, run_id: str, source_dataset: str = "source",
                  target_dataset: str = "output") -> DataFrame:
    """The plan's edges (``LINEAGE_SCHEMA``), from the declared inputs and outputs of its steps."""
    rows = [(run_id, source_dataset, s, target_dataset, t, label) for s, t, label in plan.edges(source)]
    return source.sparkSession.createDataFrame(rows, LINEAGE_SCHEMA)


def node(dataset: str, column: str):
    return F.concat_ws(".", dataset, column)


def column_edges(lineage: DataFrame) -> DataFrame:
    """``(source, target)`` of all runs, each edge once."""
    return lineage.select(node("source_dataset", "source_column").alias("source"),
                          node("target_dataset", "target_column").alias("target")).distinct()


def trace(edges: DataFrame, start: DataFrame, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """``(node, depth)`` of everything reachable from the ``node`` column of ``start``.

    Breadth first: one join per level against the edges, with the level
    checkpointed to the shared folder so plans do not grow and a lost executor
    costs one level.
    """
    spark = edges.sparkSession
    checkpoint_root(spark)
    near, far = ("source", "target") if direction == "down" else ("target", "source")
    links = edges.select(F.col(near).alias("node"), F.col(far).alias("_next"))
    frontier = start.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    reached, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = (
            frontier.select("node").join(links, "node").select(F.col("_next").alias("node")).distinct()
            .join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint())
        if level.isEmpty():
            break
        reached, frontier = reached.unionByName(level), level
    return reached
