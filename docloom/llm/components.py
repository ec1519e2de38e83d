"""Connected components by label propagation with pointer doubling over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import materialize


def components(edges: DataFrame, nodes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, node, block): for each node of ``nodes`` (keys, node) the smallest node that ``edges`` (keys, a, b) connect it with; components of different keys are apart.

    Every round takes the smallest label among a node and its neighbours (aggregated map-side) and then the label's own
    label, so a chain of n nodes needs about log n rounds. A round's labels are written before the next reads them. No
    component meets in one task: messages are combined by node."""
    labels = materialize(nodes.select(*keys, "node", F.col("node").alias("block")), f"{name}-labels")
    forth, back = edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("other")), edges.select(*keys, F.col("b").alias("node"), F.col("a").alias("other"))
    both = materialize(forth.unionByName(back).distinct(), f"{name}-edges")
    if both.limit(1).count() == 0:
        return labels
    while True:
        near = both.join(labels.select(*keys, F.col("node").alias("other"), "block"), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("block").alias("least"))
        moved = labels.join(near, [*keys, "node"], "left").select(*keys, "node", F.col("block").alias("old"), F.least("block", "least").alias("block"))
        jump = moved.select(*keys, F.col("node").alias("block"), F.col("block").alias("further"))
        fresh = materialize(moved.join(jump, [*keys, "block"], "left").select(*keys, "node", "old", F.least("block", "further").alias("block")), f"{name}-labels")
        labels = fresh.select(*keys, "node", "block")
        if fresh.filter("block < old").limit(1).count() == 0:
            return labels
