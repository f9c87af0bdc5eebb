"""Connected components of a link table, by minimum labels with pointer jumping. Nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of the links a, b. No links: no rows.

    Each round hooks every label to the least label next to it and then follows labels of labels, so chains shrink
    geometrically. A round's labels are written to the shared folder. Nodes with very many links are summed before
    the shuffle; joins on them are split by adaptive execution.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = saved(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    label = saved(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "label")
    while True:
        seen = both.join(label.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("seen"))
        hooks = (
            label.join(seen, "node")
            .select(F.explode(F.array(F.struct("node", "seen"), F.struct(F.col("label").alias("node"), "seen"))).alias("x"))
            .select("x.*")
            .groupBy("node")
            .agg(F.min("seen").alias("seen"))
        )
        hooked = saved(label.join(hooks, "node", "left").select("node", "label", F.least("label", "seen").alias("next")), "hooked")
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = saved(hooked.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "label")
        dropped(hooked)
        dropped(label)
        label = new.select("node", "label")
        label._tidelog_path = new._tidelog_path
        if not new.where("moved").limit(1).count():
            return label.select("node", F.col("label").alias("component"))
