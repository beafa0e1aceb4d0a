"""Connected components of an edge table, with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import heavy_join, heavy_keys, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge table (a, b): the component is its smallest node.

    Each round hooks every edge's two labels and the labels' own labels to the smaller one and then halves the
    label paths, so the number of rounds is about the logarithm of the longest path. All steps are joins
    and minimum aggregations, which combine before they shuffle; nodes with a large part of all edges, and components with
    a large part of all nodes, are joined by broadcast; nothing is gathered to the driver but counts.
    Null ends and loops join nothing; a node with only loops is its own component.
    """
    kind = edges.schema["a"].dataType
    ends = edges.where("a is not null and b is not null").select("a", "b")
    links = staged(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    # each node with its edges on either side and the smallest of itself and its neighbours, where the first round leads
    own = ends.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("component"), F.lit(0).alias("na"), F.lit(0).alias("nb"))
    sides = F.array(*(F.struct(F.col(x).alias("node"), F.col("a").alias("component"), F.lit(na).alias("na"), F.lit(nb).alias("nb")) for x, na, nb in (("a", 1, 0), ("b", 0, 1))))
    every = own.unionByName(links.select(F.explode(sides).alias("e")).select("e.*"))
    hooked = staged(every.groupBy("node").agg(F.min("component").alias("component"), F.sum("na").alias("na"), F.sum("nb").alias("nb")), "hooked")
    total = links.count()
    hubs = {x: heavy_keys(hooked, "node", f"n{x}", total) for x in "ab"}
    while True:
        sizes = hooked.groupBy("component").agg(F.count("*").alias("n"))
        jump = staged(sizes.join(hooked.select(F.col("node").alias("component"), F.col("component").alias("root")), "component"), "jump")
        labels = staged(heavy_join(hooked, jump, "component").select("node", F.least("component", "root").alias("component"), "na", "nb"), "labels")
        left = labels.where("na > 0").select(F.col("node").alias("a"), F.col("component").alias("la"))
        right = labels.where("nb > 0").select(F.col("node").alias("b"), F.col("component").alias("lb"))
        both = heavy_join(heavy_join(links, left, "a", keys=hubs["a"]), right, "b", keys=hubs["b"])
        apart = staged(both.where("la <> lb"), "apart")
        if apart.isEmpty():
            return labels.select("node", "component")
        low = F.least("la", "lb").cast(kind)
        none = F.lit(None).cast("long")
        better = (
            apart.select(F.explode(F.array("a", "b", "la", "lb")).alias("node"), low.alias("component"), none.alias("na"), none.alias("nb"))
            .unionByName(labels)
            .groupBy("node")
            .agg(F.min("component").alias("component"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        )
        hooked = staged(better, "hooked")
