"""Connected components of an edge table, by least labels and pointer jumps.

Labels never leave the executors; each round is written to the shared folder, so
lineage stays short. A hub's edges are joined to a table with one row a node,
which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitline.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the nodes of ``edges`` (u, v): root is the least id that
    a node reaches."""
    both = materialize(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    # a node's first label is its least neighbour, or itself
    label = both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("root"))
    label = materialize(label, "labels")
    while True:
        near = (both.join(label.withColumnsRenamed({"id": "v", "root": "r"}), "v").groupBy("u").agg(F.min("r").alias("r")))
        new = label.join(near, label["id"] == near["u"]).select("id", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        new = materialize(new, "labels")
        hop = new.select(F.col("id").alias("root"), F.col("root").alias("to"))
        new = materialize(new.join(hop, "root").select("id", "was", F.col("to").alias("root")), "labels")
        if new.where("root <> was").isEmpty():
            return new.select("id", "root")
        label = new.select("id", "root")
