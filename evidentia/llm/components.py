"""Connected components of links between ids, by contraction.

Each round every node points to the least of itself and its neighbours, pointers
are followed twice, and links are renamed to what their ends point to. Stars end
after two rounds, a chain of n links after about log n. Nothing is collected: each
round is written to the shared folder, which also cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (u, v); component is its least node.

    Nodes that only link to themselves are left out; null ends are ignored.
    """
    e = written(links.select("u", "v").where("u <> v").distinct(), "links")
    found = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("p")).select(F.col("u").alias("node"), F.least("u", "p").alias("p"))
        up = written(up, "pointers")
        for _ in range(2):
            far = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            up = up.join(far, "p", "left").select("node", F.coalesce("pp", "p").alias("p"))
        up = written(up, "pointers")
        if found is None:
            found = up.withColumnRenamed("p", "component")
        else:
            step = up.select(F.col("node").alias("component"), "p")
            found = written(found.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "components")
        a, b = up.select(F.col("node").alias("u"), F.col("p").alias("pu")), up.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        e = written(e.join(a, "u").join(b, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "links")
    return found if found is not None else e.select(F.col("u").alias("node"), F.col("v").alias("component"))
