"""Connected components of a graph that no task holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links ``a``-``b`` lead to, for every id that has a link.

    Each round a node takes the smallest label among itself and its neighbours, and then the label
    of that label, so chains shrink by half; it ends when no label changes.
    """
    rows = 2 * edges.count()
    both = edges.selectExpr("a AS src", "b AS dst").unionByName(edges.selectExpr("b AS src", "a AS dst"))
    both = cut_lineage(both.filter("src <> dst").distinct(), rows)
    if both.isEmpty():
        return both.selectExpr("src AS id", "dst AS component")
    labels = cut_lineage(both.groupBy("src").agg(F.min("dst").alias("m")).selectExpr("src AS id", "least(src, m) AS component"), rows)
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("component").alias("m"))
        step = labels.join(near.withColumnRenamed("src", "id"), "id").selectExpr("id", "component AS old", "least(component, m) AS mid")
        jump = labels.selectExpr("id AS mid", "component AS up")
        new = cut_lineage(step.join(jump, "mid").selectExpr("id", "old", "least(mid, up) AS component"), rows)
        moved = new.filter("component <> old").limit(1).count()
        labels = new.select("id", "component")
        if not moved:
            return labels
