"""Connected components of an edge table: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable from each end of the edges (a, b).

    A round takes the least label among neighbours (partially aggregated, so a hub's edges meet as one
    row for each task), then the label of that label; rounds are logarithmic in a chain's length.
    Every round is written to the shared folder; nothing but a count reaches the driver."""
    both = materialize(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        low = label.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = label.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        new = materialize(low.join(jump, "comp", "left").select("id", "old", F.least("comp", "next").alias("comp")))
        label = new.select("id", "comp")
        if new.where("old <> comp").limit(1).count() == 0:
            return label
