"""Star clustering of a similarity graph, in rounds over tables.

In order of rank, a vertex that no centre has taken becomes a centre and takes its neighbours. A
vertex can be decided as soon as all its higher neighbours are: it is a satellite if one of them is
a centre, else a centre. So all vertices are decided in as many rounds as the longest chain of
falling ranks, which is short where ranks vary, and no cluster is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.storage import materialize


def star_clusters(edges: DataFrame) -> DataFrame:
    """(vertex, centre) for the vertices of ``edges`` (a, b, n_a, n_b); each edge once, in either direction.

    Vertices rank by weight (n_a, n_b), then by number of neighbours, then by themselves, larger
    first. A satellite goes to its highest centre.
    """
    edges = materialize(edges.select("a", "b", "n_a", "n_b").distinct(), "star-pairs")
    ends = edges.select(F.col("a").alias("v"), F.col("n_a").alias("n")).unionAll(edges.select("b", "n_b"))
    ranks = ends.groupBy("v").agg(F.struct(F.max("n").alias("n"), F.count("*").alias("neighbours"), F.first("v").alias("itself")).alias("rank"))
    ranked = (
        edges.join(ranks.select(F.col("v").alias("a"), F.col("rank").alias("rank_a")), "a")
        .join(ranks.select(F.col("v").alias("b"), F.col("rank").alias("rank_b")), "b")
    )
    up = ranked.select(
        F.when(F.col("rank_a") < F.col("rank_b"), F.col("a")).otherwise(F.col("b")).alias("low"),
        F.when(F.col("rank_a") < F.col("rank_b"), F.col("b")).otherwise(F.col("a")).alias("high"),
        F.greatest("rank_a", "rank_b").alias("rank"),
    )
    up = materialize(up, "star-edges")
    vertices = up.select(F.col("low").alias("v")).unionAll(up.select("high")).distinct()
    below = up.select(F.col("low").alias("v")).distinct().withColumn("waits", F.lit(True))
    # those with no higher neighbour are centres at once
    state = vertices.join(below, "v", "left").select(
        "v", F.when(F.col("waits"), "open").otherwise("centre").alias("state"), F.lit(None).cast("string").alias("centre")
    )
    state = materialize(state, "star-state")
    while not state.where("state = 'open'").isEmpty():
        seen = (
            up.join(state.where("state = 'open'").select(F.col("v").alias("low")), "low", "left_semi")
            .join(state.select(F.col("v").alias("high"), "state"), "high")
            .groupBy("low")
            .agg(
                F.max_by(
                    F.when(F.col("state") == "centre", F.col("high").cast("string")),
                    F.when(F.col("state") == "centre", F.col("rank")),
                ).alias("to"),
                F.max(F.col("state") == "open").alias("waits"),
                # a centre above all open neighbours decides at once
                F.max(F.when(F.col("state") == "open", F.col("rank"))).alias("open_rank"),
                F.max(F.when(F.col("state") == "centre", F.col("rank"))).alias("centre_rank"),
            )
        )
        decided = (
            F.when(F.col("state") != "open", F.col("state"))
            .when(F.col("to").isNotNull() & (F.col("open_rank").isNull() | (F.col("centre_rank") > F.col("open_rank"))), "satellite")
            .when(~F.col("waits"), "centre")
            .otherwise("open")
        )
        state = materialize(
            state.join(seen, state.v == seen.low, "left")
            .withColumn("now", decided)
            .select("v", F.col("now").alias("state"), F.when((F.col("now") == "satellite") & (F.col("state") == "open"), F.col("to")).otherwise(F.col("centre")).alias("centre")),
            "star-state",
        )
    return state.select(F.col("v").alias("vertex"), F.coalesce("centre", F.col("v").cast("string")).alias("centre"))
