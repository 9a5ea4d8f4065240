"""Clustering by level."""

import threading

import numpy as np
from pyspark.sql import functions as F

from clusterloom.plans import clustering as CL
from helpers import to_df


def test_levels_are_clustered_at_the_same_time(spark, monkeypatch):
    """Two levels whose algorithms wait for each other; rows and order of the levels as configured, others left out."""
    meet = threading.Barrier(2)

    def waits(df, params, group=None):
        meet.wait(timeout=60)
        return df.select("pos", F.lit(params["label"]).alias("label")), {}

    monkeypatch.setitem(CL._REGISTRY, "waits", waits)
    kinds = F.element_at(F.array(*map(F.lit, ("document", "event", "other"))), (F.col("pos") % 3 + 1).cast("int"))
    df = to_df(spark, np.random.default_rng(1).normal(size=(30, 3))).withColumn("embedding_type", kinds)
    out = CL.cluster_levels(df, {"document": ("waits", {"label": 4}), "event": ("waits", {"label": 5}),
                                 "storyline": ("kmeans", {"n_clusters": 2})})
    got = {(r["embedding_type"], r["algorithm"], r["label"]): r["count"]
           for r in out.groupBy("embedding_type", "algorithm", "label").count().collect()}
    assert got == {("document", "waits", 4): 10, ("event", "waits", 5): 10}
