"""Partitioned search with global statistics, and the choice of replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import shard_of
from ..plans.planner import PlanOptions
from .compiler import Compiler
from .index import IndexView
from .search import planned

MOST_SHARDS = 1024
HEALTH = {"healthy": 0, "suspect": 1, "unhealthy": 2, "draining": 3}


def routed(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` with their stable shard."""
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"between 1 and {MOST_SHARDS} shards")
    return docs.withColumn("shard", shard_of(F.col("doc_id"), shards))


def shard_top_k(index: IndexView, query, k: int, shards: int, options: PlanOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """(the k best of all (doc_id, score, shard), matches of each shard (shard, matches)).

    Scores use the statistics of the whole index, each shard gives its k best, and those are merged.
    """
    hits = routed(Compiler(index, planned(index, query, options)).hits(), shards)
    order = [F.desc("score"), F.asc("doc_id")]
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("shard").orderBy(*order))).where(F.col("r") <= k).drop("r")
    return best.orderBy(*order).limit(k), hits.groupBy("shard").agg(F.count("*").alias("matches"))


def read_replica(replicas: DataFrame, most_lag: int) -> DataFrame:
    """The replica to read from, of (node_id, health, lag, inflight): none if all are unfit."""
    rank = F.create_map(*(F.lit(x) for kv in HEALTH.items() for x in kv))[F.col("health")]
    fit = replicas.where(F.col("health").isin("healthy", "suspect") & (F.col("lag") <= most_lag))
    return fit.orderBy(rank, "lag", "inflight", "node_id").limit(1).select("node_id")
